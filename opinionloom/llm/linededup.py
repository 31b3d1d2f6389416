"""Lines found in many documents, dropped by probing a sharded minimal perfect hash."""

from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import as_bytes, mixed, small_batches, with_outputs

#: Distinct lines that one task counts before it hands its counts on.
HELD = 200_000


def line_key(line):
    """The line without white space at its ends, A-Z in lower case (bytes)."""
    return line.strip().lower()


def _digest(line, min_chars):
    """16 bytes for the line's key, or None if the key is too short to count."""
    key = line_key(line)
    if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _pairs(digests):
    """Digests as two columns of 64-bit numbers."""
    numbers = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(numbers[:, 0]), np.ascontiguousarray(numbers[:, 1])


def line_counts(docs, text="text", min_chars=1):
    """(hi, lo, n_docs): in how many documents each distinct line key occurs.

    Every task counts its own documents first, so a line that a third of them hold is sent on once
    for each task, and Spark combines these counts again before and after the shuffle.
    """

    def count(batches):
        seen = {}
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = {_digest(line, min_chars) for line in value.split(b"\n")}
                found.discard(None)
                for digest in found:
                    seen[digest] = seen.get(digest, 0) + 1
                if len(seen) >= HELD:
                    yield table(seen)
                    seen = {}
        if seen:
            yield table(seen)

    def table(seen):
        hi, lo = _pairs(seen)
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(list(seen.values()), pa.int64())], ["hi", "lo", "n"])

    counted = docs.select(as_bytes(text).alias("text")).mapInArrow(count, "hi long, lo long, n long")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"))


def _slots(hi, lo, level, size):
    with np.errstate(over="ignore"):
        return (mixed(hi.view(np.uint64) ^ mixed(lo.view(np.uint64) + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def build_shard(hi, lo, counts):
    """A minimal perfect hash over distinct keys, with their fingerprints and counts in its order.

    Level by level, keys that have a slot to themselves set its bit, and the others go on to the next
    level; a key's place is the number of bits set before its own.
    """
    sizes, bits, places, rest, before = [], [], np.empty(len(hi), np.int64), np.arange(len(hi)), 0
    while len(rest):
        size = -(-2 * len(rest) // 64) * 64
        slot = _slots(hi[rest], lo[rest], len(sizes), size)
        alone = np.bincount(slot, minlength=size)[slot] == 1
        level = np.zeros(size, bool)
        level[slot[alone]] = True
        places[rest[alone]] = before + np.cumsum(level)[slot[alone]] - 1
        before += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(level, bitorder="little"))
        rest = rest[~alone]
    marks, found = np.empty(len(hi), np.int64), np.empty(len(hi), np.uint32)
    marks[places], found[places] = lo, np.minimum(counts, 2**32 - 1)
    return sizes, b"".join(x.tobytes() for x in bits), marks.tobytes(), found.tobytes()


class Shard:
    """One shard, ready for probing."""

    def __init__(self, sizes, bits, marks, counts):
        self.sizes, self.bits = sizes, np.frombuffer(bits, "<u8")
        self.marks, self.counts = np.frombuffer(marks, np.int64), np.frombuffer(counts, np.uint32)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def counts_of(self, hi, lo):
        """The stored count of each key; 0 for a key that the shard does not hold."""
        out, rest, base = np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slots(hi[rest], lo[rest], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            place = self.before[at[hit] >> 6] + below
            out[rest[hit]] = np.where(self.marks[place] == lo[rest[hit]], self.counts[place], 0)
            rest, base = rest[~hit], base + size
        return out


def line_index(counts, shard_keys=50_000):
    """Shards of the index over the counted lines, one row each, and the number of shard bits.

    A shard holds about ``shard_keys`` keys, whatever their number, because keys are digests.
    """
    counts = kept(counts, "line-counts")
    bits = max(0, int(counts.count()) // shard_keys).bit_length()

    def build(table):
        hi, lo = (np.ascontiguousarray(table.column(x).to_numpy()) for x in ("hi", "lo"))
        sizes, *arrays = build_shard(hi, lo, table.column("n_docs").to_numpy())
        return pa.table(
            {"shard": table.column("shard")[:1], "sizes": pa.array([sizes], pa.list_(pa.int64()))}
            | {name: pa.array([x], pa.binary()) for name, x in zip(("bits", "marks", "counts"), arrays)}
        )

    shard = F.shiftrightunsigned("hi", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    shards = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(
        build, "shard long, sizes array<long>, bits binary, marks binary, counts binary"
    )
    return kept(shards, "line-index"), bits


def _probe(shards, bits, min_docs, min_chars):
    """An Arrow function: a text without the lines of these shards (null: none left), and how many went."""

    @F.arrow_udf("struct<text:string,dropped:long>")
    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = {row["shard"]: Shard(row["sizes"], row["bits"], row["marks"], row["counts"]) for row in shards.value}
        for batch in batches:
            texts = [None if x is None else x.split(b"\n") for x in batch.to_pylist()]
            digests = [_digest(line, min_chars) for lines in texts if lines is not None for line in lines]
            drop = np.zeros(len(digests), bool)
            counted = np.array([x is not None for x in digests], bool)
            hi, lo = _pairs([x for x in digests if x is not None])
            shard = hi.view(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(hi), np.uint64)
            gone = np.zeros(len(hi), bool)
            for number, part in index.items():
                own = np.flatnonzero(shard == number)
                gone[own] = part.counts_of(hi[own], lo[own]) >= min_docs
            drop[counted] = gone
            left, dropped, at = [], [], 0
            for lines in texts:
                if lines is None:
                    left.append(None)
                    dropped.append(0)
                    continue
                own, at = drop[at : at + len(lines)], at + len(lines)
                n = int(own.sum())
                stay = [line for line, out in zip(lines, own) if not out] if n else lines
                left.append(b"\n".join(stay) if stay else None)
                dropped.append(n)
            yield pa.StructArray.from_arrays(
                [pa.array(left, pa.binary()).cast(pa.string()), pa.array(dropped, pa.int64())], ["text", "dropped"]
            )

    return probe


def drop_common_lines(docs, text="text", min_docs=10, min_chars=1, sweep_bytes=64 << 20):
    """The documents without the lines that at least ``min_docs`` of them (rows) hold.

    A line's key is the line without white space at its ends, A-Z in lower case; keys of fewer than
    ``min_chars`` code points never count.  The lines that occur often enough are indexed by a sharded
    minimal perfect hash with a 64-bit fingerprint and a count for each; documents probe these arrays
    where they are, so neither lines nor texts are shuffled.  Shards are sent out in sweeps of at most
    ``sweep_bytes`` (or one shard); with more shards the documents, without the lines found so far,
    are written between two sweeps.

    Adds ``n_lines`` (before), ``n_dropped``; the text becomes the other lines joined by line feeds.  A
    null or empty text is one empty line, and a text that loses all its lines is empty.  Input columns
    called ``n_lines`` or ``n_dropped`` are replaced; repeated rows count as documents of their own.
    """
    spark = small_batches(docs).sparkSession
    counts = line_counts(docs, text, min_chars).where(F.col("n_docs") >= min_docs)
    shards, bits = line_index(counts)
    sizes = shards.select("shard", sum(F.octet_length(x) for x in ("bits", "marks", "counts")).alias("size"))
    sweeps, room = [], 0
    for row in sizes.orderBy("shard").toLocalIterator():
        if not sweeps or row["size"] > room:
            sweeps.append([])
            room = sweep_bytes
        sweeps[-1].append(row["shard"])
        room -= row["size"]
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.octet_length(value) - F.octet_length(F.replace(value, F.lit("\n"), F.lit(""))) + 1
    rows = with_outputs(docs, {text: value, "n_lines": lines.cast("long"), "n_dropped": F.lit(0).cast("long")})
    for number, sweep in enumerate(sweeps):
        rows = kept(rows, "line-sweep") if number else rows
        part = shards.where(F.col("shard").between(sweep[0], sweep[-1])).toArrow().to_pylist()
        probe = _probe(spark.sparkContext.broadcast(part), bits, min_docs, min_chars)
        rows = rows.withColumn("_probed", probe(F.col(text).cast("binary"))).withColumns(
            {text: F.col("_probed.text"), "n_dropped": F.col("n_dropped") + F.col("_probed.dropped")}
        ).drop("_probed")
    return rows.withColumn(text, F.coalesce(F.col(text), F.lit("")))

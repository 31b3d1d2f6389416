"""Near-duplicate documents: SimHash fingerprints linked by covering locality-sensitive hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import as_bytes, quoted, small_batches

#: Most members of a bucket that one task compares with each other; larger ones are split by more masks.
BUCKET = 4096


def _fingerprint(text, width):
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())])
    # Rows of one hash's bits; up to 255 rows are added eight counters at a time without a carry.
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):
        part = np.ascontiguousarray(bits[at : at + 255]).view(np.uint64)
        counts += part.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(bits)).tobytes(), "big")


def fingerprints(text, width=3):
    """A column with the SimHash of each text as a 64-bit number (two's complement).

    Words are runs without white space, A-Z in lower case.  A bit is set if over half of the hashes of the shingles of
    ``width`` words, repeats included, have it; a shorter text is one shingle, a null or empty one gives 0.
    """

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_fingerprint(x, width) for x in texts.to_pylist()], np.uint64).view(np.int64))

    return simhash(as_bytes(text))


def covering_masks(radius, fixed=0, bits=64):
    """Masks, as two's complement numbers, of which every pair within the radius agrees on one at least.

    Each bit not in ``fixed`` has a vector of radius + 1 binary places; mask v holds the bits whose vector has an odd
    product with v.  The vectors of up to ``radius`` differing bits leave some v that is orthogonal to
    all of them, so its mask avoids these bits.  All masks hold the bits in ``fixed`` too.
    """
    free = [b for b in range(bits) if not fixed >> b & 1]
    vector = {b: i % ((1 << radius + 1) - 1) + 1 for i, b in enumerate(free)}
    masks = []
    for v in range(1, 1 << radius + 1):
        mask = fixed | sum(1 << b for b in free if (vector[b] & v).bit_count() % 2)
        masks.append(mask)
    return masks


def _signed(number):
    return number - (1 << 64) if number >> 63 else number


def _bucketed(points, masks, radius, most):
    """Rows (mask, bucket, fp) of buckets with two to ``most`` members; larger ones go on to finer masks.

    A larger bucket is split by masks that cover the bits its own mask leaves free, which keeps every
    pair within the radius together in one of them.  Free bits run out after a few levels.
    """
    table = F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask")) for m in dict.fromkeys(masks)]))
    rows = points.select("fp", table.alias("m")).select("fp", "m.mask")
    level, found = 1, []
    while True:
        rows = rows.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "bucket").agg(F.count("*").alias("n"))
        large = kept(sizes.where(F.col("n") > most).select("mask", "bucket"), "simhash-large")
        if large.isEmpty():
            return [*found, rows]
        rows = kept(rows, f"simhash-level-{level}")
        found.append(rows.join(large, ["mask", "bucket"], "left_anti").select("fp", "mask", "bucket"))
        finer = {m["mask"]: covering_masks(radius, m["mask"] & (1 << 64) - 1) for m in large.select("mask").distinct().toLocalIterator()}
        finer = {m: [_signed(x) for x in new if _signed(x) != m] for m, new in finer.items()}
        if not all(finer.values()):
            return [*found, rows.join(large, ["mask", "bucket"], "left_semi").select("fp", "mask", "bucket")]
        to = points.sparkSession.createDataFrame([(m, sorted(set(new))) for m, new in finer.items()], "mask long, finer array<long>")
        split = rows.join(large, ["mask", "bucket"], "left_semi").join(F.broadcast(to), "mask")
        rows = split.select("fp", F.explode("finer").alias("mask")).distinct()
        level += 1


def _near(batches, radius):
    """Links inside of buckets, whose rows follow each other: of each group of close points to its first one."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        mask, bucket = rows.column("mask").to_numpy(), rows.column("bucket").to_numpy()
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        last = int(edges[-1]) if len(edges) else 0
        yield _links(rows.column("fp").to_numpy()[:last], edges, radius)
        rest = rows.slice(last)
    if rest is not None and len(rest):
        yield _links(rest.column("fp").to_numpy(), np.array([len(rest)]), radius)


def _links(points, edges, radius):
    points = np.ascontiguousarray(points).view(np.uint64)
    starts = np.concatenate([[0], edges[:-1]]) if len(edges) else np.empty(0, np.int64)
    sizes = edges - starts if len(edges) else starts
    a, b = [], []
    pair = starts[sizes == 2]
    close = pair[np.bitwise_count(points[pair] ^ points[pair + 1]) <= radius]
    a.append(points[close])
    b.append(points[close + 1])
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        own = points[start : start + size]
        while len(own) > 1:
            # All that can be reached from the first point; what has been reached is not looked at again.
            reached, at, own = [own[0]], 0, own[1:]
            while at < len(reached) and len(own):
                close = np.bitwise_count(own ^ reached[at]) <= radius
                reached.extend(own[close])
                own, at = own[~close], at + 1
            a.append(np.full(len(reached) - 1, reached[0]))
            b.append(np.array(reached[1:], np.uint64))
    a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def near_links(points, radius=3, most=BUCKET):
    """Pairs (a, b) of distinct fingerprints, a < b, that join all that are linked within the radius.

    Inside of a bucket only as many links are given as hold its members together, not all pairs.
    """
    links = None
    for rows in _bucketed(points, covering_masks(radius), radius, most):
        rows = rows.select("mask", "bucket", "fp").repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")
        found = rows.mapInArrow(lambda batches: _near(batches, radius), "a long, b long")
        links = found if links is None else links.union(found)
    return links.where("a < b").distinct()


def components(links):
    """(node, root) for the nodes of the links: the smallest node that each is joined with.

    Links turn towards smaller nodes in two alternating steps (every node's larger neighbours, then its smaller ones, go
    to its smallest), which takes a number of rounds that grows with the logarithm of the longest chain.  Each step keeps what
    is joined joined and makes the sum of the links' nodes smaller unless all are tied to their root, so the rounds end by themselves.
    """

    def turned(pairs, larger):
        """pairs (u, v): for every u the chosen neighbours v are tied to the smallest of them and u."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = pairs.join(least, "u")
        if larger:
            return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")

    links = kept(links.select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = turned(both, True).distinct()
        small = turned(big, False).distinct()
        links = kept(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs, text="text", key="doc_id", width=3, radius=3, most=BUCKET):
    """(key, text_hash, fp, n_near, component, root): one row for each document, with its group.

    ``fp`` is the fingerprint, ``component`` the smallest key reachable over links of at most ``radius`` differing
    bits (null where all keys are null), ``n_near`` the documents with the same fingerprint.  ``root`` names the group itself, also where
    documents of different groups share a key.  Equal
    fingerprints are one point; only points are bucketed and linked.  Empty texts have fingerprint 0.
    """
    own = small_batches(docs).select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), fingerprints(text, width).alias("fp"))
    own = kept(own, "fingerprints")
    points = kept(own.groupBy("fp").agg(F.count("*").alias("n_near"), F.min("key").alias("least")), "points")
    roots = components(near_links(points.select("fp"), radius, most))
    joined = points.join(roots, points.fp == roots.node, "left").select("fp", "n_near", "least", F.coalesce("root", "fp").alias("root"))
    joined = kept(joined, "rooted")
    named = joined.groupBy("root").agg(F.min("least").alias("component"))
    groups = joined.join(named, "root").select("fp", "n_near", "component", "root")
    return own.join(groups, "fp").select("key", "text_hash", "fp", "n_near", "component", "root")


def first_of_each(docs, found, group, text="text", key="doc_id"):
    """One document of each group of rows (key, text_hash), the one with the smallest key, with its own columns.

    Rows without a key come last, in the order of their texts' hashes; of equal rows one stays.
    """
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("text_hash"))
    first = found.groupBy(group.alias("group")).agg(F.min(order).alias("first")).select("first.key", "first.text_hash")
    first = first.select(F.col("key").alias("_k"), F.col("text_hash").alias("_h")).distinct()
    own = [F.col(quoted(c)) for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"))
    rows = rows.join(first, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_semi")
    copy = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_hash"))
    return rows.withColumn("_copy", copy).where("_copy = 1").select("_row.*")


def one_of_each(docs, text="text", key="doc_id", **options):
    """One document of each group of near duplicates; see ``first_of_each``."""
    return first_of_each(docs, near_duplicates(docs, text, key, **options), F.col("root"), text, key)

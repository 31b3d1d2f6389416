"""Packing documents into token sequences: dominance reduction, then best fit."""

import base64
import bisect
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import as_bytes, small_batches

#: Ranks within a length stay below this, so that a length and a rank make one number.
RANKS = 1 << 50
#: White space so long that the faster of the two encoders gives up on it.
_long_gap = re.compile(r"\s{100000}")
#: How the byte-level BPE tokenizer splits texts first (a fixed value that belongs to its vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name):
    """Where a file of the installed public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as bytes (little-endian, 32 bits each), by a byte-level BPE tokenizer.

    ``ranks`` is the file of the same vocabulary as ranks of byte strings; ids are the same and come about five times
    faster with it.  The strings of tokens that the tokenizer has added to its vocabulary become these tokens.
    """

    def __init__(self, tokenizer, ranks=None):
        self.path, self.whole, self.fast, self.added = tokenizer, None, None, []
        if ranks:
            import tiktoken

            with open(tokenizer, encoding="utf-8") as file:
                self.added = [x["content"] for x in json.load(file).get("added_tokens", [])]

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})

    def tokenizer(self):
        if self.whole is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    def __call__(self, text):
        if self.fast and not any(x in text for x in self.added) and (len(text) < 100_000 or not _long_gap.search(text)):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer().encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def pieces(docs, tokenizer, ranks=None, text="text", key="doc_id", capacity=2048, end=0, with_ids=False):
    """(key, piece, start, length, ids_crc32, part, nth): the token pieces of every document.

    A document is the ids of its text and the id ``end``.  One that is longer than the capacity is cut into pieces of
    that size, of which the first may be shorter.  ``part`` and ``nth`` number the pieces of one length: the nth of a
    task.  With ``with_ids`` there is a column ``ids`` too.  Null and empty texts are one piece of length 1.
    """
    name, kind = key, docs.schema[key].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        encode, part, seen = Encoder(tokenizer, ranks), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.slice(at, 200)
                texts = (x.as_py().decode("utf-8", "replace") for x in some.column(1))
                yield rows(some.column(0), map(encode, texts), part, seen)

    def rows(keys, encoded, part, seen):
        of, number, start, length, check, nth, ids = [], [], [], [], [], [], []
        for i, own in enumerate(encoded):
            own += int(end).to_bytes(4, "little")
            total = len(own) // 4
            first = (total - 1) % capacity + 1
            for n, (a, b) in enumerate(zip([0, *range(first, total, capacity)], range(first, total + 1, capacity))):
                piece = own[4 * a : 4 * b]
                of.append(i)
                number.append(n)
                start.append(a)
                length.append(b - a)
                check.append(zlib.crc32(piece))
                nth.append(seen[b - a])
                seen[b - a] += 1
                if with_ids:
                    ids.append(piece)
        columns = [
            keys.take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            pa.array(check, pa.int64()), pa.array([part] * len(of), pa.int32()), pa.array(nth, pa.int64()),
        ]
        names = [name, "piece", "start", "length", "ids_crc32", "part", "nth"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = f"`{name}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return small_batches(docs).select(F.col(key), as_bytes(text).alias("_text")).mapInArrow(cut, schema)


def dominating_set(counts, a, capacity):
    """Lengths of a set with ``a`` that is at least as good as any other set with it, or None if that is not plain.

    ``counts`` has the number of items by length.  A set is as good as another one if the items of the other can be
    put in groups, each no longer than an item of its own in this set; then swapping them never costs a bin.
    """
    room = capacity - a
    counts[a] -= 1
    try:
        here = np.flatnonzero(counts)
        if not len(here) or here[0] > room:
            return (a,)
        fit = here[here <= room]
        largest = int(fit[-1])
        small = np.repeat(here[:3], np.minimum(counts[here[:3]], 3))[:3]
        if largest == room or len(small) < 2 or small[:2].sum() > room:
            return a, largest
        if len(small) == 3 and small.sum() <= room:
            return None
        # Two more fit at most.  The best partner of each length:
        at = np.searchsorted(fit, room - fit, "right") - 1
        alone = (at >= 0) & (fit[at] == fit) & (counts[fit] < 2)
        at = at - alone
        pair = at >= 0
        if largest >= (fit[pair] + fit[at[pair]]).max(initial=0):
            return a, largest
        second = np.minimum(fit[pair], fit[at[pair]]).max(initial=0)
        counts[largest] -= 1
        beside = fit[(counts[fit] > 0) & (fit <= room - largest)]
        counts[largest] += 1
        if len(beside) and beside[-1] >= second:
            return a, largest, int(beside[-1])
        return None
    finally:
        counts[a] += 1


def reduced(counts, capacity):
    """Bins fixed by dominance, as (number, lengths), and the counts that are left."""
    counts, fixed, changed = np.array(counts, np.int64), [], True
    while changed:
        changed = False
        for a in range(capacity, 0, -1):
            while counts[a]:
                found = dominating_set(counts, a, capacity)
                if found is None:
                    break
                n = min(int(counts[x]) // found.count(x) for x in set(found))
                fixed.append((n, found))
                for x in found:
                    counts[x] -= n
                changed = True
    return fixed, counts


def best_fit(counts, capacity):
    """Bins of best fit decreasing, as (number, [(length, times), ...]); equal bins are handled together."""
    open_bins, rooms = {}, []  # by room that is left: lists of [number, items]; the rooms in order

    def put(room, number, items):
        if number:
            if room not in open_bins:
                bisect.insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append([number, items])

    for a in range(capacity, 0, -1):
        left = int(counts[a])
        while left:
            at = bisect.bisect_left(rooms, a)
            if at < len(rooms):
                room = rooms[at]
                number, items = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, number, items = capacity, -(-left // (capacity // a)), []
            times = room // a
            full = min(number, left // times)
            put(room - times * a, full, [*items, (a, times)])
            left -= full * times
            number -= full
            if number and left and left < times:
                put(room - left * a, 1, [*items, (a, left)])
                number, left = number - 1, 0
            put(room, number if items else 0, items)
    return [(number, items) for groups in open_bins.values() for number, items in groups]


class Plan:
    """Where the pieces of each length go: the nth piece of a length has its sequence and offset."""

    def __init__(self, counts, capacity):
        fixed, rest = reduced(counts, capacity)
        bins = [(n, [(x, own.count(x)) for x in sorted(set(own), reverse=True)]) for n, own in fixed]
        used, entries, self.sequences = {}, [], 0
        for number, items in bins + best_fit(rest, capacity):
            offset = 0
            for length, times in items:
                low = used.get(length, 0)
                entries.append((length * RANKS + low, self.sequences, times, offset, length, low))
                used[length] = low + number * times
                offset += length * times
            self.sequences += number
        self.table = np.array(sorted(entries), np.int64).reshape(-1, 6)

    def places(self, length, rank):
        """Sequence and offset for arrays of lengths and ranks within them."""
        entry = self.table[np.searchsorted(self.table[:, 0], length * RANKS + rank, "right") - 1]
        nth, within = np.divmod(rank - entry[:, 5], entry[:, 2])
        return entry[:, 1] + nth, entry[:, 3] + within * length


def pack(docs, tokenizer, ranks=None, text="text", key="doc_id", capacity=2048, end=0, with_ids=False):
    """The pieces of all documents (see ``pieces``) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length matters for the plan, and there are at most ``capacity`` lengths, so the
    plan is made from these counts: sets that provably dominate all others are fixed, which shrinks the instance, and
    the rest goes by best fit decreasing.  Then each piece finds its place by its rank among those of its length: its
    number in its own task, plus the pieces of the tasks before.

    Repeated rows and null keys are documents of their own; a sequence has no gaps.
    """
    name = key
    cut = kept(pieces(docs, tokenizer, ranks, text, key, capacity, end, with_ids), "pieces")
    tasks = kept(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "pieces-of-tasks")
    counts = np.zeros(capacity + 1, np.int64)
    for row in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = Plan(counts, capacity)

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = plan.places(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    placed = cut.join(tasks.select("length", "part", before.alias("before")), ["length", "part"])
    placed = placed.withColumn("_place", place("length", F.col("nth") + F.col("before")))
    own = [name, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return placed.select(*own, "_place.sequence_id", "_place.offset")


def sequences(packed):
    """(sequence_id, ids, keys): the token ids of each sequence as 32-bit little-endian bytes, from ``pack(with_ids=True)``."""
    key = packed.columns[0]
    items = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(key).alias("key"))))
    rows = packed.groupBy("sequence_id").agg(items.alias("items"))
    joined = F.aggregate("items", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("items.key").alias("keys"))

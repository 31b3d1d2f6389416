"""Ranked lexical search, reversed: the asking items form the index, and documents stream through it."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import as_bytes, quoted, small_batches

#: Items of one index come to at most so many bytes of text (a longer item is an index of its own), since tasks hold it whole.
INDEX_BYTES = 16 << 20
#: Scores that a task holds at a time, and candidates that it gathers before it cuts them to the best of each item.
CELLS, CANDIDATES = 1 << 20, 1 << 18
#: Bytes outside of terms become spaces, capital letters small ones.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
#: Constants of the score: a term's count, the length of a document, and how much the length matters.
COUNT, WEIGHT, LENGTH, SHARE, UNIT = 1000, 1000, 12, 25, 10**9


def terms(text):
    """The terms of a text in bytes: runs of ASCII letters and digits and of all that is not ASCII; A-Z as a-z."""
    return text.translate(TABLE).split()


class Index:
    """Terms of some items, with the items that hold them.

    ``heads`` numbers the terms; the postings of term t are ``items[first[t]:first[t + 1]]`` and ``times``.
    """

    def __init__(self, texts):
        self.size, self.heads, postings = len(texts), {}, []
        for item, text in enumerate(texts):
            for term, n in Counter(terms(text)).items():
                postings.append((self.heads.setdefault(term, len(self.heads)), item, n))
        table = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(len(self.heads) + 1))
        self.items, self.times = table[:, 1].copy(), table[:, 2].copy()


def counted(docs, index, text, key):
    """(key, n, terms, counts): for each document with terms their number, and how often it holds each term of the index."""
    heads = index.heads

    def count(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                sizes, found, often, rows = [], [], [], []
                ends = [0]
                for row, own in enumerate(some.column(1)):
                    words = terms(own.as_py())
                    if not words:
                        continue
                    rows.append(row)
                    sizes.append(len(words))
                    for word, n in Counter(words).items():
                        head = heads.get(word)
                        if head is not None:
                            found.append(head)
                            often.append(n)
                    ends.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((found, pa.int32()), (often, pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["key", "n", "terms", "counts"])

    rows = small_batches(docs).select(F.col(quoted(key)).cast("long").alias("key"), as_bytes(F.col(quoted(text))).alias("_text"))
    return kept(rows.mapInArrow(count, "key long, n long, terms array<int>, counts array<long>"), "term-counts")


class Best:
    """The best documents of each item so far: those with the highest scores, equal ones by the smaller key."""

    def __init__(self, items, k):
        self.k, self.least, self.last = k, np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)
        self.rows, self.more, self.n = np.zeros((3, 0), np.int64), [], 0

    def add(self, scores, keys):
        """Scores of documents (rows) and items (columns)."""
        better = (scores > self.least) | ((scores == self.least) & (keys[:, None] < self.last))
        doc, item = np.nonzero(better & (scores > 0))
        if len(doc):
            self.more.append(np.stack([item, scores[doc, item], keys[doc]]))
            self.n += len(doc)
            if self.n > CANDIDATES:
                self.cut()

    def cut(self):
        rows = np.concatenate([self.rows, *self.more], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        edges = np.searchsorted(rows[0], np.arange(len(self.least) + 1))
        rank = np.arange(rows.shape[1]) - edges[rows[0]]
        # Of an item with k documents, the last one says what a further one must reach.
        full = np.flatnonzero(np.diff(edges) >= self.k)
        worst = edges[full] + self.k - 1
        self.least[full], self.last[full] = rows[1, worst], rows[2, worst]
        self.rows, self.more, self.n = rows[:, rank < self.k], [], 0
        return self.rows


def scored(table, index, weights, n_docs, length, k):
    """(item, key, score): the best documents of each item among those of a task."""
    # Sums of doubles are exact up to 2**53; where an item might exceed that, whole numbers are added.
    most = np.zeros(index.size, object)
    owner = np.repeat(np.arange(len(weights)), np.diff(index.first))
    np.add.at(most, index.items, weights[owner].astype(object) * index.times * (UNIT // COUNT))
    exact = max(most, default=0) >= 1 << 53
    together = max(1, CELLS // max(1, index.size))

    def score(batches):
        best = Best(index.size, k)
        for batch in batches:
            for at in range(0, len(batch), together):
                some = batch.slice(at, together)
                sizes = some.column(1).to_numpy(zero_copy_only=False)
                heads, counts = (some.column(x).flatten().to_numpy(zero_copy_only=False) for x in (2, 3))
                doc = np.repeat(np.arange(len(some)), np.diff(some.column(2).offsets.to_numpy(zero_copy_only=False)))
                # The length of documents in whole per cents of the mean, partly.
                wide = sizes.astype(object) if int(sizes.max(initial=0)) * n_docs * SHARE >= 1 << 62 else sizes
                norm = (100 - SHARE + SHARE * wide * n_docs // length).astype(np.int64)
                gain = weights[heads] * (UNIT * counts // (COUNT * counts + LENGTH * norm[doc]))
                often = index.first[heads + 1] - index.first[heads]
                ends = np.cumsum(often)
                place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(index.first[heads] - ends + often, often)
                cell = np.repeat(doc, often) * index.size + index.items[place]
                gain = np.repeat(gain, often) * index.times[place]
                if exact:
                    sums = np.zeros(len(some) * index.size, np.int64)
                    np.add.at(sums, cell, gain)
                else:
                    sums = np.bincount(cell, gain, len(some) * index.size).astype(np.int64)
                best.add(sums.reshape(len(some), index.size), some.column(0).to_numpy(zero_copy_only=False))
        rows = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[2]), pa.array(rows[1])], ["item", "key", "score"])

    return table.mapInArrow(score, "item long, key long, score long")


def _dealt(items, text, item, index_bytes):
    """Items with a number, and a part whose texts come to at most so many bytes; a longer text is a part of its own."""
    rows = items.select(F.col(quoted(item)).alias("item_key"), as_bytes(F.col(quoted(text))).alias("item_text"))
    rows = kept(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("item_text").cast("long")), "items")
    total = rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    parts = max(1, -(-2 * total // index_bytes))
    # By a hash, a part may come out larger than the mean: it is cut further by running sums.
    rows = rows.withColumn("pile", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    before = F.sum("bytes").over(Window.partitionBy("pile").orderBy("uid")) - F.col("bytes")
    return kept(rows.withColumn("part", F.struct("pile", F.floor(before / F.lit(float(index_bytes))).alias("layer"))), "items-dealt")


def ranked_search(docs, items, text="text", key="doc_id", item="item_id", item_text="text", k=20, index_bytes=INDEX_BYTES):
    """(item, rank, key, score): for each item the ``k`` documents with the highest scores above 0, equal ones by the smaller key.

    Terms are those of ``terms``, of whole texts.  A document's score sums over the terms of the item, repeats included,
    w * ((10**9 * tf) div (1000 * tf + 12 * m)); w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 75 + (25 * n * N) div L,
    where N documents have terms, L in all and n in this one, df of them hold the term and this one tf times.

    Null and empty texts have no terms.  Repeated documents and repeated items count each; an item that is repeated is answered each
    time.  Documents with a null key count in N, L and df, but are not ranked.  Items without terms and empty tables give no rows.

    The items are the index: their texts, at most ``index_bytes`` of them at a time, go to all tasks, each document's
    term counts run through it, and each task keeps the best ``k`` of each item.  Only these meet in a shuffle.
    """
    dealt = _dealt(items, item_text, item, index_bytes)
    results = None
    for part in sorted(row["part"] for row in dealt.select("part").distinct().collect()):
        own = dealt.where((F.col("part.pile") == part["pile"]) & (F.col("part.layer") == part["layer"])).orderBy("uid").collect()
        index = Index([row["item_text"] for row in own])
        table = counted(docs, index, text, key)
        totals = table.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        n_docs, length = totals["docs"], totals["length"] or 0
        weights = np.zeros(len(index.heads), np.int64)
        if not n_docs or not len(index.heads):
            continue
        for row in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the terms of the index
            weights[row["term"]] = math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
        found = scored(table.where("key is not null"), index, weights, n_docs, length, k)
        names = pa.array([row["uid"] for row in own], pa.int64())

        def named(batches, names=names):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([names.take(batch.column(0)), *batch.columns[1:]], ["uid", "key", "score"])

        found = found.mapInArrow(named, "uid long, key long, score long")
        results = found if results is None else results.union(found)
    kind = items.schema[item].dataType.simpleString()
    if results is None:
        return docs.sparkSession.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "key")
    best = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(dealt.select("uid", "item_key"), "uid").select(
        F.col("item_key").alias(item), "rank", F.col("key").alias(key), "score"
    )

"""Quality scores from how well a text compresses with dictionaries of good and of bad texts."""

from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

#: Bounds of the sample that the model is fitted on: rows of each label, and blocks of a text (of a longer one, blocks from all over it).
SAMPLE_ROWS, SAMPLE_BLOCKS = 3000, 4
#: Bytes of a text that are compressed at a time; more would be judged by the text's own beginning.
BLOCK = 1 << 13
#: Bytes of a dictionary, and the compression level.
DICTIONARY, LEVEL = 1 << 15, 3
#: Pairs of dictionaries, each made from all parts of the sample but one, on which its differences are calibrated.
PAIRS = 4
#: Share of the straight logistic line in the score, which keeps the order where the steps of the calibration are level.
STRAIGHT = 0.02


def is_held_out(key):
    """Rows whose labels are not learned from: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Pairs of dictionaries (bad, good), and what turns the difference of compressed sizes into a score.

    That is a rising curve through the given points, with a little of a logistic line.
    """

    def __init__(self, pairs, line, curve, level=LEVEL):
        self.pairs, self.line, self.curve, self.level = pairs, line, curve, level

    def differences(self):
        """For each pair a function from a text (bytes) to (size as bad - size as good) / (their sum), between -1 and 1.

        Sizes are sums over all blocks of the text, each compressed afresh.
        """
        return [self._difference([self._packer(d) for d in pair]) for pair in self.pairs]

    def _packer(self, dictionary):
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False, **known)

    @staticmethod
    def _difference(packers):
        def of(text):
            parts = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)] or [text]
            bad, good = (sum(len(x.compress(part)) for part in parts) for x in packers)
            return (bad - good) / (bad + good)

        return of

    def score(self, differences):
        """Scores of mean differences, rising with them."""
        slope, base = self.line
        straight = 1 / (1 + np.exp(-np.clip(slope * np.asarray(differences) + base, -30, 30)))
        return STRAIGHT * straight + (1 - STRAIGHT) * np.interp(differences, *self.curve)


def _dictionary(texts, size):
    """A trained dictionary; texts too few to train on serve as they are, and none give an empty one."""
    joined = b"".join(texts)
    try:
        return zstandard.train_dictionary(min(size, max(256, len(joined) // 8)), texts).as_bytes()
    except zstandard.ZstdError:
        return joined[-size:] if len(joined) >= 8 else b""


def _logistic(x, y, weights, rounds=50, ridge=1e-6):
    """Slope and base of a logistic regression on one number, by Newton's method."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (weights * (p * (1 - p) + 1e-9))[:, None]).T @ a + ridge * len(x) * np.eye(2)
        step = np.linalg.solve(curve, a.T @ (weights * (y - p)) - ridge * len(x) * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _rising(x, y, weights):
    """Points of the rising curve nearest to y: neighbours in the order of x are pooled while they fall."""
    pools = []
    for i in np.argsort(x, kind="stable"):
        pools.append(weights[i] * np.array([1.0, y[i], x[i]]))
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = pools[-1] + last
    pools = np.array(pools)
    share = float(np.average(y, weights=weights))
    return pools[:, 2] / pools[:, 0], (pools[:, 1] + 0.5 * share) / (pools[:, 0] + 0.5)


def _blocks_of(text, key, number):
    """The bytes, or if there are more than ``number`` blocks, one drawn block of each of that many equal stretches, joined."""
    blocks = F.ceil(F.octet_length(text) / BLOCK)

    def drawn(i):
        start, end = (F.floor(blocks * j / number) for j in (i, i + 1))
        at = start + F.pmod(F.xxhash64(F.lit(13 + i), key), F.greatest(end - start, F.lit(1)))
        return F.substring(text, (at * BLOCK + 1).cast("int"), F.lit(BLOCK))

    return F.when(blocks <= number, text).otherwise(F.concat(*[drawn(i) for i in range(number)]))


def fit(docs, labels, text="text", key="doc_id", label="quality", rows=SAMPLE_ROWS, blocks=SAMPLE_BLOCKS, size=DICTIONARY, level=LEVEL):
    """A ``Model`` from labelled rows that are not held out.

    The sample is bounded: of each label, the ``rows`` rows whose keys have the smallest hashes, whatever the length of their
    texts.  A text of more than ``blocks`` blocks gives that many of its blocks, one drawn from each of as many equal stretches.  Empty
    texts are not drawn; of rows that repeat a key, one is.  Other columns of the tables are not looked at.  Without rows of both labels the score is the share of
    label 1, or one half.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(key)).groupBy(key).agg(F.max(label).alias("_label"))
    order = F.xxhash64(F.lit(11), F.col(key))
    texts = docs.select(F.col(key), F.col(text).cast("binary").alias("_text")).where("octet_length(_text) > 0")
    there = texts.select(key).distinct().join(known, key)
    chosen = [there.where(F.col("_label") == q).orderBy(order, key).limit(rows) for q in (0, 1)]
    texts = texts.select(key, _blocks_of(F.col("_text"), F.col(key), blocks).alias("_text"))
    drawn = texts.join(F.broadcast(chosen[0].union(chosen[1])), key).groupBy(key, "_label").agg(F.min("_text").alias("_text"))
    drawn = drawn.select(key, F.col("_text").alias("text"), "_label").toArrow()
    share = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    good_share = share.get(1, 0) / sum(share.values()) if share else 0.5
    sample = sorted(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), drawn.column(2).to_pylist()))
    parts = {0: [], 1: []}
    for _, value, own in sample:
        parts[own].append(value)
    for own in parts.values():
        np.random.default_rng(5).shuffle(own)
    if not parts[0] or not parts[1]:
        good = min(max(good_share, 1e-3), 1 - 1e-3)
        return Model([], (0.0, float(np.log(good / (1 - good)))), ([0.0], [good]), level)
    number = max(1, min(PAIRS, *map(len, parts.values())))
    held = [{q: own[j::number] for q, own in parts.items()} for j in range(number)]
    made = [
        [_dictionary([x for i, part in enumerate(held) if i != j or number == 1 for x in part[q]], size) for q in (0, 1)]
        for j in range(number)
    ]
    model = Model(made, None, None, level)
    found = [(of(x), float(q)) for of, part in zip(model.differences(), held) for q in (0, 1) for x in part[q]]
    x, y = np.array(found).T
    # The sample may hold the labels in other shares than all labelled rows do.
    weights = np.where(y == 1, share[1] / len(parts[1]), share[0] / len(parts[0])) * len(y) / sum(share.values())
    return Model(made, _logistic(x, y, weights), _rising(x, y, weights), level)


def scored(docs, model, text="text"):
    """A column with the score (0 to 1, higher: label 1 likelier) of each whole text.

    A null text scores like an empty one, for which both sizes are nearly the same.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs = model.differences()
        for batch in batches:
            found = [sum(of(x) for of in pairs) / max(1, len(pairs)) for x in batch.to_pylist()]
            yield pa.array(model.score(found), pa.float64())

    return score(as_bytes(text))


def classify(docs, labels, text="text", key="doc_id", label="quality", threshold=0.3, **bounds):
    """(key, held_out, score, predicted) for every document; see ``fit`` and ``scored``.

    Rows with a null key are not held out; repeated rows are scored each.
    """
    model = fit(small_batches(docs), labels, text, key, label, **bounds)
    rows = docs.select(F.col(key), is_held_out(key).alias("held_out"), scored(docs, model, text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

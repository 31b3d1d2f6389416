"""Multinomial logistic regression over hashed words, for all penalties in the same passes.

The words of a row are stored once, as the numbers that they are hashed to, two bytes each for up to 65,536 of them, and each pass reads
only these.  The objective is the one of Spark ML's ``LogisticRegression`` (features standardised, intercepts without a
penalty), and so is the way to its minimum: L-BFGS with a line search for the strong Wolfe conditions.
"""

import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDFModel
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.util import Identifiable
from pyspark.sql import functions as F

# Words in a block of rows, and bytes of blocks that a task reads at once.
WORDS, GROUP = 1 << 18, 8 << 20
BLOCKS = "validation boolean, lengths binary, words binary, labels binary"
# Of L-BFGS and its line search.
MEMORY, TOLERANCE, TRIES, DECREASE, CURVATURE = 10, 1e-6, 10, 1e-4, 0.9


def stored_blocks(counted, dimensions, keep):
    """The rows (``_counts, label_id, split``) of both splits as blocks, which ``keep`` stores."""
    kind = np.uint16 if dimensions <= 1 << 16 else np.int32

    def block(batches):
        waiting = {False: [], True: []}

        def record(validation):
            lengths, words, labels = (np.concatenate(x).tobytes() for x in zip(*waiting[validation]))
            waiting[validation] = []
            return pa.RecordBatch.from_pylist([{"validation": validation, "lengths": lengths, "words": words, "labels": labels}])

        for batch in batches:
            places, uses = (batch.column(0).field(x) for x in ("indices", "values"))
            offsets = places.offsets.to_numpy()
            flat, uses = places.values.to_numpy(), uses.values.to_numpy().astype(np.int64)
            labels, split = batch.column(1).to_numpy().astype(np.int32), batch.column(2).to_pylist()
            ends = np.concatenate([[0], np.cumsum(uses)])[offsets]
            flat = np.repeat(flat, uses).astype(kind)
            for validation, name in ((False, "train"), (True, "validation")):
                own = np.array([x == name for x in split], bool)
                if own.any():
                    lengths = np.diff(ends)
                    words = flat[ends[0] : ends[-1]][np.repeat(own, lengths)]
                    waiting[validation].append((lengths[own].astype(np.int32), words, labels[own]))
                    if sum(len(x[1]) for x in waiting[validation]) >= WORDS:
                        yield record(validation)
        for validation in waiting:
            if waiting[validation]:
                yield record(validation)

    groups = {"parquet.block.size": str(GROUP), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    return keep(counted.select("_counts", "label_id", "split").mapInArrow(block, BLOCKS), "training", **groups)


def _rows(batches, kind):
    """Lengths, starts, words and labels of each block."""
    for batch in batches:
        for lengths, words, labels in zip(*(batch.column(name) for name in ("lengths", "words", "labels"))):
            lengths, words, labels = (np.frombuffer(x.as_buffer(), k) for x, k in ((lengths, np.int32), (words, kind), (labels, np.int32)))
            yield lengths, np.cumsum(lengths) - lengths, words.astype(np.intp), labels


def _sums(starts, lengths, values):
    """The sum of the values of each row."""
    if not len(values):
        return np.zeros(len(lengths))
    return np.where(lengths > 0, np.add.reduceat(values, np.minimum(starts, len(values) - 1)), 0.0)


class Counts(NamedTuple):
    """Rows, rows by label, and by word the sum of its uses, of their squares, and the rows that have it."""

    rows: int
    labels: np.ndarray
    uses: np.ndarray
    squares: np.ndarray
    docs: np.ndarray


class Blocks:
    """The stored blocks of a training set, read once for each call."""

    def __init__(self, stored, dimensions):
        self.dimensions = dimensions
        self.context = stored.sparkSession.sparkContext
        self.kind = np.uint16 if dimensions <= 1 << 16 else np.int32
        # Each pass sends an array of all coefficients from every task, so there are no more tasks than cores.
        tasks = self.context.defaultParallelism
        self.train, self.validation = (stored.where(F.col("validation") == x).drop("validation").coalesce(tasks) for x in (False, True))

    def counts(self):
        dimensions, kind = self.dimensions, self.kind

        def count(batches):
            labels, sums = {}, np.zeros((3, dimensions))
            for lengths, starts, words, own in _rows(batches, kind):
                for label, n in zip(*np.unique(own, return_counts=True)):
                    labels[int(label)] = labels.get(int(label), 0) + int(n)
                # The uses of a word in a row follow each other.
                new = np.ones(len(words), bool)
                new[1:] = words[1:] != words[:-1]
                new[starts[lengths > 0]] = True
                first = np.flatnonzero(new)
                uses, words = np.diff(np.append(first, len(words))).astype(float), words[first]
                for total, weights in zip(sums, (uses, uses * uses, None)):
                    total += np.bincount(words, weights, dimensions)
            yield pa.RecordBatch.from_pylist([{"labels": list(labels.items()), "sums": sums.tobytes()}], pa.schema({"labels": pa.map_(pa.int32(), pa.int64()), "sums": pa.binary()}))

        labels, sums = {}, np.zeros((3, dimensions))
        for row in self.train.mapInArrow(count, "labels map<int,bigint>, sums binary").collect():
            sums += np.frombuffer(row["sums"]).reshape(3, -1)
            for label, n in row["labels"].items():
                labels[label] = labels.get(label, 0) + n
        found = np.zeros(max(labels, default=-1) + 1, np.int64)
        found[list(labels)] = list(labels.values())
        return Counts(int(found.sum()), found, *sums)

    def losses(self, tables, offsets):
        """For each model the sums of loss, of errors by class, and of errors by class and word, of the train split.

        ``tables`` (model, class, word) and ``offsets`` (model, class) are less those of the last class, whose errors follow from the others.
        """
        dimensions, kind, sent = self.dimensions, self.kind, self.context.broadcast((tables, offsets))

        def add(batches):
            tables, offsets = sent.value
            models, classes, _ = tables.shape
            loss, errors, by_word = np.zeros(models), np.zeros((models, classes)), np.zeros(tables.shape)
            for lengths, starts, words, labels in _rows(batches, kind):
                hot = labels == np.arange(classes)[:, None]
                for m in range(models):
                    z = np.stack([_sums(starts, lengths, table[words]) + offset for table, offset in zip(tables[m], offsets[m])])
                    most = np.maximum(z.max(axis=0), 0)
                    p = np.exp(z - most)
                    total = p.sum(axis=0) + np.exp(-most)
                    loss[m] += (np.log(total) + most - (z * hot).sum(axis=0)).sum()
                    p = p / total - hot
                    errors[m] += p.sum(axis=1)
                    for k in range(classes):
                        by_word[m, k] += np.bincount(words, np.repeat(p[k], lengths), dimensions)
            yield pa.RecordBatch.from_pylist([{"loss": loss.tobytes(), "errors": errors.tobytes(), "by_word": by_word.tobytes()}])

        sums = [np.zeros(len(tables)), np.zeros(offsets.shape), np.zeros(tables.shape)]
        parts = self.train.mapInArrow(add, "loss binary, errors binary, by_word binary").collect()
        while parts:
            for total, part in zip(sums, parts.pop()):
                total += np.frombuffer(part).reshape(total.shape)
        sent.destroy()
        # What a pass has sent is copied several times on its way; the driver's heap would grow with it pass by pass.
        self.context._jvm.System.gc()
        return sums

    def confusions(self, tables, offsets):
        """Rows (model, label, prediction, n) of the validation split."""
        kind, sent = self.kind, self.context.broadcast((tables, offsets))

        def say(batches):
            tables, offsets = sent.value
            cells = {}
            for lengths, starts, words, labels in _rows(batches, kind):
                for m, (own, offset) in enumerate(zip(tables, offsets)):
                    z = np.stack([_sums(starts, lengths, table[words]) + x for table, x in zip(own, offset)] + [np.zeros(len(lengths))])
                    pairs, n = np.unique(np.stack([labels, z.argmax(axis=0)]), axis=1, return_counts=True)
                    for label, said, count in zip(*pairs.tolist(), n.tolist()):
                        cells[m, label, said] = cells.get((m, label, said), 0) + count
            if cells:
                yield pa.RecordBatch.from_pylist([{"model": m, "label": a, "prediction": b, "n": n} for (m, a, b), n in cells.items()])

        found = self.validation.mapInArrow(say, "model bigint, label bigint, prediction bigint, n bigint").collect()
        sent.destroy()
        return found


def fit(blocks, counts, penalties, iterations):
    """Coefficients (class, word) and intercepts for each penalty, on counts weighted by ``weights_of``."""
    n, classes, dimensions = counts.rows, len(counts.labels), blocks.dimensions
    weights = weights_of(counts)
    mean = weights * counts.uses / n
    varied = counts.squares - counts.uses**2 / n
    spread = weights * np.sqrt(np.maximum(varied, 0) / max(n - 1, 1))
    inverse = np.divide(1.0, spread, out=np.zeros(dimensions), where=(varied > 1e-12 * counts.squares) & (spread > 0))
    factor, centre = weights * inverse, mean * inverse
    start = np.zeros((classes, dimensions + 1))
    start[:, -1] = np.log1p(counts.labels) - np.log1p(counts.labels).mean()

    def told(solutions):
        """Tables and offsets of solutions in the standardised space, less those of the last class."""
        own = np.stack([x.reshape(classes, -1) for x in solutions])
        tables, offsets = own[:, :, :-1] * factor, own[:, :, -1] - own[:, :, :-1] @ centre
        return tables[:, :-1] - tables[:, -1:], offsets[:, :-1] - offsets[:, -1:]

    def evaluate(solutions, own_penalties):
        for x, penalty, loss, errors, by_word in zip(solutions, own_penalties, *blocks.losses(*told(solutions))):
            errors, by_word = (np.concatenate([e, -e.sum(axis=0, keepdims=True)]) for e in (errors, by_word))
            x = x.reshape(classes, -1)
            slope = np.empty_like(x)
            slope[:, :-1] = (by_word * factor - errors[:, None] * centre) / n + penalty * x[:, :-1]
            slope[:, -1] = errors / n
            yield loss / n + penalty / 2 * np.sum(x[:, :-1] ** 2), slope.ravel()

    searches = [_minimised(start.ravel(), iterations) for _ in penalties]
    asked, solutions = {m: next(search) for m, search in enumerate(searches)}, {}
    while asked:
        answers = evaluate(list(asked.values()), [penalties[m] for m in asked])
        for m, answer in zip(list(asked), list(answers)):
            try:
                asked[m] = searches[m].send(answer)
            except StopIteration as end:
                solutions[m] = end.value
                del asked[m]
    fitted = []
    for m, penalty in enumerate(penalties):
        own = solutions[m].reshape(classes, -1)
        coefficients, intercepts = own[:, :-1] * inverse, own[:, -1] - own[:, :-1] @ centre
        if penalty == 0:
            coefficients = coefficients - coefficients.mean(axis=0)
        fitted.append((coefficients, intercepts - intercepts.mean()))
    return fitted, told([solutions[m] for m in range(len(penalties))])


def _minimised(x, iterations):
    """L-BFGS as a generator that asks for value and gradient at a point; it returns the point found."""
    value, slope = yield x
    past, values, failed = [], [value], False
    done = 0
    while done < iterations and np.linalg.norm(slope) > max(TOLERANCE * abs(value), 1e-8):
        direction = _direction(slope, past)
        first = 1.0 if past else 1 / np.linalg.norm(direction)
        found = yield from _line_search(x, direction, value, slope @ direction, first)
        if found is None:
            if failed or not past:
                break
            past, failed = [], True
            continue
        step, value, new = found
        # Only the direction depends on these, so half the memory does.
        past = [*past, ((step * direction).astype(np.float32), (new - slope).astype(np.float32))][-MEMORY:]
        x, slope, done = x + step * direction, new, done + 1
        if abs(value - max(values[-20:])) <= TOLERANCE * abs(values[0]):
            break
        values.append(value)
    return x


def _direction(slope, past):
    products = [np.sum(s * y, dtype=np.float64) for s, y in past]
    found, shares = -slope, []
    for (s, y), product in zip(reversed(past), reversed(products)):
        shares.append((s @ found) / product)
        found = found - shares[-1] * y
    if past:
        y = past[-1][1]
        found = found * (products[-1] / np.sum(y * y, dtype=np.float64))
    for (s, y), product, share in zip(past, products, reversed(shares)):
        found = found + s * (share - (y @ found) / product)
    return found


def _line_search(x, direction, value, steep, t):
    """(step, value, gradient) that meet the strong Wolfe conditions, or None."""

    def at(t):
        value, slope = yield x + t * direction
        return t, value, slope @ direction, slope

    def zoom(low, high):
        for _ in range(TRIES):
            left, right = (high, low) if low[0] > high[0] else (low, high)
            own = yield from at(_between(left, right))
            if own[1] > value + DECREASE * own[0] * steep or own[1] >= low[1]:
                high = own
            else:
                if abs(own[2]) <= CURVATURE * abs(steep):
                    return own
                if own[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = own
        return None

    low, own = (0.0, value, steep, None), None
    if steep >= 0:
        return None
    for i in range(TRIES):
        own = yield from at(t)
        if not np.isfinite(own[1]):
            t, own = t / 2, None
            continue
        if own[1] > value + DECREASE * t * steep or own[1] >= low[1] and i > 0:
            own = yield from zoom(low, own)
            break
        if abs(own[2]) <= CURVATURE * abs(steep):
            break
        if own[2] >= 0:
            own = yield from zoom(own, low)
            break
        low, t, own = own, t * 1.5, None
    return None if own is None else (own[0], own[1], own[3])


def _between(left, right):
    """Where the cubic through both ends is least, not too close to either."""
    width = right[0] - left[0]
    d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
    d2 = np.sqrt(max(d1 * d1 - left[2] * right[2], 0.0))
    bottom = right[2] - left[2] + 2 * d2
    t = right[0] - width * (right[2] + d2 - d1) / bottom if bottom else left[0] + width / 2
    return min(max(t, left[0] + 0.1 * width), left[0] + 0.9 * width)


def weights_of(counts):
    """The inverse document frequencies of Spark ML's ``IDF``."""
    return np.log((counts.rows + 1.0) / (counts.docs + 1.0))


def weights_model(context, counts, source, target):
    """The weights as a model of Spark ML."""
    jvm = context._jvm.org.apache.spark
    weights = jvm.mllib.linalg.Vectors.fromML(_py2java(context, Vectors.dense(weights_of(counts))))
    docs = _py2java(context, array.array("l", counts.docs.astype(np.int64).tolist()))
    own = jvm.ml.feature.IDFModel(_uid("IDF"), jvm.mllib.feature.IDFModel(weights, docs, counts.rows))
    return IDFModel(own).setInputCol(source).setOutputCol(target)


def regression_model(context, coefficients, intercepts, features, prediction):
    """Coefficients and intercepts as a model of Spark ML."""
    matrix = _py2java(context, DenseMatrix(*coefficients.shape, coefficients.ravel("F"), False))
    own = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        _uid("LogisticRegression"), matrix, _py2java(context, Vectors.dense(intercepts)), len(intercepts), True
    )
    return LogisticRegressionModel(own).setFeaturesCol(features).setPredictionCol(prediction)


def _uid(name):
    class Named(Identifiable):
        pass

    Named.__name__ = name
    return Named().uid

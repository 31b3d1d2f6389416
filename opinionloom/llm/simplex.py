"""Exact centroid clustering; distances to a few pivots rule out most centroids before vectors are compared."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import quoted, small_batches

#: Vectors that distances are kept to.
PIVOTS = 16
#: A pivot must stand off the others by this share of the largest distance between candidates, so that the simplex is not flat.
HEIGHT = 0.2
#: Components of this size or larger are an error: squared distances might not fit in 64 bits.
LARGEST = 1 << 27
#: Vectors whose differences are held at a time.
ROWS = 4096


def _solved(lower, right):
    """x with lower @ x = r for each row r; ``lower`` is a lower triangle (a few rows: no threads of a linear algebra library)."""
    found = np.empty_like(right)
    for i in range(len(lower)):
        rest = right[:, i].copy()
        for j in range(i):
            rest -= lower[i, j] * found[:, j]
        found[:, i] = rest / lower[i, i]
    return found


class Simplex:
    """The simplex of some pivots; a vector becomes an apex over it.

    The apex of a vector has its coordinates in the flat of the pivots, and its height above that flat.  Both follow
    from the distances to the pivots alone.  Between two vectors, the heights may point the same way or
    opposite ways; no other case lies outside, which bounds their distance from below and above.
    """

    def __init__(self, pivots):
        pivots = np.asarray(pivots, np.int64)
        square = lambda v: int((v.astype(object) ** 2).sum())
        most = max((square(a - pivots[0]) for a in pivots[1:]), default=0)
        chosen, corners = [0], np.zeros((1, 0))
        for i in range(1, len(pivots)):
            apart = np.array([[float(square(pivots[i] - pivots[j])) for j in chosen]])
            flat, height = self._over(corners, apart)
            if height[0] > HEIGHT**2 * most:
                corners = np.hstack([corners, np.zeros((len(corners), 1))])
                corners = np.vstack([corners, [[*flat[0], np.sqrt(height[0])]]])
                chosen.append(i)
        self.pivots, self.corners = pivots[chosen], corners
        # How far rounding may move a squared height, for squared distances of 1.
        lower = corners[1:]
        inverse = _solved(lower, np.eye(len(lower)))
        self.rounding = 1e-13 * max(1.0, (lower**2).sum() * (inverse**2).sum())

    @staticmethod
    def _over(corners, squares):
        """Coordinates in the flat of the corners, and the squared height, from squared distances to them."""
        if len(corners) == 1:
            return np.zeros((len(squares), 0)), squares[:, 0].copy()
        right = (squares[:, :1] - squares[:, 1:] + (corners[1:] ** 2).sum(axis=1)) / 2
        flat = _solved(corners[1:], right)
        return flat, np.maximum(squares[:, 0] - (flat**2).sum(axis=1), 0.0)

    def apexes(self, ints):
        """One row for each vector: coordinates, squared height, and its squared distance to the first pivot."""
        squares = np.stack([((ints - p) ** 2).sum(axis=1) for p in self.pivots], axis=1).astype(float)
        flat, height = self._over(self.corners, squares)
        return np.column_stack([flat, height, squares[:, 0]])

    def possible(self, apexes, centres):
        """For each vector and centre, whether the centre may be the nearest one."""
        flat = ((apexes[:, None, :-2] - centres[None, :, :-2]) ** 2).sum(axis=2)
        far = apexes[:, -1][:, None] + centres[:, -1][None] + (self.corners**2).sum(axis=1).max()
        slack = self.rounding * far
        a, b = apexes[:, -2][:, None], centres[:, -2][None]
        both = 2 * np.sqrt((a + slack) * (b + slack))
        low, high = flat + a + b - both - 4 * slack, flat + a + b + both + 4 * slack
        return low <= high.min(axis=1, keepdims=True)


def nearest(ints, apexes, simplex, centres, need_distance=True):
    """(cluster, squared distance, comparisons) of each vector; ties go to the smaller number.

    Whole vectors are compared with a centre only where the bounds leave more than this centre, or where the distance
    itself is needed.
    """
    centres = np.asarray(centres, np.int64)
    possible = simplex.possible(apexes, simplex.apexes(centres))
    open_ = np.ones(len(ints), bool) if need_distance else possible.sum(axis=1) > 1
    squares = np.where(possible, 0, np.iinfo(np.int64).max)
    compared = 0
    for c, centre in enumerate(centres):
        rows = np.flatnonzero(possible[:, c] & open_)
        compared += len(rows)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            squares[some, c] = ((ints[some] - centre) ** 2).sum(axis=1)
    cluster = squares.argmin(axis=1)
    return cluster, squares[np.arange(len(ints)), cluster], compared


def _matrix(column, width, kind):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(matrix):
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def whole_numbers(rows, vector, dims, scale):
    """The rows with ``_ints``: floor(scale * x) of each component; other vectors are left out.

    Left out are vectors that are null, have another length, or hold a null, NaN or infinite component.
    """
    wide = F.transform(F.col(quoted(vector)), lambda x: x.cast("double"))
    odd = F.exists("_ints", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("_ints", wide).where((F.size("_ints") == dims) & ~odd)
    large = F.exists("_ints", lambda x: F.abs(x) * F.lit(float(scale)) >= F.lit(float(LARGEST)))
    checked = F.when(large, F.raise_error(F.lit("a component is too large for 64-bit squared distances"))).otherwise(F.col("_ints"))
    return rows.withColumn("_ints", F.transform(checked, lambda x: F.floor(x * F.lit(float(scale)))))


def first_by_digest(numbers, salt, n):
    """The vectors whose key has the n smallest digests, in their order; a null key comes last, ties go by the vector."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256)
    first = numbers.select(digest.alias("digest"), "ints").orderBy(F.col("digest").asc_nulls_last(), "ints").limit(n)
    return [row["ints"] for row in first.collect()]


def cluster(rows, key="vec_id", vector="embedding", dims=64, k=8, rounds=10, scale=1024, salt="3", pivots=PIVOTS):
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector that takes part.

    Vectors of exactly ``dims`` components, none null or non-finite, become whole numbers, floor(scale * x); others take
    no part.  The first ``k`` vectors by the digest of ``salt:key`` are the first centroids (fewer vectors: fewer
    centroids).  In each round every vector goes to its nearest centroid by squared distance (ties: the smaller number),
    and every centroid that has vectors becomes the floor of their mean; an empty one stays.  ``distance`` is the squared distance to the
    final centroid, the inertias are its sums over the cluster and over all.

    Repeated rows are vectors each; rows with a null key take part like others, but start no cluster while others can.  No
    vectors at all give an empty table.  Components of 2**27 or more after scaling are an error.

    Distances to the pivots are computed once and kept as apexes; only (cluster, component) sums leave a task, so the
    shuffle of a round does not grow with the vectors and no cluster is gathered anywhere.
    """
    spark = rows.sparkSession
    small = small_batches(rows).select(F.col(quoted(key)).alias("key"), F.col(quoted(vector)).alias("_vector"))
    numbers = kept(whole_numbers(small, "_vector", dims, scale).select("key", F.col("_ints").alias("ints")), "whole-numbers")
    centres = np.array(first_by_digest(numbers, salt, k), np.int64).reshape(-1, dims)
    columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return numbers.select(F.col("key").alias(key), *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in columns.split(", ")])
    simplex = Simplex(first_by_digest(numbers, f"pivot-{salt}", pivots))
    kind = numbers.schema["key"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            apexes = simplex.apexes(_matrix(batch.column(1), dims, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(apexes)], ["key", "ints", "apex"])

    numbers = kept(numbers.mapInArrow(project, f"key {kind}, ints array<long>, apex array<double>"), "apexes")
    width = len(simplex.corners) + 1
    for _ in range(rounds):
        new = _moved(numbers, simplex, centres, dims, width)
        if np.array_equal(new, centres):
            break  # all further rounds are the same
        centres = new

    def assign(batches):
        for batch in batches:
            own, far, _ = nearest(_matrix(batch.column(1), dims, np.int64), _matrix(batch.column(2), width, float), simplex, centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(far, pa.int64())], ["key", "cluster", "distance"])

    done = kept(numbers.mapInArrow(assign, f"key {kind}, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["n"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    return done.select(
        F.col("key").alias(key), "cluster", "distance",
        of_cluster([sums.get(c, 0) for c in range(len(centres))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"),
    )


def _moved(numbers, simplex, centres, dims, width):
    """The centroids after one round."""

    def add(batches):
        for batch in batches:
            ints = _matrix(batch.column(1), dims, np.int64)
            own, _, _ = nearest(ints, _matrix(batch.column(2), width, float), simplex, centres, need_distance=False)
            order = np.argsort(own, kind="stable")
            found, first, n = np.unique(own[order], return_index=True, return_counts=True)
            if len(found):
                sums = np.add.reduceat(ints[order], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64()), _lists(sums)], ["cluster", "n", "sums"])

    parts = numbers.select("key", "ints", "apex").mapInArrow(add, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("place", "sum"))
    total = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    centres = centres.copy()
    for row in total.collect():  # at most one row for each component of each centroid
        centres[row["cluster"], row["place"]] = int(row["sum"]) // row["n"]
    return centres

"""Nearest-neighbour search in lists of similar vectors: most of a large table is never read.

Every stored vector belongs to the list of its most similar centroid.  A search reads the lists whose centroids are most similar to a
query and ranks their vectors exactly.  What a list can hold at best follows from its least similar vector, so a
search can also go on until no other list can hold a neighbour, which makes the result exact.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from opinionloom.operators.ranking import first_n_per_group
from opinionloom.operators.vectors import MOST_QUERY_BYTES, QUERIES_AT_ONCE, _best

# Centroids are learned from so many bytes of vectors at most; there are so many lists at most.
SAMPLE_BYTES, MOST_LISTS = 64 << 20, 4096
ROUNDS, SEED = 10, 17
# Similarities closer than this to a list's bound do not rule it out.
SLACK = 1e-6


def _units(matrix):
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _alike(a, b):
    """Inner products of the rows of two small matrices."""
    return np.einsum("id,jd->ij", a, b)


class ListIndex:
    """An index in a folder: ``vectors`` (list, id, embedding) in the order of the lists, and ``lists`` with their centroids."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()
        self.lists = [row["list"] for row in rows]
        self.centroids = np.array([row["centroid"] for row in rows], np.float64).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)
        self.least = np.array([row["least"] for row in rows], np.float64)
        self.sizes = [row["n"] for row in rows]

    @classmethod
    def build(cls, vectors, path, vector_id="vec_id", lists=None, sample_bytes=SAMPLE_BYTES):
        """Write the index of a table with ``embedding`` arrays of one length, and return it.

        ``lists`` is their number, by default about the square root of the rows.  Centroids are learned from a sample of at
        most ``sample_bytes``, chosen by a digest of the id; every vector is put into a list.  Vectors that are null, hold a
        null or non-finite component, or have length 0 have no similarity and are left out.
        """
        spark, path = vectors.sparkSession, path.rstrip("/")
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        known = vectors.select(vector_id, "embedding").where(F.col("embedding").isNotNull())
        known = known.where(~odd & F.exists("embedding", lambda x: x != 0))
        shape = known.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
        if shape["a"] != shape["b"]:
            raise ValueError("vectors of different lengths have no similarity; index them apart")
        dims = shape["a"] or 0
        wanted = min(lists or round(shape["n"] ** 0.5), MOST_LISTS)
        centroids = cls._learned(known, vector_id, wanted, max(1, sample_bytes // max(1, 8 * dims))) if shape["n"] else np.zeros((1, 1))
        kind = known.schema[vector_id].dataType.simpleString()

        def assign(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in blocks:
                if len(block):
                    alike = _units(np.stack(block["embedding"].to_numpy()).astype(np.float64)) @ centroids.T
                    block["list"], block["own"] = alike.argmax(axis=1), alike.max(axis=1)
                    yield block[["list", vector_id, "embedding", "own"]]

        placed = known.mapInPandas(assign, f"list int, `{vector_id}` {kind}, embedding array<float>, own double")
        # By ranges of list and id: a list lies together, and a large one in many files.
        placed.repartitionByRange("list", vector_id).sortWithinPartitions("list").write.parquet(f"{path}/vectors")
        found = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.min("own").alias("least"), F.count("*").alias("n"))
        named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        named.join(found, "list").write.parquet(f"{path}/lists")
        return cls(spark, path)

    @staticmethod
    def _learned(known, vector_id, lists, rows):
        """Unit centroids of a bounded sample, at most one for each of its vectors."""
        sample = known.orderBy(F.xxhash64(vector_id), vector_id).limit(rows)
        points = sample.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=max(2, lists), maxIter=ROUNDS, seed=SEED, distanceMeasure="cosine").fit(points)
        found = np.array(model.clusterCenters())
        return _units(found[(found * found).sum(axis=1) > 0])

    def search(self, queries, k, probes=8, exact=False, vector_id="vec_id"):
        """(query_id, id, similarity, rank): the ``k`` most similar vectors to each query, by cosine.

        Reads ``probes`` lists for each query, those with the most similar centroids, and compares all their vectors with
        it.  With ``exact`` it then reads all lists that might still hold one of the ``k`` too; equal similarities go to the smaller id.
        ``queries`` is a list of vectors given by the caller, like a search request.
        """
        asked = np.asarray(queries, dtype=np.float64)
        if asked.nbytes > MOST_QUERY_BYTES:
            raise ValueError("too many query vectors for one search; ask in parts")
        lengths = np.sqrt((asked * asked).sum(axis=1))
        if not (np.isfinite(lengths) & (lengths > 0)).all():
            raise ValueError("a query vector needs a finite length above 0")
        asked = asked / lengths[:, None]
        if not self.lists:
            return self._found(asked, np.zeros((len(asked), 0), bool), k, vector_id)
        alike = np.clip(_alike(asked, self.centroids), -1, 1)
        first = np.argsort(-alike, axis=1, kind="stable")[:, :probes]
        chosen = np.zeros(alike.shape, bool)
        np.put_along_axis(chosen, first, True, axis=1)
        found = self._found(asked, chosen, k, vector_id)
        if not exact:
            return found
        best = found.groupBy("query_id").agg(F.min("similarity").alias("last"), F.count("*").alias("n")).collect()
        last = np.full(len(asked), -np.inf)  # one number for each query
        for row in best:
            if row["n"] >= k:
                last[row["query_id"]] = row["last"]
        # The angle to a vector is at least the angle to its centroid less the widest angle in its list.
        angle = np.arccos(alike) - np.arccos(np.clip(self.least, -1, 1))
        most = np.cos(np.maximum(angle, 0))
        chosen |= most >= last[:, None] - SLACK
        return self._found(asked, chosen, k, vector_id)

    def _found(self, asked, chosen, k, vector_id):
        table = self.spark.read.parquet(f"{self.path}/vectors")
        ask = {number: np.flatnonzero(chosen[:, i]) for i, number in enumerate(self.lists) if chosen[:, i].any()}

        def best_of_task(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = {}
            for block in blocks:
                for number, rows in block.groupby("list"):
                    stored, ids = _units(np.stack(rows["embedding"].to_numpy()).astype(np.float64)), rows[vector_id].to_numpy()
                    own = ask[number]
                    for start in range(0, len(own), QUERIES_AT_ONCE):
                        some = own[start : start + QUERIES_AT_ONCE]
                        alike = stored @ asked[some].T
                        for column, query in enumerate(some.tolist()):
                            before = best.get(query, (ids[:0], alike[:0, 0]))
                            best[query] = _best(np.concatenate([before[0], ids]), np.concatenate([before[1], alike[:, column]]), k)
            for query, (ids, similarity) in best.items():
                yield pd.DataFrame({"query_id": query, vector_id: ids, "similarity": similarity})

        kind = table.schema[vector_id].dataType.simpleString()
        rows = table.where(F.col("list").isin(list(ask))).select("list", vector_id, "embedding")
        partial = rows.mapInPandas(best_of_task, f"query_id int, `{vector_id}` {kind}, similarity double")
        return first_n_per_group(partial, ["query_id"], [F.desc("similarity"), F.asc(vector_id)], k, spread_by=vector_id)


def recall(found, exact, vector_id="vec_id"):
    """The share of the exact neighbours that were found."""
    both = exact.select("query_id", vector_id).join(found.select("query_id", vector_id, F.lit(1).alias("hit")), ["query_id", vector_id], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]

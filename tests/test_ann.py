"""Search in lists against search in the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionloom.operators import ann
from opinionloom.operators.vectors import search_vectors

SCHEMA = "vec_id long, embedding array<float>"


def grouped(n, dims, groups, spread, seed=1):
    own = np.random.default_rng(seed)
    middles = own.normal(size=(groups, dims))
    return (middles[own.integers(0, groups, n)] + spread * own.normal(size=(n, dims))).astype(np.float32)


def table(spark, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], SCHEMA)


def rows(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["similarity"], 9)) for r in found.collect())


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall_and_the_exact_way(spark, tmp_path, spread):
    matrix = grouped(3000, 24, 30, spread)
    vectors, queries = table(spark, matrix), grouped(40, 24, 30, spread, seed=2)
    exact = search_vectors(vectors, queries, 10)
    index = ann.ListIndex.build(vectors, str(tmp_path / "index"), lists=40)
    assert sum(index.sizes) == 3000 and len(index.lists) > 20
    assert rows(index.search(queries, 10, probes=2, exact=True)) == rows(exact)
    some = index.search(queries, 10, probes=8 if spread < 1 else 28)
    assert ann.recall(some, exact) >= 0.9
    stored = {(r["query_id"], r["vec_id"]): r["similarity"] for r in search_vectors(vectors, queries, 3000).collect()}
    assert all(stored[r["query_id"], r["vec_id"]] == pytest.approx(r["similarity"]) for r in some.collect())
    again = ann.ListIndex(spark, str(tmp_path / "index"))
    assert rows(again.search(queries, 10, probes=40)) == rows(exact)


def test_few_lists_are_read(spark, tmp_path):
    index = ann.ListIndex.build(table(spark, grouped(2000, 8, 20, 0.05)), str(tmp_path / "index"), lists=20)
    plan = index.search(grouped(1, 8, 20, 0.05, seed=3), 5, probes=1)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(list, [" in plan or "PushedFilters: [IsNotNull(list), EqualTo(list," in plan


def test_hot_list_ties_and_awkward_vectors(spark, tmp_path):
    hot = [(i, [1.0, 2.0, 3.0]) for i in range(2000)] + [(2000 + i, [float(i % 7) - 3, 1.0, -2.0]) for i in range(500)]
    odd = [(9000, None), (9001, [1.0, None, 2.0]), (9002, [float("nan"), 1.0, 1.0]), (9003, [0.0, 0.0, 0.0]), (9004, [float("inf"), 1.0, 1.0])]
    vectors = spark.createDataFrame(hot + odd, SCHEMA)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # else such small files are merged
    try:
        index = ann.ListIndex.build(vectors, str(tmp_path / "index"), lists=12)
    finally:
        spark.conf.unset(name)
    files = spark.read.parquet(str(tmp_path / "index/vectors")).where("vec_id < 2000").select(F.col("_metadata.file_path")).distinct().count()
    assert sum(index.sizes) == 2500 and files > 1
    queries = [[1.0, 2.0, 3.0], [0.0, 1.0, -2.0], [-1.0, 0.0, 0.0]]
    exact = search_vectors(spark.createDataFrame(hot, SCHEMA), queries, 7)
    assert rows(index.search(queries, 7, probes=1, exact=True)) == rows(exact)
    assert [r["vec_id"] for r in index.search(queries[:1], 7, probes=1).orderBy("rank").collect()] == list(range(7))


def test_tables(spark, tmp_path):
    vectors = table(spark, grouped(5, 4, 2, 0.1))
    empty = ann.ListIndex.build(vectors.limit(0), str(tmp_path / "a"))
    assert empty.search([[1.0, 0.0, 0.0, 0.0]], 3, exact=True).collect() == []
    one = ann.ListIndex.build(vectors.limit(1), str(tmp_path / "b"))
    assert one.search([[1.0, 0.0, 0.0, 0.0]], 3, exact=True).count() == 1
    with pytest.raises(ValueError, match="lengths"):
        ann.ListIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="length above 0"):
        one.search([[0.0, 0.0, 0.0, 0.0]], 3)
    clashing = vectors.withColumn("list", F.lit("x")).withColumn("own", F.lit("y"))
    assert ann.ListIndex.build(clashing, str(tmp_path / "d"), lists=2).search([[1.0, 0.0, 0.0, 0.0]], 9, exact=True).count() == 5

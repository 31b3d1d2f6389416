import math
import random

import pytest
from pyspark.sql import functions as F

from opinionloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every, scale=64):
    ints = []
    for key, v in rows:
        if key is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v):
            ints.append((key, [math.floor(scale * x) for x in v]))
    out = []
    for q, a in ints:
        if q % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), c) for c, b in ints if c != q and len(a) == len(b)]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(n, dims, seed, spread=1.0):
    own = random.Random(seed)
    return [(i, [own.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


def run(spark, rows, k, every, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    import numpy as np

    rows = [(key, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for key, v in rows]
    found = topk.top_k(frame, is_query=F.col("vec_id") % every == 0, k=k, **options)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, k, every)


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "query_rows": 3}])
def test_same_as_brute_force(spark, options):
    run(spark, vectors(700, 16, 1, 0.2), 20, 20, **options)
    run(spark, vectors(130, 3, 2, 40.0), 5, 7, **options)


def test_ties_and_awkward_vectors(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(60)] + [(i, [0.0, 0.0, 0.0]) for i in range(60, 90)] + vectors(30, 3, 3)
    rows += [(200, None), (201, [1.0, None, 2.0]), (220, [1.0, float("nan"), 2.0]), (240, [1.0, float("inf"), 2.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (260, [1.0, 2.0]), (280, [3.0, -2.0]), (300, []), (320, []), (340, [1.0])]
    rows = [(i if key is not None and i < 120 else key, v) for i, (key, v) in enumerate(rows)]
    run(spark, rows, 20, 20)
    run(spark, rows, 20, 1, block_rows=17)


def test_tables(spark):
    frame = spark.createDataFrame(vectors(40, 4, 5), SCHEMA)
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame, is_query=F.col("vec_id") < 0).count() == 0
    assert topk.top_k(frame.limit(1)).count() == 0
    odd = frame.withColumn("key", F.lit("x")).withColumn("score", F.lit("y")).withColumn("a.b", F.lit(1))
    assert topk.top_k(odd, k=3).count() == 120
    twice = topk.top_k(frame.union(frame), k=100)
    assert twice.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 2 * 78

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionloom.llm import simplex

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, dims, k, rounds, scale=1024, salt="3"):
    """Every vector against every centroid, in whole numbers."""
    fit = lambda v: v is not None and len(v) == dims and not any(x is None or not math.isfinite(x) for x in v)
    own = [(key, [math.floor(scale * float(np.float32(x))) for x in v]) for key, v in rows if fit(v)]
    digest = lambda key: hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
    first = sorted(own, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))
    centres = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), i) for i, c in enumerate(centres)) for _, v in own]
    for _ in range(rounds):
        groups = {}
        for (_, i), (_, v) in zip(assign(), own):
            groups.setdefault(i, []).append(v)
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centres)]
    done = assign()
    sums = {i: sum(d for d, j in done if j == i) for i in range(len(centres))}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, i, d, sums[i], sum(sums.values()), marks[i]) for (key, _), (d, i) in zip(own, done)), key=repr)


def run(spark, rows, dims, k=8, rounds=4, **options):
    found = simplex.cluster(spark.createDataFrame(rows, SCHEMA), dims=dims, k=k, rounds=rounds, **options)
    got = sorted(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == brute(rows, dims, k, rounds)


def grouped(n, dims, seed, spread):
    own = random.Random(seed)
    middles = [[own.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [own.gauss(x, spread) for x in own.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_same_as_brute_force(spark, spread):
    run(spark, grouped(600, 12, 1, spread), 12)


def test_ties_repeats_and_awkward_vectors(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(40)] + [(i % 5, [1.0, 0.0, -1.0]) for i in range(30)] + grouped(60, 3, 2, 0.5)
    rows += [(None, [1.0, 1.0, 1.0]), (None, [7.0, 7.0, 7.0]), (200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0])]
    rows += [(203, [1.0, float("-inf"), 2.0]), (204, [1.0, 2.0]), (205, []), (206, [1.0, 2.0, 3.0, 4.0]), (207, [-0.0001, 1e-9, -5.0])]
    run(spark, rows, 3)
    run(spark, rows, 3, k=1)
    run(spark, [(i, [0.5, 0.5, 0.5]) for i in range(20)], 3)
    run(spark, [(None, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.5])], 3)


def test_tables(spark):
    frame = spark.createDataFrame(grouped(30, 4, 5, 1.0), SCHEMA)
    assert simplex.cluster(frame.limit(0), dims=4).collect() == [] and simplex.cluster(frame, dims=5).collect() == []
    names = simplex.cluster(frame, dims=4).columns
    assert simplex.cluster(frame.limit(0), dims=4).dtypes == simplex.cluster(frame, dims=4).dtypes
    odd = frame.selectExpr("vec_id as key", "embedding as ints", "1 as _ints", "2 as cluster", "3 as apex", "4 as distance", "5 as `a.b`", "6 as _vector")
    found = simplex.cluster(odd, key="key", vector="ints", dims=4)
    assert found.columns == ["key", *names[1:]]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, simplex.cluster(frame, dims=4).collect()))
    named = frame.withColumnRenamed("vec_id", "cluster")
    assert simplex.cluster(named, key="cluster", dims=4).count() == 30
    with pytest.raises(Exception, match="too large"):
        simplex.cluster(frame.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)), dims=4).collect()


@pytest.mark.parametrize("case", range(6))
def test_bounds_hold(case):
    """The centre that is nearest is always among the possible ones, also where vectors lie in the flat of the pivots."""
    own = np.random.default_rng(case)
    dims = int(own.integers(1, 40))
    pivots = own.integers(-1000, 1000, (10, dims)) if case % 2 else own.integers(-2, 3, (30, dims))
    ints = np.concatenate([own.integers(-1500, 1500, (2000, dims)), own.choice(pivots, 500), own.integers(-(1 << 26), 1 << 26, (200, dims))])
    centres = np.concatenate([own.choice(ints, 6), own.choice(pivots, 2), own.integers(-1500, 1500, (2, dims))])
    made = simplex.Simplex(pivots)
    want = ((ints[:, None].astype(object) - centres[None].astype(object)) ** 2).sum(axis=2)
    possible = made.possible(made.apexes(ints), made.apexes(centres))
    least = want.min(axis=1, keepdims=True)
    assert possible[want == least].all()
    cluster, distance, _ = simplex.nearest(ints, made.apexes(ints), made, centres)
    assert (distance == least[:, 0]).all() and (cluster == (want == least).argmax(axis=1)).all()
    moved, _, _ = simplex.nearest(ints, made.apexes(ints), made, centres, need_distance=False)
    assert (moved == cluster).all()


def test_centroids_are_ruled_out():
    """Of well parted groups, most are never compared."""
    rows = grouped(4000, 64, 7, 0.05)
    ints = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    made = simplex.Simplex(ints[:16])
    _, _, compared = simplex.nearest(ints, made.apexes(ints), made, ints[100:108])
    assert compared < 0.5 * 8 * len(ints)


def test_no_cluster_is_gathered(spark):
    """Sums leave the tasks, not vectors: what a round shuffles does not grow with the rows."""
    frame = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(1000)], SCHEMA).repartition(4)
    numbers = simplex.whole_numbers(frame.withColumnRenamed("vec_id", "key"), "embedding", 2, 4).select("key", F.col("_ints").alias("ints"))
    assert numbers.select("ints").distinct().collect()[0][0] == [1, 2]

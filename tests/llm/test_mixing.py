import re

import pytest
from pyspark.sql import functions as F
from rows import SCHEMA, awkward, prose, table

from opinionloom.llm import mixing


def expected_targets(sizes):
    """Water filling one source after the other; sizes by source, None last."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    target, total, free = {}, float(sum(sizes.values())), set(names)
    while free:
        unit = total / sum(weight[x] for x in free)
        over = {x for x in free if weight[x] * unit >= 3 * sizes[x]}
        if not over:
            return target | {x: weight[x] * unit for x in free}
        target |= {x: 3.0 * sizes[x] for x in over}
        total -= sum(target[x] for x in over)
        free -= over
    return target


def check(rows):
    sizes, taken, most, tied = {}, {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        tie = (r["source"], r["doc_id"], r["size"])
        tied[tie] = tied.get(tie, 0) + r["size"]
        most[r["source"]] = max(most.get(r["source"], 0), tied[tie])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
    target = expected_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for x in sizes:
        assert abs(taken[x] - target[x]) <= most[x] / 2 + 1e-6, (x, taken[x], target[x])


def test_targets_and_words(spark):
    texts = [prose(i, 5 + i * 7 % 60) for i in range(400)]
    rows = [(i, t, "en", ["a", "b", "é", None, "Z", "tiny"][0 if i % 3 == 0 else i % 6 if i > 6 else 5], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = mixing.mix(docs).collect()
    check(first)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in first}
    copies = sum(r["copies"] for r in first)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies


def test_awkward_rows(spark):
    docs = table(spark, awkward())
    check(mixing.mix(docs).collect())
    check(mixing.mix(docs.union(docs)).collect())
    check(mixing.mix(docs.withColumn("source", F.lit(None).cast("string"))).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(table(spark, [None, ""])).collect())
    odd = docs.withColumn("Size", F.lit("x")).withColumn("taken", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("doc_id", F.lit(None).cast("long"))
    done = mixing.mix(odd)
    assert sorted(done.columns) == sorted([*docs.columns, "a.b", "size", "source_size", "target", "copies", "taken"])
    assert done.count() == docs.count()
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_large_documents_are_preferred(spark):
    texts = [prose(i, 3) for i in range(300)] + [prose(i, 100) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "a" if i % 2 else "b", 0) for i, t in enumerate(texts)], SCHEMA)
    done = mixing.mix(docs).where("source = 'a'").groupBy(F.col("size") > 10).agg(F.avg("copies")).collect()
    share = dict(tuple(x) for x in done)
    assert share[True] > share[False]


def test_columns_named_like_those_of_the_rule(spark):
    docs = table(spark, [prose(i, 5 + i) for i in range(40)])
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "target", "taken").collect()))
    odd = docs
    for i, name in enumerate(["_s", "_p", "_t", "_rule", "_aim", "_size", "_copies", "_row", "_source", "_key", "left", "whole", "Taken", "a.b"]):
        odd = odd.withColumn(name, F.lit(i))
    found = mixing.mix(odd)
    assert sorted(map(tuple, found.select("doc_id", "size", "target", "taken").collect())) == want
    assert found.select("_rule", "`a.b`").distinct().collect() == [(3, 13)] and "Taken" not in found.columns
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(docs.limit(0)).collect() == []

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import awkward, prose, table

from opinionloom.llm import compression

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = compression.classify(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right >= 0.93
    again = {r["doc_id"]: r["score"] for r in compression.classify(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in found.collect())


def test_only_texts_and_learnable_labels_count(spark):
    texts = [prose(i, 60) if i % 2 else "buy now !!! " * 20 + prose(i, 5) for i in range(300)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], LABELS)
    first = {r["doc_id"]: r["score"] for r in compression.classify(docs, labels).collect()}
    assert sum((s >= 0.3) == (i % 2 == 1) for i, s in first.items()) > 285
    wrong = labels.withColumn("quality", F.when(compression.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    assert {r["doc_id"]: r["score"] for r in compression.classify(other, wrong).collect()} == first


def test_awkward_tables(spark):
    docs = table(spark, awkward())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 1), (5, 1, 0)], LABELS)
    odd = docs.union(docs).withColumn("Score", F.lit("x")).withColumn("_label", F.lit(1)).withColumn("a.b", F.lit(2))
    rows = compression.classify(odd, labels).collect()
    assert len(rows) == 2 * len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] is not None
    none = compression.classify(docs, labels.limit(0)).collect()
    assert {round(r["score"], 9) for r in none} == {0.5}
    ones = compression.classify(docs, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in ones}) == 1 and ones[0]["score"] > 0.9
    assert compression.classify(docs.limit(0), labels).count() == 0
    nulls = compression.classify(docs.withColumn("doc_id", F.lit(None).cast("long")), labels)
    assert [r["held_out"] for r in nulls.limit(2).collect()] == [False, False]


def test_calibration_rises():
    x = np.linspace(-1, 1, 400)
    y = (np.random.default_rng(1).random(400) < (x + 1) / 2).astype(float)
    weights = np.ones(400)
    model = compression.Model([], compression._logistic(x, y, weights), compression._rising(x, y, weights))
    scores = model.score(np.linspace(-1.5, 1.5, 100))
    assert (np.diff(scores) > 0).all() and 0 <= scores.min() and scores.max() <= 1
    assert np.abs(model.score(x) - (x + 1) / 2).mean() < 0.1
    assert compression.Model([], (0.0, 0.0), ([0.0], [0.5])).score([0.0])[0] == pytest.approx(0.5)


def test_long_texts_are_judged_whole(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = {0: [], 1: []}
    for r in docs.join(labels, "doc_id").where(compression.is_held_out("doc_id")).orderBy("doc_id").collect():
        if r["quality"] is not None and r["text"]:
            texts[r["quality"]].append(r["text"])
    own = np.random.default_rng(1)
    rows = [(i, "\n".join(own.choice(texts[i % 2], 150))) for i in range(8)]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    model = compression.fit(docs, labels)
    found = {r["doc_id"]: (r["s"], r["n"]) for r in long.select("doc_id", compression.scored(long, model).alias("s"), F.length("text").alias("n")).collect()}
    assert min(n for _, n in found.values()) > 150_000
    assert all((s >= 0.3) == (i % 2 == 1) for i, (s, _) in found.items()), found


def test_labels_with_long_texts_only(spark):
    texts = [prose(i, 60) if i % 2 else "buy now !!! " * 2000 + prose(i, 5) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    found = {r["doc_id"]: r["predicted"] for r in compression.classify(table(spark, texts), labels).collect()}
    assert sum(found[i] == i % 2 for i in found) > 110


def test_length_is_looked_at_before_the_draw(spark):
    texts = [prose(i, 60) if i % 2 or i >= 60 else "buy now !!! " * 2000 for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    assert compression.fit(table(spark, texts), labels, rows=20).pairs


def test_what_stands_deep_in_long_texts_is_learned(spark):
    words = [prose(seed, 300).split(" ") for seed in (1, 2)]
    deep = [" ".join(np.random.default_rng(i).choice(words[i % 2], 9000)) for i in range(60)]
    texts = [prose(1000 + i, 9000) + x for i, x in enumerate(deep)]
    assert min(map(len, texts)) > 80_000
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    found = {r["doc_id"]: r["predicted"] for r in compression.classify(table(spark, texts), labels, rows=30).collect()}
    assert sum(found[i] == i % 2 for i in found) > 54

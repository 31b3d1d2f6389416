"""Each stage against plain Python on what it was given, and the whole run."""

import corpus_pipeline
from rows import awkward, prose, table
from test_jaccard import brute_survivors
from test_mixing import expected_targets
from test_packing import check as check_packing
from test_packing import ids_of
from test_rules import brute_lines, brute_measures

from opinionloom.llm import repetition


def documents(spark):
    licence = "\n".join(prose(900 + i, 9) for i in range(4))
    texts = [*awkward(), *awkward()]
    for i in range(60):
        body = prose(i, 40 + i * 3)
        texts += [body + "\n" + licence, (body + "\n" + licence).replace(" ", "  ", 2), body + "\n" + prose(i + 500, 30)]
    return table(spark, texts)


def test_stages(spark):
    docs = documents(spark)
    columns, frames = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        docs = spark.createDataFrame(docs.toArrow()) if name != "packed_sequences" else docs
        frames.append(docs.collect())
        assert name == "packed_sequences" or docs.columns == columns
    given, good, lines, single, mixed, packed = frames

    def passes(text):
        m = brute_measures(text)
        shares = [(m["line_chars"], 30), *((m[f"chars_{n}"], x) for n, x in repetition.COVERAGE.items())]
        return m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"] and all(100 * n <= x * m["word_chars"] for n, x in shares)

    assert sorted(r["doc_id"] for r in good) == [r["doc_id"] for r in given if passes(r["text"])]
    good.sort(key=lambda r: r["doc_id"])
    want = {r["doc_id"]: x[2] for r, x in zip(good, brute_lines([r["text"] for r in good], 10))}
    assert {r["doc_id"]: r["text"] for r in lines} == want and all(r["n_chars"] == len(r["text"]) for r in lines)
    lines.sort(key=lambda r: r["doc_id"])
    # The smallest id of what links of a five-word Jaccard similarity of 0.8 or more join.
    stays = brute_survivors([r["text"] for r in lines])
    assert sorted(r["doc_id"] for r in single) == [lines[i]["doc_id"] for i in sorted(stays)] and len(single) < len(lines)
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in single}
    total, taken, largest = {}, {}, {}
    for r in single:
        total[r["source"]] = total.get(r["source"], 0) + size[r["doc_id"]]
        largest[r["source"]] = max(largest.get(r["source"], 0), size[r["doc_id"]])
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    assert max(sum(r["doc_id"] == i for r in mixed) for i in size) <= 3
    for source, target in expected_targets(total).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] / 2 + 1e-6
    tokens = sum(r["length"] for r in packed)
    assert tokens == sum(len(x) + 1 for x in ids_of([r["text"] for r in mixed]))
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-tokens // 2048) + 1


def test_whole_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows.columns)
    found = rows.collect()
    assert len(found) > 50 and [name for name, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_empty_and_clashing_tables(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    for some in (docs.limit(0), table(spark, [None, ""]), docs.withColumn("n_lines", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("a.b", F.lit(2))):
        for name, stage in corpus_pipeline.STAGES:
            columns = some.columns
            some = stage(spark, some, None)
            assert name == "packed_sequences" or some.columns == columns
        some.collect()


def test_packing_of_repeated_documents(spark):
    texts = awkward()
    docs = table(spark, texts)
    packed = corpus_pipeline.packed_sequences(spark, docs.union(docs.limit(0)), None).collect()
    check_packing(packed, texts, 2048)

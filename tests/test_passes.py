"""How often costly inputs are computed."""

import pytest
from pyspark.sql import functions as F

from opinionloom.functions import language
from opinionloom.functions import text as txt
from opinionloom.functions.scorers import lexicon_scorer
from opinionloom.operators import cleaning, lookup, stats, training
from opinionloom.plans import job, queries
from opinionloom.sources import readers
from opinionloom.sources.shared import Workspace


def counted(spark, rows, column):
    """The rows, and an accumulator of how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def see(value):
        seen.add(1)
        return value

    return rows.withColumn(column, F.udf(see, "string").asNondeterministic()(F.col(column))), seen


def test_rows_of_top_aspects_cuts_sentences_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0, f"a{i % 10}", "Positive", "text") for i in range(100)], "review_id long, sent_pos int, aspect string, label string, text string")
    rows, seen = counted(spark, rows, "aspect")
    monkeypatch.setattr(queries, "absa", lambda *_: rows)
    found = queries.rows_of_top_aspects(spark, "").collect()
    assert sorted({r["aspect"] for r in found}) == [f"a{i}" for i in range(8)] and len(found) == 80
    assert seen.value == 100


def test_a_classifier_is_trained_in_one_pass(spark):
    labels = ["Positive", "Negative", "Neutral"]
    rows = spark.createDataFrame([(f"{labels[i % 3]} {i % 7}", "a", labels[i % 3], "m", i, 0, 0) for i in range(120)], "text string, aspect string, label string, model_name string, review_id long, sent_pos int, aspect_ord int")
    rows, seen = counted(spark, training.training_set(rows), "text")
    _, metrics = training.train_classifier(rows, dimensions=2**8, penalties=(0.0, 0.1), iterations=5)
    assert metrics.first()["f1"] == 1.0
    assert seen.value == 120


def test_texts_are_not_copied_for_each_gram(spark):
    words = ["able", "ab", "größe", "zzzz", "x", "the end", "😀b"]
    texts = spark.createDataFrame([(i, t, i) for i, t in enumerate(["Unable to GRÖSSE größe", None, "", "the end 😀b x", "a", "zzz the\tend"] * 5)], "id long, text string, `a.b` long")
    terms = spark.createDataFrame([(w,) for w in [*words, " ", "d ", "to g", None]], "term string")
    found = lookup.table_matches(texts, "text", terms)
    words = [*words, " ", "d ", "to g"]
    want = {(r["id"], w) for r in texts.collect() for w in words if w in (r["text"] or "").lower()}
    assert {(r["id"], r["term"]) for r in found.collect()} == want and found.count() == len(want)
    # A join with the index got one row, with the whole text, for each gram.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_languages_need_no_regular_expression(spark):
    texts = ["we play, we rest", "wir spielen; wir ruhen", "a1b2", "größe\t日本語 テキスト 😀", "x-y_z", "!?", "", None]
    frame = spark.createDataFrame([("de" if i % 2 else "en", t) for i, t in enumerate(texts)], "lang string, text string")
    profile = language.learn_languages(frame)
    assert "regexp_replace" not in plan_of(frame.select(profile.detector()(F.col("text"))))
    assert "regexp_replace" not in plan_of(language.bucket_counts(frame))
    # All that is no letter counts as one space, as it does in letter_words.
    read = language.bucket_reader()
    spaced = frame.select(language.spaced_text(F.col("text")).alias("s"), language.letter_words(F.col("text")).alias("w")).collect()
    for row in spaced:
        (_, raw, _), (_, words, _) = next(read([row["s"]])), next(read([row["w"]]))
        assert raw.tolist() == words.tolist()


def test_a_run_stores_each_text_once(spark):
    rows = spark.createDataFrame([(i, "m", f"good phone {i // 2}") for i in range(6)], "review_id long, model string, original_review string")
    for translator, texts in ((None, {"cleaned_review"}), (F.upper, {"cleaned_review", "translated_review"})):
        with Workspace(spark) as space:
            done = job.run(rows, lexicon_scorer(), translator, space=space)
            stored = space._cached[0]
            assert {c for c in stored.columns if c.endswith("_review")} == {"original_review", *texts}
            found = done.scored.orderBy("review_id").collect()
        assert done.scored.columns == [
            "review_id", "model", "original_review", "cleaned_review", "translated_review", "final_review", "norm_review",
            "sentiment_score", "sentiment_label",
        ]
        said = "GOOD PHONE" if translator else "good phone"
        assert [r["final_review"] for r in found] == [f"{said} {i // 2}" if i % 2 == 0 else None for i in range(6)]
        assert [r["translated_review"] for r in found] == [f"{said} {i // 2}" for i in range(6)]
        assert [r["norm_review"] for r in found] == [f"good phone {i // 2}" for i in range(6)]
        assert [r["sentiment_label"] for r in found] == ["Positive" if i % 2 == 0 else None for i in range(6)]


@pytest.mark.parametrize("format, ending", [("parquet", ".zstd.parquet"), ("csv", ".csv.gz")])
def test_a_written_run_keeps_no_texts_on_the_executors(spark, tmp_path, format, ending):
    texts = ["good camera", "GOOD camera", "bad price <b>x</b>, poor", None, "", "ok", 'a "quoted", good\nline']
    rows = spark.createDataFrame([(i, f"m{i % 3}", t, "x") for i, t in enumerate(texts * 3)], "review_id long, model string, original_review string, lang string")
    info = spark.sparkContext._jsc.sc().getRDDStorageInfo
    spark.catalog.clearCache()
    with Workspace(spark) as space:
        done = job.run(rows, lexicon_scorer(), space=space)
        lazy = [sorted(map(str, table.collect())) for table in (done.scored, done.stats, done.feedback, done.aspects)]
    spark.catalog.clearCache()
    with Workspace(spark) as space:
        done = job.run(rows, lexicon_scorer(), space=space)
        paths = done.write(str(tmp_path), format)
        assert not [x for x in info() if x.diskSize() or x.memSize()]
        assert [sorted(map(str, table.collect())) for table in (done.stats, done.feedback)] == lazy[1:3]
        if format == "parquet":
            assert sorted(map(str, spark.read.parquet(paths["sentiment_output"]).collect())) == lazy[0]
            assert sorted(map(str, spark.read.parquet(paths["absa_training_dataset"]).collect())) == lazy[3]
        again, _ = readers.load_scored(spark, paths["sentiment_output"], paths["absa_training_dataset"])
        assert {r["review_id"]: r["sentiment_label"] for r in again.collect()} == {r["review_id"]: r["sentiment_label"] for r in done.scored.collect()}
    assert all(p.name.endswith(ending) for p in tmp_path.glob("sentiment_output*/part-*"))


@pytest.mark.parametrize("sent", [cleaning.IDS_SENT, 0])
def test_first_reviews_are_found_without_moving_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(cleaning, "IDS_SENT", sent)
    ids = [0, 1, 7, 8, -1, -8, -32768, 32768, 32769, 2**40, 2**63 - 1, -(2**63), 5, 6, None, None]
    rows = [(x, f"m{n % 2}", [None, "Same ", "same", f"own {n % 7}"][n % 4]) for n, x in enumerate(ids)]
    for given in (rows, rows + rows, [*rows, (5, "m0", "another text"), (5, "m1", "one more")], rows[:0]):
        frame = spark.createDataFrame(given, "review_id long, model string, t string")
        with Workspace(spark) as space:
            found = cleaning.with_first_sent(frame, space.kept, text="t")
            assert found.columns == [*frame.columns, "_first"]
            assert sorted(map(str, found.collect())) == sorted(map(str, cleaning.with_first(frame, text="t").collect()))
            moved = [line for line in plan_of(found).splitlines() if "Exchange" in line and "t#" in line]
            assert sent == 0 or len(given) == len(rows) + 2 or not moved


def test_statistics_of_stored_reviews_are_the_same(spark, monkeypatch):
    rows = [(i, f"m{i % 3}" if i % 11 else None, " ".join(f"word{i * j % (5 + j)}" for j in range(1, 9)), i % 5 + 1.0, ["Positive", "Negative", "Neutral", None][i % 4]) for i in range(300)]
    frame = spark.createDataFrame(rows, "review_id long, model string, final_review string, sentiment_score double, sentiment_label string")
    known = sorted(map(str, stats.model_stats(frame).collect()))
    counted = []
    sketched = stats.top_keywords_sketched
    monkeypatch.setattr(stats, "top_keywords_sketched", lambda *a, **b: counted.append(b) or sketched(*a, **b))
    assert sorted(map(str, stats.model_stats(frame, stored=True).collect())) == known and len(counted) == 1
    monkeypatch.setattr(stats, "GROUPS", 3)
    assert sorted(map(str, stats.model_stats(frame, stored=True).collect())) == known and len(counted) == 1


def test_places_of_keywords_are_decimals_only_for_large_ids(spark):
    ids = [0, 5, -7, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 2**62, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i, f"w{n % 3}ord sturdy item{n}") for n, i in enumerate(ids)], "review_id long, final_review string")
    found = stats.keyword_counts(rows)
    assert "min(cast(" not in plan_of(found)
    want = {}
    for n, i in enumerate(ids):
        for pos, word in enumerate([f"w{n % 3}ord", "sturdy", f"item{n}"]):
            want.setdefault(word, []).append(i * stats.POSITIONS + pos)
    assert {r["word"]: (r["uses"], int(r["first_place"])) for r in found.collect()} == {w: (len(p), min(p)) for w, p in want.items()}


def test_cleaned_texts_are_judged_without_their_letters_being_cut_out(spark):
    texts = ["good phone", "a.b", "...,,,...,,,abc", "._,abc__", "1,2.3", "a_b_c_d_e", "größe 日本 😀", "lol ok", "", None, "a  b\u2003c", ". . . . . . . . abc", "x" * 9 + "." * 21]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("c", txt.clean_text(F.col("t")))
    judged = frame.select("c", txt.is_meaningless(F.col("c")).alias("a"), txt.is_meaningless(F.col("c"), signs=txt.CLEAN_SIGNS).alias("b"))
    rows = judged.collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and {r["a"] for r in rows} == {True, False}
    plan = plan_of(cleaning.preprocess_reviews(frame.select(F.col("t").alias("original_review"))))
    assert txt.NOT_ALNUM not in plan


def test_summaries_are_made_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 3}", "Positive", f"m{i % 4}") for i in range(60)], "aspect string, label string, model_name string")
    rows, seen = counted(spark, rows, "model_name")
    job.publish_summaries(rows, str(tmp_path / "summaries"))
    assert seen.value == 60


def test_embeddings_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(text):
        calls.add(1)
        return [1.0, 2.0]

    rows = spark.createDataFrame([(i, "m", f"good phone {i}", "Positive", 5.0) for i in range(30)], "review_id long, model string, final_review string, sentiment_label string, sentiment_score double")
    job.publish_embeddings(rows, str(tmp_path / "vectors"), F.udf(embed, "array<float>").asNondeterministic())
    assert calls.value == 30


def test_only_translated_texts_are_cleaned_again(spark, monkeypatch):
    texts = ["good phone", "bon phone", "htt#p://x.y z", "ww#w.x y good phone", "", None, "lol", "a <b> c... d", "!?"]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id int, original_review string")
    prepared = cleaning.preprocess_reviews(rows)

    def bon(text):
        return F.when(text.contains("bon"), F.concat(text, F.lit(" !!")))

    done = cleaning.translate_reviews(prepared, bon, lang=None).orderBy("review_id").collect()
    # A link that was broken by a symbol is dropped by the second cleaning.
    assert [r["translated_review"] for r in done] == ["good phone", "bon phone", None, "y good phone", None, None, None, "a c. d", None]
    known = cleaning.translate_reviews(prepared.where("review_id in (0, 7)"), bon, lang=None)
    monkeypatch.setattr(txt, "clean_text", lambda text: F.raise_error(F.lit("cleaned again")).cast("string"))
    again = cleaning.translate_reviews(prepared.where("review_id in (0, 7)"), bon, lang=None)
    assert sorted(map(str, again.collect())) == sorted(map(str, known.collect()))

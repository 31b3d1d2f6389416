import pytest
from golden import COUNTS, REPORTS, STATISTICS
from pyspark.sql import functions as F

from opinionloom.functions import labels as lab
from opinionloom.functions.scorers import batch_scorer, batch_translator, lexicon_scorer
from opinionloom.operators import cleaning, dashboard, evidence, report, scoring, stats
from opinionloom.operators.aspects import (
    aspect_pivot,
    aspect_rows,
    clause_aspects,
    clauses_gathered,
    clauses_in_place,
    insight_lines,
    vocabulary_matches,
)
from opinionloom.operators.ranking import first_n_per_group
from opinionloom.plans.job import final_reviews


def raw(spark, rows):
    return spark.createDataFrame(rows, "review_id bigint, model string, original_review string")


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "review_id bigint, model string, final_review string, sentiment_score double, sentiment_label string"
    )


def by_id(rows, column, key="review_id"):
    return {r[key]: r[column] for r in rows.collect()}


DUPLICATES = [
    (1, "a", "Great phone"), (2, "a", "great PHONE!"), (3, "b", "Great phone"), (4, "a", None), (5, "a", "ok lol"),
    (6, "a", "nan nan"), (7, None, "lonely text"), (8, None, "lonely text"), (9, "a", "Great phone "), (10, "a", "nan"),
]


@pytest.mark.parametrize("keep", [True, False])
def test_repeats_per_model(spark, keep):
    final = by_id(final_reviews(raw(spark, DUPLICATES), keep=keep), "final_review")
    assert final == {
        1: "Great phone", 2: None, 3: "Great phone", 4: None, 5: None, 6: "nan nan", 7: "lonely text", 8: None,
        9: None, 10: None,
    }


def test_marking_repeats_twice_changes_nothing(spark):
    once = final_reviews(raw(spark, DUPLICATES))
    twice = cleaning.mark_repeats(once.drop("norm_review"))
    assert by_id(once, "final_review") == by_id(twice, "final_review")


def test_order_of_rows_does_not_matter(spark):
    rows = raw(spark, DUPLICATES)
    mixed = rows.repartition(7).orderBy(F.desc("review_id"))
    assert by_id(final_reviews(rows), "final_review") == by_id(final_reviews(mixed), "final_review")


def test_a_third_of_all_rows_in_one_group(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("review_id"), F.lit("m").alias("model"),
        F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("original_review"),
    )
    final = final_reviews(rows)
    assert final.where(F.col("final_review").isNotNull()).count() == 2001
    assert final.where("final_review = 'same text'").first()["review_id"] == 0


def test_quality_report(spark):
    prepared = cleaning.translate_reviews(cleaning.preprocess_reviews(raw(spark, DUPLICATES)))
    # Missing texts count as repeats of one another, and of a review that reads 'nan'.
    assert cleaning.quality_report(prepared).first().asDict() == {
        "total_reviews": 10, "meaningless_reviews": 2, "repeated_reviews": 5,
    }
    assert cleaning.quality_report(prepared.limit(0)).first()["total_reviews"] == 0


def test_translation_sees_only_foreign_texts(spark):
    rows = spark.createDataFrame(
        [(1, "en", "hello there"), (2, "fr", "bonjour"), (3, None, "who knows"), (4, "de", "kaputt"), (5, "fr", None),
         (6, "unknown", "what is it"), (7, "fr", "weg")],
        "review_id bigint, lang string, cleaned_review string",
    )

    def load_model():
        def translate(texts):
            assert "hello there" not in texts
            table = {"bonjour": "good  day!!", "weg": "!!"}
            return [table.get(t) for t in texts]

        return translate

    translated = by_id(cleaning.translate_reviews(rows, batch_translator(load_model)), "final_review")
    assert translated == {
        1: "hello there", 2: "good day", 3: "who knows", 4: "kaputt", 5: None, 6: "what is it", 7: None,
    }


def test_failing_translator_keeps_texts(spark):
    def load_model():
        def translate(texts):
            raise OSError("no answer")

        return translate

    rows = spark.createDataFrame([(1, "fr", "bonjour")], "review_id bigint, lang string, cleaned_review string")
    kept_text = cleaning.translate_reviews(rows, batch_translator(load_model, on_error="keep"))
    assert by_id(kept_text, "final_review") == {1: "bonjour"}
    with pytest.raises(Exception, match="no answer"):
        cleaning.translate_reviews(rows, batch_translator(load_model)).collect()


RAW_LABELS = {
    "1 star": (1, "Negative", "Negative"), "2 stars": (2, "Negative", "Negative"), "3 stars": (3, "Neutral", "Neutral"),
    "4 stars": (4, "Positive", "Positive"), "5 stars": (5, "Positive", "Positive"), "Positive": (5, "Positive", "Positive"),
    "NEGATIVE": (1, "Negative", "Negative"), "neutral": (3, "Neutral", "Neutral"), "LABEL_0": (3, "Neutral", "Neutral"),
    "LABEL_1": (3, "Neutral", "Negative"), "LABEL_2": (3, "Neutral", "Negative"), "LABEL_4": (3, "Neutral", "Positive"),
}


def test_raw_labels(spark):
    rows = spark.createDataFrame([(k,) for k in RAW_LABELS] + [(None,)], "raw string")
    stars = lab.stars_of_raw_label(F.col("raw"))
    found = rows.select("raw", stars.alias("s"), lab.label_of_stars(stars).alias("l"), lab.display_label(F.col("raw")).alias("d"))
    for r in found.collect():
        assert (r["s"], r["l"], r["d"]) == RAW_LABELS.get(r["raw"], (None, None, None))


def test_label_ids(spark):
    rows = spark.createDataFrame([("Negative",), ("Neutral",), ("Positive",), ("other",)], "l string")
    assert [r[0] for r in rows.select(lab.label_id(F.col("l"))).collect()] == [0, 1, 2, None]


def test_lexicon_scorer(spark):
    rows = spark.createDataFrame(
        [(1, "Great, great camera but bad"), (2, "greatness"), (3, "BAD!"), (4, "good bad"), (5, None), (6, "")],
        "review_id bigint, final_review string",
    )
    scores = rows.select("review_id", lexicon_scorer()(F.col("final_review")).alias("s"))
    assert by_id(scores, "s") == {
        1: ("Positive", 2 / 3), 2: ("Neutral", 0.0), 3: ("Negative", 1.0), 4: ("Neutral", 0.5), 5: None, 6: ("Neutral", 0.0),
    }
    labels = by_id(scoring.score_reviews(rows), "sentiment_label")
    assert labels == {1: "Positive", 2: "Neutral", 3: "Negative", 4: "Neutral", 5: None, 6: None}


def test_batch_scorer_batches_and_skips_missing_texts(spark):
    def load_model():
        def score(texts):
            assert 0 < len(texts) <= 4 and None not in texts and "" not in texts
            return [("4 stars" if "x" in t else "1 star", 0.25) for t in texts]

        return score

    rows = spark.range(50).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").when(F.col("id") % 2 == 0, "x").otherwise("y")
        .alias("final_review"),
    )
    labels = by_id(scoring.score_reviews(rows, batch_scorer(load_model, batch_size=4)), "sentiment_label")
    assert labels == {
        i: None if i % 5 < 2 else "Positive" if i % 2 == 0 else "Negative" for i in range(50)
    }


def test_failing_scorer(spark):
    def load_model():
        def score(texts):
            raise ValueError("broken")

        return score

    rows = spark.createDataFrame([(1, "text")], "review_id bigint, final_review string")
    neutral = scoring.score_reviews(rows, batch_scorer(load_model, on_error="neutral")).first()
    assert (neutral["sentiment_label"], neutral["sentiment_score"]) == ("Neutral", 3.0)
    with pytest.raises(Exception, match="broken"):
        scoring.score_reviews(rows, batch_scorer(load_model)).collect()


def test_overall_scores_skip_blank_texts(spark):
    rows = spark.createDataFrame([(1, "great"), (2, "  "), (3, None)], "review_id bigint, text string")
    assert by_id(scoring.score_overall(rows, "text"), "overall_sentiment") == {1: "Positive", 2: None, 3: None}


def test_aspect_rows(spark):
    rows = scored(spark, [
        (1, "m", "Battery life is bad. The camera and sound are fine.", 5.0, "Positive"),
        (2, "m", "Price", None, None), (3, "m", None, None, None), (4, "m", "nothing here", 1.0, "Negative"),
    ])
    found = [(r["review_id"], r["sent_pos"], r["aspect_ord"], r["aspect"], r["label"], r["text"])
             for r in aspect_rows(rows).orderBy("review_id", "sent_pos", "aspect_ord").collect()]
    second = "The camera and sound are fine."
    assert found == [
        (1, 0, 0, "battery", "Positive", "Battery life is bad."), (1, 1, 0, "camera", "Positive", second),
        (1, 1, 1, "sound", "Positive", second), (2, 0, 0, "price", "Neutral", "Price"),
    ]

    def by_sentence(text):
        raw_label = F.when(text.contains("bad"), "1 star").otherwise("Positive")
        return F.struct(raw_label.alias("raw_label"), F.lit(1.0).alias("confidence"))

    own = aspect_rows(rows, scorer=by_sentence).orderBy("review_id", "sent_pos", "aspect_ord").collect()
    assert [r["label"] for r in own] == ["Negative", "Positive", "Positive", "Neutral"]


REVIEW = "The camera is great but the battery is bad. Battery is awful! Love the screen. It is a thing."


def test_clause_tables(spark):
    rows = spark.createDataFrame([(1, REVIEW), (2, "It is."), (3, "..."), (4, None)], "review_id bigint, text string")
    table = clause_aspects(rows)
    found = [(r["review_index"], r["clause"], r["aspect"], r["sentiment"]) for r in
             table.orderBy("review_index", "clause_pos").collect()]
    assert found == [
        (1, "The camera is great", "Camera", "Positive"), (1, "the battery is bad", "Battery", "Negative"),
        (1, "Battery is awful", "Battery", "Negative"), (1, "Love the screen", "Display", "Positive"),
        (1, "It is a thing", "Design & Build", "Neutral"), (2, "It is", "Other", "Neutral"),
    ]
    expected = [
        (1, 0, "✅ **Camera**: The camera is great"), (1, 1, "✅ **Display**: Love the screen"),
        (1, 2, "⚠️ **Battery**: the battery is bad; Battery is awful"),
        (2, 0, "Overall tone is neutral with no strong praise or complaints detected."),
    ]
    gathered = insight_lines(clauses_gathered(table)).orderBy("review_index", "line_no").collect()
    assert [tuple(r) for r in gathered] == expected
    in_place = insight_lines(clauses_in_place(rows.where("review_id < 3"))).orderBy("review_index", "line_no").collect()
    assert [tuple(r) for r in in_place] == expected
    pivot = {r["aspect"]: (r["Positive"], r["Neutral"], r["Negative"], r["Negative_pct"]) for r in aspect_pivot(table).collect()}
    assert pivot["Battery"] == (0, 0, 2, 100.0) and pivot["Other"] == (0, 1, 0, 0.0)


def test_vocabulary_matches(spark):
    rows = spark.createDataFrame([(1, "A red-hot day"), (2, "cold")], "i int, text string")
    found = sorted((r["i"], r["term"]) for r in vocabulary_matches(rows, "text", ["hot", "red", "hot day", "old"]).collect())
    assert found == [(1, "hot"), (1, "hot day"), (1, "red"), (2, "old")]


def test_keywords_break_ties_by_first_use(spark):
    rows = scored(spark, [
        (5, "m", "zebra apple zebra", 5.0, "Positive"), (2, "m", "mango apple the of xy", 5.0, "Positive"),
        (9, "m", "mango lemon", 1.0, "Negative"),
    ])
    ranked = {(r["sentiment_label"], r["rank"]): (r["word"], r["uses"]) for r in stats.top_keywords(rows, ("model", "sentiment_label"), 3).collect()}
    assert ranked == {
        ("Positive", 1): ("apple", 2), ("Positive", 2): ("zebra", 2), ("Positive", 3): ("mango", 1),
        ("Negative", 1): ("mango", 1), ("Negative", 2): ("lemon", 1),
    }
    overall = [(r["word"], r["uses"]) for r in stats.top_keywords_overall(rows, 2).collect()]
    assert overall == [("mango", 2), ("apple", 2)]


@pytest.mark.parametrize("tracked", [4, 100, 10000])
def test_sketched_keywords_are_the_exact_ones(spark, tracked):
    """Sketches that are too small, even uses with many ties, a null group, a hot group and one with few words."""
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("m"), F.col("id") % 2))
    heavy, rare = F.expr("concat('word', cast(floor(pow(300, rand(3))) as string))"), F.expr("concat('rare', cast(id as string))")
    even = F.expr("concat('even', cast(id % 50 as string))")
    rows = spark.range(4000).select(
        F.col("id").alias("review_id"), group.alias("model"),
        F.when(group == "m1", even).otherwise(F.concat_ws(" ", heavy, heavy, rare)).alias("final_review"),
    )
    rows = rows.unionByName(spark.createDataFrame([(9000, "one", "only words here"), (9001, "one", None), (9002, "none", "")], rows.schema))
    rows = spark.createDataFrame(rows.collect(), rows.schema)

    def of(table):
        return sorted(map(str, table.select("model", "rank", "word", "uses", "first_place").collect()))

    assert of(stats.top_keywords_sketched(rows, ["model"], 5, tracked=tracked)) == of(stats.top_keywords(rows, ["model"], 5))
    everything = stats.top_keywords_sketched(rows, (), 5, tracked=tracked)
    assert [tuple(r) for r in everything.orderBy("rank").collect()] == [tuple(r) for r in stats.top_keywords(rows, (), 5).orderBy("rank").collect()]
    assert stats.top_keywords_sketched(rows.limit(0), ["model"], tracked=tracked).isEmpty()


def test_keywords_with_the_largest_ids(spark):
    rows = scored(spark, [(2**63 - 1, "m", "late early", 5.0, "Positive"), (2**63 - 2, "m", "early", 5.0, "Positive")])
    assert [r["word"] for r in stats.top_keywords_overall(rows, 1).collect()] == ["early"]


# model, total, positive, negative, neutral, mean stars, shares of all rows
def golden_reviews(spark):
    sizes = spark.createDataFrame([(i, *row[:2], *COUNTS[row[0]]) for i, row in enumerate(STATISTICS)], "o int, model string, t int, p int, n int, u int")
    rows = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("i"))
    label = (
        F.when(F.col("i") < F.col("p"), "Positive").when(F.col("i") < F.col("p") + F.col("n"), "Negative")
        .when(F.col("i") < F.col("p") + F.col("n") + F.col("u"), "Neutral")
    )
    stars = F.when(label == "Positive", 5.0).when(label == "Negative", 1.0).when(label == "Neutral", 3.0)
    return rows.select(
        (F.col("o") * 100_000 + F.col("i")).cast("bigint").alias("review_id"), "model", F.lit("fine text").alias("final_review"),
        stars.alias("sentiment_score"), label.alias("sentiment_label"),
    )


def test_golden_statistics(spark):
    found = stats.model_stats(golden_reviews(spark), "all").orderBy("first_review").collect()
    assert [
        (r["model"], r["total_reviews"], r["valid_cleaned_reviews"], r["average_sentiment_score"], r["pct_positive"],
         r["pct_negative"], r["pct_neutral"]) for r in found
    ] == [(m, t, v, mean, p, n, u) for m, t, v, p, n, u, mean, _, _ in STATISTICS]
    labelled = stats.model_stats(golden_reviews(spark)).collect()
    assert {r["model"]: r["valid_cleaned_reviews"] for r in labelled} == {model: sum(own) for model, own in COUNTS.items()}
    assert all(abs(r["pct_positive"] + r["pct_negative"] + r["pct_neutral"] - 100) < 0.02 for r in labelled)


def test_statistics_edge_cases(spark):
    rows = scored(spark, [(1, "none", "some text", None, None), (2, None, "lost", 5.0, "Positive")])
    assert stats.model_stats(rows).drop("first_review").collect()[0].asDict() == {
        "model": "none", "total_reviews": 1, "valid_cleaned_reviews": 0, "pct_positive": 0.0, "pct_negative": 0.0,
        "pct_neutral": 0.0, "average_sentiment_score": 0.0, "top_6_positive_keywords": "", "top_6_negative_keywords": "",
    }
    many = scored(spark, [(i, "m", "word", 5.0 if i == 0 else 3.0, "Positive" if i == 0 else "Neutral") for i in range(32)])
    assert stats.model_stats(many).first()["pct_positive"] == 3.12
    with pytest.raises(ValueError):
        stats.model_stats(rows, "other")


STATS = "model string, valid_cleaned_reviews bigint, pct_positive double, pct_negative double, pct_neutral double, " \
        "top_6_positive_keywords string, top_6_negative_keywords string, first_review bigint"


def test_golden_report(spark):
    rows = [(m, v, p, n, u, good, bad, i) for i, (m, _, v, p, n, u, _, good, bad) in enumerate(STATISTICS)]
    feedback = report.feedback_report(spark.createDataFrame(rows, STATS))
    found = {r["model"]: r for r in feedback.collect()}
    assert found.keys() == REPORTS.keys() and len(found) == 8
    for model, texts in REPORTS.items():
        names = ("summary", "strengths", "weaknesses", "recommendations", "full_report_text")
        assert tuple(found[model][name] for name in names) == texts
    parts = report.markdown_full(feedback).orderBy("part", "place").collect()
    text = "".join(r["value"] + "\n" for r in parts)
    assert text == "# Manufacturer Feedback Report\n\n" + "".join(
        f"## Model: {row[0]}\n{REPORTS[row[0]][4]}\n\n---\n\n" for row in STATISTICS
    )


def test_hand_made_report(spark):
    rows = spark.createDataFrame([("shoe", 50, 30.0, 60.0, 10.0, "", "shipping, photo, battery", 1), ("hat", 51, 75.0, 20.0, 5.0, "soft", "", 0)], STATS)
    hat, shoe = report.feedback_report(rows).orderBy("first_review").collect()
    assert "sentiment for hat is generally positive." in hat["summary"] and "High review volume" in hat["summary"]
    assert "sentiment for shoe is largely negative." in shoe["summary"] and "Low to moderate volume" in shoe["summary"]
    assert shoe["strengths"].endswith("No specific praise themes detected.") and shoe["recommendations"].count("\n- ") == 3
    bold = report.markdown_sections(report.feedback_report(rows)).orderBy("part", "place").collect()
    assert bold[1]["value"].startswith("## Model: hat\n**Summary**: 6.1 Summary\n")


@pytest.mark.parametrize("positive, tone", [
    (75.0, "generally positive"), (75.01, "overwhelmingly positive"), (50.0, "mixed"), (30.0, "largely negative"), (30.01, "mixed"),
])
def test_tones_are_strict(spark, positive, tone):
    rows = spark.createDataFrame([("m", 50, positive, 0.0, 0.0, "", "", 1)], STATS)
    summary = report.feedback_report(rows).first()["summary"]
    assert f"is {tone}. " in summary and summary.endswith("Low to moderate volume—insights may be limited.")


@pytest.mark.parametrize("words, rules, lines", [
    ("foo", 0, 3), ("screens", 1, 3), ("drain, price, photos", 3, 3),
    ("battery, crack, cost, camera, shipping, support", 6, 6), ("Expensive, DISPLAY", 2, 3),
])
def test_advice(spark, words, rules, lines):
    found = spark.createDataFrame([(words,)], "w string").select(report.advice_list(F.col("w"))).first()[0]
    general = {"Marketing: Highlight", "Engagement: packagin", "Trust: Respond publi"}
    assert len(found) == lines and len([line for line in found if line[:20] not in general]) == rules


def test_dashboard(spark):
    rows = scored(spark, [
        (1, "a", "x", 5.0, "Positive"), (2, "a", "x", 1.0, "Negative"), (3, "b", "x", 3.0, "Neutral"), (4, "a", None, None, None),
    ])
    kpi = dashboard.kpi_row(rows).first()
    assert (kpi["total_reviews"], kpi["average_rating"], kpi["positive_pct"]) == (4, 3.0, 25.0)
    assert (kpi["average_rating_text"], kpi["negative_text"]) == ("3.0 ★", "25.0%")
    assert dashboard.kpi_row(rows, "b").first()["total_reviews"] == 1
    assert {r[0]: r[1] for r in dashboard.label_distribution(rows).collect()} == {"Positive": 1, "Negative": 1, "Neutral": 1}
    known = dashboard.known_models((rows, "model"), (rows.selectExpr("'zz' as m"), "m"))
    assert [r[0] for r in known.collect()] == ["a", "b", "zz"]


def test_nothing_in_gives_nothing_out(spark):
    none = scored(spark, [])
    kpi = dashboard.kpi_row(none).first()
    assert (kpi["total_reviews"], kpi["average_rating"], kpi["positive_pct"], kpi["positive_text"]) == (0, None, None, None)
    assert report.feedback_report(stats.model_stats(none)).isEmpty()
    assert stats.top_keywords_overall(none).isEmpty()
    assert final_reviews(raw(spark, [])).isEmpty()
    rows = spark.createDataFrame([(1, "fine words here")], "review_id bigint, text string")
    silent = batch_scorer(lambda: lambda texts: [(None, None) for _ in texts])
    unjudged = aspect_pivot(clause_aspects(rows, scorer=silent)).first()
    assert (unjudged["Total"], unjudged["Positive_pct"]) == (0, None)


ASPECTS = "text string, aspect string, label string, model_name string, review_id bigint, sent_pos int, aspect_ord int"


def test_crosstab_keeps_the_top_aspects(spark):
    rows = spark.createDataFrame(
        [("t", f"a{i}", "Positive" if j else "Negative", "m", j, 0, 0) for i in range(9) for j in range(i + 1)], ASPECTS
    )
    found = {r["aspect"]: (r["Negative"], r["Positive"]) for r in dashboard.aspect_crosstab(rows).collect()}
    assert set(found) == {f"a{i}" for i in range(1, 9)}
    assert found["a3"] == (25.0, 75.0)
    assert dashboard.rows_of_top_aspects(rows).count() == rows.count() - 1


def test_first_records_and_summaries(spark):
    rows = spark.createDataFrame(
        [(f"text {i}", "battery" if i % 2 else "price", "Negative" if i % 2 else "Positive", "m", 500 - i, 0, 0) for i in range(300)]
        + [("x", None, None, "n", 1, 0, 0)], ASPECTS
    )
    records = evidence.payload_records(evidence.first_records(rows)).where("model = 'm'").orderBy("review_id").collect()
    assert [r["review_id"] for r in records] == list(range(100))
    assert records[0]["review_text"] == "text 299" and records[0]["sentiment"] == "negative"
    other = evidence.payload_records(evidence.first_records(rows)).where("model = 'n'").first()
    assert (other["aspect"], other["sentiment"], other["confidence"]) == ("General", "neutral", 0.95)
    summaries = evidence.business_summaries(evidence.aspect_shares(rows.where("model_name = 'm'")))
    body = evidence.parse_summaries(evidence.summary_json(summaries)).first()["business_summary"]
    assert [s["aspect"] for s in body["key_strengths"]] == ["price"]
    assert [(i["aspect"], i["priority"]) for i in body["key_issues"]] == [("battery", "HIGH")]
    assert body["recommendations"][0]["linked_aspects"] == ["battery"]


def test_summary_lines_fill_in_defaults(spark):
    texts = spark.createDataFrame([
        ('{"model": "m", "business_summary": {"key_issues": [{"summary": "s"}], "key_strengths": [{"aspect": "a"}]}}',)
    ], "summary_json string")
    lines = evidence.summary_lines(evidence.parse_summaries(texts)).orderBy("line_no").collect()
    assert [(r["section"], r["title"], r["priority"], r["text"], r["note"]) for r in lines] == [
        ("overview", None, None, "No overview available.", None),
        ("strength", "a", None, "", "Positive: N/A • Negative: N/A"),
        ("issue", "Feature", "MEDIUM", "s", "Negative: N/A • Positive: N/A"),
    ]


def test_first_n_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id"), (-F.col("id")).alias("o"))
    for spread in (None, "id"):
        found = first_n_per_group(rows, ["g"], [F.col("o")], 3, spread_by=spread).orderBy("rank").collect()
        assert [(r["id"], r["rank"]) for r in found] == [(4999, 1), (4998, 2), (4997, 3)]

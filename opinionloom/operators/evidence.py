"""Business summaries: the records sent to a writer, and the figures behind a summary."""

from pyspark.sql import functions as F

from opinionloom.functions import vocab
from opinionloom.functions.vocab import NEGATIVE, NEUTRAL, POSITIVE
from opinionloom.operators.ranking import first_n_per_group

# Our own bands: the share from which an aspect is a strength, and the priorities of issues.
STRENGTH_SHARE = 0.5
PRIORITIES = ((0.5, "HIGH"), (0.25, "MEDIUM"))
LOWEST_PRIORITY = "LOW"

SHARES_TYPE = "struct<positive_share: double, negative_share: double>"
SUMMARY_TYPE = f"""
    model string,
    business_summary struct<
        executive_overview: string,
        key_strengths: array<struct<aspect: string, summary: string, supporting_sentiment: {SHARES_TYPE}>>,
        key_issues: array<struct<aspect: string, priority: string, summary: string,
                                 supporting_sentiment: {SHARES_TYPE}>>,
        recommendations: array<struct<title: string, description: string, linked_aspects: array<string>,
                                      expected_impact: string>>>
"""

READING_ORDER = ("review_id", "sent_pos", "aspect_ord")


def first_records(aspects, n=100):
    """The first ``n`` aspect rows of each model, numbered from 0 as ``record_id``."""
    named = aspects.where(F.col("model_name").isNotNull())
    first = first_n_per_group(
        named, ["model_name"], [F.col(c) for c in READING_ORDER], n, rank="_rank", spread_by="review_id"
    )
    return first.withColumn("record_id", F.col("_rank") - 1).drop("_rank")


def payload_records(records):
    """The records as a writer gets them, with defaults for what is missing."""
    return records.select(
        F.col("model_name").alias("model"),
        F.col("record_id").cast("int").alias("review_id"),
        F.coalesce("text", F.lit("")).alias("review_text"),
        F.coalesce("aspect", F.lit("General")).alias("aspect"),
        F.lower(F.coalesce("label", F.lit(NEUTRAL))).alias("sentiment"),
        F.lit(vocab.PAYLOAD_CONFIDENCE).alias("confidence"),
    )


def payloads(aspects, n=100):
    """One JSON text per model with its first ``n`` records (so a group is never larger)."""
    records = payload_records(first_records(aspects, n))
    fields = F.struct("review_id", "review_text", "aspect", "sentiment", "confidence")
    return records.groupBy("model").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("payload"))


def aspect_shares(aspects):
    """Rows, positive share and negative share per model and aspect."""
    named = aspects.where(F.col("model_name").isNotNull())
    label = F.coalesce(F.col("label"), F.lit(NEUTRAL))
    return named.groupBy(F.col("model_name").alias("model"), "aspect").agg(
        F.count("*").alias("mentions"),
        F.avg((label == POSITIVE).cast("double")).alias("positive_share"),
        F.avg((label == NEGATIVE).cast("double")).alias("negative_share"),
    )


def priority(negative_share):
    """Priority of an issue by its negative share."""
    level = F.lit(LOWEST_PRIORITY)
    for bound, name in reversed(PRIORITIES):
        level = F.when(negative_share >= bound, F.lit(name)).otherwise(level)
    return level


def business_summaries(shares):
    """One nested summary per model from ``aspect_shares``; a model has one row per vocabulary aspect."""
    sentiment = F.struct("positive_share", "negative_share")
    percent = [F.format_number(F.col(f"{side}_share") * 100, 1) for side in ("positive", "negative")]
    strength = F.struct(
        (-F.col("positive_share")).alias("_order"), F.col("aspect"),
        F.format_string("%s%% of %d mentions are positive.", percent[0], "mentions").alias("summary"),
        sentiment.alias("supporting_sentiment"),
    )
    issue = F.struct(
        (-F.col("negative_share")).alias("_order"), F.col("aspect"),
        priority(F.col("negative_share")).alias("priority"),
        F.format_string("%s%% of %d mentions are negative.", percent[1], "mentions").alias("summary"),
        sentiment.alias("supporting_sentiment"),
    )
    per_model = shares.groupBy("model").agg(
        F.sum("mentions").alias("mentions"),
        F.count("*").alias("aspects"),
        F.array_sort(F.collect_list(F.when(F.col("positive_share") >= STRENGTH_SHARE, strength))).alias("strengths"),
        F.array_sort(F.collect_list(F.when(F.col("negative_share") > 0, issue))).alias("issues"),
    )
    overview = F.format_string(
        "%s: %d mentions of %d aspects, %d strengths and %d issues.",
        "model", "mentions", "aspects", F.size("strengths"), F.size("issues"),
    )
    urgent = F.filter("issues", lambda i: i["priority"] != LOWEST_PRIORITY)
    advice = F.transform(
        urgent,
        lambda i: F.struct(
            F.concat(F.lit("Improve "), i["aspect"]).alias("title"),
            i["summary"].alias("description"),
            F.array(i["aspect"]).alias("linked_aspects"),
            F.concat(F.lit("Fewer complaints about "), i["aspect"]).alias("expected_impact"),
        ),
    )
    summary = F.struct(
        overview.alias("executive_overview"),
        F.transform("strengths", lambda s: s.dropFields("_order")).alias("key_strengths"),
        F.transform("issues", lambda i: i.dropFields("_order")).alias("key_issues"),
        advice.alias("recommendations"),
    )
    return per_model.select("model", summary.alias("business_summary"))


def summary_json(summaries):
    """Summaries as one JSON text per model."""
    return summaries.select("model", F.to_json(F.struct("model", "business_summary")).alias("summary_json"))


def parse_summaries(texts, column="summary_json"):
    """Summaries from JSON texts; a text that is not JSON gives NULL fields."""
    parsed = F.from_json(F.col(column), SUMMARY_TYPE)
    return texts.select(parsed["model"].alias("model"), parsed["business_summary"].alias("business_summary"))


def summary_lines(summaries):
    """What a reader is shown: one row per overview, strength, issue and recommendation.

    Missing parts get the reader's fixed defaults.
    """
    body = F.col("business_summary")
    overview = F.struct(
        F.lit("overview").alias("section"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("priority"),
        F.coalesce(body["executive_overview"], F.lit("No overview available.")).alias("text"),
        F.lit(None).cast("string").alias("note"),
    )
    strengths = F.transform(
        _or_empty(body["key_strengths"]), lambda s: _point("strength", s, F.lit(None).cast("string"), POSITIVE, NEGATIVE)
    )
    issues = F.transform(
        _or_empty(body["key_issues"]),
        lambda i: _point("issue", i, F.coalesce(i["priority"], F.lit("MEDIUM")), NEGATIVE, POSITIVE),
    )
    advice = F.transform(
        _or_empty(body["recommendations"]),
        lambda r: F.struct(
            F.lit("recommendation").alias("section"),
            F.coalesce(r["title"], F.lit("Recommendation")).alias("title"),
            F.lit(None).cast("string").alias("priority"),
            F.coalesce(r["description"], F.lit("")).alias("text"),
            F.coalesce(r["expected_impact"], F.lit("")).alias("note"),
        ),
    )
    lines = summaries.select("model", F.posexplode(F.concat(F.array(overview), strengths, issues, advice)))
    return lines.select("model", F.col("pos").alias("line_no"), "col.*")


def _point(section, item, level, first, second):
    shares = item["supporting_sentiment"]
    shown = [
        F.concat(
            F.lit(f"{side}: "),
            F.coalesce(shares[f"{side.lower()}_share"].cast("string"), F.lit("N/A")),
        )
        for side in (first, second)
    ]
    return F.struct(
        F.lit(section).alias("section"),
        F.coalesce(item["aspect"], F.lit("Feature")).alias("title"),
        level.alias("priority"),
        F.coalesce(item["summary"], F.lit("")).alias("text"),
        F.concat_ws(" • ", *shown).alias("note"),
    )


def _or_empty(array):
    return F.coalesce(array, F.filter(array, lambda _: F.lit(False)), F.array())

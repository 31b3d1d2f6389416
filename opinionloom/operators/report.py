"""Feedback reports from per-model statistics."""

from pyspark.sql import functions as F

from opinionloom.functions import vocab


def feedback_report(stats):
    """One row per model with the four report sections and the full text."""
    praise = F.coalesce(F.col("top_6_positive_keywords"), F.lit(""))
    complaints = F.coalesce(F.col("top_6_negative_keywords"), F.lit(""))
    kept = [c for c in ("first_review",) if c in stats.columns]
    summary = F.format_string(
        vocab.SUMMARY_TEXT, "model", _tone(F.col("pct_positive")),
        *[F.col(f"pct_{name}").cast("string") for name in ("positive", "negative", "neutral")],
        F.when(F.col("valid_cleaned_reviews") > vocab.VOLUME_BOUND, vocab.HIGH_VOLUME).otherwise(vocab.LOW_VOLUME),
    )
    praised = F.when(praise != "", F.format_string(vocab.PRAISE_TEXT, praise)).otherwise(vocab.NO_PRAISE_TEXT)
    blamed = F.when(complaints != "", F.format_string(vocab.COMPLAINT_TEXT, complaints)).otherwise(
        vocab.NO_COMPLAINT_TEXT
    )
    advice = F.array_join(F.transform(advice_list(complaints), lambda line: F.concat(F.lit("- "), line)), "\n")
    sections = stats.select(
        "model",
        summary.alias("summary"),
        F.format_string(vocab.STRENGTHS_TEXT, praised).alias("strengths"),
        F.format_string(vocab.WEAKNESSES_TEXT, blamed).alias("weaknesses"),
        F.format_string(vocab.ADVICE_TEXT, advice).alias("recommendations"),
        *kept,
    )
    full = F.concat_ws("\n\n", "summary", "strengths", "weaknesses", "recommendations")
    return sections.withColumn("full_report_text", full)


def advice_list(complaints):
    """Advice lines called for by the complaint keywords, filled up with general advice."""
    lowered = F.lower(complaints)
    called_for = F.array_compact(
        F.array(*[F.when(lowered.rlike("|".join(words)), F.lit(line)) for words, line in vocab.ADVICE_RULES])
    )
    general = F.array(*[F.lit(line) for line in vocab.DEFAULT_ADVICE])
    missing = F.greatest(F.lit(vocab.MIN_ADVICE) - F.size(called_for), F.lit(0))
    return F.concat(called_for, F.slice(general, F.lit(1), missing))


def markdown_full(feedback, order="first_review"):
    """Markdown report with the full texts: ordered rows of text, joined by line ends when written."""
    body = F.format_string("## Model: %s\n%s\n\n---\n", "model", "full_report_text")
    return _with_title(feedback, body, order)


def markdown_sections(feedback, order="first_review"):
    """Markdown report with the four sections under bold names."""
    names = ("Summary", "Strengths", "Weaknesses", "Recommendations")
    template = "## Model: %s\n" + "".join(f"**{name}**: %s\n\n" for name in names) + "---\n"
    body = F.format_string(template, "model", *[name.lower() for name in names])
    return _with_title(feedback, body, order)


def _with_title(feedback, body, order):
    # ``part`` and ``place`` order the rows: the title, then the models.
    title = feedback.sparkSession.range(1).select(
        F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("place"), F.lit(vocab.REPORT_TITLE).alias("value")
    )
    models = feedback.select(F.lit(1).alias("part"), F.col(order).cast("bigint").alias("place"), body.alias("value"))
    return title.unionByName(models)


def _tone(positive):
    tone = F.lit(vocab.LOWEST_TONE)
    for bound, name in reversed(vocab.TONES):
        tone = F.when(positive > bound, F.lit(name)).otherwise(tone)
    return tone

"""Polarity of reviews."""

from pyspark.sql import functions as F

from opinionloom.functions import labels
from opinionloom.functions.scorers import lexicon_scorer
from opinionloom.functions.text import trim_space


def score_reviews(reviews, scorer=None, text="final_review"):
    """Add ``sentiment_score`` (stars) and ``sentiment_label``; both NULL without a text."""
    scorer = scorer or lexicon_scorer()
    given = F.when(F.col(text) != "", F.col(text))
    scored = reviews.withColumn("_raw", scorer(given)["raw_label"])
    stars = labels.stars_of_raw_label(F.col("_raw"))
    return (
        scored.withColumn("sentiment_score", stars)
        .withColumn("sentiment_label", labels.label_of_stars(F.col("sentiment_score")))
        .drop("_raw")
    )


def score_overall(rows, text, scorer=None):
    """Add the classifier's verdict on each whole text; blank and missing texts get NULLs."""
    scorer = scorer or lexicon_scorer()
    given = F.when(trim_space(F.col(text)) != "", F.col(text))
    scored = rows.withColumn("_score", scorer(given))
    raw = F.col("_score")["raw_label"]
    return scored.select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns],
        raw.alias("overall_raw"),
        labels.display_label(raw).alias("overall_sentiment"),
        F.bround(F.col("_score")["confidence"], 4).alias("overall_confidence"),
    )


def attach_scores(rows, scores, key="review_id"):
    """Bring scores kept in their own table back to the rows; rows without one get NULLs."""
    return rows.join(scores, key, "left")

"""Tables behind the dashboard's figures and charts."""

from pyspark.sql import functions as F

from opinionloom.functions.vocab import NEGATIVE, NEUTRAL, POSITIVE

ALL_MODELS = "All"


def of_model(rows, model=ALL_MODELS, column="model"):
    """Rows of one model, or all of them."""
    return rows if model == ALL_MODELS else rows.where(F.col(column) == model)


def kpi_row(reviews, model=ALL_MODELS):
    """One row: number of reviews, mean stars, and shares of all reviews, as figures and as shown."""
    label = F.col("sentiment_label")
    totals = of_model(reviews, model).agg(
        F.count("*").alias("total_reviews"),
        F.avg("sentiment_score").alias("average_rating"),
        (F.try_divide(F.count_if(label == POSITIVE), F.count("*")) * 100).alias("positive_pct"),
        (F.try_divide(F.count_if(label == NEGATIVE), F.count("*")) * 100).alias("negative_pct"),
    )
    return totals.select(
        "*",
        F.format_number("total_reviews", 0).alias("total_reviews_text"),
        F.concat(F.format_number("average_rating", 1), F.lit(" ★")).alias("average_rating_text"),
        F.concat(F.format_number("positive_pct", 1), F.lit("%")).alias("positive_text"),
        F.concat(F.format_number("negative_pct", 1), F.lit("%")).alias("negative_text"),
    )


def label_distribution(reviews):
    """Labelled reviews by label; order by ``n`` at the sink for a chart."""
    labelled = reviews.where(F.col("sentiment_label").isNotNull())
    return labelled.groupBy("sentiment_label").agg(F.count("*").alias("n"))


def star_distribution(reviews):
    """Scored reviews by stars."""
    scored = reviews.where(F.col("sentiment_score").isNotNull())
    return scored.groupBy("sentiment_score").agg(F.count("*").alias("n"))


def label_by_model(reviews):
    """Labelled reviews by model and label."""
    labelled = reviews.where(F.col("sentiment_label").isNotNull())
    return labelled.groupBy("model", "sentiment_label").agg(F.count("*").alias("n"))


def aspect_crosstab(aspects, top=8):
    """Percentage of each label within the ``top`` most frequent aspects (ties by name)."""
    counts = aspects.groupBy("aspect").agg(
        F.count("*").alias("n"),
        F.count("label").alias("total"),
        *[F.count_if(F.col("label") == name).alias(name) for name in (NEGATIVE, NEUTRAL, POSITIVE)],
    )
    # One aggregate gives both the shares and the ranking, so the list of frequent aspects
    # needs no second pass and no join.
    frequent = counts.orderBy(F.desc("n"), "aspect").limit(top).where(F.col("total") > 0)
    return frequent.select(
        "aspect", *[(F.col(name) / F.col("total") * 100).alias(name) for name in (NEGATIVE, NEUTRAL, POSITIVE)]
    )


def rows_of_top_aspects(aspects, top=8):
    """Aspect rows restricted to the ``top`` most frequent aspects.  ``aspects`` is read twice, so store what is costly."""
    counts = aspects.groupBy("aspect").agg(F.count("*").alias("n"))
    frequent = counts.orderBy(F.desc("n"), "aspect").limit(top).select("aspect")
    # Never more than ``top`` rows, so the broadcast is bounded.
    return aspects.join(F.broadcast(frequent), "aspect", "left_semi")


def distinct_values(rows, column):
    """Distinct values of a column without NULL."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def known_models(*tables):
    """Distinct, sorted union of the models in several ``(table, column)`` pairs."""
    lists = [distinct_values(rows, column).toDF("model") for rows, column in tables]
    union = lists[0]
    for more in lists[1:]:
        union = union.unionByName(more)
    return union.distinct().orderBy("model")

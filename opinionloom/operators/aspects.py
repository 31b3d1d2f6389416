"""Opinions on single aspects, at sentence and at clause level."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionloom.functions import labels, vocab
from opinionloom.functions import text as txt
from opinionloom.functions.numbers import round_half_even
from opinionloom.functions.phrases import bind, phrase_hits
from opinionloom.functions.scorers import lexicon_scorer
from opinionloom.functions.vocab import NEGATIVE, NEUTRAL, POSITIVE
from opinionloom.operators.cleaning import valid_reviews
from opinionloom.operators.lookup import table_matches


def aspect_rows(reviews, terms=vocab.ASPECT_TERMS, splitter=txt.split_sentences, scorer=None):
    """One row per sentence and aspect term in it, with a polarity label.

    The label is the one of the review; a ``scorer`` whose raw label starts with a number of
    stars overrides it sentence by sentence.
    """
    sentences = valid_reviews(reviews).select(
        "review_id", "model", "sentiment_label", F.posexplode(splitter(F.col("final_review"))).alias("sent_pos", "text")
    )
    tagged = sentences.withColumn("_terms", txt.matching_terms(F.col("text"), terms))
    label = F.coalesce(F.col("sentiment_label"), F.lit(NEUTRAL))
    if scorer is not None:
        # A scorer is costly, so it does not get the sentences without any term.
        tagged = tagged.where(F.size("_terms") > 0).withColumn("_raw", scorer(F.col("text"))["raw_label"])
        in_stars = F.col("_raw").rlike("^[0-9]+( |$)")
        own = F.when(in_stars, labels.label_of_stars(labels.stars_of_raw_label(F.col("_raw"))))
        label = F.coalesce(own, label)
    return tagged.select(
        "text", F.posexplode("_terms").alias("aspect_ord", "aspect"), label.alias("label"),
        F.col("model").alias("model_name"), "review_id", "sent_pos",
    )


def vocabulary_matches(rows, text, terms):
    """One row per text and vocabulary term that occurs in it as a substring, ignoring case.

    ``terms`` is a list of lower-case terms of any length, for which each text is scanned once, or a table with a column
    ``term``, which may be large (see ``lookup.table_matches``).
    """
    if isinstance(terms, DataFrame):
        return table_matches(rows, text, terms)
    return rows.withColumn("term", F.explode(phrase_hits(F.col(text), list(dict.fromkeys(terms)))))


def clause_aspects(reviews, text="text", review_id="review_id", scorer=None, keywords=vocab.ASPECT_KEYWORDS):
    """One row per clause with its aspect and the classifier's verdict."""
    scorer = scorer or lexicon_scorer()
    clauses = reviews.select(
        F.col(review_id).alias("review_index"), F.col(text).alias("review_text"),
        F.posexplode(txt.split_clauses(F.col(text))).alias("clause_pos", "clause"),
    )
    scored = clauses.withColumn("_score", scorer(F.col("clause")))
    raw = F.col("_score")["raw_label"]
    return scored.select(
        "review_index", "review_text", "clause_pos", "clause",
        txt.detect_aspect(F.col("clause"), keywords).alias("aspect"),
        labels.display_label(raw).alias("sentiment"),
        raw.alias("raw_label"),
        F.bround(F.col("_score")["confidence"], 4).alias("confidence"),
    )


def first_clauses(clauses, n=100):
    """The first ``n`` clause rows, in reading order."""
    return clauses.orderBy("review_index", "clause_pos").limit(n)


def aspect_pivot(clauses):
    """Clauses per aspect and sentiment, and their percentages with one decimal."""
    counts = clauses.groupBy("aspect").agg(
        *[F.count_if(F.col("sentiment") == name).alias(name) for name in (POSITIVE, NEUTRAL, NEGATIVE)]
    )
    total = F.col(POSITIVE) + F.col(NEUTRAL) + F.col(NEGATIVE)
    counted = counts.withColumn("Total", total)
    return counted.select(
        "*",
        *[
            round_half_even(F.try_divide(F.col(name), F.col("Total")) * 100, 1).alias(f"{name}_pct")
            for name in (POSITIVE, NEUTRAL, NEGATIVE)
        ],
    )


def clauses_in_place(reviews, text="text", review_id="review_id", scorer=None, keywords=vocab.ASPECT_KEYWORDS):
    """One row per review with its judged clauses as an array; needs a native scorer, no shuffle."""
    scorer = scorer or lexicon_scorer()
    judged = F.transform(
        txt.split_clauses(F.col(text)),
        lambda clause: F.struct(
            clause.alias("clause"),
            txt.detect_aspect(clause, keywords).alias("aspect"),
            labels.display_label(scorer(clause)["raw_label"]).alias("sentiment"),
        ),
    )
    return reviews.select(F.col(review_id).alias("review_index"), judged.alias("clauses"))


def clauses_gathered(clauses):
    """The same from the rows of ``clause_aspects``; a group is never more than one review's text."""
    in_order = F.array_sort(F.collect_list(F.struct("clause_pos", "clause", "aspect", "sentiment")))
    return clauses.groupBy("review_index").agg(in_order.alias("clauses"))


def insight_lines(gathered):
    """Praise by aspect, then complaints by aspect, as text lines for each review."""
    lines = F.concat(_lines(POSITIVE, vocab.PRAISE_LINE), _lines(NEGATIVE, vocab.COMPLAINT_LINE))
    neutral = F.array(F.lit(vocab.NEUTRAL_LINE))
    shown = bind(lines, lambda found: F.when(F.size(found) > 0, found).otherwise(neutral))
    return gathered.select("review_index", F.posexplode(shown).alias("line_no", "line"))


def _lines(sentiment, template):
    def line(told, aspect):
        about = F.filter(told, lambda c: c["aspect"] == aspect)
        return F.format_string(template, aspect, F.array_join(F.transform(about, lambda c: c["clause"]), "; "))

    def by_aspect(told):
        aspects = F.array_sort(F.array_distinct(F.transform(told, lambda c: c["aspect"])))
        return F.transform(aspects, lambda aspect: line(told, aspect))

    return bind(F.filter("clauses", lambda c: c["sentiment"] == sentiment), by_aspect)

"""From raw to final reviews: clean, reject, translate, mark repeats, and count what was rejected.

Reviews carry a unique BIGINT ``review_id`` that stands for their order in the input.
"""

from pyspark.sql import functions as F

from opinionloom.functions import text as txt

NO_TRANSLATION = ("en", "unknown")
# Bytes of bitmaps of review ids (see ``with_first_sent``) that are sent to all tasks, and of one bitmap.
IDS_SENT, BITMAP = 64 << 20, 4096


def preprocess_reviews(reviews, text="original_review"):
    """Add ``cleaned_review``; a worthless review becomes NULL there and its row is kept."""
    cleaned = reviews.withColumn("cleaned_review", txt.clean_text(F.col(text)))
    return cleaned.withColumn("cleaned_review", _null_if_meaningless(F.col("cleaned_review")))


def translate_reviews(reviews, translator=None, lang="lang", detector=None):
    """Add ``translated_review`` and ``final_review`` to reviews that ``preprocess_reviews`` has cleaned.

    ``translator`` maps a text Column to a Column; it sees only the texts whose language calls
    for it, and NULL otherwise, so one pass serves all rows.  The language is what ``detector`` (a function from
    a text Column to a Column) says, or else the column ``lang``; with ``lang=None`` the translator sees every
    text.  A text that it returns as NULL stays as it was.  Without a translator both columns equal
    ``cleaned_review``.
    """
    cleaned = F.col("cleaned_review")
    if translator is None:
        return reviews.withColumn("translated_review", cleaned).withColumn("final_review", cleaned)
    if detector is not None:
        # A condition that changes from row to row keeps Spark from copying the detector into all that uses its result.
        once = F.when(F.monotonically_increasing_id() >= 0, detector(cleaned))
        reviews, language = reviews.withColumn("_language", once), F.col("_language")
    else:
        language = None if lang is None else F.col(lang)
    foreign = F.lit(True) if language is None else F.coalesce(~language.isin(*NO_TRANSLATION), F.lit(False))
    translated = reviews.withColumn("_translation", translator(F.when(foreign, cleaned)))
    # A cleaned text is the same when it is cleaned again, unless dropping symbols has put a link together.
    link = cleaned.contains("http") | cleaned.contains("www.")
    same = F.coalesce(F.col("_translation").isNull() & ~link, F.lit(False))
    again, text = txt.clean_text(F.coalesce(F.col("_translation"), cleaned)), F.col("translated_review")
    recleaned = translated.withColumn("translated_review", F.when(same, cleaned).otherwise(again))
    return (
        recleaned.withColumn("translated_review", F.when(same, text).otherwise(_null_if_meaningless(text)))
        .withColumn("final_review", F.col("translated_review"))
        .drop("_translation", "_language")
    )


def mark_repeats(reviews, group=("model",), text="final_review"):
    """Null the text of every review whose normalised text came earlier in the same group.

    The first ``review_id`` of each distinct text is found by an aggregate over a digest, so a
    text that makes up a large part of the input is combined before the shuffle.  The reviews
    themselves are joined on the unique ``review_id``, which cannot be skewed, and the normalised
    text is made after that, so that it need not travel.
    """
    marked = with_first(reviews, group, text)
    return (
        marked.withColumn("norm_review", txt.normalise_review(F.col(text)))
        .withColumn(text, F.when(F.col("_first"), F.col(text)))
        .drop("_first")
    )


def with_first(reviews, group=("model",), text="final_review"):
    """Add ``_first``, which is true for the first review of each normalised text of a group and NULL for others."""
    return reviews.join(_first_ids(reviews, group, text).withColumn("_first", F.lit(True)), "review_id", "left")


def with_first_sent(reviews, keep, group=("model",), text="final_review"):
    """The rows of ``with_first``, computed now, with the texts left in place where the ids allow it.

    ``reviews`` are read twice, so they had better be cheap to make again.  The ids of the first reviews become bitmaps of
    32,768 ids each, a bit for an id, which ``keep`` stores and all tasks get.  Ids that lie so far apart that these are over ``IDS_SENT``
    bytes, or that are given twice, are joined as in ``with_first``.
    """
    first = _first_ids(reviews, group, text).where(F.col("review_id").isNotNull())
    number = F.col("review_id").cast("bigint")
    maps = keep(first.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"), F.count("*").alias("_ids")
    ))
    size = maps.agg(F.count("*").alias("n"), F.count_if(F.bitmap_count("_bits") < F.col("_ids")).alias("twice")).first()
    if size["n"] * BITMAP > IDS_SENT or size["twice"]:
        return with_first(reviews, group, text)
    joined = reviews.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(maps.drop("_ids")), "_bucket", "left")
    place = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return joined.withColumn("_first", F.when(F.getbit(byte, place % 8) == 1, True)).drop("_bucket", "_bits")


def _first_ids(reviews, group, text):
    """The id of the first review of each normalised text of a group."""
    keyed = reviews.select("review_id", *group, txt.normalise_review(F.col(text)).alias("norm_review"))
    return _by_distinct_text(keyed, group).agg(F.min("review_id").alias("review_id")).select("review_id")


def quality_report(reviews, group=("model",)):
    """One row: reviews in all, worthless ones, and repeats (missing texts count as equal)."""
    keyed = reviews.withColumn("norm_review", txt.normalise_review(F.col("final_review")))
    per_text = _by_distinct_text(keyed, group).agg(
        F.count("*").alias("n"), F.count_if(F.col("cleaned_review").isNull()).alias("meaningless")
    )
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"),
        F.coalesce(F.sum("meaningless"), F.lit(0)).alias("meaningless_reviews"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_reviews"),
    )


def valid_reviews(reviews, text="final_review"):
    """Reviews that still have a text."""
    return reviews.where(F.col(text).isNotNull() & (F.col(text) != ""))


def _by_distinct_text(keyed, group):
    return keyed.groupBy(*group, F.unhex(F.sha2(F.col("norm_review"), 256)).alias("_digest"))


def _null_if_meaningless(text):
    """A text that ``clean_text`` made, or NULL."""
    return F.when(~txt.is_meaningless(text, signs=txt.CLEAN_SIGNS), text)

"""Keywords and per-model statistics."""

import math
from functools import reduce

from pyspark.sql import functions as F

from opinionloom.functions import text as txt
from opinionloom.functions import vocab
from opinionloom.functions.numbers import round_half_even, share
from opinionloom.functions.vocab import NEGATIVE, NEUTRAL, POSITIVE
from opinionloom.operators.ranking import first_n_per_group
from opinionloom.sources.shared import kept

# Room for the position of a word below one review id; a decimal holds any BIGINT id exactly.
POSITIONS = 2**31
# Words that the sketch of a group tracks in the statistics: some 50 KB for a group and task, and words that make up 0.17 % of the uses
# are certain to be among them.  Spark sorts the input of such an aggregate beyond 128 groups, so it is for fewer.
TRACKED, GROUPS = 2000, 100


def keywords_used(reviews, keys=(), text="final_review", stop_words=vocab.STOP_WORDS):
    """One row for each use of a keyword: ``keys, review_id, pos, word``."""
    used = reviews.select(*keys, "review_id", F.posexplode(txt.words(F.col(text))).alias("pos", "word"))
    return used.where((F.length("word") > 2) & ~F.col("word").isin(*stop_words))


def keyword_counts(reviews, keys=(), text="final_review", stop_words=vocab.STOP_WORDS):
    """Keywords with their number of uses and first place of use, per group."""
    return _counted(keywords_used(reviews, keys, text, stop_words), keys)


def top_keywords(reviews, keys, n=6, text="final_review"):
    """The ``n`` most used keywords of each group, ranked; the earlier one wins a tie."""
    return first_n_per_group(keyword_counts(reviews, keys, text), list(keys), _most_used_first(), n)


def top_keywords_sketched(reviews, keys, n=6, text="final_review", tracked=10000):
    """The rows of ``top_keywords``, without sending all distinct words through the shuffle.

    A sketch of frequent words per group, merged from the tasks, names the candidates, and a second pass counts only these.
    With N uses in a group an estimate is between the true count and e * N above it, and every word used more than
    2 * e * N times is named, where e is 3.5 over the sketch's table size.  So no word is missed if the n-th exact count is above
    2 * e * N.  Groups for which that does not hold (few or evenly used words) are counted in full.  It reads ``reviews``
    two times, three if there are such groups, and pays off where distinct words are many more than ``tracked``; with a group
    per row or so it does not.  Empty input gives no rows; a NULL in a key is a group of its own.
    """
    keys = list(keys)
    used = keywords_used(reviews, keys, text)
    # The table of the sketch is the power of two that holds the tracked items at a load of 3/4.
    error = 3.5 / 2 ** math.ceil(math.log2(math.ceil(tracked / 0.75)))
    sketches = used.groupBy(*keys).agg(
        F.count("*").alias("_uses"), F.expr(f"approx_top_k_accumulate(word, {int(tracked)})").alias("_sketch")
    ).where(F.col("_uses") > 0)
    named = sketches.select(*keys, "_uses", F.expr(f"approx_top_k_estimate(_sketch, {int(tracked)})").alias("_named"))
    # Estimates come in falling order.  A word among the first n has one of at least the n-th less the error.
    least = F.coalesce(F.get("_named", F.lit(n - 1))["count"] - F.col("_uses") * error, F.lit(0.0))
    likely = F.transform(F.filter("_named", lambda item: item["count"] >= least), lambda item: item["item"])
    groups = kept(named.select(*keys, "_uses", likely.alias("_words")), "keywords")

    candidates = groups.select(*keys, F.explode("_words").alias("word")).alias("candidate")
    few = used.alias("used").join(candidates, _same([*keys, "word"], "used", "candidate"), "left_semi")
    top = kept(first_n_per_group(_counted(few, keys), keys, _most_used_first(), n), "keywords")
    last = top.where(F.col("rank") == n).select(*keys, F.col("uses").alias("_last")).alias("last")
    both = groups.drop("_words").alias("group").join(last, _same(keys, "group", "last"), "left")
    # Of a group with fewer words, any other one would be used once at least.
    unproven = both.where(F.coalesce("_last", F.lit(1)) <= 2 * error * F.col("_uses"))
    unproven = kept(unproven.select(*[F.col(f"group.{k}") for k in keys], F.lit(True).alias("_open")), "keywords").alias("open")
    if unproven.isEmpty():
        return top
    proven = top.alias("top").join(unproven, _same(keys, "top", "open"), "left_anti")
    rest = used.alias("used").join(unproven, _same(keys, "used", "open"), "left_semi")
    return proven.unionByName(first_n_per_group(_counted(rest, keys), keys, _most_used_first(), n))


def _counted(used, keys):
    """The place is one number, not a struct, so that Spark can keep the groups in a hash table and combine them before
    the shuffle.  It is a BIGINT for the ids with which it fits into one, which costs far less than a decimal."""
    number = F.col("review_id")
    fits = number.between(-POSITIONS, POSITIONS - 1)
    large = (number.cast("decimal(19,0)") * F.lit(POSITIONS).cast("decimal(10,0)") + F.col("pos")).cast("decimal(38,0)")
    counted = used.groupBy(*keys, "word").agg(
        F.count("*").alias("uses"),
        F.min(F.when(fits, number.cast("bigint") * F.lit(POSITIONS) + F.col("pos"))).alias("_near"),
        F.min(F.when(~fits, large)).alias("_far"),
    )
    first = F.least(F.col("_near").cast("decimal(38,0)"), F.col("_far"))
    return counted.select(*keys, "word", "uses", first.alias("first_place"))


def _same(keys, left, right):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def top_keywords_overall(reviews, n=10, text="final_review"):
    """The ``n`` most used keywords of all labelled reviews, with their counts."""
    labelled = reviews.where(F.col("sentiment_label").isNotNull())
    return keyword_counts(labelled, (), text).orderBy(*_most_used_first()).limit(n).select("word", "uses")


def model_stats(reviews, denominator="labelled", keywords=6, stored=False):
    """Volume, polarity shares, average stars and top keywords per model.

    ``denominator='labelled'`` relates the shares to the reviews that have a label, ``'all'`` to
    every review.  Reviews without a model are left out.  ``first_review`` is the first review
    id of the model, for output in order of appearance.  ``stored`` reviews are cheap to read and are read now, more than once, so that
    few of the words travel (see ``top_keywords_sketched``); without it no job starts.
    """
    if denominator not in ("labelled", "all"):
        raise ValueError("denominator is 'labelled' or 'all'")
    reviews = reviews.where(F.col("model").isNotNull())
    label = F.col("sentiment_label")
    counts = reviews.groupBy("model").agg(
        F.count("*").alias("total_reviews"),
        F.count(label if denominator == "labelled" else F.lit(1)).alias("valid_cleaned_reviews"),
        *[F.count_if(label == name).alias(name) for name in (POSITIVE, NEGATIVE, NEUTRAL)],
        F.avg(F.when(label.isNotNull(), F.col("sentiment_score"))).alias("mean"),
        F.min("review_id").alias("first_review"),
    )
    valid = F.col("valid_cleaned_reviews")
    stats = counts.select(
        "model", "total_reviews", "valid_cleaned_reviews",
        *[
            round_half_even(share(F.col(name), valid), 2).alias(f"pct_{name.lower()}")
            for name in (POSITIVE, NEGATIVE, NEUTRAL)
        ],
        F.coalesce(round_half_even(F.col("mean"), 2), F.lit(0.0)).alias("average_sentiment_score"),
        "first_review",
    )
    told = reviews.where(label.isin(POSITIVE, NEGATIVE))
    groups = ("model", "sentiment_label")
    if stored and told.select(*groups).distinct().limit(GROUPS + 1).count() <= GROUPS:
        ranked = top_keywords_sketched(told, groups, keywords, tracked=TRACKED)
    else:
        ranked = top_keywords(told, groups, keywords)
    lists = ranked.groupBy("model").agg(
        *[
            _keyword_text(label == name).alias(f"top_{keywords}_{name.lower()}_keywords")
            for name in (POSITIVE, NEGATIVE)
        ]
    )
    joined = stats.join(lists, "model", "left")
    texts = [f"top_{keywords}_{name.lower()}_keywords" for name in (POSITIVE, NEGATIVE)]
    return joined.select(
        *[c for c in stats.columns if c != "first_review"],
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in texts],
        "first_review",
    )


def _most_used_first():
    return [F.desc("uses"), F.asc("first_place")]


def _keyword_text(condition):
    # At most a handful of rows per model arrive here: the rank cut came first.
    ranked = F.array_sort(F.collect_list(F.when(condition, F.struct("rank", "word"))))
    return F.array_join(F.transform(ranked, lambda item: item["word"]), ", ")

"""Mixing sources to target weights by Pareto order sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import quoted

#: Weights of the sources in their order, repeating; the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Slices of the order in which a source's cut is first looked for.
SLICES = 1 << 12
WORDS = r"[^\x20\x09-\x0D]+"


def words(text="text"):
    """Number of words (runs without white space) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def preference(size):
    """How much a document of this size is preferred to others of its source: 1 for each doubling, from 1.

    Documents of a few words are taken less often than long ones.  The values are few, which the
    allocation of whole copies relies on.
    """
    return (F.floor(F.log2(size + F.lit(1))) + 1).cast("long")


def source_targets(sizes, weights=WEIGHTS, most=MOST_COPIES):
    """Adds ``target`` to rows of (source, source_size), one for each source.

    In the order of code points, null last, sources get the weights in turns and share the total of all
    sizes.  No target is above ``most`` times its source's size; what is over is shared out again by weight.
    Each round settles at least one more source at its limit, and looks at sums only.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    placed = spark.createDataFrame(ordered.map(lambda x: (x[0]["source"], x[0]["source_size"], x[1])), "source string, source_size long, place long")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = kept(placed.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int"))).drop("place"), "sources")
    limit = F.lit(float(most)) * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= limit
        used, weight, n = table.agg(
            F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if weight is None or n == before:
            break
        level, before = (total - (used or 0.0)) / weight, n
    return table.withColumn("target", F.least(limit, F.lit(level) * F.col("weight"))).drop("weight")


def _copies(sizes, targets, most):
    """Expected copies of the documents of each (source, preference): in proportion to it, at most ``most``.

    ``sizes`` has the words of each.  With the preferences of a source from the highest on, those at the limit
    come first; the scale of the others follows from what is left for them.  At most 64 rows a source.
    """
    down = Window.partitionBy("source").orderBy(F.desc("preference"))
    up = Window.partitionBy("source").orderBy("preference").rowsBetween(Window.unboundedPreceding, 0)
    classed = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    above = F.sum(F.lit(float(most)) * F.col("words")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("target") - F.coalesce(above, F.lit(0.0))
    scaled = classed.withColumn(
        "scale", F.try_divide(left, F.sum(F.col("preference") * F.col("words")).over(up).cast("double"))
    ).withColumn("free", F.col("scale") * F.col("preference") <= most)
    scale = F.max(F.when(F.col("free"), F.struct("preference", "scale"))).over(Window.partitionBy("source"))["scale"]
    share = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("scale") * F.col("preference")))
    share = F.when(F.col("scale").isNull(), F.lit(float(most))).otherwise(share)
    return scaled.withColumn("scale", scale).withColumn("expected", share)


def _order(key, seed):
    """Random odds of a document: u / (1 - u) for a hash u of its key, between 0 and 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return u / (1 - u)


def _rank(key, seed, odds):
    return F.try_divide(_order(key, seed), odds)


def mix_rule(docs, text="text", source="source", key="doc_id", weights=WEIGHTS, most=MOST_COPIES, seed=7):
    """The rule of a mix: for each (source, preference) the certain ``whole`` copies, the inclusion ``odds`` of one
    copy more, and the ``cut`` of the source in the Pareto order.

    The sample of a source has a fixed size in words: documents are taken in the order of their random odds divided by
    their inclusion odds until the words left for the source are used up, to the nearest document.  The
    cut is found from sums over slices of that order, and then in one slice of each source.
    """
    rows = docs.select(F.col(source).cast("string").alias("source"), words(text).alias("size"), F.col(key).alias("key"))
    rows = kept(rows.withColumn("preference", preference(F.col("size"))), "mix-sizes")
    classes = kept(rows.groupBy("source", "preference").agg(F.sum("size").alias("words")), "mix-classes")
    totals = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = kept(source_targets(totals, weights, most), "mix-targets")
    copies = _copies(classes, targets.withColumnRenamed("source", "_source"), most)
    whole = F.floor("expected")
    part = F.col("expected") - F.floor("expected")
    rule = copies.select(
        "source", "preference", "source_size", "target", whole.cast("long").alias("whole"), (part / (1 - part)).alias("odds"),
        (F.col("target") - F.sum(whole * F.col("words")).over(Window.partitionBy("source"))).alias("left"),
    )
    rule = kept(rule, "mix-classes-rule")
    named = rule.select(F.col("source").alias("_s"), F.col("preference").alias("_p"), "odds", "left").where("odds > 0")
    ranked = rows.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("preference") == F.col("_p")))
    q = _rank(F.col("key"), seed, F.col("odds"))
    slice_of = F.least(F.floor(q / (1 + q) * SLICES), F.lit(SLICES - 1))
    ranked = ranked.select("source", "size", "left", q.alias("q"), slice_of.alias("slice"))
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    order = Window.partitionBy("source").orderBy("slice")
    slices = slices.withColumn("before", F.sum("words").over(order) - F.col("words"))
    last = slices.where("before <= left").groupBy("source").agg(F.max(F.struct("slice", "before")).alias("x"))
    last = last.select(F.col("source").alias("_s"), F.col("x.slice").alias("_slice"), F.col("x.before").alias("before"))
    inside = ranked.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_slice")))
    inside = inside.groupBy("source", "left", "slice", "before", "q").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("q")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    taken = F.col("upto") - F.col("size") / 2 <= F.col("left")
    # The last one taken, or else the end of the slice before.
    cuts = inside.groupBy("source").agg(
        F.coalesce(F.max(F.when(taken, F.col("q"))), F.max(F.col("slice") / SLICES / (1 - F.col("slice") / SLICES)) * (1 - 1e-12)).alias("cut")
    )
    cuts = cuts.withColumnRenamed("source", "_s")
    rule = rule.drop("left").join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return kept(rule.withColumn("cut", F.coalesce("cut", F.lit(-1.0))), "mix-rule"), targets


def mix(docs, text="text", source="source", key="doc_id", weights=WEIGHTS, most=MOST_COPIES, seed=7):
    """The documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Targets: see ``source_targets``.  Within a source, expected copies go with ``preference`` of the size, at
    most ``most``; their whole part is certain, and a Pareto sample by the rest gets one copy more, so that the words
    taken meet the target to about half a document.

    Null and empty texts have size 0 and no copies; a null source is a source, the last.  The random odds
    are a hash of ``seed`` and the key, so reruns agree; rows with equal keys and preference share their
    luck, and are taken or left together.  Input columns with the names of the outputs are replaced.  Documents are not shuffled: the rule has at
    most 64 rows a source, and Spark chooses the join by its size.
    """
    rule, targets = mix_rule(docs, text, source, key, weights, most, seed)
    named = rule.select(
        F.col("source").alias("_s"), F.col("preference").alias("_p"), F.struct("whole", "odds", "cut").alias("_rule")
    )
    aims = targets.select(F.col("source").alias("_t"), F.struct("source_size", "target").alias("_aim"))
    # The document's own columns travel as one, so that none can clash with those of the rule.
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), words(text).alias("_size"),
        F.col(quoted(source)).cast("string").alias("_source"), F.col(quoted(key)).alias("_key"),
    )
    rows = rows.join(aims, F.col("_source").eqNullSafe(F.col("_t")), "left").drop("_t")
    rows = rows.join(named, F.col("_source").eqNullSafe(F.col("_s")) & (preference(F.col("_size")) == F.col("_p")), "left").drop("_s", "_p")
    extra = (F.col("_rule.odds") > 0) & (_rank(F.col("_key"), seed, F.col("_rule.odds")) <= F.col("_rule.cut"))
    copies = F.when(F.col("_size") > 0, F.col("_rule.whole") + F.coalesce(extra.cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    outputs = {
        "size": F.col("_size"), "source_size": F.coalesce(F.col("_aim.source_size"), F.lit(0)).cast("long"),
        "target": F.coalesce(F.col("_aim.target"), F.lit(0.0)), "copies": F.col("_copies"), "taken": F.col("_copies") * F.col("_size"),
    }
    others = [c for c in docs.columns if c.lower() not in outputs]
    return rows.withColumn("_copies", copies).select(
        *[F.col("_row." + quoted(c)).alias(c) for c in others], *[x.alias(name) for name, x in outputs.items()]
    )


def mixed_documents(docs, **options):
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    own = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rows = docs.select(
        F.struct(*[F.col(c) for c in own]).alias("_row"),
        *[F.col(options.get(x, d)).alias(f"_{x}") for x, d in (("text", "text"), ("source", "source"), ("key", "doc_id"))],
    )
    taken = mix(rows, **options | {"text": "_text", "source": "_source", "key": "_key"})
    return taken.where("copies > 0").select("_row", F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_copy")).select("_copy.*")

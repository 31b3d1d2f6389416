"""Live views over arriving reviews, and keyed tables kept up to date by a stream."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinionloom.functions.vocab import NEGATIVE, POSITIVE
from opinionloom.sources.keyed import upsert_keyed
from opinionloom.sources.shared import delete_path, file_system

# Sums of a window that can be added up over batches.
SUMS = "total_reviews", "scored_reviews", "stars", "positive", "negative"
OPEN, CLOSED, CORRECTION = "open", "closed", "correction"


def read_arrivals(spark, path, schema, files_per_trigger=None):
    """Stream of the Parquet files that are, or arrive, at a path or file pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def live_kpi(arrivals, keys=(), time="ts", window="1 day", delay="1 hour"):
    """Reviews, mean stars and polarity shares per time window, emitted once a window is over.

    ``drain_to_figures`` has every window and takes late arrivals too.
    """
    label = F.col("sentiment_label")
    windows = arrivals.withWatermark(time, delay).groupBy(F.window(time, window), *keys)
    kpi = windows.agg(
        F.count("*").alias("total_reviews"),
        F.avg("sentiment_score").alias("average_rating"),
        (F.count_if(label == POSITIVE) / F.count("*") * 100).alias("positive_pct"),
        (F.count_if(label == NEGATIVE) / F.count("*") * 100).alias("negative_pct"),
    )
    return kpi.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *keys, "total_reviews", "average_rating", "positive_pct", "negative_pct",
    )


def drain_to_figures(arrivals, path, checkpoint, keys=(), time="ts", window="1 day"):
    """Add up the arrivals that are there now by time window, then stop.

    Every micro-batch leaves the sums of the windows that it touches, combined before the shuffle, in a folder of its own
    number, so a batch that runs again after a failure replaces what it wrote.  Nothing is kept as state and
    nothing waits for a watermark: windows without an end yet are there, and late arrivals add to theirs however late
    they come.  Arrivals without a time belong to no window and are left out, as in ``live_kpi``.  One checkpoint feeds one table.
    """
    label = F.col("sentiment_label")

    def add(batch, number):
        timed = batch.where(F.col(time).isNotNull())
        windows = timed.groupBy(F.window(time, window).alias("_window"), *keys).agg(
            F.count("*").alias("total_reviews"), F.count("sentiment_score").alias("scored_reviews"),
            F.sum("sentiment_score").alias("stars"),
            F.count_if(label == POSITIVE).alias("positive"), F.count_if(label == NEGATIVE).alias("negative"),
            F.max(time).alias("last_arrival"),
        )
        sums = windows.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *SUMS, "last_arrival")
        sums.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    query = (
        arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def window_figures(spark, path, keys=()):
    """Figures of every window with an arrival so far, as in ``live_kpi``; batches without arrivals add no row, a path without batches is an error."""
    own = ["window_start", "window_end", *keys]
    sums = _batches(spark, path).groupBy(*own).agg(*[F.sum(c).alias(c) for c in SUMS])
    return sums.select(*own, *_figures())


def window_revisions(spark, path, keys=(), delay="1 hour"):
    """What each batch said of the windows that it touched: the figures up to then, numbered by ``revision`` from 1.

    ``kind`` is ``open`` while the window's end is not ``delay`` behind the latest arrival of the batches up to this one, ``closed`` for the
    first row after that, and ``correction`` for those of late arrivals to a window that was over before their
    batch.  A window that no later batch touches keeps its last row, whatever its kind.
    """
    batches = _batches(spark, path)
    # One row a batch: when the stream had come how far, before it and with it.
    clock = batches.groupBy("batch").agg(F.max("last_arrival").alias("_last"))
    order = Window.orderBy("batch")
    clock = clock.select(
        "batch", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.max("_last").over(order).alias("_now"),
    )
    own = ["window_start", "window_end", *keys]
    so_far = Window.partitionBy(*own).orderBy("batch")
    sums = batches.join(clock, "batch").withColumns({c: F.sum(c).over(so_far) for c in SUMS})
    end = F.col("window_end") + F.expr(f"interval {delay}")
    kind = F.when(end <= F.col("_before"), CORRECTION).when(end <= F.col("_now"), CLOSED).otherwise(OPEN)
    return sums.select(*own, "batch", F.row_number().over(so_far).alias("revision"), kind.alias("kind"), *_figures())


def fold_figures(spark, path, upto):
    """Put the batches up to a number into one folder and delete theirs; their revisions become one.

    Only batches that the stream has finished may be folded.  A fold that fails half-way leaves the batches as they were.
    """
    path = path.rstrip("/")
    folded, batches = _listed(spark, path)
    gone = [folder for number, folder in batches.items() if number <= upto]
    if not gone:
        return
    rows = _batches(spark, path).where(F.col("batch") <= upto)
    own = [c for c in rows.columns if c not in (*SUMS, "last_arrival", "batch")]
    sums = rows.groupBy(*own).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("last_arrival").alias("last_arrival"))
    sums.write.mode("overwrite").parquet(f"{path}/folded={upto}")
    for folder in [*folded.values(), *gone]:
        delete_path(spark, folder)


def _listed(spark, path):
    """Folders of the complete folds and batches that count, by their numbers."""
    found = {}
    for name in ("folded", "batch"):
        system, target = file_system(spark, f"{path.rstrip('/')}/{name}=*/_SUCCESS")
        folders = [status.getPath().getParent().toString() for status in system.globStatus(target) or []]
        found[name] = {int(folder.rsplit("=", 1)[1]): folder for folder in folders}
    newest = max(found["folded"], default=-1)
    return (
        {number: folder for number, folder in found["folded"].items() if number == newest},
        {number: folder for number, folder in found["batch"].items() if number > newest},
    )


def _batches(spark, path):
    """Sums of all batches with their number; those of a fold have its number."""
    folded, batches = _listed(spark, path)
    if not folded and not batches:
        raise FileNotFoundError(f"no figures at {path}")
    sets = []
    if batches:
        sets.append(spark.read.option("basePath", path).parquet(*batches.values()).withColumn("batch", F.col("batch").cast("bigint")))
    for number, folder in folded.items():
        sets.append(spark.read.parquet(folder).withColumn("batch", F.lit(number).cast("bigint")))
    return sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1])


def _figures():
    return (
        F.col("total_reviews"),
        (F.col("stars") / F.col("scored_reviews")).alias("average_rating"),
        (F.col("positive") / F.col("total_reviews") * 100).alias("positive_pct"),
        (F.col("negative") / F.col("total_reviews") * 100).alias("negative_pct"),
    )


def first_arrivals(arrivals, keys, time="ts", delay="1 hour"):
    """Arrivals without repeats of the same keys within the watermark delay."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def drain_to_parquet(stream, path, checkpoint):
    """Process all that is there now in append mode, then stop.

    Windows that the watermark has not closed yet are not written; they come with later arrivals, from
    the same checkpoint.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_to_keyed_table(stream, path, keys, checkpoint, order):
    """Upsert every micro-batch into the keyed table at ``path``, then stop.

    Every batch writes the next version and names itself in it by the checkpoint and its own number, so a batch
    that runs again after a failure finds its version or takes its claim up again.  An arrival whose ``order`` is
    below that of the stored row changes nothing.
    """
    name = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()

    def merge(batch, number):
        upsert_keyed(batch, path, keys, order, source=f"{name}-{number}")

    query = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()

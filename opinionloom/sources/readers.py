"""Reading reviews and stored results."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinionloom.functions import vocab
from opinionloom.sources.csv_ranges import read_csv_parallel
from opinionloom.sources.shared import file_system, kept

ASPECT_TYPES = {
    "text": "string", "aspect": "string", "label": "string", "model_name": "string", "review_id": "bigint", "sent_pos": "int",
    "aspect_ord": "int",
}
SCORED_TYPES = {"review_id": "bigint", "sentiment_score": "double"}
# Names of our columns in an uploaded table, which may have any others.
UPLOAD_ID, UPLOAD_TEXT = "_review_id", "_review_text"
# The place of a row that was read in stretches.
PLACE = "_place_in_files"
# Offsets of file splits are broadcast up to this number of splits (some 30 bytes each).
SPLITS_SENT = 500_000


def quoted(name):
    """A column name as Spark wants it when it may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def read_table(spark, path, multiline=True):
    """A CSV (header line, quoted fields, all text) or Parquet table, by the ending of its path.

    A CSV file whose fields hold line ends cannot be split: with ``multiline`` each file is read
    by one task.  Cut a large export into many files, or convert it to Parquet once.
    """
    trimmed = path.rstrip("/").lower()
    if trimmed.endswith(".parquet"):
        return spark.read.parquet(path)
    if trimmed.endswith(".csv"):
        return spark.read.options(header=True, multiLine=multiline, quote='"', escape='"').csv(path)
    raise ValueError(f"not a .csv or .parquet path: {path}")


def missing_to_null(rows, columns=None):
    """NULL for every text that stands for a missing value."""
    named = columns or rows.columns
    return rows.select(
        *[
            F.when(~F.col(quoted(c)).isin(*vocab.NA_STRINGS), F.col(quoted(c))).alias(c) if c in named else F.col(quoted(c))
            for c in rows.columns
        ]
    )


def typed(rows, types):
    """The rows with missing texts as NULL and the named columns cast, if they are there."""
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    rows = missing_to_null(rows, texts) if texts else rows
    return rows.select(*[F.col(quoted(c)).cast(types[c]).alias(c) if c in types else F.col(quoted(c)) for c in rows.columns])


def load_reviews(spark, path, id_column=None, multiline=True, extra=(), partitions=None, parallel=False):
    """Reviews from the first two columns of a table, as ``review_id, model, original_review`` and the ``extra`` columns.

    Without an ``id_column`` the rows are numbered from 0 in file order.  Parquet rows take the
    id from a column, as their order is not part of the data.  A few files that cannot be split
    leave most executors idle; ``partitions`` then deals the rows out by their id, or ``parallel`` has CSV files read in
    stretches by many tasks (see ``csv_ranges``), with the same rows.
    """
    parallel = parallel and not path.rstrip("/").lower().endswith(".parquet")
    table = read_csv_parallel(spark, path, PLACE) if parallel else read_table(spark, path, multiline)
    first, second = [c for c in table.columns if c != PLACE][:2]
    picked = [F.col(quoted(first)).cast("string").alias("model"), F.col(quoted(second)).cast("string").alias("original_review")]
    picked += [F.col(quoted(c)) for c in extra]
    if id_column is not None:
        reviews = table.select(F.col(quoted(id_column)).cast("bigint").alias("review_id"), *picked)
    elif parallel:
        reviews = table.select(F.col(PLACE).alias("review_id"), *picked)
    else:
        reviews = numbered(table, picked)
    return missing_to_null(spread(reviews, "review_id", partitions), ["model", "original_review"])


def spread(rows, key, partitions=None):
    """The rows dealt out by the hash of a unique key, if a number of partitions is given."""
    return rows if partitions is None else rows.repartition(partitions, key)


def numbered(table, columns, name="review_id"):
    """The columns of a file-based table after ``name``, the row's place in the files, from 0.

    Partitions hold file splits in no useful order, so the place is the size of all earlier
    splits plus the place within the split.  The raw numbers are frozen in a written table first;
    a task that runs again could otherwise number its rows anew.  The upper bits of a raw number are its
    partition, so each partition's splits meet the rows without a look at the texts, which stay where they are.
    """
    raw = kept(
        table.select(
            F.struct(*columns).alias("_row"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_raw"),
        ),
        "numbered",
    )
    part = F.shiftright("_raw", 33)
    # One row per file split, as many as Spark's own list of splits.
    sizes = raw.groupBy(part.alias("_part"), "_path", "_start").agg(F.min("_raw").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    splits = kept(sizes.select("_part", F.struct("_first", offset.alias("_offset")).alias("_split")), "splits")
    offsets = splits.groupBy("_part").agg(F.reverse(F.array_sort(F.collect_list("_split"))).alias("_splits"))
    offsets = F.broadcast(offsets) if splits.count() <= SPLITS_SENT else offsets
    joined = raw.withColumn("_part", part).join(offsets, "_part")
    # The last split of the partition that begins at or before the row.
    own = F.filter("_splits", lambda s: s["_first"] <= F.col("_raw"))[0]["_offset"]
    return joined.select(F.struct((F.col("_raw") + own).alias(name), F.col("_row")).alias("_all")).select(
        F.col(f"_all.{name}"), "_all._row.*"
    )


def load_uploaded(spark, path, review_column, parallel=False):
    """Any table with all its columns, after ``_review_id`` (the place in the file) and ``_review_text``.

    Missing texts in the review column are NULL in ``_review_text``; the column itself stays as it was.  With ``parallel`` one
    large CSV file is read by many tasks.
    """
    parallel = parallel and not path.rstrip("/").lower().endswith(".parquet")
    table = read_csv_parallel(spark, path, PLACE) if parallel else read_table(spark, path)
    names = [c for c in table.columns if not (parallel and c == PLACE)]
    taken = {UPLOAD_ID, UPLOAD_TEXT} & {c.lower() for c in names}
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)}")
    chosen = F.col(quoted(review_column)).cast("string").alias(UPLOAD_TEXT)
    columns = [chosen, *[F.col(quoted(c)) for c in names]]
    rows = table.select(F.col(PLACE).alias(UPLOAD_ID), *columns) if parallel else numbered(table, columns, UPLOAD_ID)
    return missing_to_null(rows, [UPLOAD_TEXT])


def load_aspects(spark, path):
    """Stored aspect rows with the types they were written with; an empty table when there is none at the path.

    Files of other tools have the first four columns only; their rows are numbered in file order, each as
    a review of its own.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{name} {kind}" for name, kind in ASPECT_TYPES.items()))
    table = read_table(spark, path)
    if "review_id" not in table.columns:
        table = numbered(table, [F.col(quoted(c)) for c in table.columns])
    table = typed(table, ASPECT_TYPES)
    for name in ("sent_pos", "aspect_ord"):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(0))
    others = [c for c in table.columns if c not in ASPECT_TYPES]
    return table.select(*ASPECT_TYPES, *[F.col(quoted(c)) for c in others])


def load_scored(spark, reviews_path, aspects_path):
    """Stored scored reviews with the types they were written with, and aspect rows if there are any.

    Reviews without ids are numbered in file order.
    """
    reviews = read_table(spark, reviews_path)
    if "review_id" not in reviews.columns:
        reviews = numbered(reviews, [F.col(quoted(c)) for c in reviews.columns])
    return typed(reviews, SCORED_TYPES), load_aspects(spark, aspects_path)


def path_exists(spark, path):
    """Whether the path is there, on whatever file system it names."""
    system, target = file_system(spark, path)
    return system.exists(target)

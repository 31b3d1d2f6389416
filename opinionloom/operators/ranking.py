"""First rows of each group, safe for groups of any size."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def first_n_per_group(rows, keys, order, n, rank="rank", spread_by=None, buckets=64):
    """The first ``n`` rows of every group with their 1-based rank.

    Spark cuts each group to ``n`` rows before the shuffle, in every input partition.  With a
    very large input one hot group still sends ``n`` rows per partition to one task; then name
    a ``spread_by`` column: the group is first cut to ``n`` rows in each of ``buckets`` parts.
    """
    if spread_by is not None:
        bucket = F.pmod(F.xxhash64(spread_by), F.lit(buckets)).alias("_bucket")
        part = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        rows = (
            rows.select("*", bucket)
            .withColumn("_rank", F.row_number().over(part))
            .where(F.col("_rank") <= n)
            .drop("_rank", "_bucket")
        )
    group = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(group)).where(F.col(rank) <= n)

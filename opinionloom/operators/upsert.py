"""Keyed upsert of one table into another."""

from functools import reduce

from pyspark.sql import functions as F


def upsert(target, updates, keys, order=None):
    """Merge ``updates`` into ``target`` on ``keys`` (NULL equals NULL).

    A row with a known key has the fields of the update overwritten, also by NULL, and keeps its
    other fields; a row with a new key is added.  When ``updates`` has several rows for a key, name the
    column that ``order``s them: the last one counts, and if the target has that column too, an update
    that is older than the stored row changes nothing.  Without an order such updates are an error.
    """
    keys = list(keys)
    fields = [c for c in updates.columns if c not in keys]
    row = F.struct(*fields)
    if order is not None:
        updates = updates.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_last")).select(*keys, "_last.*")
    else:
        single = F.when(F.col("_n") > 1, F.raise_error(F.lit("several updates for one key; name their order"))).otherwise(F.col("_last"))
        updates = updates.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(row).alias("_last")).select(*keys, single.alias("_last"))
        updates = updates.select(*keys, "_last.*")
    old = target.withColumn("_known", F.lit(True)).alias("old")
    new = updates.withColumn("_given", F.lit(True)).alias("new")
    same_key = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    merged = old.join(new, same_key, "full_outer")
    given = F.col("new._given").isNotNull()
    if order is not None and order in target.columns:
        given &= F.coalesce(F.col(f"new.{order}") >= F.col(f"old.{order}"), F.lit(True))

    def field(name):
        if name not in updates.columns:
            return F.col(f"old.{name}")
        if name not in target.columns:
            return F.when(given, F.col(f"new.{name}")).alias(name)
        return F.when(given, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    added = [c for c in updates.columns if c not in target.columns]
    return merged.select(*[field(name) for name in [*target.columns, *added]])


def find_one(table, key, value):
    """Any one row of the key, or none."""
    return table.where(F.col(key) == value).limit(1)

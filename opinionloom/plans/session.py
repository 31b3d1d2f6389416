"""Session settings that the jobs rely on or profit from."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins on a unique id then hash the small side instead of sorting the texts, where it fits.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Reviews can be long; this keeps the batches of plugged-in models small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(name="opinionloom", **settings):
    """A session with the recommended settings; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

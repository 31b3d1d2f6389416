"""Run registered queries in Spark and their SQL in another engine, and compare the values."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def sql_result(folder, sql):
    """Rows of the statement, and its column types."""
    with duckdb.connect() as connection:
        connection.execute("set timezone = 'UTC'")
        for name in TABLES:
            connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
        types = {row[0]: row[1] for row in connection.execute(f"describe {sql}").fetchall()}
        return connection.execute(sql).df(), types


def type_differences(spark_types, sql_types):
    """Columns whose types do not correspond."""
    return {
        name: (kind, sql_types.get(name))
        for name, kind in spark_types
        if SQL_TYPES.get(kind, kind) != sql_types.get(name)
    }


def comparable(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = [tuple(str(v) if isinstance(v, pd.Timestamp) else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


def difference(spark_frame, sql_frame):
    """None when both hold the same rows, else a short description."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    left, right = comparable(spark_frame), comparable(sql_frame)
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return f"{a!r:.600}\n  and {b!r:.600}"
    return None

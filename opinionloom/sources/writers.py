"""Writing results."""


# Small files for tables whose columns hold one text several times.
SMALL = {"parquet": {"compression": "zstd"}, "csv": {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}}


def write_table(rows, path, format="parquet", **options):
    """Write a table as Parquet or as CSV with a header line, with options of Spark's writer."""
    writer = rows.write.mode("overwrite").options(**options)
    if format == "csv":
        writer.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("format is 'parquet' or 'csv'")


def write_results(folder, scored, derived, format="parquet"):
    """Write the tables of one run, compressed; aspect rows only when there are any.  Returns the paths.

    ``derived(path)`` gives the tables that are made from the scored reviews when these have been written to the path.
    """
    paths = {"sentiment_output": _path(folder, "sentiment_output", format)}
    write_table(scored, paths["sentiment_output"], format, **SMALL.get(format, {}))
    stats, feedback, aspects = derived(paths["sentiment_output"])
    tables = {"per_model_summary": stats, "feedback_report": feedback}
    if not aspects.isEmpty():
        tables["absa_training_dataset"] = aspects
    for name, rows in tables.items():
        paths[name] = _path(folder, name, format)
        write_table(rows, paths[name], format, **SMALL.get(format, {}))
    return paths


def _path(folder, name, format):
    return f"{folder.rstrip('/')}/{name}.{format}"


def write_markdown(report, path):
    """Write a report's rows as text files; the files read in name order are the report."""
    report.orderBy("part", "place").select("value").write.mode("overwrite").text(path)

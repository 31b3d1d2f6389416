"""Large CSV files with line ends inside of quoted fields, read by many tasks.

Whether a line begins a record or lies in a quoted field depends on all lines before it.  So every stretch of lines reports how it
ends in both cases; a prefix over the stretches, a few numbers each, then says which case holds, and all stretches are
cut into records independently.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from opinionloom.sources.shared import kept

# Bytes in one stretch at most (a longer line is a stretch of its own).
BYTES = 4 << 20
CASES = ("closed", "open")

# A field that is complete on its line, with the comma after it: not quoted, or quoted and closed.  What follows a closing
# quote belongs to the field up to the comma, so that a stray quote there opens nothing.
_QUOTED = r'(?:[^"]|"")*+'
_FIELD = rf'(?:(?!")[^,]*+,|"{_QUOTED}"[^,]*+,)*+'
#: A line that begins outside of quotes, and ends inside.
OPENS = rf'(?s)^{_FIELD}"{_QUOTED}$'
#: A line that begins inside of quotes, and ends inside.
STAYS_OPEN = rf'(?s)^{_QUOTED}(?:"[^,]*+,{_FIELD}"{_QUOTED})?$'


def _lines(spark, path):
    """The lines of all files with their split, and the state after each line for both states before it."""
    text = F.col("value")
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.make_valid_utf8(text).alias("line"), F.col("_metadata.file_size").alias("size"), (F.octet_length(text) + 1).alias("bytes"),
    )
    # Lines without quotes, most of them, change nothing.
    some = F.col("line").contains('"')
    return rows.select(
        "path", "start", "line", (some & F.col("line").rlike(OPENS)).alias("after_closed"),
        (~some | F.col("line").rlike(STAYS_OPEN)).alias("after_open"), "size", "bytes",
    )


def _states(before, after_closed, after_open):
    """Whether each line begins inside of quotes, if the first one does (or does not)."""
    n = len(after_closed)
    fixed, swap = after_closed == after_open, after_closed & ~after_open
    swaps = np.concatenate([[0], np.cumsum(swap)])
    at = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, n + 1), 0)]))
    base = np.where(at > 0, after_closed[np.maximum(at - 1, 0)] if n else before, before)
    return base ^ ((swaps - swaps[at]) % 2 == 1)


def _is(lines, value):
    return pc.equal(lines, value).to_numpy(zero_copy_only=False)


def _stretches(lines):
    """One row for each stretch: its place, its lines, and for both states before it the state after it and the records that begin in it."""

    def cut(batches):
        place, number = None, 0
        for batch in batches:
            paths, starts, text = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            closed, open_ = (batch.column(x).to_numpy(zero_copy_only=False) for x in (3, 4))
            codes = paths.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            piece = (np.cumsum(size) - size) // BYTES
            edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0) | (np.diff(piece) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                if a == b:
                    continue
                here = (paths[a].as_py(), int(starts[a]))
                place, number = here, number + 1 if here == place else 0
                lines = text.slice(a, b - a)
                full, bare = ~_is(lines, ""), _is(lines, "\r")
                states = [_states(before, closed[a:b], open_[a:b]) for before in (False, True)]
                yield pa.RecordBatch.from_pylist(
                    [{
                        "path": here[0], "start": here[1], "number": number, "crlf": lines[0].as_py().endswith("\r"),
                        "lines": lines, "after_closed": closed[a:b].tolist(), "after_open": open_[a:b].tolist(),
                        "end_closed": bool(states[0][-1]), "end_open": bool(states[1][-1]),
                        **{f"records_{name}": int((~x[:-1] & full).sum()) for name, x in zip(CASES, states)},
                        **{f"bare_{name}": int((~x[:-1] & bare).sum()) for name, x in zip(CASES, states)},
                        "size": batch.column(5)[a].as_py(), "bytes": int(pc.sum(batch.column(6).slice(a, b - a)).as_py()),
                    }],
                    schema,
                )

    counts = ["records_closed", "records_open", "bare_closed", "bare_open", "size", "bytes"]
    schema = pa.schema([
        ("path", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("crlf", pa.bool_()), ("lines", pa.list_(pa.string())),
        ("after_closed", pa.list_(pa.bool_())), ("after_open", pa.list_(pa.bool_())), ("end_closed", pa.bool_()), ("end_open", pa.bool_()),
        *[(name, pa.int64()) for name in counts],
    ])
    return lines.mapInArrow(
        cut,
        "path string, start long, number long, crlf boolean, lines array<string>, after_closed array<boolean>, after_open array<boolean>, "
        f"end_closed boolean, end_open boolean, {', '.join(f'{name} long' for name in counts)}",
    )


def _decided(stretches):
    """(path, start, number, open, open_after, before, own, crlf, ended): for each stretch the state in which it begins, and the records of its file before it.

    ``own`` is the number of records that begin in it; ``crlf`` and ``ended`` say whether the file's lines end with CR LF and whether its
    last one has an end.  Works on a few numbers for each stretch of some megabytes; files are separate.
    """
    file = Window.partitionBy("path")
    order = file.orderBy("start", "number")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = stretches.drop("lines", "after_closed", "after_open").withColumn("crlf", F.first("crlf").over(order))
    # A byte order mark at the beginning is not part of the first line.
    rows = rows.withColumn("ended", (F.col("size") - F.sum("bytes").over(file)).isin(0, 3))
    fixed, swap = F.col("end_closed") == F.col("end_open"), F.col("end_closed") & ~F.col("end_open")
    rows = rows.withColumn("swaps", F.coalesce(F.sum(swap.cast("long")).over(order), F.lit(0)))
    # The last stretch before that ends the same way whatever was before it, and the changes since.
    last = F.last(F.when(fixed, F.struct("end_closed", "swaps")), ignorenulls=True).over(earlier)
    rows = rows.withColumn("last", last).withColumn("swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    odd = (F.col("swapped") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    rows = rows.withColumn("open", F.coalesce("last.end_closed", F.lit(False)) != odd)
    rows = rows.withColumn("open_after", F.when(F.col("open"), F.col("end_open")).otherwise(F.col("end_closed")))
    # A line with nothing but CR is blank only where CR belongs to the line end.
    records = [F.col(f"records_{x}") - F.when(F.col("crlf"), F.col(f"bare_{x}")).otherwise(0) for x in CASES]
    rows = rows.withColumn("own", F.when(F.col("open"), records[1]).otherwise(records[0]))
    rows = rows.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    return rows.select("path", "start", "number", "open", "open_after", "before", "own", "crlf", "ended")


def _parts(spark, path):
    """(records, places): the records as (path, record, text), and what ``_decided`` says of the stretches."""
    stretches = kept(_stretches(_lines(spark, path)), "csv-stretches")
    places = kept(_decided(stretches), "csv-places")
    keys = ["path", "start", "number"]
    known = stretches.select(*keys, "lines", "after_closed", "after_open").join(places.select(*keys, "open", "before", "crlf"), keys)

    def records(batches):
        for batch in batches:
            for row in range(len(batch)):
                yield one(*[batch.column(x)[row] for x in range(batch.num_columns)])

    def one(path, start, number, lines, after_closed, after_open, open_, before, crlf):
        lines = pc.replace_substring_regex(lines.values, "\r$", "") if crlf.as_py() else lines.values
        inside = _states(open_.as_py(), *[x.values.to_numpy(zero_copy_only=False) for x in (after_closed, after_open)])
        bounds = np.append(np.flatnonzero(~inside[:-1]), len(lines))
        begins = np.flatnonzero(~inside[:-1] & ~_is(lines, ""))
        # A record has the lines from its first one to the next that begins outside of quotes, blank or not.
        ends, ids = bounds[np.searchsorted(bounds, begins, "right")], np.arange(len(begins))
        if inside[0]:  # the rest of a record that began before
            begins, ends, ids = np.append(0, begins), np.append(bounds[0], ends), np.append(-1, ids)
        sizes = ends - begins
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begins, sizes)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines.take(pa.array(taken))), "\n")
        whole = ids >= 0
        if len(ids) and inside[-1]:
            whole[-1] = False
        fixed = [pa.repeat(x, len(ids)) for x in (start, number)]
        return pa.RecordBatch.from_arrays(
            [pa.repeat(path, len(ids)), pa.array(ids + before.as_py(), pa.int64()), pa.array(whole), *fixed, texts.cast(pa.string())],
            ["path", "record", "whole", "start", "number", "text"],
        )

    columns = "path string, record long, whole boolean, start long, number long, text string"
    pieces = kept(known.select(*keys, "lines", "after_closed", "after_open", "open", "before", "crlf").mapInArrow(records, columns), "csv-pieces")
    # At most two pieces of a stretch are put together with those of others.
    place = F.sort_array(F.collect_list(F.struct("start", "number", "text")))
    joined = pieces.where("not whole").groupBy("path", "record").agg(F.array_join(F.transform(place, lambda x: x["text"]), "\n").alias("text"))
    return pieces.where("whole").select("path", "record", "text").union(joined), places


def csv_records(spark, path):
    """(path, record, text): the records of all CSV files at the path, numbered from 0 in each file, as they stand there.

    A record ends at a line end outside of quotes; a quote counts as such at the beginning of a field only, and is doubled
    inside of a quoted field.  Where something follows a closing quote, the field goes on to the next comma or line end.  Blank lines
    between records are left out.  Lines end with LF, or with CR LF where a file's first line does; the line
    ends inside of fields become LF then.  A quoted field that is never closed takes in the rest of its file.
    """
    return _parts(spark, path)[0]


def read_csv_parallel(spark, path, number=None):
    """All columns of the CSV files at a path as text, with the names in the first one's header; each file has a header line.

    The rows are those of ``spark.read.csv`` with ``multiLine``, which reads a file in one task.  With ``number`` the rows
    have their place in the files (in the order of their paths), from 0, in a column of this name before the others.
    """
    names = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).columns
    records, places = _parts(spark, path)
    # One row for each file: the number of its last record, whether that has a line end, and the rows of the files before.
    files = places.groupBy("path").agg(
        (F.sum("own") - 1).alias("last"), F.first("ended").alias("ended"), F.max_by("open_after", F.struct("start", "number")).alias("open")
    )
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = kept(files.withColumn("first", F.coalesce(F.sum(F.greatest("last", F.lit(0))).over(earlier), F.lit(0))), "csv-files")
    rows = records.where("record > 0").join(files, "path")
    # What ends a record matters to a field with stray quotes.  A comma does to it as a line end does, and adds a column that has no name.
    last = F.col("record") == F.col("last")
    end = F.when(last & ~F.col("ended"), "").when(last & F.col("open"), "\n").otherwise(",")
    fields = F.from_csv(F.concat("text", end), ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"'})
    rows = rows.select((F.col("first") + F.col("record") - 1).alias("place"), fields.alias("fields"))
    own = [F.col(f"fields.c{i}").alias(name) for i, name in enumerate(names)]
    return rows.select(*([F.col("place").alias(number)] if number else []), *own)

"""Keyed tables on a file system, kept in hash buckets of their keys that split as they grow.

Every upsert writes a new version with what it changes, and leaves all other files where they are.  Of a
bucket that it touches it writes a delta, the rows of the updated keys, until the deltas have come to a
quarter of the bucket or to ``MOST_DELTAS`` in number; then it writes the bucket whole, so that a row is written again a
bounded number of times however large the table gets.  A bucket of over ``most_bytes`` is split when it is
written whole: bucket b of n becomes b of 2n and n + b of 2n, and so on; which buckets have been split is read from
the names of the folders.

A version counts once its ``_SUCCESS`` mark is there, so a reader never meets a half-written one.  A writer
first claims the number of its version, so two of them cannot write the same one.
"""

import json
import uuid
from functools import reduce

from pyspark.sql import functions as F

from opinionloom.operators.upsert import upsert
from opinionloom.sources.shared import delete_path, file_system

BUCKETS = 16
BUCKET_BYTES = 256 << 20
MOST_DELTAS = 8
DELTA_SHARE = 0.25
WHOLE, DELTA = "whole", "delta"
# Columns that the names of the folders stand for.
FOLDER_COLUMNS = "_version", "_bucket", "_part"


class BusyTable(RuntimeError):
    """Another write has claimed the next version."""


def versions(spark, path):
    """Complete versions as ``{number: (folder, source)}``."""
    out = {}
    for mark in _listed(spark, f"{path.rstrip('/')}/_version=*/_SUCCESS"):
        folder = mark.rsplit("/", 1)[0]
        number, _, source = folder.rsplit("=", 1)[1].partition("~")
        out[int(number)] = (folder, source)
    return out


def newest_version(spark, path):
    """Number of the newest complete version, or None."""
    return max(versions(spark, path), default=None)


def read_keyed(spark, path, version=None, buckets=None):
    """The newest (or the named) state of a keyed table; ``buckets`` names those wanted, by default all.

    Rows that a later delta replaces are left out by a join with the deltas' keys; a table without deltas is only scanned.
    """
    path = path.rstrip("/")
    found, _ = _state(spark, path, version)
    if not found:
        raise FileNotFoundError(f"no keyed table at {path}")
    wanted = [folder for name, own in sorted(found.items()) if buckets is None or name in buckets for folder in own]
    if not wanted:
        return _rows(spark, path, next(iter(found.values()))).drop(*FOLDER_COLUMNS).limit(0)
    rows = _rows(spark, path, wanted)
    deltas = [folder for folder in wanted if _kind(folder) == DELTA]
    if deltas:
        keys = json.loads(_text_of(spark, f"{path}/_keys"))
        newest = _rows(spark, path, deltas).groupBy(*keys).agg(F.max(_number()).alias("_newest"))
        rows = rows.alias("row").join(newest.alias("delta"), _same(keys, "row", "delta"), "left")
        rows = rows.where(F.coalesce(_number("row._version") >= F.col("_newest"), F.lit(True))).select("row.*")
    return rows.drop(*FOLDER_COLUMNS)


def find_keyed(spark, path, key, version=None):
    """The row of one key, or none; ``key`` gives a value for each key column of the table, in the order of its ``upsert_keyed``.

    Only the bucket that the key belongs to is read.
    """
    path = path.rstrip("/")
    names = list(key)
    schema = read_keyed(spark, path, version, buckets=[]).schema
    values = [F.lit(key[name]).cast(schema[name].dataType) for name in names]
    found, split = _state(spark, path, version)
    place = _place(values, _bucket_number(spark, path, BUCKETS), split)
    own = spark.range(1).select(place).first()[0]
    if own not in found:
        return read_keyed(spark, path, version, buckets=[])
    rows = _rows(spark, path, found[own])
    for name, value in zip(names, values):
        rows = rows.where(F.col(name).eqNullSafe(value))
    return rows.orderBy(_number().desc()).limit(1).drop(*FOLDER_COLUMNS)


def upsert_keyed(updates, path, keys, order=None, source=None, buckets=BUCKETS, takeover=False, most_bytes=BUCKET_BYTES):
    """Merge updates into the keyed table, which need not exist yet; returns the number of the version.

    See ``upsert`` for the rules.  ``source`` names the updates: if a complete version has it, they are in already and
    nothing is written.  Another writer's claim on the next version raises ``BusyTable``; ``takeover`` says that
    this writer is known to have failed.  ``buckets`` counts when the table is new.  The key columns are those that the
    table was made with; others are an error.  No column may be named like those of ``FOLDER_COLUMNS``.
    """
    spark, path, keys = updates.sparkSession, path.rstrip("/"), list(keys)
    known = versions(spark, path)
    source = source or uuid.uuid4().hex
    for number, (_, own) in known.items():
        if own == source:
            return number
    number = max(known, default=-1) + 1
    _claim(spark, f"{path}/_claims/{number}", source, takeover)
    if newest_version(spark, path) != (number - 1 if number else None):
        raise BusyTable(f"version {number} of {path} has been written meanwhile")
    if known and json.loads(_text_of(spark, f"{path}/_keys")) != keys:
        raise ValueError(f"{path} has other keys")
    if not known:
        _write_text(spark, f"{path}/_keys", json.dumps(keys))
    buckets = _bucket_number(spark, path, buckets)
    found, split = _state(spark, path)
    place = _place([F.col(k) for k in keys], buckets, split)
    incoming = dict(updates.groupBy(place.alias("_bucket")).agg(F.count("*")).collect())
    touched = {name: found[name] for name in incoming if name in found}
    whole = _due(spark, path, incoming, touched)
    for name in whole & touched.keys():
        split = split | _halved(name, sum(_length(spark, folder) for folder in touched[name]), most_bytes)

    stored = updates.limit(0)
    if touched:
        # Of a bucket that gets a delta only the rows of the updated keys are merged.
        given = updates.select(*keys).distinct().alias("given")
        few = read_keyed(spark, path, buckets=touched.keys() - whole).alias("stored").join(given, _same(keys, "stored", "given"), "left_semi")
        stored = read_keyed(spark, path, buckets=touched.keys() & whole).unionByName(few, allowMissingColumns=True)
    merged = upsert(stored, updates, keys, order).withColumn("_part", F.when(place.isin(*whole), WHOLE).otherwise(DELTA))
    merged = merged.withColumn("_bucket", _place([F.col(k) for k in keys], buckets, split)).hint("rebalance", "_bucket", "_part")
    merged.write.mode("overwrite").partitionBy("_bucket", "_part").parquet(f"{path}/_version={number}~{source}")
    return number


def prune_keyed(spark, path, keep=1):
    """Delete what the ``keep`` newest states do not need, and old claims; returns how many folders went.

    Readers of these states are not disturbed.
    """
    path = path.rstrip("/")
    known = versions(spark, path)
    needed = set()
    for version in sorted(known)[-keep:]:
        needed.update(folder for own in _state(spark, path, version)[0].values() for folder in own)
    old = [folder for _, _, folder in _folders(spark, path, known) if folder not in needed]
    for folder in old:
        delete_path(spark, folder)
    for claim in _listed(spark, f"{path}/_claims/*"):
        # A writer that comes late with such a number sees after its claim that the version is there.
        if int(claim.rsplit("/", 1)[1]) in known:
            delete_path(spark, claim)
    return len(old)


def _place(keys, buckets, split):
    """The bucket that a row belongs to, such as ``3of16``: of the smallest number of buckets at which it has not been split."""
    digest = F.xxhash64(*[k.cast("string") for k in keys])
    moduli = sorted({modulus for modulus, _ in split})
    own = _name(digest, 2 * moduli[-1] if moduli else buckets)
    for modulus in reversed(moduli):
        gone = [bucket for other, bucket in split if other == modulus]
        own = F.when(F.pmod(digest, F.lit(modulus)).isin(*gone), own).otherwise(_name(digest, modulus))
    return own


def _name(digest, modulus):
    return F.concat(F.pmod(digest, F.lit(modulus)).cast("string"), F.lit(f"of{modulus}"))


def _halved(name, size, most_bytes):
    """What is split, as ``{(modulus, bucket)}``, when a bucket of that size is to be cut into parts of ``most_bytes``."""
    bucket, modulus = map(int, name.split("of"))
    split, last = set(), modulus
    while size > most_bytes * (last // modulus):
        split |= {(last, part) for part in range(bucket, last, modulus)}
        last *= 2
    return split


def _due(spark, path, incoming, touched):
    """Buckets to be written whole: new ones, and those whose deltas with the incoming rows have grown too large or too many."""
    due = incoming.keys() - touched.keys()
    if touched:
        folders = [folder for own in touched.values() for folder in own]
        # Row counts come from the footers of the files.
        counts = {tuple(row[:2]): row[2] for row in _rows(spark, path, folders).groupBy("_bucket", "_part").agg(F.count("*")).collect()}
        for name, own in touched.items():
            changed = incoming[name] + counts.get((name, DELTA), 0)
            if changed > DELTA_SHARE * counts.get((name, WHOLE), 0) or len(own) > MOST_DELTAS:
                due = due | {name}
    return set(due)


def _rows(spark, path, folders):
    # Columns that came with a later update are missing in the files from before it.
    return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*folders)


def _number(column="_version"):
    return F.substring_index(F.col(column), "~", 1).cast("int")


def _same(keys, left, right):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _kind(folder):
    return folder.rsplit("=", 1)[1]


def _folders(spark, path, known):
    """``(version, bucket, folder)`` of all folders in the given versions, oldest first."""
    complete = {folder: number for number, (folder, _) in known.items()}
    found = []
    for folder in _listed(spark, f"{path}/_version=*/_bucket=*/_part=*"):
        parent, bucket, _ = folder.rsplit("/", 2)
        if parent in complete:
            found.append((complete[parent], bucket.split("=")[1], folder))
    return sorted(found)


def _state(spark, path, version=None):
    """What counts as of the named version, by default the newest: ``{bucket: [whole, delta, ...]}``, oldest first, and what has
    been split, as ``{(modulus, bucket)}``."""
    known = {number: own for number, own in versions(spark, path).items() if version is None or number <= version}
    found, split = {}, set()
    first = _bucket_number(spark, path, BUCKETS) if known else BUCKETS
    for _, name, folder in _folders(spark, path, known):
        if _kind(folder) == WHOLE:
            found[name] = [folder]
        else:
            found.setdefault(name, []).append(folder)
        bucket, modulus = map(int, name.split("of"))
        while modulus > first:
            modulus //= 2
            split.add((modulus, bucket % modulus))
    gone = {f"{bucket}of{modulus}" for modulus, bucket in split}
    return {name: own for name, own in found.items() if name not in gone}, split


def _listed(spark, pattern):
    system, target = file_system(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(target) or []]


def _length(spark, folder):
    """Bytes in a folder."""
    system, target = file_system(spark, folder)
    return system.getContentSummary(target).getLength()


def _write_text(spark, path, text):
    """Write a small file, in place of one that an earlier attempt has left."""
    delete_path(spark, path)
    _create(spark, path, text)


def _create(spark, path, text):
    """Write a small file that must not be there yet; whether that worked."""
    system, target = file_system(spark, path)
    try:
        stream = system.create(target, False)
    except Exception:
        if not system.exists(target):
            raise
        return False
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _claim(spark, path, source, takeover):
    if _create(spark, path, source):
        return
    if _text_of(spark, path) == source:
        return
    if not takeover:
        raise BusyTable(f"{path} is claimed by another write")
    delete_path(spark, path)
    _claim(spark, path, source, False)


def _bucket_number(spark, path, wanted):
    _create(spark, f"{path}/_buckets", str(wanted))
    return int(_text_of(spark, f"{path}/_buckets"))


def _text_of(spark, path):
    """The text of a small file."""
    system, target = file_system(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()

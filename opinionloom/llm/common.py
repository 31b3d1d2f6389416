"""Small helpers shared by the operators of this package."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.isin(np.arange(256), np.frombuffer(WHITE, np.uint8))


def read(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column):
    """The text of a column as UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def with_outputs(rows, outputs):
    """The rows with the named columns; an input column of the same name (in any case) gives way."""
    names = {name.lower() for name in outputs}
    others = [name for name in rows.columns if name.lower() not in names]
    return rows.select(*[F.col(quoted(name)) for name in others], *[c.alias(n) for n, c in outputs.items()])


def quoted(name):
    """A column name as Spark wants it where it may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def small_batches(rows):
    """The rows, after bounding the batches that Python workers get by bytes, a setting of the session.

    Texts may be long, and a worker holds a batch several times over.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = conf.get(name).lower().rstrip("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows


def blocks(array, most_bytes=1 << 19):
    """Bytes and offsets (one more than texts) of consecutive texts, in blocks of about so many bytes.

    Yields (first text, bytes, offsets from 0).  A longer text is a block of its own.
    """
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mixed(values):
    """64-bit numbers spread over the whole range (a finaliser of multiplications and shifts)."""
    values = np.asarray(values).astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


#: An odd number and its inverse modulo 2**64, so that prefix sums of a polynomial can be shifted back.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {}


def powers(base, n):
    """base**0 to base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), np.uint64(base))
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def segment_hashes(codes, starts, ends):
    """A 64-bit hash of each segment codes[start:end]; equal segments have equal hashes wherever they lie."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(BASE, len(codes)), dtype=np.uint64)])
        found = (sums[ends] - sums[starts]) * powers(INVERSE, len(codes) + 1)[starts]
    return mixed(found + (ends - starts).astype(np.uint64))

"""Exact top-k inner products by a bit-sliced index."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import small_batches

#: Rows of the index in one block, and queries that are answered by one block in one go.
BLOCK_ROWS = 1 << 16
QUERY_ROWS = 256


def quantised(rows, key, vector, scale):
    """(key, ints, dims): floor(scale * x) of each component, without vectors that are null or not finite."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.select(F.col(key).alias("key"), wide.alias("wide")).where("key is not null and wide is not null")
    rows = rows.where(~F.coalesce(F.exists("wide", odd), F.lit(True)))
    return rows.select("key", F.transform("wide", lambda x: F.floor(x * F.lit(float(scale)))).alias("ints"), F.size("wide").alias("dims"))


def _matrix(column, dims):
    """Rows of a list column as a matrix of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def build_block(keys, ints):
    """Slices of a block: for each attribute its lowest value, and bitmaps of the bits of what lies above.

    Rows are in the order of their keys.  Returns keys, lowest values, slices of each attribute, and the bitmaps.
    """
    order = np.argsort(keys, kind="stable")
    keys, ints = keys[order], ints[order]
    low = ints.min(axis=0) if len(keys) else np.zeros(ints.shape[1], np.int64)
    above = ints - low
    widths = np.array([int(x).bit_length() for x in above.max(axis=0)] if len(keys) else [], np.int64)
    words = -(-len(keys) // 64)
    maps = np.zeros((int(widths.sum()), words * 8), np.uint8)
    at = 0
    for column, width in zip(above.T, widths):
        for bit in range(width):
            packed = np.packbits((column >> bit & 1).astype(bool), bitorder="little")
            maps[at, : len(packed)] = packed
            at += 1
    return keys, low, widths, maps.view("<u8")


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, keys, low, widths, maps):
        self.keys, self.low, self.widths = keys, low, widths
        n = len(maps)
        # Attributes with a negative weight are added by their complement, which differs by a constant.
        self.maps = np.concatenate([maps, ~maps])
        self.first = np.concatenate([[0], np.cumsum(widths)])[:-1].astype(np.int64)
        self.flip = n
        self.valid = np.zeros(maps.shape[1] * 8, np.uint8)
        packed = np.packbits(np.ones(len(keys), bool), bitorder="little")
        self.valid[: len(packed)] = packed
        self.valid = self.valid.view("<u8")

    def sums(self, query):
        """Slices of the weighted sum of all rows, least significant first, and the constant to add."""
        levels = {}
        constant = int(np.dot(query.astype(object), self.low.astype(object))) if len(query) else 0
        for i in np.flatnonzero(query):
            weight, width, first = abs(int(query[i])), int(self.widths[i]), int(self.first[i])
            if query[i] < 0:
                constant -= weight * ((1 << width) - 1)
                first += self.flip
            for bit in range(weight.bit_length()):
                if weight >> bit & 1:
                    for s in range(width):
                        levels.setdefault(bit + s, []).append(first + s)
        slices, carried, level = [], [], 0
        last = max(levels, default=-1)
        while level <= last or carried:
            rows = [self.maps[levels[level]]] if level in levels else []
            rows = np.concatenate(rows + carried) if rows or carried else np.zeros((0, len(self.valid)), np.uint64)
            carried = []
            while len(rows) > 2:
                # Three bitmaps of a level become one of it and one of the next.
                n = len(rows) // 3
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                either = a ^ b
                carried.append(a & b | either & c)
                rows = np.concatenate([either ^ c, rows[3 * n :]])
            if len(rows) == 2:
                carried.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
            slices.append(rows[0] if len(rows) else np.zeros(len(self.valid), np.uint64))
            level += 1
        return slices, constant

    def top(self, query, own, k):
        """Keys and scores of the k best rows whose key is not ``own``; ties by the smaller key."""
        slices, constant = self.sums(query)
        chosen, equal, n = np.zeros_like(self.valid), self.valid.copy(), 0
        for at in range(*np.searchsorted(self.keys, [own, own + 1])):
            equal[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        for bits in reversed(slices):
            ones = equal & bits
            more = int(np.bitwise_count(ones).sum())
            if n + more > k:
                equal = ones
            else:
                chosen |= ones
                n += more
                equal &= ~bits
                if n == k:
                    break
        rows = self._rows(chosen)
        if n < k:
            # Rows that no slice tells apart: those with the smallest keys.
            rows = np.concatenate([rows, self._rows(equal)[: k - n]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        scores = np.full(len(rows), constant, np.int64)
        for level, bits in enumerate(slices):
            scores += ((bits[word] >> bit & np.uint64(1)).astype(np.int64)) << level
        return self.keys[rows], scores

    @staticmethod
    def _rows(bitmap):
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def build_index(rows, block_rows=BLOCK_ROWS):
    """The blocks (block, dims, keys, low, widths, maps) of quantised rows, and their number.

    Rows are dealt out evenly, whatever their keys; each block has vectors of one length.
    """
    parts = max(1, -(-rows.count() // block_rows))

    def build(batches):
        from pyspark import TaskContext

        held, made = {}, 0

        def block(dims, tables):
            nonlocal made
            table = pa.concat_tables(tables)
            keys, low, widths, maps = build_block(table.column("key").to_numpy(), _matrix(table.column("ints"), dims))
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": [number], "dims": pa.array([dims], pa.int32()), "keys": [keys.tobytes()],
                    "low": [low.tolist()], "widths": [widths.tolist()], "maps": [maps.tobytes()],
                },
                pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("keys", pa.binary()), ("low", pa.list_(pa.int64())), ("widths", pa.list_(pa.int64())), ("maps", pa.binary())]),
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dims in np.unique(table.column("dims").to_numpy()):
                own = table.filter(pa.array(table.column("dims").to_numpy() == dims))
                held.setdefault(int(dims), []).append(own)
                if sum(map(len, held[dims])) >= block_rows:
                    yield block(int(dims), held.pop(int(dims)))
        for dims, tables in held.items():
            yield block(dims, tables)

    blocks = rows.repartition(parts).mapInArrow(
        build, "block long, dims int, keys binary, low array<long>, widths array<long>, maps binary"
    )
    return kept(blocks, "bit-slices")


def top_k(rows, key="vec_id", vector="embedding", is_query=None, k=20, scale=64, block_rows=BLOCK_ROWS, query_rows=QUERY_ROWS):
    """(query_id, rank, key, score): for each query row the ``k`` other rows with the largest inner product.

    Components become floor(scale * x); scores are exact whole numbers, ties go to the smaller key.  ``is_query`` says
    which rows are queries (by default all).  Rows with the query's own key are not its candidates.  Rows with a null
    key take no part, nor do vectors that are null or hold null or non-finite components; vectors of different lengths have no
    score with each other.  Repeated rows are candidates each; a query row that is repeated is answered each time.  Scores must
    fit in 64 bits.

    The index is built over all rows in blocks.  Each block meets the queries in groups of bounded size, sums the slices
    of the query's attributes with bitmap arithmetic, and keeps the best from the most significant slice of the sum
    downward; the best of all blocks are then ranked.
    """
    numbers = quantised(small_batches(rows), key, vector, scale)
    blocks = build_index(numbers, block_rows)
    asked = quantised(rows.where(is_query) if is_query is not None else rows, key, vector, scale)
    asked = kept(asked.withColumn("uid", F.monotonically_increasing_id()), "queries")
    groups = max(1, -(-asked.count() // query_rows))
    spread = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    places = blocks.select(F.col("block").alias("to_block"), "dims")
    asked = asked.withColumn("to_group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")).join(places, "dims")

    def best(block, queries):
        if not len(block) or not len(queries):
            return pa.table({x: pa.array([], pa.int64()) for x in ("uid", "query_id", "key", "score")})
        row = block.to_pylist()[0]
        keys, low, widths = (np.frombuffer(row["keys"], np.int64), np.array(row["low"], np.int64), np.array(row["widths"], np.int64))
        index = Block(keys, low, widths, np.frombuffer(row["maps"], "<u8").reshape(int(widths.sum()), -(-len(keys) // 64)))
        out = [[], [], [], []]
        own = zip(queries.column("uid").to_pylist(), queries.column("key").to_pylist(), _matrix(queries.column("ints"), row["dims"]))
        for uid, query, ints in own:
            found, scores = index.top(ints, query, k)
            for column, values in zip(out, (np.full(len(found), uid), np.full(len(found), query), found, scores)):
                column.append(values)
        return pa.table({x: pa.array(np.concatenate(v), pa.int64()) for x, v in zip(("uid", "query_id", "key", "score"), out)})

    found = spread.groupBy("block", "group").cogroup(asked.groupBy("to_block", "to_group")).applyInArrow(
        best, "uid long, query_id long, key long, score long"
    )
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("key").alias(key), "score"
    )

"""Placement of documents on shards by a table that shards fill in turns."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from .common import with_outputs

#: A prime number of slots, far above the number of shards.
SLOTS = 65_537


def lookup_table(shards, slots=SLOTS):
    """The shard of each slot.

    ``shards`` are names, or a dict of names and whole-number weights.  Every name has its own order of
    preference over all slots (an offset and a step, which meet every slot because their number is prime).
    The shards take turns: each claims as many free slots as its weight, in its order.  A shard that goes
    leaves most slots of the others as they are.
    """
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or len(weights) > slots // 100 or any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("give 1 shard at least, at most a hundredth of the slots, and whole weights from 1")
    if slots < 2 or any(slots % x == 0 for x in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    names = sorted(weights)
    offset = [xxhash.xxh64_intdigest(name.encode(), seed=1) % slots for name in names]
    step = [xxhash.xxh64_intdigest(name.encode(), seed=2) % (slots - 1) + 1 for name in names]
    table, tried, free = np.full(slots, -1, np.int64), [0] * len(names), slots
    while free:
        for shard, name in enumerate(names):
            for _ in range(min(weights[name], free)):
                while table[slot := (offset[shard] + tried[shard] * step[shard]) % slots] >= 0:
                    tried[shard] += 1
                table[slot] = shard
                free -= 1
    return [names[x] for x in table]


def assign_shards(rows, shards, key="doc_id", slots=SLOTS):
    """The rows with ``slot`` and ``shard`` (the name) for the hash of their key.

    The table has ``slots`` rows however many documents there are, so it is broadcast, and no document
    is shuffled.  Null keys share one slot; repeated keys go to the same shard.  Input columns called
    ``slot`` or ``shard`` are replaced.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot int, shard string")
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")
    placed = with_outputs(rows, {"slot": slot}).drop("shard")
    return placed.join(F.broadcast(table), "slot")

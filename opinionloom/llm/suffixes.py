"""Passages that occur again, found with suffix and longest-previous-factor arrays."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ..sources.shared import kept
from .common import BASE, BYTE_CODES, INVERSE, as_bytes, blocks, mixed, powers, quoted, small_batches

#: Bytes of the strings whose smallest hash names a window.
GRAM = 64
#: Most different stretches of one name that go into one suffix array; with more, windows are counted one by one.
GROUP = 20_000
#: Most bytes of one name's different stretches that go into one suffix array.
NAME_BYTES = 4 << 20
#: Windows that are hashed at a time.
HASHED = 1 << 16
#: Bytes that a suffix array takes at least, if there are so many.
TOGETHER = 1 << 20
PLACE = ("_key", "_a", "_b")


# --- windows and their names ------------------------------------------------------------------------------------------


def stretches(data, offsets, length, gram):
    """The longest stretches of windows that follow each other and share a name, in the texts of a block.

    A window's name is the smallest hash of the strings of ``gram`` bytes in it, so equal windows share it.  Returns
    arrays (text, start, windows, name, twice); ``twice`` says whether the string that gives the name
    occurs more than once, without which no window of the stretch occurs in it again.
    """
    n = len(data)
    starts = np.arange(n)
    starts = starts[starts + length <= np.repeat(offsets[1:], np.diff(offsets))]
    if not len(starts):
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64), np.empty(0, bool)]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * powers(BASE, n), dtype=np.uint64)])
        hashes = mixed((sums[gram:] - sums[:-gram]) * powers(INVERSE, n - gram + 1))
    wide, have, least = length - gram + 1, 1, hashes
    # A string that names a window is the smallest one on that side of it on which the window has its longer part.
    side, near = 1, hashes
    while have < wide:
        more = min(have, wide - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
        if have == more * 2 and have <= (wide + 1) // 2:
            side, near = have, least
    names = least[starts]
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])))
    text, begin, windows, names = text[first], starts[first], np.diff(np.append(first, len(starts))), names[first]
    small = np.zeros(len(hashes), bool)
    small[: len(near)] = hashes[: len(near)] == near
    small[side - 1 :] |= hashes[side - 1 :] == near
    known, number = np.unique(names, return_inverse=True)
    places = np.flatnonzero(small)
    of = np.minimum(np.searchsorted(known, hashes[places]), len(known) - 1)
    own = known[of] == hashes[places]
    keys = np.sort(of[own] << 32 | places[own])
    low, high = number << 32 | begin, number << 32 | begin + windows + wide - 2
    twice = np.searchsorted(keys, high, "right") - np.searchsorted(keys, low) > 1
    return text, begin - offsets[text], windows, names, twice


# --- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_ranks(data, room, length):
    """For 8, 16, 32, ... and at last ``length`` bytes, the ranks of suffixes by so many first bytes.

    ``room`` says how many bytes each suffix has.  Equal ranks mean equal bytes.  Each step doubles the compared length:
    suffixes are ordered by the ranks of their two halves.  A suffix that is alone at some length keeps its rank.
    """
    width = 1 << max(0, min(3, length.bit_length() - 1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for i in range(width):
        words <<= np.uint64(8)
        words |= padded[i : i + len(data)]
    # Places and ranks take four bytes for as long as that is enough; the ranks of all lengths are held at once.
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    act = np.flatnonzero(room >= width).astype(kind)
    words = words[act]
    by = np.argsort(words, kind="stable")
    order, words = act[by], words[by]
    head = np.append(True, words[1:] != words[:-1])[: len(order)]
    del words, by, padded
    rank = np.zeros(len(data), kind)
    rank[order] = np.flatnonzero(head).astype(kind)[np.cumsum(head, dtype=kind) - 1]
    levels, act = [(width, rank)], _shared(order, head)
    while width < length:
        step = min(width, length - width)
        act = act[room[act] >= width + step]
        key = rank[act].astype(np.int64)
        key <<= 32
        key |= rank[act + step]
        by = np.argsort(key, kind="stable").astype(kind)
        order, key = act[by], key[by]
        del by
        head = np.append(True, key[1:] != key[:-1])[: len(order)]
        key >>= 32
        group = np.append(True, key[1:] != key[:-1])[: len(order)]
        del key
        at = np.arange(len(order), dtype=kind)
        sub = at[head][np.cumsum(head, dtype=kind) - 1] - at[group][np.cumsum(group, dtype=kind) - 1] if len(order) else at
        rank = rank.copy()
        rank[order] += sub
        width += step
        levels.append((width, rank))
        act = _shared(order, head)
    return levels


def _shared(order, head):
    """Those of an order whose group (begun by a head) has two members at least."""
    sizes = np.diff(np.append(np.flatnonzero(head), len(order)))
    return order[np.repeat(sizes > 1, sizes)]


def previous_smaller(values):
    """For each place of an array the nearest place before it with a smaller value, or -1.

    A candidate that is not smaller hands on its own candidate, since what lies between is larger still.
    """
    found, active = np.arange(len(values)) - 1, np.arange(len(values))
    while len(active):
        active = active[found[active] >= 0]
        active = active[values[found[active]] >= values[active]]
        found[active] = found[found[active]]
    return found


def _common(levels, a, b, length):
    """How many first bytes suffixes a and b share, up to ``length``, as far as the levels tell."""
    shared = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        fits = np.flatnonzero(shared + width <= length)
        same = rank[a[fits] + shared[fits]] == rank[b[fits] + shared[fits]]
        shared[fits[same]] += width
    return shared


def previous_factors(levels, suffixes, length):
    """The longest previous factor of each suffix (given in suffix order), up to ``length``.

    That is the longest of its beginnings that also begins at an earlier place; the neighbours in suffix order
    with the nearest smaller places have it.
    """
    n = len(suffixes)
    before, after = previous_smaller(suffixes), n - 1 - previous_smaller(suffixes[::-1])[::-1]
    out = np.zeros(n, np.int64)
    for other in (before, after):
        has = np.flatnonzero((other >= 0) & (other < n))
        out[has] = np.maximum(out[has], _common(levels, suffixes[has], suffixes[other[has]], length))
    return out


def repeated_windows(parts, counts, length, both):
    """For each part (bytes), which of its first ``counts`` windows of ``length`` bytes occur in an earlier place.

    Places are in the order of the parts.  With ``both``, later places count too: the same arrays are then
    read with the order of places turned round.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes)
    room -= np.arange(len(data))
    levels = suffix_ranks(data, room, length)
    del room
    starts = np.repeat(ends - sizes, counts) + np.concatenate([np.arange(n) for n in counts])
    final = levels[-1][1]
    # Only suffixes that share half the length with another one can share all of it.
    half = levels[-2][1] if len(levels) > 1 else final
    order = starts[np.argsort(final[starts], kind="stable")]
    near = half[order]
    suffixes = order[np.append(False, near[1:] == near[:-1]) | np.append(near[1:] == near[:-1], False)] if len(order) else order
    found = np.zeros(len(data), bool)
    found[suffixes] = previous_factors(levels, suffixes, length) >= length
    if both:
        turned = previous_smaller(-suffixes), len(suffixes) - 1 - previous_smaller(-suffixes[::-1])[::-1]
        for other in turned:
            has = np.flatnonzero((other >= 0) & (other < len(suffixes)))
            found[suffixes[has]] |= _common(levels, suffixes[has], suffixes[other[has]], length) >= length
    return [found[e - s : e - s + n] for e, s, n in zip(ends, sizes, counts)]


def _intervals(flags, start, length):
    """Byte ranges covered by flagged windows, the first of which begins at ``start``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(start + int(a), start + int(b) + length - 1) for a, b in zip(edges[::2], edges[1::2])]


# --- Spark ------------------------------------------------------------------------------------------------------------


def _named(docs, text, key):
    """Columns that tell a document: its key and two hashes of its text."""
    value = F.coalesce(F.col(text), F.lit(""))
    return {"_key": F.col(key), "_a": F.xxhash64(value), "_b": F.xxhash64(F.lit(1), value)}


def _runs(docs, length, gram):
    """Rows (place, start, windows, name, content) for every stretch of every text; ``content`` is a hash of its bytes."""
    kind = docs.schema["_key"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts = batch.column(3)
            for first, data, offsets in blocks(texts, 1 << 18):
                text, start, windows, name, twice = stretches(data, offsets, length, gram)
                if not len(text):
                    continue
                whole, begin = data.tobytes(), offsets[text] + start
                hashed = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(begin.tolist(), (begin + windows + length - 1).tolist())]
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(3)), pa.array(start, pa.int64()), pa.array(windows, pa.int64())]
                    + [pa.array(name.view(np.int64)), pa.array(np.array(hashed, np.uint64).view(np.int64)), pa.array(twice)],
                    [*PLACE, "start", "windows", "name", "content", "twice"],
                )

    schema = f"_key {kind}, _a long, _b long, start long, windows long, name long, content long, twice boolean"
    return docs.select(*PLACE, "_bytes").mapInArrow(cut, schema)


def _same_place():
    return F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_a") == F.col("_a2")) & (F.col("_b") == F.col("_b2"))


def _whole(rows):
    """A use of all other columns, without which Spark would prune them differently in two joins, and then shuffle twice."""
    return F.lit(0).cast("long") if "map<" in rows.schema["_row"].dataType.simpleString() else F.xxhash64("_row")


def _contents(docs, firsts, length):
    """The bytes of the given stretches: their texts are cut where they lie."""
    kind = docs.schema["_key"].dataType.simpleString()
    lists = firsts.groupBy(*PLACE).agg(F.collect_list(F.struct("name", "content", "n", "start", "windows")).alias("parts"))
    lists = lists.select(*[F.col(c).alias(c + "2") for c in PLACE], "parts")
    # The rows are dealt out with all their columns, as for the last join, so that Spark does that once.
    joined = docs.join(lists, _same_place()).select(*PLACE, "_bytes", "parts", _whole(docs).alias("_all"))

    def cut(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.slice(at, 200)
                parts = some.column(4)
                of = np.repeat(np.arange(len(some)), parts.value_lengths().to_numpy(zero_copy_only=False))
                flat = parts.flatten()
                texts = some.column(3).to_pylist()
                start, windows = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "windows"))
                content = [texts[i][a:b] for i, a, b in zip(of.tolist(), start.tolist(), (start + windows + length - 1).tolist())]
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(i).take(rows) for i in range(3)), *(flat.field(x) for x in ("name", "content", "n", "start", "windows"))]
                    + [pa.array(content, pa.binary())],
                    [*PLACE, "name", "content", "n", "start", "windows", "bytes"],
                )

    schema = f"_key {kind}, _a long, _b long, name long, content long, n long, start long, windows long, bytes binary"
    return joined.mapInArrow(cut, schema)


def _by_suffixes(parts, length, both):
    """Byte ranges (place, start, end) of stretches' windows that occur in other stretches of the same name."""
    kind = parts.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, _a long, _b long, start long, end long"

    def solve(table):
        own = table.column("content").to_numpy()
        name = table.column("name").to_numpy()
        table = table.filter(pa.array(np.append(True, (own[1:] != own[:-1]) | (name[1:] != name[:-1]))))
        # In the order of places, so that "earlier" is the same for all tasks.
        table = table.sort_by([(x, "ascending") for x in (*PLACE, "start")])
        start, n = table.column("start").to_pylist(), table.column("n").to_pylist()
        flags = repeated_windows(table.column("bytes").to_pylist(), table.column("windows").to_numpy(), length, both)
        ranges = [[] if both and n[i] > 1 else _intervals(x, start[i], length) for i, x in enumerate(flags)]
        of = pa.array(np.repeat(np.arange(len(ranges)), [len(x) for x in ranges]))
        flat = np.array([x for own in ranges for x in own], np.int64).reshape(-1, 2)
        columns = [table.column(x).combine_chunks().take(of) for x in PLACE]
        return pa.RecordBatch.from_arrays([*columns, pa.array(flat[:, 0]), pa.array(flat[:, 1])], [*PLACE, "start", "end"])

    def group(batches):
        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += table.nbytes
            if size < TOGETHER:
                continue
            table = pa.concat_tables(held)
            name = table.column("name").to_numpy()
            last = int(np.flatnonzero(name != name[-1])[-1]) + 1 if (name != name[-1]).any() else 0
            at = 0
            while at < last:
                # Whole names, as many as come to the size wanted.
                sizes = np.cumsum(table.column("windows").to_numpy()[at:last] + length)
                upto = at + int(np.searchsorted(sizes, TOGETHER)) + 1
                upto = min(last, upto)
                more = np.flatnonzero(name[upto:last] != name[upto - 1])
                upto = upto + int(more[0]) if len(more) else last
                yield solve(table.slice(at, upto - at))
                at = upto
            held, size = [table.slice(last)], 0
        if held and sum(map(len, held)):
            yield solve(pa.concat_tables(held))

    return parts.repartition("name").sortWithinPartitions("name", "content").mapInArrow(group, schema)


def _digests(content, windows, length):
    """The 128-bit hashes of all windows of a stretch, as two numbers each."""
    parts = []
    for at in range(0, windows, HASHED):
        digests = b"".join([xxhash.xxh3_128_digest(content[i : i + length]) for i in range(at, min(windows, at + HASHED))])
        parts.append(np.frombuffer(digests, "<i8").reshape(-1, 2))
    return np.concatenate(parts)


def _by_windows(parts, length, both):
    """The same for names with very many or very long stretches: every window is counted by its hash.

    Windows that repeat in their own stretch are settled in it, so a periodic text gives as many rows as its period is
    long: a row (times, hi, lo) for each different window at its first place, and rows with an ``end`` for ranges found.
    """
    kind = parts.schema["_key"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                start, windows = row.column("start")[0].as_py(), row.column("windows")[0].as_py()
                pairs = _digests(row.column("bytes")[0].as_py(), windows, length)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))  # Stable: the first place of equal windows comes first.
                ranked = pairs[order]
                new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, windows))
                again = np.zeros(windows, bool)
                again[order] = np.repeat(times > 1, times) if both else ~new
                ranges = np.array(_intervals(again, start, length), np.int64).reshape(-1, 2)
                n, m = len(heads), len(ranges)
                at = np.concatenate([start + order[heads], ranges[:, 0]])
                end = pa.array(np.concatenate([np.zeros(n, np.int64), ranges[:, 1]]), mask=np.arange(n + m) < n)
                hashes = [np.concatenate([ranked[heads, k], np.zeros(m, np.int64)]) for k in (0, 1)]
                of = pa.array(np.zeros(n + m, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(x).take(of) for x in (*PLACE, "n")), pa.array(at), end, *map(pa.array, hashes), pa.array(np.append(times, np.zeros(m, np.int64)))],
                    [*PLACE, "n", "start", "end", "hi", "lo", "times"],
                )

    schema = f"_key {kind}, _a long, _b long, n long, start long, end long, hi long, lo long, times long"
    rows = kept(parts.dropDuplicates(["name", "content"]).mapInArrow(cut, schema), "windows")
    windows, inside = rows.where("end is null"), rows.where("end is not null").select(*PLACE, "start", "end")
    place = F.struct(*PLACE, "start")
    often = windows.groupBy("hi", "lo").agg(F.count("*").alias("rows"), F.min(place).alias("first")).where("rows > 1")
    found = windows.join(often, ["hi", "lo"])
    found = found.where("n = 1 and times = 1") if both else found.where(place != F.col("first"))
    return inside.union(found.select(*PLACE, "start", (F.col("start") + length).alias("end")))


def repeated_ranges(docs, length, keep, gram, most):
    """(_key, _a, _b, start, end): byte ranges covered by strings of ``length`` bytes that occur elsewhere.

    ``docs`` has a place for each text (its key and two hashes of it) and its ``_bytes``.  ``keep="none"`` gives all
    copies, ``keep="first"`` spares the first (in the order of places).  Every window of
    ``length`` bytes belongs to one stretch of windows with the same name, and equal windows have equal names.  So
    stretches with the same bytes are settled by counting, and of different ones with one name, a single copy
    each goes into a suffix array with the others of its name, and so do stretches that may repeat in themselves.  Where one name has more than ``most`` different
    stretches, or more than ``NAME_BYTES`` in them, their windows are counted by hash instead, which Spark can spread.
    """
    both = {"none": True, "first": False}[keep]
    runs = _runs(docs, length, min(gram, length))
    # Rows that repeat a key and its text are one document if the first copy is to stay.
    runs = kept(runs if both else runs.distinct(), "stretches")
    place = F.struct(*PLACE, "start")
    different = runs.groupBy("name", "content").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.first("windows").alias("windows"), F.first("twice").alias("twice")
    )
    different = kept(different, "different-stretches")
    total = F.sum(F.col("windows") + length).alias("total")
    names = different.groupBy("name").agg(F.count("*").alias("many"), F.max("twice").alias("again"), total).where("many > 1 or again")
    names = names.withColumn("large", (F.col("many") > most) | (F.col("total") > NAME_BYTES))
    names = kept(names, "names")
    firsts = different.join(names, "name").select("name", "content", "n", "windows", "large", "first.*")
    parts = _contents(docs, firsts.where("not large"), length)
    found = [_by_suffixes(parts, length, both)]
    if not names.where("large").isEmpty():
        found.append(_by_windows(_contents(docs, firsts.where("large"), length), length, both))
    often = different.where("n > 1").select("name", "content", "first")
    copies = runs.join(often, ["name", "content"])
    copies = copies if both else copies.where(place != F.col("first"))
    found.append(copies.select(*PLACE, "start", (F.col("start") + F.col("windows") + length - 1).alias("end")))
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.union(more)
    return ranges


def drop_repeats(docs, text="text", key="doc_id", length=400, keep="none", gram=GRAM, most=GROUP):
    """The documents with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (what is left, as bytes).

    Texts are UTF-8 bytes; matches do not cross documents.  Bytes covered by a string of ``length`` bytes that starts
    anywhere else too, in the same document included, are removed, or spared in the first place with ``keep="first"``;
    see ``repeated_ranges``.  Overlapping and adjoining ranges are one span.  All is judged on the input.

    Null texts are empty.  Repeated rows are copies of each other with ``keep="none"``, and one document with ``keep="first"``.
    Input columns with the names of the outputs are replaced.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    own = [c for c in docs.columns if c.lower() not in names]
    others = F.struct(*[F.col(quoted(c)) for c in own if c != text], F.col(text).isNull().alias("_null"))
    rows = small_batches(docs).select(others.alias("_row"), as_bytes(text).alias("_bytes"), *[c.alias(n) for n, c in _named(docs, text, key).items()])
    ranges = repeated_ranges(rows, length, keep, gram, most)
    lists = ranges.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_ranges"))
    lists = lists.select(*[F.col(c).alias(c + "2") for c in PLACE], "_ranges")
    joined = rows.join(lists, _same_place(), "left").select("_row", "_bytes", "_ranges")

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_bytes:binary>")
    def remove(texts: pa.Array, ranges: pa.Array, _: pa.Array) -> pa.Array:
        out = [[], [], [], []]
        flat, offsets = ranges.flatten(), np.concatenate([[0], np.cumsum(ranges.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))])
        start, end = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "end"))
        for i, text in enumerate(texts):
            text, a, b = text.as_py(), start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]
            if len(a):
                reach = np.maximum.accumulate(b)
                head = np.append(True, a[1:] > reach[:-1])
                a, b = a[head].tolist(), reach[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)].tolist()
                left = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)]))
            else:
                left = text
            for column, value in zip(out, (len(text), len(text) - len(left), len(a), left)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["n_bytes", "n_removed", "n_spans", "kept_bytes"])

    done = joined.select("_row", "_bytes", remove("_bytes", "_ranges", _whole(rows)).alias("_done"))
    given = F.when(~F.col("_row._null"), F.col("_bytes").cast("string"))
    return done.select(
        *[given.alias(c) if c == text else F.col(f"_row.{quoted(c)}") for c in own], *[F.col(f"_done.{n}") for n in names]
    )

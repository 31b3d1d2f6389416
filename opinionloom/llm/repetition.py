"""Quality rules: how much of a text lies in repeated word sequences and lines."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import BYTE_CODES, IS_WHITE, as_bytes, blocks, mixed, segment_hashes, small_batches, with_outputs

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

#: Words in a sequence, and the most per cent of a text's characters that repeated sequences may hold.
COVERAGE = {5: 40, 10: 35, 20: 30}
#: The same for lines that repeat an earlier one.
LINES = 30
#: Fixed values of the base rule: fewest words, window length, most per cent of words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30


def _repeated(keys, texts):
    """Of keys with the number of their text: which occur more than once in it, and which not for the first time."""
    with np.errstate(over="ignore"):
        own = keys ^ mixed(texts + 1)
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    later, often = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:]] = same
    often[order[1:]] = same
    often[order[:-1]] |= same
    return often, later


def _covered(hashes, texts, n):
    """Which words lie in a sequence of n words that occurs again in the same text."""
    if len(hashes) < n:
        return np.zeros(len(hashes), bool)
    starts = np.arange(len(hashes) - n + 1)
    starts = starts[texts[starts] == texts[starts + n - 1]]
    often, _ = _repeated(segment_hashes(hashes, starts, starts + n), texts[starts])
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts[often], 1)
    np.add.at(edges, starts[often] + n, -1)
    return np.cumsum(edges)[:-1] > 0


def _sums(values, offsets):
    """Sum of each text's values; offsets are the places where texts begin, and the end."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(data, offsets, lengths):
    """Counts for each text of a block, as a dict of arrays."""
    white, points = IS_WHITE[data], (data & 0xC0) != 0x80
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inside = ~white
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= white[:-1] | first[1:-1]
    ends[:-1] &= white[1:] | first[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    codes = BYTE_CODES[data]
    words = np.searchsorted(begins, offsets)
    text_of_word = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    hashes = segment_hashes(codes, begins, ends)
    point_sums = np.concatenate([[0], np.cumsum(points & inside, dtype=np.int64)])
    chars = point_sums[ends] - point_sums[begins]

    line_first = first[:-1].copy()
    line_first[1:] |= data[:-1] == 10
    line_begins = np.flatnonzero(line_first)
    line_ends = np.append(line_begins[1:], len(data))[: len(line_begins)]
    line_ends = line_ends - (data[line_ends - 1] == 10)
    held = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
    line_begins, line_ends = line_begins[held], line_ends[held]
    lines = np.searchsorted(line_begins, offsets)
    _, again = _repeated(segment_hashes(codes, line_begins, line_ends), np.repeat(np.arange(len(offsets) - 1), np.diff(lines)))
    out = {
        "n_words": np.diff(words),
        "word_chars": _sums(chars, words),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_dup_lines": _sums(again, lines),
        "n_repeat_words": _sums(_covered(hashes, text_of_word, WINDOW), words),
        "line_chars": _sums(np.where(again, point_sums[line_ends] - point_sums[line_begins], 0), lines),
    }
    for n in lengths:
        out[f"chars_{n}"] = _sums(np.where(_covered(hashes, text_of_word, n), chars, 0), words)
    return out


def measured(docs, text="text", coverage=None, line_limit=LINES):
    """The documents with their repetition measures and the verdict ``kept``.

    Words are runs without white space.  ``n_repeat_words`` counts words in windows of 8 words that the
    text holds twice or more, the first included; ``chars_N`` the characters of words inside sequences
    of N words that occur again, ``line_chars`` the characters of words in lines equal to an earlier one.
    The base rule fails a text with fewer than 20 words, or with over 30 % of them in repeated
    windows.  ``kept`` is false if that fails, or if a measure is over its per cent of ``word_chars``.

    Null and empty texts have no words and fail.  Input columns with the names of the measures are
    replaced.  Each text is measured as a whole, for itself; no row leaves its task.
    """
    coverage = COVERAGE if coverage is None else coverage
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", *(f"chars_{n}" for n in coverage)]

    @F.arrow_udf("struct<" + ",".join(f"{name}:long" for name in names) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        found = [measure(data, offsets, coverage) for _, data, offsets in blocks(texts)]
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([x[name] for x in found]) if found else [], pa.int64()) for name in names], names
        )

    rows = small_batches(docs).drop("_measures").withColumn("_measures", counts(as_bytes(text)))
    of = lambda name: F.col(f"_measures.{name}")
    failed = (of("n_words") < LEAST_WORDS) | (100 * of("n_repeat_words") > MOST_REPEATED * of("n_words"))
    good = 100 * of("line_chars") <= line_limit * of("word_chars")
    for n, limit in coverage.items():
        good &= 100 * of(f"chars_{n}") <= limit * of("word_chars")
    outputs = {name: of(name) for name in names} | {"base_failed": failed, "kept": ~failed & good}
    return with_outputs(rows, outputs).drop("_measures")


def good_documents(docs, text="text", **limits):
    """The documents whose verdict is ``kept``, with the columns they came with."""
    own = [name for name in docs.columns]
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in own]).alias("_row"), F.col(text).alias("_text"))
    return measured(rows, "_text", **limits).where("kept").select("_row.*")

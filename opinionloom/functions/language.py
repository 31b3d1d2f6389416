"""The language of a text, by its runs of three letters.

A profile holds, for each language, a weight of every bucket of letter runs: the logarithm of how often it occurs in texts of the
language, in whole steps.  It is learned from texts of known language, and applied to batches of texts.
"""

import functools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# Buckets of letter runs (a prime), steps of the logarithm, and languages that a profile may have.
BUCKETS, STEPS, MOST_LANGUAGES = 8191, 1000, 200
UNKNOWN = "unknown"
NOT_LETTERS = r"\P{L}+"
# Code points of a run become one number with these factors.
FACTORS = (961, 31, 1)
# Characters whose runs are looked at together; a longer text is looked at on its own.
PART = 1 << 18


def letter_words(text):
    """Lower-case runs of letters of a text, between single spaces, with one before and one after; a missing text has none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), NOT_LETTERS, " ")


def spaced_text(text):
    """The lower-case text with a space before and after it; a missing text is two spaces."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


@functools.cache
def _letter_edges():
    """The code points at which letters begin and end, in turns."""
    letters = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
    return np.flatnonzero(np.diff(letters)) + 1


def bucket_reader():
    """A function that yields (first text, buckets, offsets) for consecutive texts of ``spaced_text`` or ``letter_words``, some
    ``PART`` characters at a time.

    ``buckets`` has one number for each run of three characters whose middle is a letter, where all that is no letter counts as
    a space; ``offsets`` (one more than texts) says which are whose.  It is made here so that it travels with the functions that use it.
    """
    part, buckets, (first, second, third), edges, end = PART, BUCKETS, FACTORS, _letter_edges(), sys.maxunicode + 1

    def read(texts):
        sizes = np.diff(np.concatenate([[0], edges, [end]]))
        is_letter = np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size == 0 or size + len(texts[upto]) <= part):
                size += len(texts[upto])
                upto += 1
            some = texts[at:upto]
            # Texts begin and end with a space, so no run with a letter in the middle reaches into the next one.
            codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
            letter = is_letter[codes]
            codes = np.where(letter, codes, np.uint32(32))
            runs = codes[:-2] * np.uint32(first) + codes[1:-1] * np.uint32(second) + codes[2:] * np.uint32(third)
            # The remainder; numpy divides whole arrays faster than it takes remainders.
            runs -= runs // np.uint32(buckets) * np.uint32(buckets)
            letters = np.flatnonzero(letter)
            ends = np.cumsum([len(x) for x in some])
            yield at, runs[letters - 1].astype(np.int64), np.concatenate([[0], np.searchsorted(letters, ends)])
            at = upto

    return read


def run_buckets(spaced):
    """The bucket of each run of three characters in ``letter_words`` whose middle is a letter."""
    read = bucket_reader()

    @F.arrow_udf("array<int>")
    def of_texts(texts: pa.Array) -> pa.Array:
        parts = [pa.array(np.split(found, offsets[1:-1]), pa.list_(pa.int32())) for _, found, offsets in read(texts.to_pylist())]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return of_texts(spaced)


class LanguageProfile:
    """Weights of the buckets for each language, the languages in order of their names."""

    def __init__(self, weights):
        self.weights = {name: list(own) for name, own in sorted(weights.items())}

    def detector(self, least=1):
        """A function from a text Column to a Column with the language whose runs of letters fit best.

        Texts with fewer than ``least`` runs, and those that fit two languages equally well, are 'unknown'.  The profile
        travels with the function (one number for each bucket and language), so nothing is joined.
        """
        if not self.weights:
            return lambda text: F.lit(UNKNOWN)
        read, unknown, names = bucket_reader(), UNKNOWN, list(self.weights)
        weights = np.array(list(self.weights.values()), np.int64)

        @F.arrow_udf("string")
        def best(texts: pa.Array) -> pa.Array:
            out = []
            for _, found, offsets in read(texts.to_pylist()):
                scores = np.empty((len(names), len(offsets) - 1), np.int64)
                for own, score in zip(weights, scores):
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(own[found])])
                    score[:] = sums[offsets[1:]] - sums[offsets[:-1]]
                tie = np.count_nonzero(scores == scores.max(axis=0), axis=0) > 1
                open_ = tie | (np.diff(offsets) < least)
                out.extend(unknown if x else names[i] for i, x in zip(scores.argmax(axis=0).tolist(), open_.tolist()))
            return pa.array(out, pa.string())

        return lambda text: best(spaced_text(text))

    def save(self, spark, path):
        """Store the profile as a table."""
        rows = [(name, bucket, weight) for name, own in self.weights.items() for bucket, weight in enumerate(own)]
        spark.createDataFrame(rows, "lang string, bucket int, weight long").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path):
        weights = {}
        for row in spark.read.parquet(path).orderBy("lang", "bucket").collect():
            weights.setdefault(row["lang"], []).append(row["weight"])
        return cls(weights)


def bucket_counts(rows, text="text", lang="lang"):
    """(lang, bucket, n): how often each bucket occurs in the texts of each language, added up in each task first."""
    kind = rows.schema[lang].dataType.simpleString()
    read, buckets, most = bucket_reader(), BUCKETS, MOST_LANGUAGES

    def rows_of(sums, type_):
        names = list(sums)
        table = np.array([sums[x] for x in names]).reshape(-1, buckets)
        which, bucket = np.nonzero(table)
        langs = pa.array(names, type_).take(pa.array(which))
        return pa.RecordBatch.from_arrays([langs, pa.array(bucket.astype(np.int32)), pa.array(table[which, bucket])], ["lang", "bucket", "n"])

    def count(batches):
        sums, type_ = {}, None
        for batch in batches:
            coded, type_ = batch.column(0).dictionary_encode(), batch.column(0).type
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for first, found, offsets in read(batch.column(1).to_pylist()):
                here = of[first : first + len(offsets) - 1]
                whose = np.repeat(here, np.diff(offsets))
                for code in np.unique(here).tolist():
                    own = np.bincount(found[whose == code], minlength=buckets)
                    sums[names[code]] = sums[names[code]] + own if names[code] in sums else own
            if len(sums) > most:
                yield rows_of(sums, type_)
                sums = {}
        if sums:
            yield rows_of(sums, type_)

    spaced = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), spaced_text(F.col(text)).alias("spaced"))
    counted = spaced.mapInArrow(count, f"lang {kind}, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn_languages(rows, text="text", lang="lang"):
    """The profile of the languages of some texts of known language; texts without a language are left out.

    One number for each bucket and language comes to the driver, whatever the number of texts.
    """
    counts = {}
    # One pass: that many rows and one more are of too many languages.
    found = bucket_counts(rows, text, lang).limit(MOST_LANGUAGES * BUCKETS + 1).collect()
    if len(found) > MOST_LANGUAGES * BUCKETS or len({row["lang"] for row in found}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for row in found:
        counts.setdefault(row["lang"], [0] * BUCKETS)[row["bucket"]] = row["n"]
    return LanguageProfile({name: weights_of(own) for name, own in counts.items()})


def weights_of(counts):
    total = sum(counts) + len(counts)
    return [math.floor(STEPS * math.log((n + 1) / total) + 0.5) for n in counts]

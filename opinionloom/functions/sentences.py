"""Sentences with learned abbreviations: a full stop after one of them does not end a sentence.

Abbreviations are found without labelled text, by how much more often a word stands before a full stop than words in
general do (the log-likelihood ratio of Kiss and Strunk's published method, with their factors for short words, for
inner full stops, and for uses without a full stop).
"""

import math

from pyspark.sql import functions as F

from opinionloom.functions import text as txt
from opinionloom.functions.phrases import phrase_pattern

# A word with inner full stops, and the full stops that may follow it.
WORD = r"\p{L}[\p{L}\p{N}.]*"
# Probability of a full stop after an abbreviation, and the score from which a word is one (fixed values of the method).
STOPPED, LEAST_SCORE = 0.99, 0.3
# The longest abbreviation, and the most that a model keeps, the best first.
LONGEST, MOST = 20, 2000
# Stands between a full stop and white space where no sentence ends; a non-character, which no text should hold.
HELD = "\ufdd0"


def word_counts(rows, text="text"):
    """(word, n, stopped): how often each lower-case word occurs, and how often exactly one full stop follows."""
    found = rows.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))).alias("found"))
    word = F.rtrim(F.col("found"), F.lit("."))
    stopped = F.length("found") == F.length(word) + 1
    return found.groupBy(word.alias("word")).agg(F.count("*").alias("n"), F.count_if(stopped).alias("stopped"))


def abbreviation_scores(counts):
    """(word, n, stopped, score) of the words that may be abbreviations, from ``word_counts``."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("stopped").alias("stopped")).first()
    share = (total["stopped"] or 0) / (total["n"] or 1)
    rows = counts.where((F.col("stopped") > 0) & (F.length("word") <= LONGEST))
    if not 0 < share < 1:
        return rows.withColumn("score", F.lit(0.0)).where("false")
    k, n = F.col("stopped").cast("double"), F.col("n").cast("double")
    usual = k * math.log(share) + (n - k) * math.log(1 - share)
    always = k * math.log(STOPPED) + (n - k) * math.log(1 - STOPPED)
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = (F.length("word") - inner).cast("double")
    score = -2 * (usual - always) * F.exp(-letters) * (inner + 1) * F.pow(letters, k - n)
    return rows.withColumn("score", score)


def learn_abbreviations(rows, text="text", least=LEAST_SCORE, most=MOST):
    """The abbreviations of a corpus, at most ``most`` of them, the best first; equal scores in order of the words.

    The corpus is counted by words, combining in each task; only the list itself comes to the driver.
    """
    scored = abbreviation_scores(word_counts(rows, text)).where(F.col("score") >= least)
    return [row["word"] for row in scored.orderBy(F.desc(F.round("score", 9)), "word").limit(most).collect()]


def sentence_splitter(abbreviations):
    """A function from a text Column to its sentences, like ``text.split_sentences``, that knows these abbreviations.

    After an abbreviation and one full stop the sentence goes on, unless the line ends there.
    """
    words = sorted({word.lower() for word in abbreviations if word})
    if not words:
        return txt.split_sentences
    blank = rf"[{txt.SPACE}&&[^\n]]"
    held = rf"(?<![\p{{L}}\p{{N}}.])((?iu:{phrase_pattern(words)})\.)(?={blank}+[^\n{txt.SPACE}])"

    def split(text):
        return F.transform(txt.split_sentences(F.regexp_replace(text, held, "$1" + HELD)), lambda s: F.replace(s, F.lit(HELD), F.lit("")))

    return split

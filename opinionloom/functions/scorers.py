"""Scorers: functions from a text Column to a ``struct<raw_label, confidence>`` Column.

``lexicon_scorer`` is a native expression and the default.  ``batch_scorer`` plugs in any
batch model through an Arrow iterator function.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from opinionloom.functions import text as txt
from opinionloom.functions import vocab
from opinionloom.functions.phrases import bind, word_count
from opinionloom.functions.vocab import NEGATIVE, NEUTRAL, POSITIVE

SCORE_TYPE = "struct<raw_label: string, confidence: double>"


def lexicon_scorer(positive=vocab.POSITIVE_WORDS, negative=vocab.NEGATIVE_WORDS):
    """Scorer by lists of lower-case words: the side with more uses wins, a tie is neutral.

    Confidence is the share of the winning side among the listed words found, 0 if none was.
    """

    def verdict(found):
        good, bad = found["good"], found["bad"]
        label = F.when(good > bad, POSITIVE).when(bad > good, NEGATIVE).otherwise(NEUTRAL)
        confidence = F.when(good + bad > 0, F.greatest(good, bad) / (good + bad)).otherwise(F.lit(0.0))
        return F.when(good.isNotNull(), F.struct(label.alias("raw_label"), confidence.alias("confidence")))

    def counts(lowered):
        good = word_count(lowered, positive, txt.WORD).alias("good")
        bad = word_count(lowered, negative, txt.WORD).alias("bad")
        return bind(F.struct(good, bad), verdict)

    def score(text):
        return bind(F.lower(text), counts)

    return score


def batch_scorer(load_model, batch_size=32, on_error="raise"):
    """Scorer around a batch model.

    ``load_model()`` runs once per Python worker task and returns a function from a list of
    texts to a list of ``(raw_label, confidence)``.  NULL texts are not passed to it.  With
    ``on_error='neutral'`` a failing batch is labelled neutral instead of failing the job.
    """
    if on_error not in ("raise", "neutral"):
        raise ValueError("on_error is 'raise' or 'neutral'")

    def score_batch(model, texts):
        try:
            return list(model(texts))
        except Exception:
            if on_error == "raise":
                raise
            return [(NEUTRAL, 0.0)] * len(texts)

    @F.pandas_udf(SCORE_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for texts in batches:
            given = texts[texts.notna()]
            scored = []
            for start in range(0, len(given), batch_size):
                scored.extend(score_batch(model, given.iloc[start:start + batch_size].tolist()))
            rows = pd.DataFrame(scored, columns=["raw_label", "confidence"], index=given.index)
            yield rows.reindex(texts.index)

    return score


def batch_translator(load_model, batch_size=32, on_error="raise"):
    """Translator around a batch model; ``load_model()`` gives a function list → list.

    NULL texts are not passed on, and a text that comes back as None counts as not translated.
    With ``on_error='keep'`` the texts of a failing batch stay as they were.
    """
    if on_error not in ("raise", "keep"):
        raise ValueError("on_error is 'raise' or 'keep'")

    def translate_batch(model, texts):
        try:
            return list(model(texts))
        except Exception:
            if on_error == "raise":
                raise
            return [None] * len(texts)

    @F.pandas_udf("string")
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            given = texts[texts.notna()]
            translated = []
            for start in range(0, len(given), batch_size):
                translated.extend(translate_batch(model, given.iloc[start:start + batch_size].tolist()))
            yield pd.Series(translated, index=given.index, dtype=object).reindex(texts.index)

    return translate

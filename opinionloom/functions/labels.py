"""Polarity labels: from stars, from raw classifier output, and as class ids."""

from pyspark.sql import functions as F

from opinionloom.functions import vocab
from opinionloom.functions.vocab import NEGATIVE, NEUTRAL, POSITIVE

LEADING_NUMBER = "^([0-9]+)"


def label_of_stars(stars):
    """Up to two stars are Negative, three Neutral, more Positive; no stars give no label."""
    return F.when(stars <= 2, NEGATIVE).when(stars == 3, NEUTRAL).when(stars.isNotNull(), POSITIVE)


def stars_of_raw_label(raw):
    """Stars of raw output such as '4 stars' or 'Negative'; any other text counts as neutral."""
    number = F.regexp_extract(raw, LEADING_NUMBER, 1)
    lowered = F.lower(raw)
    worded = (
        F.when(lowered.contains("positive"), vocab.LABEL_STARS[POSITIVE])
        .when(lowered.contains("negative"), vocab.LABEL_STARS[NEGATIVE])
        .when(raw.isNotNull(), vocab.LABEL_STARS[NEUTRAL])
    )
    return F.when(number != "", number.cast("double")).otherwise(worded.cast("double"))


def display_label(raw):
    """Label shown for raw output: a 4, 5 or 'pos' in it wins over a 1, 2 or 'neg'."""
    upper = F.upper(raw)
    return (
        F.when(upper.rlike("[45]|POS"), POSITIVE)
        .when(upper.rlike("[12]|NEG"), NEGATIVE)
        .when(raw.isNotNull(), NEUTRAL)
    )


def label_id(label):
    """Class id of a label; NULL for an unknown one."""
    pairs = [F.lit(part) for pair in vocab.LABEL_IDS.items() for part in pair]
    return F.create_map(*pairs)[label]

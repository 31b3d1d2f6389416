"""Cleaning and the junk test on random Unicode texts, against the SQL forms of the same rules."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from opinionloom.functions import text as txt
from oracle.sql import clean, junk, strip

PIECES = [
    "phone", "Ok", "lol", "k", "http://a.b/c", "www.x", "<b>", "</p\n>", "<", ">", "...", "!?", ",", " ", "  ", "\t", "\n", "\r",
    "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　", "​",
    "é", "é", "ß", "ñ", "½", "²", "٣", "Ⅷ", "中文", "한국", "Ωσς", "_", "-", "'", "\"", "$", "€", "\U0001f600", "\U00020000", "a", "B", "7",
]


def random_texts(count):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(count)]


def test_random_texts(spark):
    texts = pd.DataFrame({"i": range(5000), "t": random_texts(5000)})
    c = F.col("c")
    found = (
        spark.createDataFrame(texts).withColumn("c", txt.clean_text(F.col("t")))
        .select("i", "c", txt.is_meaningless(c).alias("junk"), txt.trim_space(F.col("t")).alias("s")).orderBy("i").collect()
    )
    with duckdb.connect() as connection:
        connection.register("texts", texts)
        expected = connection.execute(
            f"select i, c, {junk('c')}, s from (select i, {clean('t')} as c, {strip('t')} as s from texts) order by i"
        ).fetchall()
    for ours, theirs in zip(found, expected):
        assert tuple(ours) == theirs, texts["t"][ours["i"]]

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from rows import awkward, prose, table

from opinionloom.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    own = [(key, Counter(w), len(w)) for key, w in ((key, words(t)) for key, t in docs) if w]
    n_docs, length = len(own), sum(n for *_, n in own)
    df = Counter(term for _, tf, _ in own for term in tf)
    out = []
    for item, text in items:
        scores = []
        for key, tf, n in own:
            m = 75 + 25 * n * n_docs // length
            score = 0
            for term in words(text):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * tf[term] // (1000 * tf[term] + 12 * m))
            if score > 0 and key is not None:
                scores.append((-score, key))
        out += [(item, i + 1, key, -s) for i, (s, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def run(spark, texts, asked, **options):
    found = ranked.ranked_search(table(spark, texts), items_of(spark, asked), **options)
    got = sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute(enumerate(texts), enumerate(asked), options.get("k", 20))


def corpus(n, seed):
    own = random.Random(seed)
    lexicon = prose(seed, 400).split(" ")
    return [" ".join(own.choices(lexicon[: own.choice([5, 50, 400])], k=own.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"index_bytes": 300, "k": 3}])
def test_same_as_brute_force(spark, options):
    texts = corpus(400, 1)
    run(spark, texts, [*texts[:12], *corpus(8, 2), texts[0]], **options)


def test_ties_repeats_and_awkward_texts(spark, monkeypatch):
    texts = [*awkward(), *["the same text again"] * 60, *["again The SAME text!"] * 30, "Größe 日本語", "a_b-c9", "x" * 100_000, "\x7f[`{"]
    asked = [*awkward(), "same text", "same same same", "日本語 GRÖSSE größe", "B c9", "\x00", None, "no such words here", "same text"]
    run(spark, texts, asked)
    monkeypatch.setattr(ranked, "CANDIDATES", 7)
    monkeypatch.setattr(ranked, "CELLS", 40)
    run(spark, texts, asked, k=2)


def test_tables(spark):
    docs, items = table(spark, corpus(30, 3)), items_of(spark, corpus(3, 3))
    assert ranked.ranked_search(docs.limit(0), items).collect() == [] and ranked.ranked_search(docs, items.limit(0)).collect() == []
    assert ranked.ranked_search(docs.limit(0), items).dtypes == ranked.ranked_search(docs, items).dtypes
    assert ranked.ranked_search(table(spark, [None, "", " "]), items).collect() == []
    odd = docs.selectExpr("doc_id as key", "text as terms", "1 as n", "2 as uid", "3 as score", "4 as `a.b`", "5 as item")
    asked = items.selectExpr("item_id as key", "text as uid", "1 as item_key", "2 as part", "3 as bytes", "4 as rank")
    found = ranked.ranked_search(odd, asked.withColumnRenamed("key", "score"), text="terms", key="key", item="score", item_text="uid")
    assert found.count() == ranked.ranked_search(docs, items).count() and found.columns == ["score", "rank", "key", "score"]
    nulls = spark.createDataFrame([(None, "word"), (1, "word other"), (None, None)], "doc_id long, text string")
    rows = [(None, "word"), (1, "word other"), (None, None)]
    assert list(map(tuple, ranked.ranked_search(nulls, items_of(spark, ["word other"])).collect())) == brute(rows, [(0, "word other")])
    twice = ranked.ranked_search(docs.union(docs), items.union(items), k=100)
    assert twice.groupBy("item_id", "rank").count().where("count <> 2").isEmpty()


def test_large_scores_are_exact(spark):
    """Sums beyond what doubles hold exactly."""
    asked = ["rare " * 400_000, "rare common " * 100_000]
    run(spark, ["rare common"] * 2 + ["common"] * 50 + ["rare " * 3 + "common"], asked)


def test_best_of_hot_copies():
    """A million equal documents leave only k of them, in bounded memory."""
    best = ranked.Best(2, 3)
    for at in range(0, 1_000_000, 1000):
        best.add(np.full((1000, 2), 7), np.arange(at, at + 1000)[::-1])
        assert best.n <= ranked.CANDIDATES + 2000
    assert best.cut().tolist() == [[0, 0, 0, 1, 1, 1], [7] * 6, [0, 1, 2, 0, 1, 2]]

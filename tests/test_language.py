"""Detected languages and learned abbreviations, on real sentences and against plain Python."""

import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinionloom.functions import language, sentences
from opinionloom.functions import text as txt
from opinionloom.operators import cleaning

KNOWN = {
    "en": "the weather is nice today and we walk along the river with our friends while the children play in the garden",
    "de": "das wetter ist heute schön und wir gehen mit unseren freunden am fluss entlang während die kinder im garten spielen",
    "fr": "le temps est beau aujourd'hui et nous marchons le long de la rivière avec nos amis pendant que les enfants jouent",
}
ASKED = [
    ("en", "we play with the children in the nice garden"), ("de", "die kinder gehen heute mit den freunden in den garten"),
    ("fr", "nos enfants jouent avec les amis le long du jardin"), ("unknown", None), ("unknown", ""), ("unknown", "123 !? 45"),
]


def known(spark):
    return spark.createDataFrame([*KNOWN.items(), ("en", None), (None, "no language")], "lang string, text string")


def brute_runs(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    runs = [f" {w} "[i : i + 3] for w in words for i in range(len(w))]
    return [(ord(a) * 961 + ord(b) * 31 + ord(c)) % language.BUCKETS for a, b, c in runs]


def test_runs_of_letters(spark):
    texts = [*KNOWN.values(), "", None, "a", "I a B", "x1y2", "größe\t日本語 テキスト", "!?", "a\nb", "😀a"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(language.run_buckets(language.letter_words(F.col("t")))).collect()]
    assert found == [brute_runs(t) for t in texts]


def test_weights_are_logarithms_of_shares(spark):
    profile = language.learn_languages(known(spark))
    assert list(profile.weights) == ["de", "en", "fr"]
    counts = Counter(brute_runs(KNOWN["de"]))
    total = sum(counts.values()) + language.BUCKETS
    want = [math.floor(1000 * math.log((counts[b] + 1) / total) + 0.5) for b in range(language.BUCKETS)]
    assert profile.weights["de"] == want


def test_languages_are_told_apart(spark, tmp_path):
    profile = language.learn_languages(known(spark))
    profile.save(spark, str(tmp_path / "profile"))
    frame = spark.createDataFrame(ASKED, "lang string, text string")
    for own in (profile, language.LanguageProfile.load(spark, str(tmp_path / "profile"))):
        assert [r[0] for r in frame.select(own.detector()(F.col("text"))).collect()] == [lang for lang, _ in ASKED]
    few = profile.detector(least=1000)
    assert {r[0] for r in frame.select(few(F.col("text"))).collect()} == {"unknown"}
    twins = language.LanguageProfile({"a": profile.weights["de"], "b": profile.weights["de"]})
    assert {r[0] for r in frame.select(twins.detector()(F.col("text"))).collect()} == {"unknown"}
    assert frame.select(language.learn_languages(known(spark).limit(0)).detector()(F.col("text"))).first()[0] == "unknown"


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    detect = language.learn_languages(docs.where(~held_out)).detector()
    asked = docs.where(held_out & (F.length("text") >= 40))
    found = asked.agg(F.avg((detect(F.col("text")) == F.col("lang")).cast("int")), F.count("*")).first()
    assert found[0] >= 0.97 and found[1] > 20


def test_translator_sees_foreign_texts_only(spark):
    detector = language.learn_languages(known(spark)).detector()
    rows = [(i, text) for i, (_, text) in enumerate(ASKED)]
    reviews = spark.createDataFrame(rows, "review_id long, cleaned_review string")
    done = cleaning.translate_reviews(reviews, lambda t: F.concat(F.lit("was "), t), detector=detector).orderBy("review_id").collect()
    assert [(r["final_review"] or "").startswith("was ") for r in done] == [False, True, True, False, False, False]


ABBREVIATED = ["Dr. Who met Prof. Smith.", "He came at 9 a.m. on Monday. They went home.", "See Dr. Brown. Ask Prof. Green, e.g. today."]


def corpus(spark):
    nouns = ["dog", "cat", "park", "house", "tree", "there", "home", "him", "monday", "today"]
    plain = [f"The {a} is near the {b}." for a, b in itertools.permutations(nouns, 2)]
    return spark.createDataFrame([(t,) for t in [*plain * 8, *ABBREVIATED * 6, None, "", "..."]], "text string")


def brute_scores(texts):
    n, stopped = Counter(), Counter()
    for text in texts:
        for found in re.findall(r"[^\W\d_][^\W_.]*(?:[.][^\W_.]*)*", (text or "").lower()):
            word = found.rstrip(".")
            n[word] += 1
            stopped[word] += len(found) == len(word) + 1
    p = sum(stopped.values()) / sum(n.values())
    out = {}
    for word, k in stopped.items():
        if k and len(word) <= 20:
            ratio = -2 * (k * math.log(p) + (n[word] - k) * math.log(1 - p) - k * math.log(0.99) - (n[word] - k) * math.log(0.01))
            letters = len(word.replace(".", ""))
            out[word] = ratio * math.exp(-letters) * (word.count(".") + 1) * letters ** float(k - n[word])
    return out


def test_abbreviations_are_learned(spark):
    rows = corpus(spark)
    scored = {r["word"]: r["score"] for r in sentences.abbreviation_scores(sentences.word_counts(rows)).collect()}
    want = brute_scores([r["text"] for r in rows.collect()])
    assert scored.keys() == want.keys() and all(scored[w] == pytest.approx(want[w]) for w in want)
    found = sentences.learn_abbreviations(rows)
    assert {"dr", "prof", "a.m", "e.g"} <= set(found) and not {"dog", "park", "there", "home"} & set(found)
    assert sentences.learn_abbreviations(rows, most=2) == found[:2]
    assert sentences.learn_abbreviations(rows.limit(0)) == []
    assert sentences.learn_abbreviations(spark.createDataFrame([("no stop here",), (None,)], "text string")) == []


def test_sentences_go_on_after_abbreviations(spark):
    split = sentences.sentence_splitter(["dr", "prof", "a.m", "e.g", "z", "b"])
    cases = {
        "Dr. Who met Prof. Smith. He left.": ["Dr. Who met Prof. Smith.", "He left."],
        "At 9 a.m. it rang! DR. No, e.g. z. B. him. End": ["At 9 a.m. it rang!", "DR. No, e.g. z. B. him.", "End"],
        "Ask the dr.\nNew line. Old dr.": ["Ask the dr.", "New line.", "Old dr."],
        "Ask the dr. \n New": ["Ask the dr.", "New"],
        "a xdr. b": ["a xdr.", "b"], "dr.. b": ["dr..", "b"], "dr.  b": ["dr.  b"], "": [], None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", split(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == cases
    assert sentences.sentence_splitter([]) is txt.split_sentences


def test_runs_are_counted_in_one_pass_for_many_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "PART", 50)
    rows = [(i, "de" if i % 3 else "en", w) for i, w in enumerate(["größe", "", None, "𝐀b 𐐀c", "a" * 200, "x y z", "the end"] * 9)]
    frame = spark.createDataFrame(rows, "id int, lang string, text string")
    want = {}
    for _, lang, text in rows:
        want.setdefault(lang, Counter()).update(brute_runs(text))
    counted = language.bucket_counts(frame)
    assert {(r["lang"], r["bucket"]): r["n"] for r in counted.collect()} == {(k, b): n for k, own in want.items() for b, n in own.items()}
    # Words were shuffled before, and runs were made by an expression, row by row.
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    profile = language.learn_languages(frame)
    found = {r["id"]: r["said"] for r in frame.select("id", profile.detector()(F.col("text")).alias("said")).collect()}
    for i, _, text in rows:
        sums = sorted((sum(own[b] for b in brute_runs(text)), name) for name, own in profile.weights.items())
        assert found[i] == ("unknown" if not brute_runs(text) or sums[0][0] == sums[1][0] else sums[1][1])

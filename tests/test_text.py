import pytest
from pyspark.sql import functions as F

from opinionloom.functions import text as txt
from opinionloom.functions import vocab
from opinionloom.functions.phrases import phrase_hits, phrase_pattern


def one(spark, texts, function):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [row[0] for row in rows.orderBy("i").select(function(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "given, expected",
    [
        ('<a href="http://x.y/z">t</a> u', "a href u"),
        ("ok!! ... wow..", "ok . wow."),
        ("x\n<b\nc>y", "x b cy"),
        ("  Great   phone\t\n", "Great phone"),
        ("éclair \U0001f600 中文 don't", "eclair 中文 dont"),
        ("see www.shop.example now <br/>fine", "see now fine"),
        ("a\x1cb\x85c　d", "a b c d"),
        ("10,5 % off_now?!", "10,5 off_now"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, given, expected):
    assert one(spark, [given], txt.clean_text) == [expected]


def test_is_meaningless(spark):
    junk = ["", "  ", "ok lol", "OK K", "ab", "a,b", None, "plz xd lol ok k", "....,,,,....,,,,abc", "  "]
    fine = ["abc", "ok phone", "½½½abc", "lol okay", "kkk"]
    assert one(spark, junk, txt.is_meaningless) == [True] * len(junk)
    assert one(spark, fine, txt.is_meaningless) == [False] * len(fine)


def test_a_very_long_filler_text_is_judged(spark):
    assert one(spark, ["lol " * 50_000, "lol " * 50_000 + "phone"], txt.is_meaningless) == [True, False]


def test_clauses(spark):
    texts = ["Good BUT bad. However slow!", "butter thoughé ok?", "...", None, "a but b", "but"]
    assert one(spark, texts, txt.split_clauses) == [
        ["Good", "bad", "slow"], ["butter thoughé ok"], [], None, ["a", "b"], [],
    ]


def test_sentences(spark):
    texts = ["One. Two is 4.5 long!  Three\nfour", "", None]
    assert one(spark, texts, txt.split_sentences) == [["One.", "Two is 4.5 long!", "Three", "four"], [], None]


def test_aspect_terms(spark):
    texts = ["The CAMERA and battery, sounding", "nothing", None]
    assert one(spark, texts, txt.matching_terms) == [["battery", "camera", "sound"], [], []]


def test_detect_aspect(spark):
    texts = [
        "camera and battery", "the battery drains fast, camera", "most of it", "xyz", "", None,
        "It overheats and heats up", "Premium pricing, not worth it", "great battery life and battery backup lens photo",
    ]
    assert one(spark, texts, txt.detect_aspect) == [
        "Camera", "Battery", "Software & OS", "Other", "Other", "Other",
        "Heating / Thermals", "Price", "Battery",
    ]


def plain_aspect(text):
    best, most = "Other", 0
    for aspect, phrases in vocab.ASPECT_KEYWORDS.items():
        hits = len([p for p in phrases if p in text.lower()])
        if hits > most:
            best, most = aspect, hits
    return best


def test_aspect_of_all_keyword_pairs(spark):
    phrases = [p for group in vocab.ASPECT_KEYWORDS.values() for p in group]
    texts = [f"{a}{gap}{b}" for a in phrases[::3] for b in phrases[::5] for gap in (" ", "")]
    assert one(spark, texts, txt.detect_aspect) == [plain_aspect(t) for t in texts]


def test_phrase_hits_finds_overlaps(spark):
    phrases = ["ab", "abc", "bc", "c d", "x+y", "b"]
    hits = one(spark, ["zabc d", "AB x+y", "none", None], lambda text: phrase_hits(text, phrases))
    assert [sorted(h) if h is not None else None for h in hits] == [
        ["ab", "abc", "b", "bc", "c d"], ["ab", "b", "x+y"], [], None,
    ]
    assert phrase_pattern(["a"]) == "(?:a)"


def test_vocabulary_sizes():
    assert [len(group) for group in vocab.ASPECT_KEYWORDS.values()] == [25, 18, 34, 22, 20, 24, 14, 14, 12, 11, 9]
    assert len(vocab.STOP_WORDS) == len(set(vocab.STOP_WORDS)) == 79

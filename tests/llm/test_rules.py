"""Line dedup, quality rules and sharding against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import awkward, prose, table

from opinionloom.llm import linededup, repetition, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key_of(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def brute_lines(texts, least, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for own in lines for k in {key_of(x) for x in own})
    out = []
    for own in lines:
        stay = [x for x in own if len(key_of(x)) < min_chars or seen[key_of(x)] < least]
        out.append((len(own), len(own) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("least,chars", [(2, 1), (3, 8), (10, 1), (1, 3)])
def test_common_lines(spark, least, chars):
    shared = [prose(i, 6) for i in range(40)]
    texts = [*awkward(), *("\n".join([prose(i, 5), shared[i % 40], " " + shared[i % 7].upper() + "\t", ""]) for i in range(120))]
    docs = table(spark, texts)
    want = brute_lines(texts, least, chars)
    for size in (64 << 20, 1):
        found = linededup.drop_common_lines(docs, min_docs=least, min_chars=chars, sweep_bytes=size).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in found} == dict(enumerate(want))


def test_many_shards_and_sweeps(spark, monkeypatch):
    original = linededup.line_index
    monkeypatch.setattr(linededup, "line_index", lambda counts: original(counts, 20))
    texts = ["\n".join(prose(j, 4) for j in range(i % 50, i % 50 + 30)) for i in range(150)]
    docs = table(spark, texts)
    found = linededup.drop_common_lines(docs, min_docs=3, sweep_bytes=600).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in found} == dict(enumerate(brute_lines(texts, 3)))


def test_minimal_perfect_hash():
    random = np.random.default_rng(3)
    hi, lo = random.integers(-(2**62), 2**62, (2, 30_000))
    shard = linededup.Shard(*linededup.build_shard(hi, lo, np.arange(1, 30_001)))
    assert (shard.counts_of(hi, lo) == np.arange(1, 30_001)).all()
    assert len(shard.marks) == 30_000 and sum(shard.sizes) < 30_000 * 4.5
    assert (shard.counts_of(lo, hi) == 0).all()


def test_line_tables(spark):
    docs = table(spark, ["a\nb", "a"]).withColumn("N_Lines", F.lit("x")).withColumn("a.b", F.lit(1))
    found = linededup.drop_common_lines(docs, min_docs=2)
    assert [c for c in found.columns if c.lower() == "n_lines"] == ["n_lines"] and "a.b" in found.columns
    assert sorted(r["text"] for r in found.collect()) == ["", "b"]
    assert linededup.drop_common_lines(docs.limit(0)).count() == 0
    assert {r["n_dropped"] for r in linededup.drop_common_lines(docs.union(docs), min_docs=4).collect()} == {1}


def brute_measures(text):
    text = text or ""
    words, sizes = WORD.findall(text), None
    sizes = [len(w) for w in words]

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(n)}

    seen, again, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                again += 1
                chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = {
        "n_words": len(words), "word_chars": sum(sizes), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": again,
        "n_repeat_words": len(covered(8)), "line_chars": chars,
    }
    return out | {f"chars_{n}": sum(sizes[i] for i in covered(n)) for n in repetition.COVERAGE}


def test_measures(spark):
    texts = [*awkward(), *(prose(i, i % 90) + "\n" + prose(i % 5, i % 40) + "\n" + prose(i % 5, i % 40) for i in range(150))]
    found = repetition.measured(table(spark, texts)).collect()
    for r in found:
        want = brute_measures(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        shares = [(want["line_chars"], 30), *((want[f"chars_{n}"], x) for n, x in repetition.COVERAGE.items())]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and all(100 * n <= x * want["word_chars"] for n, x in shares))
    assert any(r["kept"] for r in found) and any(r["base_failed"] for r in found)
    assert any(not r["kept"] and not r["base_failed"] for r in found)


def test_measures_of_small_blocks(monkeypatch):
    import pyarrow as pa

    from opinionloom.llm import common

    texts = pa.array([(t or "").encode() for t in awkward()][2:])[1:]
    small = [repetition.measure(d, o, (5,))["chars_5"].tolist() for _, d, o in common.blocks(texts, 64)]
    whole = [repetition.measure(d, o, (5,))["chars_5"].tolist() for _, d, o in common.blocks(texts)]
    assert sum(small, []) == sum(whole, []) and len(small) > len(whole)


def test_rule_tables(spark):
    docs = table(spark, awkward()).withColumn("Kept", F.lit("x")).withColumn("a.b", F.lit(1))
    assert repetition.good_documents(docs).columns == docs.columns
    assert repetition.measured(docs.limit(0)).count() == 0 and repetition.good_documents(docs.limit(0)).count() == 0
    assert "kept" in repetition.measured(docs).columns and "Kept" not in repetition.measured(docs).columns


def test_shard_table():
    names = [f"n{i}" for i in range(20)]
    table = sharding.lookup_table(names, 10_007)
    share = Counter(table)
    assert len(table) == 10_007 and max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, less) if a != names[-1])
    assert moved < 0.05 * len(table)
    weighted = Counter(sharding.lookup_table({"a": 3, "b": 1}, 1_009))
    assert abs(weighted["a"] - 3 * weighted["b"]) <= 4
    for bad in ([], ["a"] * 0, {"a": 0}, names * 1):
        if bad != names:
            with pytest.raises(ValueError):
                sharding.lookup_table(bad, 10_007)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 10_000)


def test_shards_of_rows(spark):
    docs = table(spark, awkward())
    odd = docs.union(docs).withColumn("Slot", F.lit("x")).withColumn("a.b", F.lit(1))
    odd = odd.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    placed = sharding.assign_shards(odd, ["a", "b", "c"])
    assert placed.count() == odd.count() and "Slot" not in placed.columns
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    names = sharding.lookup_table(["a", "b", "c"])
    assert all(names[r["slot"]] == r["shard"] for r in placed.collect())
    assert sharding.assign_shards(docs.limit(0), ["a"]).count() == 0


def test_hash_of_kept_text(spark):
    from opinionloom.llm.queries import op2_line_dedup

    rows = op2_line_dedup(spark, "/root/testdata/sf0.001").limit(3).collect()
    assert all(len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest()) for r in rows)

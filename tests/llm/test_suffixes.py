import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import awkward, prose, table

from opinionloom.llm import suffixes


def brute(texts, length, keep):
    """For each text (bytes), which of its bytes lie in a window that occurs elsewhere (for "first": before)."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places if keep == "none" else sorted(places)[1:]:
                out[i][s : s + length] = True
    return out


def spans(flags):
    return int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())


def check(rows, texts, length, keep="none"):
    texts = [(t or "").encode() for t in texts]
    want = brute(texts, length, keep)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        flags, t = want[r["doc_id"]], texts[r["doc_id"]]
        left = bytes(np.frombuffer(t, np.uint8)[~flags])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), int(flags.sum()), spans(flags))
        assert r["kept_bytes"] == left
    return sum(int(x.sum()) for x in want)


def copied(seed, n):
    """Texts that share passages of many lengths, some only at their ends, some within one text."""
    own = random.Random(seed)
    shared = [prose(seed * 100 + i, own.randint(20, 160)) for i in range(12)]
    out = []
    for i in range(n):
        parts = [prose(seed * 1000 + i, own.randint(0, 60))]
        for _ in range(own.randint(0, 3)):
            x = own.choice(shared)
            a, b = sorted(own.randrange(len(x) + 1) for _ in range(2))
            parts += [x if own.random() < 0.4 else x[a:b], prose(own.random(), own.randint(0, 30))]
        out.append(own.choice(["", " ", "\n"]).join(parts))
    return [*out, out[0], out[1], out[1], out[2] + "!", "ab" * 700, "z" * 1500, "z" * 400, "é" * 500, prose(3, 200) * 2]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length,most", [(400, 20_000), (400, 3), (100, 20_000), (37, 5)])
def test_same_as_brute_force(spark, keep, length, most):
    texts = [*copied(length, 70), *awkward()]
    rows = suffixes.drop_repeats(table(spark, texts).repartition(4), length=length, keep=keep, most=most).collect()
    assert check(rows, texts, length, keep) > 10_000


def test_small_suffix_arrays_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 2000)
    texts = copied(7, 120)
    check(suffixes.drop_repeats(table(spark, texts), length=64, gram=16).collect(), texts, 64)


def test_arrays():
    own = random.Random(2)
    for length in (1, 2, 5, 8, 13, 40):
        text = "".join(own.choice("ab") for _ in range(300)).encode()
        n = max(0, len(text) - length + 1)
        windows = [text[i : i + length] for i in range(n)]
        found = suffixes.repeated_windows([text], np.array([n]), length, False)[0]
        assert found.tolist() == [w in windows[:i] for i, w in enumerate(windows)]
        found = suffixes.repeated_windows([text], np.array([n]), length, True)[0]
        assert found.tolist() == [windows.count(w) > 1 for w in windows]
    values = np.array([own.randint(0, 50) for _ in range(400)])
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(400)]
    assert suffixes.previous_smaller(values).tolist() == want
    data = np.frombuffer(b"abracadabra" * 9, np.uint8)
    levels = suffixes.suffix_ranks(data, len(data) - np.arange(len(data)), 16)
    order = np.argsort(levels[-1][1][:84], kind="stable")
    assert [bytes(data[i : i + 16]) for i in order] == sorted(bytes(data[i : i + 16]) for i in range(84))
    factors = suffixes.previous_factors(levels, order, 16)
    assert {int(i): int(f) for i, f in zip(order, factors)}[11] == 16 and {int(i): int(f) for i, f in zip(order, factors)}[0] == 0


def test_tables(spark):
    long = prose(5, 200)
    docs = table(spark, [long, None, "", long + "x"]).withColumn("N_Bytes", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("start", F.lit(2))
    assert suffixes.drop_repeats(docs.limit(0)).count() == 0
    done = suffixes.drop_repeats(docs)
    assert "a.b" in done.columns and "N_Bytes" not in done.columns
    assert sorted(r["n_removed"] for r in done.collect()) == [0, 0, len(long), len(long)]
    twice = docs.limit(1).union(docs.limit(1)).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["n_removed"] for r in suffixes.drop_repeats(twice).collect()] == [len(long)] * 2
    assert [r["n_removed"] for r in suffixes.drop_repeats(twice, keep="first").collect()] == [0, 0]


def test_passages_around_the_length(spark):
    """Passages of over 50 words, planted in unlike documents: whole ones of 400 bytes or more go, shorter ones stay."""
    texts, want = [], []
    for k, size in enumerate((300, 350, 394, 399, 400, 401, 450, 500)):
        passage = "é" + " ".join(w[:4] for w in prose(600 + k, 200).split())[: size - 2]
        assert len(passage.encode()) == size and len(passage.split()) > 50
        for i in range(3):
            # The digits beside it end what the documents share.
            texts.append(f"{prose(700 + 10 * k + i, 30 + 20 * i)} {i}{passage}{i} {prose(800 + 10 * k + i, 90)}")
            want.append((size, 1) if size >= 400 else (0, 0))
    rows = suffixes.drop_repeats(table(spark, texts).repartition(3)).collect()
    check(rows, texts, 400)
    assert [(r["n_removed"], r["n_spans"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == want


@pytest.mark.parametrize("keep", ["none", "first"])
def test_names_with_many_bytes_are_spread(spark, monkeypatch, keep):
    """Periodic texts of one phrase share a name: few stretches, many bytes."""
    phrase = prose(77, 8) + " "
    texts = [phrase * (20 + i) + prose(i, 3) for i in range(12)] + [prose(500, 90), prose(500, 90) + prose(501, 40), None]
    whole = suffixes.drop_repeats(table(spark, texts), length=400, keep=keep).collect()
    seen, old = [], suffixes._by_windows
    monkeypatch.setattr(suffixes, "NAME_BYTES", 2000)
    monkeypatch.setattr(suffixes, "_by_windows", lambda *a: seen.append(1) or old(*a))
    spread = suffixes.drop_repeats(table(spark, texts), length=400, keep=keep).collect()
    assert seen and sorted(whole, key=lambda r: r["doc_id"]) == sorted(spread, key=lambda r: r["doc_id"])
    assert sum(r["n_removed"] for r in spread) > 1000


def test_suffix_ranks_take_little_memory():
    import tracemalloc

    base = random.Random(5).randbytes(3000)
    parts = [base[: 1500 + 7 * (i % 200)] + random.Random(i).randbytes(500) for i in range(160)]
    tracemalloc.start()
    suffixes.repeated_windows(parts, np.array([len(x) - 399 for x in parts]), 400, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 162 bytes for each byte of text before, for up to NAME_BYTES in each of an executor's Python workers.
    assert peak < 125 * sum(map(len, parts))

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F
from rows import awkward, prose, table

from opinionloom.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(points, radius=3):
    root = {x: x for x in points}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(points, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in points}


def test_masks_cover_every_pair():
    own = random.Random(5)
    for radius, fixed in ((1, 0), (3, 0), (3, 0xFFFF0000FFFF0000), (5, 0)):
        masks = simhash.covering_masks(radius, fixed)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(m & fixed == fixed for m in masks)
        free = [b for b in range(64) if not fixed >> b & 1]
        for _ in range(3000):
            differ = sum(1 << b for b in own.sample(free, own.randint(1, radius)))
            assert any(m & differ == 0 for m in masks)


def test_fingerprints(spark):
    texts = [*awkward(), *(prose(i, i * 37 % 700) for i in range(60))]
    found = dict(table(spark, texts).select("doc_id", simhash.fingerprints("text")).collect())
    assert {i: x & (1 << 64) - 1 for i, x in found.items()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [4096, 40, 8])
def test_links_join_what_is_near(spark, most):
    own = random.Random(most)
    points = {0, 1, 3, -1}
    for _ in range(60):
        x = own.getrandbits(64)
        for _ in range(own.choice([1, 1, 2, 12])):
            x ^= sum(1 << b for b in own.sample(range(64), own.randint(0, 4)))
            points.add(x - (1 << 64) if x >> 63 else x)
    centre = own.getrandbits(63)
    points |= {centre ^ 1 << b ^ 1 << c for b in range(20) for c in range(12)}
    frame = spark.createDataFrame([(x,) for x in points], "fp long")
    found = dict(simhash.components(simhash.near_links(frame, 3, most)).collect())
    assert {x: found.get(x, x) for x in points} == brute_roots(sorted(points))


def test_long_chain_comes_together(spark):
    ids = list(range(500))
    random.Random(1).shuffle(ids)
    links = [(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])]
    found = dict(simhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {x: 0 for x in range(1, 500)}


def test_no_number_of_rounds_ends_the_joining(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROUNDS", 2, raising=False)
    ids = list(range(-100, 100))
    random.Random(3).shuffle(ids)
    links = [(min(a, b), max(a, b)) for chain in (ids[:150], ids[150:]) for a, b in zip(chain, chain[1:])]
    found = dict(simhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {x: min(chain) for chain in (ids[:150], ids[150:]) for x in chain if x != min(chain)}


def test_groups_and_survivors(spark):
    texts = awkward()
    docs = table(spark, texts)
    roots = brute_roots(sorted({brute_fingerprint(t) for t in texts}))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(roots[brute_fingerprint(t)], []).append(i)
    found = {r["key"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: min(own) for own in groups.values() for i in own}
    assert found[8] == 6 and found[7] == 6
    stay = simhash.one_of_each(docs.union(docs))
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted(min(x) for x in groups.values())


def test_awkward_tables(spark):
    docs = table(spark, ["a b c d", "a b c d", None, ""]).withColumn("fp", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("key", F.lit(2))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["component"] for r in simhash.near_duplicates(none).collect()} == {None}
    assert simhash.one_of_each(none).count() == 2 and simhash.one_of_each(docs).columns == docs.columns


def test_unlike_documents_with_one_key_stay(spark):
    a, b = prose(71, 60), prose(72, 60)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (None, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == sorted([(1, a), (1, b)])
    found = simhash.near_duplicates(docs)
    assert found.select("root").distinct().count() == 2 and {r["component"] for r in found.collect()} == {1}

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import awkward, prose, table
from tokenizers import Tokenizer

from opinionloom.llm import packing

JSON, RANKS = (packing.tokenizer_path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


END = "<|endoftext|>"
#: Texts that hold the string of the added token: at the start, in the middle, at the end, repeated, broken, in a long text.
ADDED = [
    f"{END} a", f"one {END} two", f"end {END}", END, END * 3, f"{END} {END}\n{END}", f"a{END}b", "<|endoftext|", "<|endoftext |>",
    f"{'many words ' * 20_000}{END}{'more of them ' * 20_000}{END}", f"{' ' * 200_000}{END}x",
]


def ids_of(texts):
    tokenizer = Tokenizer.from_file(JSON)
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers():
    own = random.Random(1)
    texts = [*(t or "" for t in awkward()), *ADDED, "\x85 a\xa0 b ᠎ c", " " * 3000 + "a"]
    texts += ["".join(own.choice(" \n\t\xa0ab1é's!　\x1c日9") for _ in range(own.randint(1, 40))) for _ in range(3000)]
    texts += [f"a{c}b {c}1 {c}{c}  {c}\n'{c}" for c in map(chr, range(1, 0x30000, 7)) if not 0xD800 <= ord(c) < 0xE000]
    encode, slow = packing.Encoder(JSON, RANKS), packing.Encoder(JSON)
    want = ids_of(texts)
    assert [np.frombuffer(encode(x), "<u4").tolist() for x in texts] == want
    assert [np.frombuffer(slow(x), "<u4").tolist() for x in texts[:40]] == want[:40]
    long = " " * 300_000 + "b" + " " * 1_000_000
    assert np.frombuffer(encode(long), "<u4").tolist() == ids_of([long])[0]
    assert ids_of([f"one {END} two"]) == [[505, 220, 50256, 734]]


def check(rows, texts, capacity, key=lambda r: r["doc_id"]):
    """Rows are the pieces of the texts, whole and in sequences without gaps."""
    ids = [[*x, 0] for x in ids_of([t or "" for t in texts])]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(key(r), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == set(range(len(texts)))
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids[i]) // capacity)
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i]) and all(r["length"] == capacity for r in own[1:])
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(map(len, ids)) // capacity)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_pieces_and_places(spark, capacity):
    texts = [*awkward(), *(prose(i, i * 31 % 160) for i in range(150))]
    docs = table(spark, texts).repartition(5)
    used, least = check(packing.pack(docs, JSON, RANKS, capacity=capacity).collect(), texts, capacity)
    assert used <= least * 1.03 + 2


def test_sequences_hold_the_ids(spark):
    texts = awkward()
    packed = packing.pack(table(spark, texts), JSON, RANKS, capacity=100, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == 4 * sum(len(x) + 1 for x in ids_of([t or "" for t in texts]))
    assert all(0 < len(r["ids"]) <= 400 for r in rows)


def fewest(items, capacity):
    """The fewest bins, by trying all."""
    best = len(items)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[at] <= capacity:
                bins[i] += items[at]
                place(at + 1, bins)
                bins[i] -= items[at]
        place(at + 1, [*bins, items[at]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_reduction_never_costs_a_bin():
    own = random.Random(9)
    shrunk = 0
    for _ in range(400):
        capacity = own.choice([10, 15, 24])
        items = [own.randint(1, capacity) for _ in range(own.randint(1, 10))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, rest = packing.reduced(counts, capacity)
        left = list(itertools.chain.from_iterable([x] * int(n) for x, n in enumerate(rest)))
        bins = sum(n for n, _ in fixed)
        assert all(sum(x) <= capacity for _, x in fixed)
        assert sorted(left + [x for n, s in fixed for x in s * n]) == sorted(items)
        assert bins + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
        shrunk += len(left) < len(items)
    assert shrunk > 200


def test_plan_places_every_piece():
    own = np.random.default_rng(2)
    for capacity in (7, 50, 2048):
        lengths = own.integers(1, capacity + 1, 5000)
        plan = packing.Plan(np.bincount(lengths, minlength=capacity + 1), capacity)
        rank = np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            rank[lengths == x] = np.arange((lengths == x).sum())
        sequence, offset = plan.places(lengths, rank)
        order = np.lexsort((offset, sequence))
        sequence, offset, lengths = sequence[order], offset[order], lengths[order]
        first = np.append(True, sequence[1:] != sequence[:-1])
        assert (offset[first] == 0).all() and (offset + lengths <= capacity).all()
        assert (np.where(first, 0, np.append(0, (offset + lengths)[:-1])) == offset).all()
        assert sequence.max() + 1 == plan.sequences == first.sum()
        assert plan.sequences <= lengths.sum() / capacity * 1.35 + 2


def test_tables(spark):
    docs = table(spark, ["a b", None, "a b"]).withColumn("Length", F.lit("x")).withColumn("a.b", F.lit(1))
    assert packing.pack(docs.limit(0), JSON, RANKS).count() == 0
    both = docs.union(docs).withColumn("doc_id", F.lit(None).cast("long"))
    rows = packing.pack(both, JSON, RANKS).collect()
    assert len(rows) == 6 and {r["length"] for r in rows} == {1, 3} and len({r["sequence_id"] for r in rows}) == 1

"""Exact round trips of encoding and packing, and the plan against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.llm import packing
from tests.llm.helpers import awkward, documents, prose


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


TEXTS = ["", " ", "it's  a\tb\x1cc\x1d d", "a<|endoftext|>b <|ENDOFTEXT|>", "İSTANBUL ΣΑΣ é ́x 12'34 don't'll", "ªº µ Ünïcode… “quoted” ß ẞ THE!! the,,, --- x2y", "日本語 テスト", "word\n\nWord. WORD!? à Àñ í­", "\x00 \x7f a\x85b\xa0c"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(tokenizer, text):
    raw = b"".join(packing.WordEncoder(packing.vocabulary()).encode([text]))
    assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    raw = b"".join(packing.WordEncoder(packing.vocabulary()).encode([text]))
    assert np.frombuffer(raw, "<u4").tolist() == Tokenizer.from_file(packing.vocabulary()).encode(text, add_special_tokens=False).ids


def test_small_memory_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    mine, rng = packing.WordEncoder(packing.vocabulary()), random.Random(1)
    for _ in range(20):
        text = prose(rng, 50)
        assert np.frombuffer(next(mine.encode([text])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, capacity=packing.CAPACITY):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_round_trip(spark, tokenizer):
    docs = awkward(spark)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    got = defaultdict(list)
    rows = packing.pack(docs).collect()
    for r in packing.pieces(docs, with_ids=True).collect():
        found = np.frombuffer(r["ids"], "<u4").tolist()
        assert (len(found), zlib.crc32(r["ids"])) == (r["length"], r["ids_crc32"])
        got[r["doc_id"]].append((r["piece"], r["start"], found))
    for key, found in got.items():
        assert Counter(map(tuple, (i for _, _, i in found))) == Counter(tuple(x[a : a + 2048]) for x in ids[key] for a in range(0, len(x), 2048))
    assert len(rows) == sum(map(len, got.values()))
    check(rows)


def test_few_sequences(spark, sf):
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert check(rows) <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1  # no packing has fewer than the first


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), max_size=4), st.integers(0, 25))
def test_fullest_is_the_fullest(counts, room):
    best = max((t for pick in product(*[range(n + 1) for n in counts.values()]) if (t := sum(k * length for k, length in zip(pick, counts, strict=True))) <= room), default=0)
    chosen = packing.fullest(counts, room)
    assert sum(k * length for length, k in chosen) == best
    assert all(k <= counts[length] for length, k in chosen)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**12), max_size=30))
def test_plan_uses_everything(histogram):
    used = Counter()
    steps = packing.plan(histogram, 64)
    for _, many, chosen in steps:
        assert sum(length * k for length, k in chosen) <= 64
        for length, k in chosen:
            used[length] += many * k
    assert used == Counter(histogram)
    assert len(steps) < 500
    assert [s[0] for s in steps] == [sum(s[1] for s in steps[:i]) for i in range(len(steps))]


def test_one_length_in_many_rows(spark):
    rows = packing.pack(documents(spark, [(i, "alpha beta", "a") for i in range(3000)])).collect()
    assert check(rows) == -(-3000 * 3 // 2048)

"""Substring deduplication against brute force."""

import hashlib
import random

import pytest

from meshloom.llm import substrings
from tests.llm.helpers import awkward, documents


def brute(rows):
    first = {}
    split = [(i if i is not None else -(2**63), i, (t or "").encode().split()) for i, t in rows]
    for k, _, w in split:
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            first[key] = min(first.get(key, (k, p)), (k, p))
    out = []
    for k, i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (k, p):
                gone[p : p + 20] = [True] * 20
        kept = [x for x, c in zip(w, gone, strict=True) if not c]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def same(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=str) == brute(rows)


def test_awkward(spark):
    same(awkward(spark))


@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_cut_and_pasted(spark, letters):
    rng = random.Random(letters)
    parts = [" ".join(rng.choices(letters, k=70)) for _ in range(8)]
    rows = [(rng.randrange(400), " ".join(rng.choice(parts)[rng.randrange(80) :] for _ in range(rng.randrange(1, 6))), "a") for _ in range(120)]
    rows += [(1000, "a " * 100, "a"), (1001, "b a " * 50 + "c", "a"), (1002, "a " * 45, "a"), (1003, "x" * 500 + " " + parts[0], "a"), (1004, "x" * 500 + " " + parts[0], "a")]
    same(documents(spark, rows))


def test_small_parts_and_buckets(spark, monkeypatch, sf):
    monkeypatch.setattr(substrings, "PART_BYTES", 20_000)
    same(spark.read.parquet(f"{sf}/documents.parquet"))


def test_every_window_has_an_anchor_that_equal_windows_share():
    rng = random.Random(2)
    for _ in range(30):
        window = [rng.choice("abcde") * rng.randrange(1, 3) for _ in range(20)]
        places = set()
        for _ in range(5):
            before, after = (" ".join(rng.choices("abcde", k=rng.randrange(12))) for _ in range(2))
            words = substrings.Words([f"{before} {' '.join(window)} {after}".encode()])
            at = len(before.split())
            which, bounds = words.anchors(words.windows())
            places.add((int(bounds[which[at]]) - at, int(bounds[which[at] + 1]) - at))
        assert len(places) == 1
        (a, b), = places
        assert substrings.MARGIN <= a < b <= 20 - substrings.MARGIN

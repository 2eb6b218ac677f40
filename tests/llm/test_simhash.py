"""Fingerprints, links and classes against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from meshloom.llm import simhash
from meshloom.operators.components import components
from tests.llm.helpers import documents, prose


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) > k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=n)) for n in (0, 1, 2, 3, 4, 10, 254, 257, 300, 1200)] + ["ÀB ab\x0bAB\x85x"]
    got = simhash.fingerprints([simhash.shingles(t, 3) for t in texts])
    assert [int(x) for x in got] == [fingerprint(t, 3) for t in texts]


def test_whole_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fp = {r["doc_id"]: fingerprint(r["text"], 3) for r in docs.collect()}
    want = classes([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    rows = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_crowds_and_chains(spark):
    """Random fingerprints, pairs at each small distance, a chain, and a crowd around one centre."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps)[:100]:
        for d in (1, 2, 3):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(20, 60, 3)}
    fps |= {center ^ (1 << 62) ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(150)}
    nodes = sorted(map(signed, fps))
    raw = {signed(f): f for f in fps}
    want = classes([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (raw[a] ^ raw[b]).bit_count() <= 2], nodes)
    found = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp long")).collect()]
    assert all((raw[a] ^ raw[b]).bit_count() <= 2 for a, b in found)
    assert classes(found, nodes) == want
    assert len(found) < 40 * len(nodes)


def test_six_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 0)
    test_links_of_crowds_and_chains(spark)


def test_components_by_rounds_and_at_once(spark):
    rng = random.Random(1)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(5000 + i, 5001 + i) for i in range(60)] + [(9000, 9000 + i) for i in range(1, 60)]
    want = {n: r for n, r in classes(links, {x for p in links for x in p}).items() if n != r}
    table = spark.createDataFrame(links, "u long, v long")
    for most in (0, 10**6):
        assert {r["u"]: r["root"] for r in components(table, most).collect()} == want


def test_similar_sets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r["doc_id"]: set(map(bytes, simhash.shingles(r["text"], 5))) for r in docs.collect()}
    alike = [(a, b) for a in sets for b in sets if a < b and (u := len(sets[a] | sets[b])) and len(sets[a] & sets[b]) >= 0.8 * u]
    want = classes(alike, sets)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == want


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    base = [prose(rng, 200).split() for _ in range(20)]
    rows, n = [], 0
    for group, words in enumerate(base):
        for copy in range(12):
            edited = list(words)
            if copy:
                edited[rng.randrange(200)] = f"edit{n}"
            rows.append((n, " ".join(edited), f"s{group}"))
            n += 1
    kept = simhash.deduplicated(documents(spark, rows)).select("doc_id").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [12 * g for g in range(20)]


def test_repeated_rows_stay_once(spark):
    docs = documents(spark, [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (3, "other words are here", "x")])
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).select(F.col("doc_id")).collect()) == [1, 3]


def alike_classes(texts):
    """Classes of similarity 0.8 by brute force over all pairs."""
    sets = {i: set(map(bytes, simhash.shingles(t, 5))) for i, t in texts.items()}
    return classes([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)


def test_copies_in_crowded_buckets(spark):
    """Pairs of near copies among many texts that share a long passage, which heads most of their buckets."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(150)]
    texts = {}
    for pair in range(150):
        own = [word() for _ in range(14)]
        for copy in range(2):
            words = passage + own
            for at in rng.sample(range(150), 1):
                words[at] = word()
            texts[2 * pair + copy] = " ".join(words)
    want = alike_classes(texts)
    got = simhash.similar_documents(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 40


def test_long_texts_are_decided_exactly(spark):
    """Pairs of 1,200 words just above and just below the similarity."""
    rng = random.Random(22)
    texts = {}
    for pair in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
        other = list(words)
        # a block of changed words: c + 4 of 1,196 shingles differ, the limit is at 132
        changed = 122 if pair % 2 else 134
        other[300 : 300 + changed] = [f"v{rng.randrange(10**6)}" for _ in range(changed)]
        texts |= {2 * pair: " ".join(words), 2 * pair + 1: " ".join(other)}
    want = alike_classes(texts)
    assert sum(i != c for i, c in want.items()) == 15
    got = simhash.similar_documents(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_repeated_lines_do_not_hide_copies(spark):
    """A text that repeats a line has the same shingle set, nearly, as one that does not."""
    rng = random.Random(23)
    texts = {}
    for pair in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(700)]
        line = [f"l{rng.randrange(10**6)}" for _ in range(15)]
        texts |= {2 * pair: " ".join(words + line), 2 * pair + 1: " ".join(words + line * 20)}
    got = simhash.similar_documents(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in texts}


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    """Sixty members of one bucket that share no other key, each alike to one other."""
    alike = lambda table, pairs, similarity: pairs.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct().where("u - v = 30")
    monkeypatch.setattr(simhash, "_decided", alike)
    crowded = spark.range(60).selectExpr("0 AS way", "7L AS key", "id AS node")
    found = simhash._rest(None, crowded, spark.createDataFrame([], "u long, v long"), 0.8)
    assert {(r["u"], r["v"]) for r in found.collect()} == {(n + 30, n) for n in range(30)}


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A hundred texts that share half their words, each alike to one other, in blocks of seven; no pair of a bucket is a row."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "DENSE", 5)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    monkeypatch.setattr(simhash, "_paired", None)
    rng, sizes = random.Random(24), []
    compared = simhash._blocks
    monkeypatch.setattr(simhash, "_blocks", lambda members: (sizes.append(compared(members).groupBy("bucket", "lo", "hi").count().agg({"count": "max"}).first()[0]), compared(members))[1])
    common = [f"c{n}" for n in range(120)]
    texts = {}
    for n in range(50):
        own = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts |= {n: " ".join(common + own), n + 50: " ".join(common + own[:60] + [f"v{rng.randrange(10**6)}" for _ in range(12)])}
    want = alike_classes(texts)
    assert len(set(want.values())) == 50
    got = simhash.similar_documents(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sizes and 7 < sizes[0] < 50


def test_shared_items_by_products(monkeypatch):
    rng = random.Random(25)
    sets = [np.array(sorted(rng.sample(range(400), rng.randrange(1, 200))), dtype=np.uint32) for _ in range(30)]
    i, j = np.array([(a, b) for a in range(0, 30, 2) for b in range(1, 30, 3) if a != b]).T
    want = [len({*sets[a].tolist()} & {*sets[b].tolist()}) for a, b in zip(i, j, strict=True)]
    assert simhash.shared(sets, i, j).tolist() == want
    monkeypatch.setattr(simhash, "DENSE", 1)
    monkeypatch.setattr(simhash, "COLUMNS", 37)
    assert simhash.shared(sets, i, j).tolist() == want

"""Decontamination, secrets, URLs, WARC and toxicity on cases made by hand."""

import hashlib
import random
import re
import string

import numpy as np
import pytest

from meshloom.llm import decontamination, secrets, toxicity, urls, warc
from tests.llm.helpers import documents, prose

# Decontamination.


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_edited_passages(spark):
    rng = random.Random(4)
    bench = [[f"{w}{rng.randrange(9999)}" for w in prose(rng, 30).replace(",", "").split()] for _ in range(12)]
    rows, want = [], set()
    for i, words in enumerate(bench):
        changed = list(words)
        for at in rng.sample(range(30), 6 if i % 2 else 15):  # a fifth of the words, or half
            changed[at] = f"new{rng.randrange(10**6)}"
        if i % 2:
            want.add((i, i))
        rows.append((i, prose(rng, 200) + " " + " ".join(changed).upper() + ", " + prose(rng, 200), "a"))
    rows += [(100 + i, prose(rng, 300), "a") for i in range(30)]
    rows.append((200, "Before: " + "; ".join(bench[0]) + "!", "a"))
    want.add((200, 0))
    docs, tests = documents(spark, rows), items(spark, [" ".join(w) for w in bench])
    found = decontamination.contaminated(docs, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert next(r["similarity"] for r in found if r["doc_id"] == 200) == 1.0
    clean = {r["doc_id"] for r in decontamination.clean_documents(docs, tests).collect()}
    assert clean == {r[0] for r in rows} - {i for i, _ in want}


def test_passages_with_insertions(spark):
    """Words inserted into a copy break its n-grams, but not the alignment."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    bench, rows = [], []
    for i, (n, changed, inserted) in enumerate([(30, 3, 6), (100, 10, 18), (50, 0, 16)]):
        words = [word() for _ in range(n)]
        bench.append(" ".join(words))
        edits = [(at, k < changed) for k, at in enumerate(rng.sample(range(changed + inserted), changed + inserted))]
        step = n / (changed + inserted)
        for at, change in sorted(edits, reverse=True):
            where = int((at + 0.5) * step)
            words[where : where + change] = [word()]
        rows.append((i, " ".join([word() for _ in range(150)] + words + [word() for _ in range(150)]), "a"))
    found = decontamination.contaminated(documents(spark, rows), items(spark, bench)).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 2) for r in found} == {(0, 0): 0.9, (1, 1): 0.9, (2, 2): 1.0}


def test_blocks_change_nothing(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 400)
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect())) == one
    # every whole passage is found
    plain = {r["doc_id"]: decontamination.plain(r["text"]).split() for r in docs.collect()}
    for r in bench.collect():
        words = decontamination.plain(r["text"]).split()
        holds = {i for i, w in plain.items() if any(w[a : a + len(words)] == words for a in range(len(w) - len(words) + 1))}
        assert holds <= {d for d, i, *_ in one if i == r["item_id"]}


def test_alignment_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 5, 9), rng.integers(0, 5, 12)
        table = np.zeros((10, 13))
        for i in range(1, 10):
            for j in range(1, 13):
                table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -decontamination.MISMATCH), table[i - 1, j] - decontamination.GAP, table[i, j - 1] - decontamination.GAP)
        matched, start, end = decontamination.align(a, b)
        assert matched <= min(9, end - start)
        assert matched >= table.max()


# Secrets.

RULES = (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def base(text):
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, rule, group, least) in enumerate(RULES) for m in re.finditer(rule, text) if len(m[group]) >= least]
    return ",".join(s for *_, s in sorted(found))


def test_base_spans(spark):
    rng = random.Random(6)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "XYZ123", "é", "\n", "ſecret", "\u212aey", "-", "x" * 9, "token=api_key: abcdefghij"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(1, 25))), "s") for i in range(600)]
    for r in secrets.scan(documents(spark, rows)).collect():
        text = rows[r["doc_id"]][1]
        want = base(text)
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert set(want.split(",")) - {""} <= set(r["spans"].split(","))


def test_novel_strings():
    rng = random.Random(1)
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=24))
    novelty = secrets.Novelty()
    told = secrets.all_spans(f"the session cookie {key} was sent", novelty)[1]
    assert told == [("novel", 19, 43)]
    for plain in ("the session key getUserSessionTokenFromCookie()", "authorization: see https://www.example.com/index.html", "the private thandednotionerlyingtherething", f"no context {key}"):
        assert secrets.all_spans(plain, novelty)[1] == []


def test_redaction():
    assert secrets.redacted("abcdefgh", [("a", 1, 3), ("b", 2, 4), ("c", 6, 8)], "*") == "a*ef*"


# URLs.


def test_parts_and_rules(spark):
    rows = {
        1: ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("http://net", "net", "", None, "allow"),
        3: (None, "", "", None, "allow"),
        4: ("no scheme/x", "", "", None, "allow"),
        5: ("x://net/?q=://z", "net", "/", "net/", "block"),
        6: ("http://subnet/", "subnet", "/", None, "allow"),
        7: ("https://www.example.com/de/x#y", "www.example.com", "/de/x", "example.com/de/", "block"),
        8: ("https://www.example.com/de", "www.example.com", "/de", None, "allow"),
        9: ("ftp://q.org/fr/a?b", "q.org", "/fr/a", "org/fr/", "allow"),
        10: ("http://É.org#/fr/", "É.org", "", None, "allow"),
    }
    got = urls.judge(spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "page_id long, url string")).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {k: v[1:] for k, v in rows.items()}


def test_templates_are_judged_by_their_labels(spark):
    """Numbers, codes and many siblings are generalised; a place whose labelled URLs are all blocked is rejected."""
    rows = [("h.com", f"/blog/{i}", 1, int(i < 60), int(i < 60)) for i in range(90)]
    rows += [("h.com", f"/shop/item-{i + 100}xyz.html", 1, int(i < 40), 0) for i in range(80)]
    rows += [("h.com", f"/tag/{a}{b}", 1, 0, 0) for a in "abcdefgh" for b in "abcdefgh"]
    named, judged = urls.templates(spark.createDataFrame(rows, "host string, path string, n long, labelled long, blocked long"))
    verdicts = {r["template"]: r["verdict"] for r in judged.collect()}
    assert verdicts == {"/blog/{n}": "block", "/shop/{c}.html": "allow", "/tag/*": "allow"}
    assert named.count() == len(rows)


@pytest.mark.parametrize("siblings", [24, 25, 60])
def test_labels_stay_apart_among_many_siblings(spark, siblings):
    """Blocked pages of one section say nothing about another, however many sections there are."""
    rows = [("h.com", f"/de/{i}", 1, 1, 1) for i in range(14)] + [("h.com", f"/en/{i}", 1, 0, 0) for i in range(30)]
    rows += [("h.com", f"/{chr(97 + k // 20)}{chr(97 + k % 20)}/{i}", 1, 0, 0) for k in range(siblings - 2) for i in range(3)]
    named, judged = urls.templates(spark.createDataFrame(rows, "host string, path string, n long, labelled long, blocked long"))
    verdicts = {r["path"]: r["verdict"] for r in named.join(judged, ["host", "template"]).collect()}
    assert {p for p, v in verdicts.items() if v == "block"} == {f"/de/{i}" for i in range(14)}
    assert len(verdicts) == len(rows)


# WARC.


def test_loser_tree():
    rng = random.Random(4)
    for k in range(9):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("size", [300, 10**6])
def test_archives(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 7)
    rng = random.Random(2)
    bodies = [prose(rng, 30) for _ in range(6)] + ["x" * 99, "x" * 100, "é" * 50, None, ""]
    rows = [(i, f"http://h{rng.randrange(4)}.org/{rng.randrange(3)}", rng.choice(bodies)) for i in rng.sample(range(1000), 60)]
    rows += [(None, None, bodies[0]), (5000, "bad\nurl", bodies[0]), (5001, "http://[::1", "y"), rows[0]]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted(str((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", first[h]) if i is not None and first.get(h, i) < i else ("response", None)))) for i, _, h in rows)
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == want
    order = [(r["urlkey"], r["time"]) for r in sorted(got, key=lambda r: (r["range"], r["rank"]))]
    assert order == sorted(order)


def test_members_of_any_size():
    import gzip
    import io

    parts = [bytes([i]) * (i * 1000) for i in range(5)]
    raw = b"".join(map(gzip.compress, parts))
    for size in (1, 7, 1 << 20):
        found = list(warc.members(io.BytesIO(raw), size))
        assert [m for *_, m in found] == parts
        assert [raw[a : a + n] for a, n, _ in found] == [gzip.compress(p) for p in parts] or size
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(io.BytesIO(raw[:-3])))


# Toxicity.


def test_unseen_misspellings(spark):
    rng = random.Random(7)
    bad = ["scoundrel", "rascally", "villainous"]
    rows, marks = [], []
    for i in range(600):
        words, toxic = prose(rng, 60).split(), i % 3 == 0
        held = toxicity.zlib.crc32(str(i).encode()) % 3 == 1
        if toxic:
            for at in rng.sample(range(60), 5):
                w = rng.choice(bad)
                if held:  # never seen in training
                    k = rng.randrange(2, len(w) - 1)
                    w = w[:k] + w[k] + w[k:]
                words[at] = w
        rows.append((i, " ".join(words), "a"))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, rows), labels).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert sum(got[i]["predicted"] == marks[i][2] for i in held) > 0.95 * len(held)


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.repartition(7), labels.repartition(3)).collect()} == one

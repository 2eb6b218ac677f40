"""What earlier limits left out: short and long items, strings of one kind, deep paths, templates that are rejected."""

import random
import string
import time

import numpy as np

from meshloom.llm import decontamination, secrets, simhash, urls
from tests.llm.helpers import documents, prose


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "red owls sleep by day"), (2, "Red owls!"), (3, "never seen in here at all")], "item_id smallint, text string")
    docs = documents(spark, [(1, "They say: red owls sleep, by day. So be it.", "a"), (2, "red and owls", "a"), (3, "so many RED OWLS", "a")])
    found = decontamination.contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"], r["start"], r["words"], r["similarity"]) for r in found.collect()} == {(1, 1, 2, 5, 1.0), (1, 2, 2, 2, 1.0), (3, 2, 2, 2, 1.0)}
    # two words are no reason to go
    assert {r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()} == {2, 3}


def test_long_items_are_aligned_in_little_memory():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 1 << 60, 3000).astype(np.uint64)
    passage = np.r_[rng.integers(0, 1 << 60, 2000).astype(np.uint64), np.delete(item, np.arange(0, 3000, 10)), rng.integers(0, 1 << 60, 2000).astype(np.uint64)]
    matched, start, end = decontamination.align(item, passage)
    assert matched == 2700
    assert (start, end) == (2000, 4700)


def test_keys_of_one_kind_of_characters():
    novelty = secrets.Novelty()
    for text, string_ in [("the secret key qzxkvjwpmtrbydhsgnlc is here", "qzxkvjwpmtrbydhsgnlc"), ("access token 83920174659201837465 was sent", "83920174659201837465"), ("private key QXVJZKWPMTRBYDHSGNLC", "QXVJZKWPMTRBYDHSGNLC")]:
        assert [text[a:b] for _, a, b in secrets.novel_spans(text, novelty)] == [string_]
    assert secrets.novel_spans("the password of password-password-password and token_token_token", novelty) == []


def test_scan_takes_time_in_proportion():
    rng = random.Random(2)
    text = " ".join(rng.choice(["token", "secret", "key", "of", "an"]) for _ in range(120_000))
    began = time.perf_counter()
    assert secrets.novel_spans(text, secrets.Novelty()) == []
    assert time.perf_counter() - began < 20
    long = "token " + "".join(rng.choice(string.ascii_letters) for _ in range(300_000))
    assert secrets.novel_spans(long, secrets.Novelty())[0][1:] == (6, len(long))


def test_templates_are_rejected_and_kept(spark):
    """Labels reach branches that are built alike; a branch that is labelled otherwise or built otherwise stays apart."""
    rules = (("block", "bad.com/de/"), ("allow", "bad.com/en/"))
    rows = [f"http://bad.com/{lang}/{i}" for lang in ("de", "fr") for i in range(30)] + [f"http://bad.com/en/{i}" for i in range(30)] + ["http://bad.com/about/us/now/x"] * 6
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    verdict = {}
    for r in urls.judge(pages, rules=rules).collect():
        verdict.setdefault(r["path"].split("/")[1], set()).add(r["verdict"])
    assert verdict["de"] == {"block"} and verdict["en"] == verdict["about"] == {"allow"}
    only = spark.createDataFrame(list(enumerate(rows[:60] + rows[90:])), "page_id long, url string")
    told = {r["path"]: r for r in urls.judge(only, rules=rules[:1]).collect()}
    assert {told[f"/fr/{i}"]["verdict"] for i in range(30)} == {"block"} and told["/fr/3"]["template"] == "/*/{n}"
    assert told["/about/us/now/x"]["verdict"] == "allow"


def test_deep_paths_keep_their_segments(spark):
    deep = "/".join(["a"] * 20)
    rows = [f"http://h.com/{deep}/{end}" for end in ("x", "y", "77")]
    found = {r["path"]: r["template"] for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert found[f"/{deep}/77"].endswith("/a/{n}")
    assert len(set(found.values())) == 3


def test_pivots_discard(spark):
    """The funnel: cells of pivots let fewer pairs meet than blocks, and the table leaves hardly any that are not close."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    close = [x ^ (1 << rng.randrange(64)) for x in base[:40]]
    hot = [base[0] & ~0x3FFFFF | rng.getrandbits(22) for _ in range(200)]  # one block with many
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in {*base, *close, *hot}], "fp long")
    told = simhash.funnel(nodes)
    every = list({*base, *close, *hot})
    want = sum((x ^ y).bit_count() <= 2 for i, x in enumerate(every) for y in every[:i])
    assert told["pivots"] <= told["cells"] < told["blocks"]
    assert told["links"] <= want
    found = {frozenset((r["u"], r["v"])) for r in simhash.links(nodes).collect()}
    assert all((a ^ b) & ((1 << 64) - 1) and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in map(tuple, found))
    assert prose(rng, 3)

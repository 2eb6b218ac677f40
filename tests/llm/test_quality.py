"""Quality rules against SQL, and boilerplate by hand."""

import random

from meshloom.llm import quality, queries
from tests.compare import assert_same
from tests.llm.helpers import documents, prose


def test_against_sql(spark, sf):
    assert_same(spark, sf, queries.op8_quality_rules, queries.OP8_SQL)


def test_repeated_windows(spark):
    window = "a b c d e f g h"
    rows = [(1, f"{window} x y {window} z", "s"), (2, "w " * 40, "s"), (3, f"{window} i {window}", "s")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert got == {1: 16, 2: 40, 3: 16}


def test_boilerplate_depletes(spark):
    rng = random.Random(3)
    menu = "home about contact terms privacy imprint"
    rows = [(i, f"{menu}\n{prose(rng, 40)}", "h") for i in range(30)]
    rows += [(100 + i, f"{menu}\n" * 6 + prose(rng, 10) + f" {i}", "h") for i in range(3)]
    copies = prose(rng, 30) + "\n" + prose(rng, 30)
    rows += [(200 + i, copies, "h") for i in range(30)]  # copies are not boilerplate of themselves
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(30))
    assert all(kept[200 + i] for i in range(30))
    assert {r["doc_id"] for r in quality.kept_documents(documents(spark, rows)).collect()} == {i for i, k in kept.items() if k}


def test_long_lines_are_counted(spark):
    """A paragraph of 60 words in different texts of a host is boilerplate like any line."""
    rng = random.Random(4)
    licence = prose(rng, 60)
    rows = [(i, f"{licence}\n{prose(rng, 25)} {i}", "h") for i in range(12)] + [(100 + i, prose(rng, 80), "h") for i in range(12)]
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert got == {i: (60, False) if i < 100 else (0, True) for i in got}

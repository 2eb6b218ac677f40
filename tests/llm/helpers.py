"""Small document tables with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "s", "ly"]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def awkward(spark):
    """Null and empty texts, one long word, blank text, very long text, ties, repeated rows, null keys and hosts."""
    rng = random.Random(9)
    long = prose(rng, 20_000)
    rows = [(1, prose(rng, 60), "a"), (2, None, "a"), (3, "", None), (4, " \t\n\x0b\x0c\r ", "a"), (5, "x" * 5000, "b"), (6, long, "b"), (7, "Ünïcode 日本語 … “quoted”\n\n" + prose(rng, 40), "b"), (None, prose(rng, 30), None)]
    rows += [rows[0], rows[5], (8, rows[0][1], "a"), (9, rows[0][1] + " end", "c")]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])


def clashing(docs):
    """The same table with columns named like those that operators make for themselves."""
    for c in ("shard", "slot", "size", "fp", "node", "kept", "piece", "length", "_words", "_q", "_k", "_h", "_t", "_gone", "_text", "_line", "k", "t", "score", "spans", "host", "rule", "verdict", "bucket", "_key", "_host", "word", "id", "text_crc32"):
        docs = docs.withColumn(c, docs["doc_id"])
    return docs

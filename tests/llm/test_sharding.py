"""Laws of rendezvous sharding."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from meshloom.llm import sharding


def test_laws(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_records(docs, 40).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(f"é{r['doc_id']}".encode()) + 16
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(40))
    assert max(map(len, slots.values())) < 1.25 * 500
    moved = sum(r["grown_shard"] == 40 for r in rows)
    assert 350 < moved < 640
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, 41).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_weights_are_shares(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = Counter(r["shard"] for r in sharding.shard_records(docs, [1.0, 2.0, 3.0], grown=False).collect())
    assert abs(counts[0] - 5000) < 300
    assert abs(counts[2] - 15_000) < 500


def test_crc(spark):
    import zlib

    docs = spark.createDataFrame([(1, "abc"), (1, "é"), (2, None)], "doc_id int, text string")
    assert {r["text_crc32"] for r in sharding.shard_records(docs).collect()} == {zlib.crc32(b"abc"), zlib.crc32("é".encode()), 0}

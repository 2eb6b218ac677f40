"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

A record's shard is the one whose score, made of the record key and the shard
number alone, is best. Another shard therefore only takes records to itself, and
a changed weight moves only the share that the weight changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sub-ranges of each shard over which slots are numbered; their counts are all that is ever gathered by shard.
SLOT_BUCKETS = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    """(score, shard) of a key: -ln(u)/weight with u in (0, 1) from XXH64 of (key, shard)."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def _best(key: Column, weights: Sequence[float]) -> Column:
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    scored = [_score(key, shard, weight) for shard, weight in enumerate(weights)]
    return scored[0] if len(scored) == 1 else F.array_min(F.array(*scored))


def _keyed(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: that of the smallest score; ties go to the lower shard.

    A null key is hashed as the empty string, so all null keys share one shard.
    """
    return _best(_keyed(key), weights)["shard"]


def shard_records(docs: DataFrame, shards: int | Sequence[float] = 40, key: str = "doc_id", text: str = "text", grown: bool = True) -> DataFrame:
    """Deal every row to a shard, with a gapless slot in it.

    ``shards`` is a count or a list of weights. Returns key, size (UTF-8 bytes plus
    16; a null text has none), text_crc32, law ('key'), shard, slot (0.. in each
    shard) and grown_shard (the shard if one more of weight 1 were added; null if
    not asked for).

    Equal keys share a shard; repeated rows get a slot each. A null key counts as
    the empty string. An empty table gives an empty result. Other columns,
    whatever their names, are ignored. Slots are numbered within buckets of a shard,
    dealt by key, size and text, and shifted by the sizes of the buckets before: no
    task ever holds a whole shard, nor all rows of one key with different texts.
    Scores are computed once for each row, and the rows (without texts) written.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = _keyed(F.col(key))
    slim = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), _best(hashed, weights).alias("_best"), *([_score(hashed, len(weights), 1.0).alias("_more")] if grown else []))
    bucket = F.pmod(F.xxhash64(_keyed(F.col("_key")), "size", "text_crc32", F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
    # one more shard takes what it scores best for, and nothing else moves
    more = F.least("_best", "_more")["shard"] if grown else F.lit(None).cast("int")
    placed = written(slim.select("_key", "size", "text_crc32", F.col("_best.shard").alias("shard"), more.alias("grown_shard"), bucket.alias("_bucket")), "placed")
    counts = placed.groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x SLOT_BUCKETS rows at most, whatever the input
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32")
    numbered = placed.withColumn("_rank", F.row_number().over(within))
    return numbered.join(starts, ["shard", "_bucket"]).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard"
    )

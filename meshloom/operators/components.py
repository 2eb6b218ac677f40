"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Rounds after which something is wrong: they are logarithmic in the longest chain.
MOST_ROUNDS = 60

#: Links up to which one task solves them all (16 MB); more are solved in rounds over the cluster, with the same result.
ONE_TASK = 1_000_000


def solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), in order, and the smallest node that each can reach: least labels, with pointers followed, until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):  # a node's label, and that of the node it points to
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a small table at once."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    nodes, roots = solved(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    other = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], names=["u", "root"])


def _sum(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, root) for every node of ``links`` (u, v; longs) but the roots themselves; root is the smallest node reachable.

    Nothing but two sums a round comes to the driver. Every round is written to the
    shared folder, so that it outlives its executors. Minima are pre-aggregated and
    hub nodes only meet their one minimum in a join, which Spark can split.
    """
    stars = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _sum(stars)
    if before[0] <= one_task:
        return written(stars.coalesce(1).mapInArrow(_solved, "u long, root long"), "roots")
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        stars = written(small, "stars")
        after = _sum(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return stars.select("u", F.col("v").alias("root"))

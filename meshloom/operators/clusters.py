"""Clusters of an object's triangles, by which distances are searched in two steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import BOX
from ..storage import exchanged

#: Objects of up to so many triangles are one cluster.
ONE_CLUSTER = 64


def _steps(n: Column) -> Column:
    """Cells in a direction for n items of a surface: about as many of them are occupied as a cell has items."""
    return F.when(n <= ONE_CLUSTER, F.lit(1)).otherwise(F.ceil(F.pow(n.cast("double"), F.lit(0.25)))).cast("int")


def _cluster(point: tuple[Column, ...], box: g.Box, steps: Column) -> Column:
    number = F.lit(0).cast("long")
    for i in range(3):
        share = (point[i] - box[i]) / F.nullif(box[i + 3] - box[i], F.lit(0.0))
        number = number * steps + F.coalesce(F.least(steps - 1, F.greatest(F.lit(0), F.floor(share * steps))), F.lit(0))
    return number


def clustered(triangles: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triangles with ``cluster``, and the clusters (object_id, cluster, box): cells of a grid over each object's box, by barycentre."""
    whole = objects.select("object_id", *[F.col(c).alias(f"_o{c}") for c in BOX], _steps(F.col("n_tri")).alias("_steps"))
    corners = [g.vec(v) for v in "abc"]
    box = tuple(F.col(f"_o{c}") for c in BOX)
    rows = exchanged(triangles).join(whole, "object_id").withColumn("cluster", _cluster(g.tri_barycenter(*corners), box, F.col("_steps"))).drop("_steps", *[f"_o{c}" for c in BOX])
    around = [(F.min if n[0] == "l" else F.max)(x).alias(n) for x, n in zip(g.tri_box(*corners), BOX, strict=True)]
    return rows, rows.groupBy("object_id", "cluster").agg(*around)


def clustered_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for points (object_id, x, y, z)."""
    at = tuple(F.col(c) for c in "xyz")
    whole = points.groupBy("object_id").agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_ol{c}") for c in "xyz"], *[F.max(c).alias(f"_oh{c}") for c in "xyz"]).withColumn("_steps", _steps(F.col("_n")))
    rows = exchanged(points).join(whole, "object_id").withColumn("cluster", _cluster(at, tuple(F.col(f"_o{c}") for c in BOX), F.col("_steps"))).drop("_n", "_steps", *[f"_o{c}" for c in BOX])
    return rows, rows.groupBy("object_id", "cluster").agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"])


def _square(x: Column) -> Column:
    return x * x


def near_clusters(points: DataFrame, clusters: DataFrame, point: tuple[str, str, str]) -> DataFrame:
    """Every point, once for each cluster of its object that can hold what is nearest to it, as column ``cluster``.

    A cluster can if it is no further than the least upper bound that any cluster
    gives. An object has as many clusters as the root of its items, in one row.
    """
    per = clusters.groupBy("object_id").agg(F.collect_list(F.struct("cluster", *BOX)).alias("_c"))
    p = [F.col(c) for c in point]
    gap = lambda c: sum((_square(F.greatest(F.lit(0.0), c[f"l{x}"] - p[i], p[i] - c[f"h{x}"])) for i, x in enumerate("xyz")), F.lit(0.0))
    reach = lambda c: sum((_square(F.greatest(F.abs(c[f"h{x}"] - p[i]), F.abs(p[i] - c[f"l{x}"]))) for i, x in enumerate("xyz")), F.lit(0.0))
    kept = F.transform(F.array(F.array_min(F.transform("_c", reach))), lambda most: F.transform(F.filter("_c", lambda c: gap(c) <= most), lambda c: c["cluster"]))[0]
    return exchanged(points).join(per, "object_id").withColumn("cluster", F.explode(F.when(F.size("_c") == 1, F.transform("_c", lambda c: c["cluster"])).otherwise(kept))).drop("_c")

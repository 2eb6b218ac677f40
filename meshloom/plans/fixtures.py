"""Mesh datasets derived from the driver's tables, and the same boxes in SQL.

Every number comes from a key by integer arithmetic, so that two engines compute
the same doubles. The offsets of side B keep the data in general position.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import BOX_CORNERS, BOX_FACES, OCTA_CORNERS, OCTA_FACES, Mesh, cube_mesh, template_mesh

CELL = 8.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashed(key: str, factor: int, shift: float = 0.0):
    c = (F.col(key) * factor) % 1000 / F.lit(10.0)
    return c + F.lit(shift) if shift else c


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dealt to all cores before they become meshes: the driver's files are one row group each."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def centers_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey"
    return dealt(spark, sf_dir, "part").select(F.col(k).cast("long").alias("object_id"), _hashed(k, 7919).alias("x"), _hashed(k, 104729).alias("y"), _hashed(k, 1299709).alias("z"), (F.lit(2) + F.col("p_size") % 10).cast("double").alias("s"))


def centers_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return dealt(spark, sf_dir, "customer").select(F.col(k).cast("long").alias("object_id"), _hashed(k, 6151, 0.0313).alias("x"), _hashed(k, 24593, 0.0471).alias("y"), _hashed(k, 49157, 0.0597).alias("z"), (F.lit(1) + F.col(k) % 7).cast("double").alias("s"))


def cubes_a(spark: SparkSession, sf_dir: str) -> Mesh:
    return Mesh(cube_mesh(centers_a(spark, sf_dir)))


def cubes_b(spark: SparkSession, sf_dir: str) -> Mesh:
    return Mesh(cube_mesh(centers_b(spark, sf_dir)))


def octahedra(spark: SparkSession, sf_dir: str, side: str = "a") -> Mesh:
    return Mesh(template_mesh((centers_a if side == "a" else centers_b)(spark, sf_dir), OCTA_CORNERS, OCTA_FACES))


# SQL of the same.

SQL_A = "A AS (SELECT CAST(p_partkey AS BIGINT) AS id, ((p_partkey*7919)%1000)/10.0::DOUBLE AS x, ((p_partkey*104729)%1000)/10.0::DOUBLE AS y, ((p_partkey*1299709)%1000)/10.0::DOUBLE AS z, CAST(2 + p_size%10 AS DOUBLE) AS s FROM part)"
SQL_B = "B AS (SELECT CAST(c_custkey AS BIGINT) AS id, ((c_custkey*6151)%1000)/10.0::DOUBLE + 0.0313::DOUBLE AS x, ((c_custkey*24593)%1000)/10.0::DOUBLE + 0.0471::DOUBLE AS y, ((c_custkey*49157)%1000)/10.0::DOUBLE + 0.0597::DOUBLE AS z, CAST(1 + c_custkey%7 AS DOUBLE) AS s FROM customer)"


def _boxes(side: str) -> str:
    return f"B{side} AS (SELECT id, s, x, y, z, " + ", ".join(f"{c} - s/2 AS l{c}, {c} + s/2 AS h{c}" for c in "xyz") + f" FROM {side})"


BOXES = f"{SQL_A}, {SQL_B}, {_boxes('A')}, {_boxes('B')}"
MEET = " AND ".join(f"a.l{c} <= b.h{c} AND b.l{c} <= a.h{c}" for c in "xyz")
A_HOLDS_B = " AND ".join(f"a.l{c} <= b.l{c} AND b.h{c} <= a.h{c}" for c in "xyz")
B_HOLDS_A = " AND ".join(f"b.l{c} <= a.l{c} AND a.h{c} <= b.h{c}" for c in "xyz")
GAP = "sqrt(" + " + ".join(f"power(greatest(0, a.l{c} - b.h{c}, b.l{c} - a.h{c}), 2)" for c in "xyz") + ")"
REACH = "sqrt(" + " + ".join(f"power(greatest(a.h{c} - b.l{c}, b.h{c} - a.l{c}), 2)" for c in "xyz") + ")"
PAIR = "a.id AS a_object_id, b.id AS b_object_id"


@lru_cache
def cube_edges() -> list[tuple[tuple[int, ...], tuple[int, ...], bool]]:
    """The eighteen edges of the template in the order of their numbers, as corner signs; whether the first occurrence runs from the lower end."""
    seen: dict[tuple, bool] = {}
    for f in BOX_FACES:
        for i, j in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
            p, q = BOX_CORNERS[i], BOX_CORNERS[j]
            seen.setdefault((min(p, q), max(p, q)), p < q)
    return [(lo, hi, up) for (lo, hi), up in sorted(seen.items())]


def edges_sql(side: str) -> str:
    """CTE E<side>: id, edge_id, p and q of every edge."""
    rows = ", ".join("({}, {}, {}, {}, {}, {}, {})".format(n, *(lo if up else hi), *(hi if up else lo)) for n, (lo, hi, up) in enumerate(cube_edges()))
    cols = ", ".join(f"{c} + t.{e}{c}*s/2 AS {e}{c}" for e in "pq" for c in "xyz")
    return f"E{side} AS (SELECT id, CAST(t.n AS BIGINT) AS edge_id, {cols} FROM {side}, (VALUES {rows}) AS t(n, px, py, pz, qx, qy, qz))"


def slab_sql(source: str, target: str, name: str = "X") -> str:
    """CTE: every edge of ``source`` with the boxes of ``target`` that its line crosses, and the parameters of entry and exit."""
    t = lambda c, side: f"(b.{side}{c} - e.p{c})/nullif(e.q{c} - e.p{c}, 0)"
    low = ", ".join(f"coalesce(least({t(c, 'l')}, {t(c, 'h')}), CASE WHEN e.p{c} BETWEEN b.l{c} AND b.h{c} THEN -1e300 ELSE 1e300 END)" for c in "xyz")
    high = ", ".join(f"coalesce(greatest({t(c, 'l')}, {t(c, 'h')}), 1e300)" for c in "xyz")
    reach = " AND ".join(f"least(e.p{c}, e.q{c}) <= b.h{c} AND b.l{c} <= greatest(e.p{c}, e.q{c})" for c in "xyz")
    return f"{name} AS (SELECT * FROM (SELECT e.id AS sid, e.edge_id, b.id AS tid, greatest({low}) AS tin, least({high}) AS tout FROM E{source} e JOIN B{target} b ON {reach}) WHERE greatest(0, tin) <= least(1, tout) AND (tin > 0 OR tout <= 1))"


def hits_sql(name: str = "X") -> str:
    """Rows (sid, edge_id, tid, pos) of every crossing of a surface."""
    return f"SELECT sid, edge_id, tid, tin AS pos FROM {name} WHERE tin > 0 AND tin <= 1 UNION ALL SELECT sid, edge_id, tid, tout FROM {name} WHERE tout > 0 AND tout <= 1"

"""The registry, continued: progressive joins, trees, tiles, stores and the codec's tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks, sources
from ..operators import detail as de
from ..operators import distance as di
from ..operators import joins as jo
from ..operators import mesh as me
from ..schema import BOX, TRIANGLE
from . import fixtures as fx
from .fixtures import BOXES, CELL, GAP, MEET, PAIR, centers_a, cubes_a, cubes_b
from .more import _folder, _poles
from .registry import SURFACE, D, both, query, rounded

#: Cells of the vertex clustering that makes the coarse levels of ``join_lods`` from the meshes.
CELLS = {20: 16.0, 40: 8.0, 60: 4.0, 80: 2.0}

# Levels of the raw tiles: cubes shrunk about their centres stand for the coarse ones.

SHRINK = {20: 2.0, 40: 1.6, 60: 1.25, 80: 1.1}


def _levels(t):
    return {lod: me.mesh_shrink(t, k) for lod, k in SHRINK.items()} | {100: t}


@query("join_lods", f"WITH {BOXES} SELECT {PAIR}, ({SURFACE} <= 2.0) AS within FROM BA a JOIN BB b ON {GAP} <= 4.0")
def join_lods(spark, sf_dir):
    """Pairs within 2, decided at the first of the levels 20, 40, 60, 80 and 100 whose range of distances can; the last level measures."""
    levels = lambda t: de.levels_of(t, CELLS, stored=True)
    return di.within_by_levels(*both(spark, sf_dir), levels, 4.0, D, CELL).select("a_object_id", "b_object_id", "within")


_RAW = ", ".join(f"({lod}, {k}::DOUBLE)" for lod, k in {**SHRINK, 100: 1.0}.items())


@query("sink_dt_raw", f"WITH {BOXES} SELECT CAST(lod AS INT) AS lod, id AS object_id, CAST(v AS BIGINT) AS voxel_id, CAST(6 AS BIGINT) AS triangles, round(CASE WHEN lod = 100 THEN 0 ELSE (s - s/k)/2 + sqrt(s/k*s/k/60/2) END, 4) AS hausdorff FROM BA, (VALUES {_RAW}) AS l(lod, k), (SELECT unnest([0, 1]) AS v)")
def sink_dt_raw(spark, sf_dir):
    """Levels 20 to 100 in steps of 20: triangles by voxel with their Hausdorff values, one partition a level."""
    t, seeds, rows = cubes_a(spark, sf_dir).triangles, _poles(spark, sf_dir), None
    for lod, coarse in _levels(t).items():
        facets = de.facet_hausdorff(coarse, t, 1).withColumnRenamed("facet", "tri_id") if lod < 100 else coarse.select("object_id", "tri_id", F.lit(0.0).alias("hausdorff"), F.lit(0.0).alias("proxy"))
        level = coarse.join(de.facet_voxels(coarse, seeds), ["object_id", "tri_id"]).join(facets, ["object_id", "tri_id"]).withColumn("lod", F.lit(lod))
        rows = level if rows is None else rows.unionByName(level)
    path = _folder(spark, "raw")
    sinks.write_raw_tiles(rows, path)
    return rounded(spark.read.parquet(path).groupBy("lod", "object_id", "voxel_id").agg(F.count("*").alias("triangles"), F.max("hausdorff").alias("hausdorff")), 4)


# Voxels: the lower and the upper half of every cube.


def _halves(centers):
    low = [F.col(c) - F.col("s") / 2 for c in "xyz"]
    high = [F.col(c) + F.col("s") / 2 for c in "xyz"]
    part = lambda n, lz, hz: F.struct(F.lit(n).cast("long").alias("voxel_id"), *[x.alias(c) for x, c in zip((low[0], low[1], lz, high[0], high[1], hz), BOX, strict=True)])
    return centers.select("object_id", F.explode(F.array(part(0, low[2], F.col("z")), part(1, F.col("z"), high[2]))).alias("v")).select("object_id", "v.*")


_HALF = lambda side: f"V{side} AS (SELECT id, v, lx, hx, ly, hy, CASE WHEN v = 0 THEN lz ELSE z END AS lz, CASE WHEN v = 0 THEN z ELSE hz END AS hz FROM B{side}, (SELECT unnest([0, 1]) AS v))"
_OVER = "sqrt(" + " + ".join(f"power(greatest(a.h{c} - b.l{c}, b.h{c} - a.l{c}), 2)" for c in "xyz") + ")"


def _voxel_pairs(a, b):
    """Of objects told by triangles and voxels; rounded before copies get their rows, of which there may be many more."""
    pairs = jo.candidates(*[me.Mesh(m.tables[0]) for m in (a, b)], CELL)
    return rounded(di.voxel_pair_candidates(pairs, a.tables[1], b.tables[1]), 5)


query("voxel_pair_candidates", f"WITH {BOXES}, {_HALF('A')}, {_HALF('B')}, C AS (SELECT {PAIR} FROM BA a JOIN BB b ON {MEET}), P AS (SELECT C.*, CAST(a.v AS BIGINT) AS a_voxel_id, CAST(b.v AS BIGINT) AS b_voxel_id, {GAP} AS mindist, {_OVER} AS maxdist FROM C JOIN VA a ON a.id = a_object_id JOIN VB b ON b.id = b_object_id) SELECT a_object_id, b_object_id, a_voxel_id, b_voxel_id, round(mindist, 5) AS mindist, round(maxdist, 5) AS maxdist FROM (SELECT *, min(maxdist) OVER (PARTITION BY a_object_id, b_object_id) AS least FROM P) WHERE mindist <= least")(
    lambda s, d: jo.by_shape(*[me.Tables((m.triangles, _halves(centers(s, d)))) for m, centers in zip(both(s, d), (centers_a, fx.centers_b), strict=True)], _voxel_pairs)
)

# Slices and trees.

_SLICES = "X AS (SELECT *, ntile({nx}) OVER (ORDER BY {x}, id) AS px FROM {t}), Y AS (SELECT *, ntile({ny}) OVER (PARTITION BY px ORDER BY {y}, id) AS py FROM X), Z AS (SELECT *, ntile({nz}) OVER (PARTITION BY px, py ORDER BY {z}, id) AS pz FROM Y)"
query("sort_partition", f"WITH {BOXES}, {_SLICES.format(nx=4, ny=4, nz=4, x='lx', y='ly', z='lz', t='BA')} SELECT id AS object_id, CAST(px AS INT) AS px, CAST(py AS INT) AS py, CAST(pz AS INT) AS pz FROM Z")(lambda s, d: di.sort_partition(cubes_a(s, d).objects.select("object_id", *BOX), 4).select("object_id", "px", "py", "pz"))
_TREE = (
    f"{BOXES}, N AS (SELECT greatest(1, CAST(ceil(count(*)/2.0::DOUBLE) AS BIGINT)) AS leaves FROM B), NX AS (SELECT leaves, CAST(greatest(1, round(power(leaves, 1/3.0::DOUBLE) + 0.4999::DOUBLE)) AS BIGINT) AS sx FROM N), NY AS (SELECT leaves, sx, CAST(greatest(1, round(sqrt(leaves/sx::DOUBLE) + 0.4999::DOUBLE)) AS BIGINT) AS sy FROM NX), S AS (SELECT sx, sy, greatest(1, CAST(ceil(leaves/(sx*sy)::DOUBLE) AS BIGINT)) AS sz FROM NY), "
    "R1 AS (SELECT BB.*, (lx + hx)/2 AS cx, (ly + hy)/2 AS cy, (lz + hz)/2 AS cz, sx, sy, sz, count(*) OVER () AS n, row_number() OVER (ORDER BY (lx + hx)/2, id) - 1 AS k FROM BB, S), "
    "T1 AS (SELECT *, CASE WHEN k < (n % sx)*(n//sx + 1) THEN k//(n//sx + 1) ELSE n % sx + (k - (n % sx)*(n//sx + 1))//greatest(n//sx, 1) END AS px FROM R1), "
    "R2 AS (SELECT * REPLACE (count(*) OVER (PARTITION BY px) AS n, row_number() OVER (PARTITION BY px ORDER BY cy, id) - 1 AS k) FROM T1), "
    "T2 AS (SELECT *, CASE WHEN k < (n % sy)*(n//sy + 1) THEN k//(n//sy + 1) ELSE n % sy + (k - (n % sy)*(n//sy + 1))//greatest(n//sy, 1) END AS py FROM R2), "
    "R3 AS (SELECT * REPLACE (count(*) OVER (PARTITION BY px, py) AS n, row_number() OVER (PARTITION BY px, py ORDER BY cz, id) - 1 AS k) FROM T2), "
    "T3 AS (SELECT *, CASE WHEN k < (n % sz)*(n//sz + 1) THEN k//(n//sz + 1) ELSE n % sz + (k - (n % sz)*(n//sz + 1))//greatest(n//sz, 1) END AS pz FROM R3), "
    "L AS (SELECT *, CAST((px*sy + py)*sz + pz AS BIGINT) AS leaf FROM T3)"
)
query("touch_str_tree", f"WITH {_TREE} SELECT id AS object_id, leaf FROM L")(lambda s, d: di.str_tree(cubes_b(s, d).objects)[0])
#: Levels that the SQL unrolls: 2^24 leaves are more than it will ever see; nodes above the root are the root.
_UP = 24
_NODES = "ND AS (SELECT lv, leaf >> lv AS node, " + ", ".join(f"{'min' if c[0] == 'l' else 'max'}({c}) AS {c}" for c in BOX) + f" FROM L, (SELECT unnest(range({_UP + 1})) AS lv) GROUP BY 1, 2), H AS (SELECT min(lv) AS top FROM (SELECT lv FROM ND GROUP BY lv HAVING max(node) = 0))"
_IN = " AND ".join(f"o.l{c} <= n.h{c} AND n.l{c} <= o.h{c}" for c in "xyz")
_STEP = ", ".join(f"W{k - 1} AS (SELECT o.id, o.lx, o.ly, o.lz, o.hx, o.hy, o.hz, o.node, count(*) AS n, min(n.node) AS child FROM {f'W{k}' if k == _UP else f'(SELECT id, lx, ly, lz, hx, hy, hz, child AS node FROM W{k} WHERE n = 1)'} o JOIN ND n ON n.lv = {k - 1} AND n.node >> 1 = o.node AND {_IN} GROUP BY ALL)" for k in range(_UP, 0, -1))
_STAY = " UNION ALL ".join([*[f"SELECT id, {k} AS lv, node FROM W{k - 1} WHERE n > 1" for k in range(_UP, 0, -1)], "SELECT id, 0, child FROM W0 WHERE n = 1"])
query("touch_assign", f"WITH {_TREE}, {_NODES}, W{_UP} AS (SELECT o.*, n.node FROM (SELECT id, lx, ly, lz, hx, hy, hz FROM BA) o JOIN ND n ON n.lv = {_UP} AND {_IN}), {_STEP}, ST AS ({_STAY}) SELECT id AS object_id, CAST(lv AS INT) AS level, CAST(node AS BIGINT) AS node FROM ST")(
    lambda s, d: di.touch_assign(di.str_tree(cubes_b(s, d).objects)[1], cubes_a(s, d).objects)
)

# Stores of files named by ids.


@query("scan_bucket_ids", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation")
def scan_bucket_ids(spark, sf_dir):
    """A store of one file a nation, with others that are no ids."""
    import pyarrow.fs as pafs

    path = _folder(spark, "bucket")
    store, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(root, recursive=True)
    for name in [f"{r[0]}.swc" for r in fx.table(spark, sf_dir, "nation").select("n_nationkey").collect()] + ["x.swc", "12.txt", "7.swc.bak"]:  # 25 rows
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(b"1 1 0 0 0 1 -1")
    return sources.read_bucket_ids(spark, path)


# The codec's tests of a vertex that may go.


def _hat(spark, sf_dir):
    """A square of neighbours with side s, counter-clockwise from below, raised by the part's key in steps."""
    k = (F.col("object_id") % 4).cast("double")
    ring = F.array(*[F.struct((F.col("s") * x).alias("x"), (F.col("s") * y).alias("y"), (F.col("s") * 0 + h + 1).alias("z")) for x, y, h in ((-1, -1, k), (1, -1, -k), (1, 1, k), (-1, 1, -k))])
    return centers_a(spark, sf_dir).select("object_id", F.lit(0).cast("long").alias("vertex_id"), ring.alias("ring"))


# four triangles around (0, 0, 1), each of area s sqrt(s^2 + k^2), against a base of their area at height 1 with normal -z
query("removal_error", f"WITH {BOXES}, P AS (SELECT id, s, (id % 4)::DOUBLE AS k FROM A), V AS (SELECT *, 4*s*s/3 - 4*s*sqrt(s*s + k*k)/3 AS volume, 4*sqrt(4*s*s + 4*k*k) AS around FROM P) SELECT id AS object_id, CAST(0 AS BIGINT) AS vertex_id, round(CASE WHEN volume > 1e-9 THEN cbrt(volume)*4/around ELSE 0 END, 5) AS error FROM V")(
    lambda s, d: de.removal_error(_hat(s, d)).select("object_id", "vertex_id", F.round(F.when(F.col("error") > 1e-2, F.col("error")).otherwise(F.lit(0.0)), 5).alias("error"))
)


@query("violates_manifold", "SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(v AS BIGINT) AS vertex_id, (p_partkey % 2 = 0 AND v IN (1, 3)) AS violates FROM part, (SELECT unnest(range(5)) AS v)")
def violates_manifold(spark, sf_dir):
    """A pyramid: base 0, 1, 2, 3 under the top 4, and for even keys a flap that joins the corners 0 and 2 of the base."""
    base, even = [[3, 2, 1, 0], [0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]], [[0, 2, 4], [2, 0, 4]]
    rows = lambda faces: F.array(*[F.struct(F.lit(i).cast("long").alias("face_id"), F.array(*[F.lit(v).cast("long") for v in f]).alias("ring")) for i, f in enumerate(faces)])
    keys = centers_a(spark, sf_dir).select("object_id")
    return de.violates_manifold(keys.select("object_id", F.explode(F.when(F.col("object_id") % 2 == 0, rows(base + even)).otherwise(rows(base))).alias("f")).select("object_id", "f.*"))

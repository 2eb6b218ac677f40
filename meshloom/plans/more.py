"""The registry, continued: scalars, quality, levels of detail, generators, analytics, sources and sinks."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import geometry as g
from ..functions.kernels import tri_tri_distance, tri_tri_intersects
from ..operators import analytics as an
from ..operators import detail as de
from ..operators import generate as ge
from ..operators import joins as jo
from ..operators import mesh as me
from ..operators import repair as re_
from ..schema import BOX, TRIANGLE
from ..storage import exchanged, new_folder, written
from ..streaming import stream_candidates
from . import fixtures as fx
from .fixtures import A_HOLDS_B, BOXES, CELL, GAP, MEET, PAIR, REACH, centers_a, centers_b, cubes_a, cubes_b
from .registry import ORACLES, OVERLAP, both, query, rounded, triangles_sql

BA = lambda: tuple(F.col(f"a_{c}") for c in BOX)
BB = lambda: tuple(F.col(f"b_{c}") for c in BOX)


def box_query(name: str, columns: dict, sql: str, where: str = MEET) -> None:
    """A query of box expressions over candidate pairs: Column makers by name, and their SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = jo.box_pairs(*(m.objects for m in both(spark, sf_dir)), CELL)
        return rounded(pairs.select("a_object_id", "b_object_id", *[f().alias(n) for n, f in columns.items()]), 5)

    query(name, f"WITH {BOXES} SELECT {PAIR}, {sql} FROM BA a JOIN BB b ON {where}")(run)


def _any(text: str) -> str:
    return " AND ".join(text.replace("$", c) for c in "xyz")


box_query("box_intersects", {"strict": lambda: g.box_intersects(BA(), BB())}, f"({_any('a.l$ < b.h$ AND b.l$ < a.h$')}) AS strict")
box_query("box_overlaps_inclusive", {"meets": lambda: g.box_overlaps_inclusive(BA(), BB())}, f"({MEET}) AS meets")
box_query("box_contains_box", {"holds": lambda: g.box_contains_box(BA(), BB())}, f"({A_HOLDS_B}) AS holds")
box_query("box_contains_point", {"holds": lambda: g.box_contains_point(BA(), g.box_center(BB()))}, f"({_any('b.$ BETWEEN a.l$ AND a.h$')}) AS holds")
box_query("box_volume", {"volume": lambda: g.box_volume(BA()), "diagonal": lambda: g.box_diagonal(BB()), "width": lambda: g.box_dims(BA())[0]}, "round(a.s*a.s*a.s, 5) AS volume, round(sqrt(3*b.s*b.s), 5) AS diagonal, round(a.s, 5) AS width")
CENTERS = "sqrt(" + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in "xyz") + ")"
box_query("box_distance", {"mindist": lambda: g.box_gap(BA(), BB()), "center_dist": lambda: g.center_distance(BA(), BB()), "maxdist": lambda: g.box_reach(BA(), BB())}, f"round({GAP}, 5) AS mindist, round({CENTERS}, 5) AS center_dist, round({REACH}, 5) AS maxdist")
box_query("box_expand", {c: (lambda i=i: g.box_expand(BA(), BB())[i]) for i, c in enumerate(BOX)}, ", ".join(f"round({'least' if c[0] == 'l' else 'greatest'}(a.{c}, b.{c}), 5) AS {c}" for c in BOX))
RA = lambda: (F.col("a_lx") + 100, F.col("a_hx") + 100)
RB = lambda: (F.col("b_ly") + 100, F.col("b_hy") + 100)
box_query("range_cmp", {"less": lambda: g.range_less(RA(), RB()), "greater": lambda: g.range_greater(RA(), RB()), "equal": lambda: g.range_equal(RA(), RB()), "valid": lambda: g.range_valid(RA())}, "(a.hx < b.ly) AS less, (a.lx > b.hy) AS greater, (a.hx >= b.ly AND a.lx <= b.hy) AS equal, TRUE AS valid")

VP = lambda: tuple(F.col(f"a_l{c}") for c in "xyz")
VQ = lambda: tuple(F.col(f"b_l{c}") for c in "xyz")
box_query(
    "vec_kit",
    {"sub_x": lambda: g.sub(VP(), VQ())[0], "add_y": lambda: g.add(VP(), VQ())[1], "dot": lambda: g.dot(VP(), VQ()), "cross_z": lambda: g.cross(VP(), VQ())[2], "dist2": lambda: g.dist2(VP(), VQ()), "scale_x": lambda: g.scale(VP(), 2.0)[0]},
    "round(a.lx - b.lx, 5) AS sub_x, round(a.ly + b.ly, 5) AS add_y, round(a.lx*b.lx + a.ly*b.ly + a.lz*b.lz, 5) AS dot, round(a.lx*b.ly - a.ly*b.lx, 5) AS cross_z, round(power(a.lx - b.lx, 2) + power(a.ly - b.ly, 2) + power(a.lz - b.lz, 2), 5) AS dist2, round(2*a.lx, 5) AS scale_x",
)
# the x-edge from a's low corner and the y-edge from b's: orthogonal lines, whose nearest points clamp axis by axis
box_query(
    "seg_seg_closest",
    {"distance": lambda: g.seg_seg_distance(VP(), (F.col("a_hx"), F.col("a_ly"), F.col("a_lz")), VQ(), (F.col("b_lx"), F.col("b_hy"), F.col("b_lz")))},
    "round(sqrt(power(greatest(0, a.lx - b.lx, b.lx - a.hx), 2) + power(greatest(0, b.ly - a.ly, a.ly - b.hy), 2) + power(a.lz - b.lz, 2)), 5) AS distance",
)
# a's centre against the lower half of b's bottom face, a right triangle
_TRI = lambda: ((F.col("b_lx"), F.col("b_ly"), F.col("b_lz")), (F.col("b_hx"), F.col("b_ly"), F.col("b_lz")), (F.col("b_lx"), F.col("b_hy"), F.col("b_lz")))
_U, _V = "(a.x - b.lx)", "(a.y - b.ly)"
_SIDE2 = f"least(power(greatest(0, -{_U}, {_U} - b.s), 2) + {_V}*{_V}, {_U}*{_U} + power(greatest(0, -{_V}, {_V} - b.s), 2), power({_U} - b.s + least(greatest((b.s - {_U} + {_V})/(2*b.s), 0), 1)*b.s, 2) + power({_V} - least(greatest((b.s - {_U} + {_V})/(2*b.s), 0), 1)*b.s, 2))"
_IN = f"({_U} >= 0 AND {_V} >= 0 AND {_U} + {_V} <= b.s)"
box_query("point_tri_distance", {"distance": lambda: g.point_tri_distance(g.box_center(BA()), *_TRI())}, f"round(CASE WHEN {_IN} THEN abs(a.z - b.lz) ELSE sqrt({_SIDE2} + power(a.z - b.lz, 2)) END, 5) AS distance")
box_query("point_in_tri_prism", {"inside": lambda: g.in_prism(g.box_center(BA()), *_TRI())}, f"{_IN} AS inside")
box_query("project_to_plane", {f"p{c}": (lambda i=i: g.project_to_plane(g.box_center(BA()), *_TRI())[i]) for i, c in enumerate("xyz")}, "round(a.x, 5) AS px, round(a.y, 5) AS py, round(b.lz, 5) AS pz")
box_query("tri_normal", {f"n{c}": (lambda i=i: g.tri_normal(*_TRI())[i] + F.lit(0.0)) for i, c in enumerate("xyz")}, "0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, round(b.s*b.s, 5) AS nz")
_FACES = lambda: [c for p in ((F.col("a_lx"), F.col("a_ly"), F.col("a_lz")), (F.col("a_hx"), F.col("a_ly"), F.col("a_lz")), (F.col("a_lx"), F.col("a_hy"), F.col("a_lz"))) for c in p] + [c for p in ((F.col("a_lx"), F.col("a_ly"), F.col("b_hz")), (F.col("a_hx"), F.col("a_ly"), F.col("b_hz")), (F.col("a_lx"), F.col("a_hy"), F.col("b_hz"))) for c in p]
box_query("tri_tri_distance", {"distance": lambda: tri_tri_distance(*_FACES())}, "round(abs(a.lz - b.hz), 5) AS distance")
box_query("tri_tri_intersects", {"meets": lambda: tri_tri_intersects(*_FACES())}, "(a.lz = b.hz) AS meets")

# Meshes.

A = lambda s, d: cubes_a(s, d).triangles
B = lambda s, d: cubes_b(s, d).triangles
query("mesh_area", f"WITH {BOXES} SELECT id AS object_id, round(6*s*s, 5) AS area FROM BA")(lambda s, d: rounded(me.mesh_area(A(s, d)), 5))
query("mesh_volume", f"WITH {BOXES} SELECT id AS object_id, round(s*s*s, 4) AS volume FROM BA")(lambda s, d: rounded(me.mesh_volume(A(s, d)), 4))
query("tri_area", f"WITH {BOXES} SELECT id AS object_id, CAST(t AS BIGINT) AS tri_id, round(s*s/2, 4) AS area, round(s*s/2, 4) AS heron FROM BA, (SELECT unnest(range(12)) AS t)")(lambda s, d: rounded(A(s, d).select("object_id", "tri_id", g.tri_area(g.vec("a"), g.vec("b"), g.vec("c")).alias("area"), g.tri_area_heron(g.vec("a"), g.vec("b"), g.vec("c")).alias("heron")), 4))
TRI = ("a", "b", "c")
query("facet_barycenter", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f"round((ta{c} + tb{c} + tc{c})/3, 5) AS m{c}" for c in "xyz") + " FROM TA")(lambda s, d: rounded(A(s, d).select("object_id", "tri_id", *[x.alias(f"m{c}") for x, c in zip(g.tri_barycenter(*map(g.vec, TRI)), "xyz", strict=True)]), 5))
query("facet_box", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f"round({'least' if b[0] == 'l' else 'greatest'}(ta{b[1]}, tb{b[1]}, tc{b[1]}), 5) AS {b}" for b in BOX) + " FROM TA")(lambda s, d: rounded(A(s, d).select("object_id", "tri_id", *[x.alias(c) for x, c in zip(g.tri_box(*map(g.vec, TRI)), BOX, strict=True)]), 5))
query("vertex_normal", f"WITH {BOXES} SELECT id AS object_id, CAST(8 AS BIGINT) AS vertices, 1.0::DOUBLE AS length FROM BA")(lambda s, d: rounded(me.vertex_normals(A(s, d)).groupBy("object_id").agg(F.count("*").alias("vertices"), F.avg(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)).alias("length"))))
query("mesh_counts", f"WITH {BOXES} SELECT id AS object_id, CAST(12 AS BIGINT) AS n_triangles, CAST(8 AS BIGINT) AS n_vertices, CAST(18 AS BIGINT) AS n_edges FROM BB")(lambda s, d: me.mesh_counts(B(s, d)))
query("mesh_is_closed", "SELECT CAST(p_partkey AS BIGINT) AS object_id, (p_partkey % 3 <> 0) AS closed FROM part")(lambda s, d: me.mesh_is_closed(A(s, d).where("object_id % 3 <> 0 OR tri_id <> 5")))
query("mesh_shift", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f'round(t{c} + {dict(x=1.5, y=-2.5, z=3.0)[c[1]]}, 5) AS "{c}"' for c in TRIANGLE) + " FROM TA")(lambda s, d: rounded(me.mesh_shift(A(s, d), 1.5, -2.5, 3.0), 5))
SCALED = lambda k: f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f'round(A.{c[1]} + (t{c} - A.{c[1]})*{k}, 5) AS "{c}"' for c in TRIANGLE) + " FROM TA JOIN A ON A.id = TA.object_id"
query("mesh_shrink", SCALED("0.5"))(lambda s, d: rounded(me.mesh_shrink(A(s, d), 2.0), 5))
query("mesh_expand", SCALED("3.0"))(lambda s, d: rounded(me.mesh_expand(A(s, d), 3.0), 5))
query("normalize_mesh", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f'round((t{c} - A.{c[1]})/A.s, 5) + 0.0 AS "{c}"' for c in TRIANGLE) + " FROM TA JOIN A ON A.id = TA.object_id")(lambda s, d: rounded(me.normalize_mesh(A(s, d)), 5))
query("rescale_units", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f'round(t{c}/1000, 6) AS "{c}"' for c in TRIANGLE) + " FROM TA")(lambda s, d: rounded(me.rescale_units(A(s, d))))
query("sphere_radius_from_volume", "SELECT CAST(p_partkey AS BIGINT) AS id, round(greatest(cbrt(p_size*3.0::DOUBLE/(4*pi())), 1.5::DOUBLE), 6) AS radius FROM part")(lambda s, d: rounded(fx.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), ge.sphere_radius(F.col("p_size").cast("double"), 1.5).alias("radius"))))
query("fan_triangulate", "SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(0 AS BIGINT) AS face_id, CAST(k AS BIGINT) AS k, CAST(0 AS BIGINT) AS i0, CAST(k + 1 AS BIGINT) AS i1, CAST(k + 2 AS BIGINT) AS i2 FROM (SELECT p_partkey, unnest(range(p_partkey % 6)) AS k FROM part)")(
    lambda s, d: me.fan_triangulate(fx.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("object_id"), F.lit(0).cast("long").alias("face_id"), F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 6 + 1).alias("ring")))
)


@query("mesh_vertex_distance", f"WITH {BOXES} SELECT {PAIR}, round(CASE WHEN {A_HOLDS_B} THEN least(" + ", ".join(f"b.l{c} - a.l{c}, a.h{c} - b.h{c}" for c in "xyz") + f") ELSE 0 END, 5) AS distance FROM BA a JOIN BB b ON {A_HOLDS_B}")
def mesh_vertex_distance(spark, sf_dir):
    """Least distance of either mesh's vertices to the other's surface; for a cube within a cube, the least gap of their faces."""
    a, b = both(spark, sf_dir)
    pairs = jo.containment(a, b, CELL)
    points = lambda t, s: me.template_vertices(t).select(F.col("object_id").alias(f"{s}_object_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    d = g.point_tri_distance(g.vec("p"), g.vec("a"), g.vec("b"), g.vec("c"))
    one = pairs.join(points(centers_b(spark, sf_dir), "b"), "b_object_id").join(a.triangles.withColumnRenamed("object_id", "a_object_id"), "a_object_id").select("a_object_id", "b_object_id", d.alias("d"))
    two = pairs.join(points(centers_a(spark, sf_dir), "a"), "a_object_id").join(b.triangles.withColumnRenamed("object_id", "b_object_id"), "b_object_id").select("a_object_id", "b_object_id", d.alias("d"))
    return rounded(one.unionByName(two).groupBy("a_object_id", "b_object_id").agg(F.min("d").alias("distance")), 5)


# Quality and repair.


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of A, some faces dirtied by their object's number."""
    vertices = me.template_vertices(centers_a(spark, sf_dir))
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("face_id"), F.array(*[F.lit(i).cast("long") for i in f]).alias("ring")) for n, f in enumerate(me.BOX_FACES)])
    faces = centers_a(spark, sf_dir).select("object_id", F.explode(rows).alias("f")).select("object_id", "f.*")
    k, first = F.col("object_id"), F.col("face_id") == 0
    ring = (
        F.when(first & (k % 10 == 1), F.array(*[F.lit(x).cast("long") for x in (0, 2, 99)]))
        .when(first & (k % 10 == 2), F.array(*[F.lit(x).cast("long") for x in (0, 2)]))
        .when(first & (k % 10 == 3), F.array(*[F.lit(x).cast("long") for x in (0, 2, 2)]))
        .when(first & (k % 10 == 4), F.array(*[F.lit(x).cast("long") for x in (0, 3, 2, 1)]))
        .when(first & (k % 10 == 5), F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)]))
        .otherwise(F.col("ring"))
    )
    return vertices, faces.withColumn("ring", ring)


_K = "p_partkey % 10"
query("obj_validate", f"SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(8 AS BIGINT) AS n_vertices, CAST(12 AS BIGINT) AS n_faces, CAST({_K} IN (2, 4) AS BIGINT) AS non_triangles, CAST({_K} = 1 AS BIGINT) AS bad_indices, CAST(0 AS BIGINT) AS isolated_vertices, {_K} NOT IN (1, 2, 4) AS valid FROM part")(lambda s, d: re_.validate(*_indexed(s, d)))
query("off_repair", f"SELECT reason, CAST(count(*) AS BIGINT) AS faces FROM (SELECT 'bad_index' AS reason FROM part WHERE {_K} = 1 UNION ALL SELECT 'short' FROM part WHERE {_K} = 2 UNION ALL SELECT 'repeated' FROM part WHERE {_K} = 3 UNION ALL SELECT 'edge_used' FROM part WHERE {_K} = 4 UNION ALL SELECT 'edge_used' FROM part, (SELECT unnest(range(3))) WHERE {_K} = 5) GROUP BY reason")(lambda s, d: re_.repair(*_indexed(s, d))[1])
query("convert_batch", f"SELECT CAST(k AS BIGINT) AS obj_id, CASE WHEN p_partkey IS NULL THEN 'missing_obj' WHEN {_K} IN (1, 2, 4) THEN 'validator_rejected' ELSE 'ok' END AS reason, p_partkey IS NOT NULL AND {_K} NOT IN (1, 2, 4) AS success FROM (SELECT unnest(range(3000)) AS k) LEFT JOIN part ON p_partkey = k")(lambda s, d: re_.convert_report(s.range(3000).withColumnRenamed("id", "obj_id"), re_.validate(*_indexed(s, d))).select("obj_id", "reason", F.coalesce("success", F.lit(False)).alias("success")))
query("sink_summary_csv", f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p_partkey IS NULL THEN 'missing_obj' WHEN {_K} IN (1, 2, 4) THEN 'validator_rejected' ELSE 'ok' END AS reason FROM (SELECT unnest(range(3000)) AS k) LEFT JOIN part ON p_partkey = k) GROUP BY reason")(lambda s, d: re_.convert_report(s.range(3000).withColumnRenamed("id", "obj_id"), re_.validate(*_indexed(s, d)), re_.repair(*_indexed(s, d))[0]).groupBy("reason").agg(F.count("*").alias("n")))
query("obj_parse_tokens", "SELECT CAST(p_partkey AS BIGINT) AS id, [p_partkey - 1, p_partkey, p_partkey + 1]::VARCHAR AS ring FROM part")(
    lambda s, d: fx.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.array(F.col("p_partkey").cast("string"), F.concat((F.col("p_partkey") + 1).cast("string"), F.lit("/7")), F.concat((F.col("p_partkey") + 2).cast("string"), F.lit("//9"))).alias("t")).select("id", F.concat(F.lit("["), F.array_join(re_.parse_face_tokens(F.col("t")).cast("array<string>"), ", "), F.lit("]")).alias("ring"))
)

# Levels of detail, samples, voxels.

query("sample_points_tri", "SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(12*15 AS BIGINT) AS points FROM part")(lambda s, d: de.sample_points(A(s, d), 4).groupBy("object_id").agg(F.count("*").alias("points")))
query("sampling_gap", f"WITH {BOXES} SELECT id AS object_id, round(6*s*s/(12*30), 6) AS gap FROM BA")(lambda s, d: rounded(de.sampling_gap(A(s, d))))


def _shrunken(spark, sf_dir):
    """Facets of A against A shrunk by half about its centres: corners are the furthest."""

    def told(m):
        # written, because the values look at the triangles many times: the driver's plan would have their making as often
        here = exchanged(written(m.triangles, "facets"))
        return de.facet_hausdorff(here, exchanged(written(me.mesh_shrink(here, 2.0), "shrunken")), 2)

    return jo.of_shapes({"object_id": cubes_a(spark, sf_dir)}, told)


_TERM = "sqrt(s*s/60/2)"  # half the diagonal of a sample's area: 6 s^2 / (12 x 30), halved
_FAR = f"round(sqrt(3*power(s/4, 2)) + {_TERM}, 4)"
query("hausdorff", f"WITH {BOXES} SELECT id AS object_id, CAST(t AS BIGINT) AS facet, {_FAR} AS hausdorff, round(s/4 + {_TERM}, 4) AS most_proxy FROM BA, (SELECT unnest(range(12)) AS t)")(
    lambda s, d: rounded(_shrunken(s, d).select("object_id", "facet", "hausdorff", F.max("proxy").over(Window.partitionBy("object_id")).alias("most_proxy")), 4)
)
query("hausdorff_global", f"WITH {BOXES} SELECT id AS object_id, {_FAR} AS min_hausdorff, {_FAR} AS avg_hausdorff, {_FAR} AS max_hausdorff FROM BA")(lambda s, d: rounded(de.hausdorff_global(_shrunken(s, d)), 4))
query("hausdorff_quantize", f"WITH {BOXES} SELECT id AS object_id, CAST(t AS BIGINT) AS facet, CAST(ceil((t + 1)*s/(12*s)*127) AS INT) AS code FROM BA, (SELECT unnest(range(12)) AS t)")(
    lambda s, d: de.hausdorff_quantize(A(s, d).join(centers_a(s, d).select("object_id", "s"), "object_id").select("object_id", F.col("tri_id").alias("facet"), ((F.col("tri_id") + 1) * F.col("s")).alias("hausdorff")))
)


def _rod(spark, sf_dir):
    """Ten vertices in a row for each part, s apart."""
    return centers_a(spark, sf_dir).select("object_id", "s", "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("object_id", F.col("k").cast("long").alias("vertex_id"), (F.col("x") + F.col("k") * F.col("s")).alias("x"), "y", "z")


def _poles(spark, sf_dir):
    """Two seeds for each cube: the middles of its bottom and of its top."""
    ends = F.array(*[F.struct(F.lit(i).cast("long").alias("seed"), (F.col("z") + F.lit(k) * F.col("s") / 2).alias("sz")) for i, k in enumerate((-1.0, 1.0))])
    return centers_a(spark, sf_dir).select("object_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(ends).alias("e")).select("object_id", "sx", "sy", "e.*")


# of the two seeds 0 and 5, the first round gives 0..2 and 3..9, the second 0..3 and 4..9
query("skeleton_points", f"WITH {BOXES} SELECT id AS object_id, CAST(k AS BIGINT) AS seed, round(x + CASE WHEN k = 0 THEN 1.5 ELSE 6.5 END*s, 5) AS sx, round(y, 5) AS sy, round(z, 5) AS sz FROM BA, (SELECT unnest([0, 5]) AS k)")(lambda s, d: rounded(de.skeleton_points(_rod(s, d), 5), 5))
query("voxels_skeleton", f"WITH {BOXES} SELECT id AS object_id, CAST(k AS BIGINT) AS voxel_id, {', '.join(f'round({c}, 5) AS {c}' for c in BOX)}, CAST(6 AS BIGINT) AS n_tri FROM BA, (SELECT unnest([0, 1]) AS k)")(lambda s, d: rounded(de.voxels_by_seed(A(s, d), _poles(s, d)), 5))
query("voxelize", "SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(56 AS BIGINT) AS cells FROM part")(lambda s, d: jo.of_shapes({"object_id": cubes_a(s, d)}, lambda m: de.voxelize_mesh(m, 5, 4)).groupBy("object_id").agg(F.count("*").alias("cells")))
query("fill_voxels", "SELECT CAST(p_partkey AS BIGINT) AS object_id, CAST(t AS BIGINT) AS tri_id, CAST(v AS BIGINT) AS voxel_id FROM part, (VALUES " + ", ".join(f"({n}, {f[0]})" for n, f in enumerate(me.BOX_FACES)) + ") AS f(t, v)")(
    lambda s, d: de.fill_voxels(A(s, d), me.template_vertices(centers_a(s, d)).select("object_id", F.col("vertex_id").alias("seed"), *[F.col(c).alias(f"s{c}") for c in "xyz"]))
)
query("profile_distance", "SELECT CAST(lod AS INT) AS lod, round(avg(p_size*(100 - lod)/100.0::DOUBLE), 6) AS mean_distance FROM part, (SELECT unnest(range(10, 101, 10)) AS lod) GROUP BY lod")(lambda s, d: rounded(de.profile_distance(fx.table(s, d, "part").select("p_size", F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10))).alias("lod")).select("lod", (F.col("p_size") * (100 - F.col("lod")) / F.lit(100.0)).alias("distance")))))
_BALL = ge.octasphere(2)
_CELL_OF = lambda v: ", ".join(f"floor(({c} + s*t{v}{c})/2.0::DOUBLE) AS k{v}{c}" for c in "xyz")
_APART = lambda u, w: "(" + " OR ".join(f"k{u}{c} <> k{w}{c}" for c in "xyz") + ")"
query("lod_cluster", f"WITH {BOXES}, T AS (SELECT id, {', '.join(map(_CELL_OF, 'abc'))} FROM A, (VALUES " + ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" for p in f for x in p) + ")" for f in _BALL) + f") AS t({', '.join('t' + c for c in TRIANGLE)})) SELECT id AS object_id, count(*) AS triangles FROM T WHERE {_APART('a', 'b')} AND {_APART('b', 'c')} AND {_APART('c', 'a')} GROUP BY id")(
    lambda s, d: de.cluster_simplify(ge.place_template(centers_a(s, d), _BALL), 2.0).groupBy("object_id").agg(F.count("*").alias("triangles"))
)

# Generators.

query("gen_cubes", "SELECT CAST(count(*) AS BIGINT) AS cubes, TRUE AS inside FROM range(5000)")(lambda s, d: ge.gen_cubes(s, 5000, 100.0, 1.0, 2.0).agg(F.count("*").alias("cubes"), F.bool_and(F.greatest("x", "y", "z").between(0, 100) & F.col("s").between(1, 2)).alias("inside")))
query("universe_for_selectivity", "SELECT CAST(p_partkey AS BIGINT) AS id, round(2*p_size/cbrt(0.001::DOUBLE), 4) AS extent FROM part")(lambda s, d: rounded(fx.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.lit(2.0) * F.col("p_size") / F.lit(0.001 ** (1 / 3))).alias("extent")), 4))
query("verify_selectivity", f"SELECT CAST(count(*) AS BIGINT) AS pairs, round(count(*)/((SELECT count(*) FROM part)*(SELECT count(*) FROM customer))::DOUBLE, 9) AS selectivity FROM ({OVERLAP})")(lambda s, d: rounded(ge.verify_selectivity(*(t := [m.objects for m in both(s, d)]), jo.box_pairs(*t, CELL)), 9))
query("reservoir_sample", "SELECT CAST(least(count(*), 50) AS BIGINT) AS rows FROM part")(lambda s, d: ge.reservoir_sample(centers_a(s, d), "object_id", 50).agg(F.count("*").alias("rows")))
query("gen_spheres", "SELECT CAST(i AS BIGINT) AS object_id, CAST(32 AS BIGINT) AS triangles, TRUE AS closed FROM range(100) t(i)")(lambda s, d: (t := ge.gen_spheres(s, 100, 1.0, 5.0, 5e-4)) and t.groupBy("object_id").agg(F.count("*").alias("triangles")).join(me.mesh_is_closed(t), "object_id"))
query("gen_tissue", "SELECT CAST(count(*) AS BIGINT) AS nuclei FROM (SELECT row_number() OVER (ORDER BY i) - 1 AS k FROM range(1000) t(i) WHERE i NOT IN (SELECT p_partkey % 1000 FROM part WHERE p_partkey % 7 = 0)), (SELECT (1000 - count(DISTINCT p_partkey % 1000))//50 AS gap FROM part WHERE p_partkey % 7 = 0) WHERE k % (gap + 1) = gap")(
    lambda s, d: ge.gen_tissue(s, 10, fx.table(s, d, "part").where("p_partkey % 7 = 0").select((F.col("p_partkey") % 1000).alias("slot")), 50, 3.0).agg(F.count("*").alias("nuclei"))
)
query("gen_nuclei_random", "SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS inside FROM range(200)")(lambda s, d: ge.gen_nuclei_random(s, 200, (10.0, 20.0, 30.0), 2.0).agg(F.count("*").alias("n"), F.bool_and(F.col("x").between(0, 20) & F.col("y").between(0, 40) & F.col("z").between(0, 60)).alias("inside")))
query("selectivity_sweep", "SELECT CAST(i AS BIGINT) AS step, round(0.0001::DOUBLE + i/9.0::DOUBLE*0.0099::DOUBLE, 9) AS sigma FROM range(10) t(i)")(lambda s, d: rounded(ge.selectivity_sweep(s, 1e-4, 1e-2, 10), 9))
query("alternating_split", "SELECT CAST(c_custkey AS BIGINT) AS object_id, CASE WHEN (row_number() OVER (ORDER BY c_custkey) - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM customer")(lambda s, d: ge.alternating_split(centers_b(s, d), "object_id").select("object_id", "side"))
query("aggregate_meshes", "SELECT CAST(12*((SELECT count(*) FROM part) + (SELECT count(*) FROM customer)) AS BIGINT) AS triangles, CAST((SELECT count(*) FROM part) + (SELECT count(*) FROM customer) AS BIGINT) AS objects")(lambda s, d: ge.aggregate_meshes([A(s, d), B(s, d)]).agg(F.count("*").alias("triangles"), F.count_distinct("object_id").alias("objects")))
query("nucleus_proxy", f"WITH {BOXES} SELECT id AS object_id, CAST(32 AS BIGINT) AS triangles FROM BA WHERE id % 3 = 0 AND x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 50 AND z BETWEEN 0 AND 50")(
    lambda s, d: ge.nucleus_proxies(centers_a(s, d).select(F.col("object_id").alias("nucleus_id"), (F.col("object_id") % 3).alias("root_id"), "x", "y", "z", F.col("s").alias("volume")), s.createDataFrame([(0,)], "root_id long"), (0, 0, 0, 50, 50, 50), 0.5).groupBy("object_id").agg(F.count("*").alias("triangles"))
)

# Benchmark analytics over the event log.

_PHASES = ["Selectivity Estimation", "RayTrace_Hash_Mesh1ToMesh2", "Raytrace_hash_mesh2tomesh1", "Download Results", "Compact_hash_table_pairs", "Upload"]
_EV = "EV AS (SELECT CAST(event_id AS BIGINT) AS seq, CAST(user_id % 20 AS BIGINT) AS run, (['" + "', '".join(_PHASES) + "'])[CAST(event_id % 6 AS INT) + 1] AS name, CAST(event_id % 997 AS BIGINT) * 10 AS us FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _PHASES])
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("seq"), (F.col("user_id") % 20).cast("long").alias("run"), F.get(names, (F.col("event_id") % 6).cast("int")).alias("name"), ((F.col("event_id") % 997) * 10).cast("long").alias("us"))


def _rolled(spark, sf_dir):
    return an.phase_rollup(an.timing_phases(_events(spark, sf_dir)).select("run", "phase", F.col("duration_ms").alias("ms")))


_ROLL = f"{_EV}, RO AS (SELECT run, lower(name) AS phase, sum(us)/1000.0::DOUBLE AS ms FROM EV GROUP BY 1, 2)"
@query("sink_timing_json", f"WITH {_EV} SELECT run, lower(name) || '_' || row_number() OVER (PARTITION BY run, lower(name) ORDER BY seq) AS phase, us AS duration_us, round(us/1000.0::DOUBLE, 6) AS duration_ms, CAST(sum(us) OVER (PARTITION BY run) AS BIGINT) AS total_us FROM EV")
def sink_timing_json(spark, sf_dir):
    """A report for each run, written as JSON lines and read back."""
    path = _folder(spark, "timing")
    sinks.timing_reports(an.timing_phases(_events(spark, sf_dir))).write.text(path)
    kind = "run long, phases map<string,struct<duration_us:long,duration_ms:double>>, counters map<string,long>, total struct<duration_us:long,duration_ms:double>"
    read = spark.read.schema(kind).json(path)
    return rounded(read.select("run", F.col("total.duration_us").alias("total_us"), F.explode("phases").alias("phase", "d")).select("run", "phase", "d.*", "total_us"))


query("phase_rollup", f"WITH {_ROLL} SELECT run, phase, round(ms, 4) AS ms FROM RO")(lambda s, d: rounded(_rolled(s, d), 4))
query("phase_query_time", f"WITH {_ROLL} SELECT run, round(sum(CASE WHEN phase <> 'upload' THEN ms ELSE 0 END), 4) AS query_ms FROM RO GROUP BY run")(lambda s, d: rounded(an.query_time(_rolled(s, d)), 4))
query("run_stats", f"WITH {_ROLL} SELECT phase, round(avg(ms), 4) AS mean, round(min(ms), 4) AS min, round(max(ms), 4) AS max, round(stddev_pop(ms), 4) AS std, CAST(count(*) AS BIGINT) AS runs FROM RO GROUP BY phase")(lambda s, d: rounded(an.run_stats(_rolled(s, d), ["phase"], "ms"), 4))
query("breakdown_groups", f"""WITH {_ROLL} SELECT run, "group", round(sum(ms), 4) AS ms FROM (SELECT run, ms, CASE phase {' '.join(f"WHEN '{p}' THEN '{n}'" for n, ps in an.GROUPS for p in ps)} END AS "group" FROM RO) WHERE "group" IS NOT NULL GROUP BY 1, 2 HAVING sum(ms) > 0""")(lambda s, d: rounded(an.breakdown_groups(_rolled(s, d)), 4))
query("latest_complete_run", f"WITH {_EV}, V AS (SELECT seq % 4 AS series, run, lower(name) AS metric, max(us) AS value FROM EV GROUP BY 1, 2, 3), L AS (SELECT series, max(run) AS run FROM (SELECT series, run FROM V WHERE metric IN ('upload', 'download results') GROUP BY 1, 2 HAVING count(DISTINCT metric) = 2) GROUP BY 1) SELECT V.* FROM V JOIN L USING (series, run)")(
    lambda s, d: an.latest_complete_run(_events(s, d).groupBy((F.col("seq") % 4).alias("series"), "run", F.lower("name").alias("metric")).agg(F.max("us").alias("value")), ["upload", "download results"])
)
query("dataset_table", "SELECT 'A' AS dataset, CAST(count(*) AS BIGINT) AS objects, CAST(12*count(*) AS BIGINT) AS triangles, CAST(12*36*count(*) AS BIGINT) AS bytes, 'A & ' || count(*) || ' & ' || 12*count(*) AS label FROM part UNION ALL SELECT 'B', count(*), 12*count(*), 12*36*count(*), 'B & ' || count(*) || ' & ' || 12*count(*) FROM customer")(
    lambda s, d: an.dataset_table(A(s, d).select(F.lit("A").alias("dataset"), "object_id").unionByName(B(s, d).select(F.lit("B").alias("dataset"), "object_id")))
)
query("speedup", f"WITH {_ROLL} SELECT u.run AS key, round(u.ms/nullif(v.ms, 0), 6) AS speedup FROM RO u JOIN RO v ON u.run = v.run AND u.phase = 'upload' AND v.phase = 'download results'")(lambda s, d: rounded(an.speedup(_rolled(s, d).select(F.col("run").alias("key"), F.col("phase").alias("mode"), "ms"), "upload", "download results")))
query("store_metrics", "SELECT CAST(p_partkey AS BIGINT) AS run, round(p_size*1000.0::DOUBLE, 4) AS total_ms, round(p_size + 0.5::DOUBLE, 4) AS index_ms, 3.0::DOUBLE AS decode_ms, 4.0::DOUBLE AS prepare_ms, 500.0::DOUBLE AS compute_ms, 6.0::DOUBLE AS evaluate_ms, 7.0::DOUBLE AS other_ms, round(p_size + 506.5::DOUBLE, 4) AS query_ms, round(p_size + 7.5::DOUBLE, 4) AS preprocessing_ms FROM part")(
    lambda s, d: rounded(an.store_metrics(fx.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("run"), F.concat(F.lit("total: "), F.col("p_size").cast("string"), F.lit(" s\nindex: "), F.col("p_size").cast("string"), F.lit(".5 ms\ndecode: 3 ms\npacking: 4 ms\ncomputation: 0.5 s\nupdatelist: 6\nother: 7 ms\n")).alias("text"))), 4)
)

# Sources and sinks: written to a fresh folder and read back.


def _folder(spark: SparkSession, what: str) -> str:
    return new_folder(spark, what)


def _faces(spark: SparkSession, sf_dir: str, side=centers_a) -> tuple[DataFrame, DataFrame]:
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("tri_id"), *[F.lit(i).cast("long").alias(c) for i, c in zip(f, ("i0", "i1", "i2"), strict=True)]) for n, f in enumerate(me.BOX_FACES)])
    return me.template_vertices(side(spark, sf_dir)), side(spark, sf_dir).select("object_id", F.explode(rows).alias("f")).select("object_id", "f.*")


TRI_OF = lambda key: f"WITH {BOXES}, {triangles_sql('A')}, O AS (SELECT id, row_number() OVER (ORDER BY {key}) - 1 AS n FROM A) SELECT CAST(n AS BIGINT) AS object_id, tri_id, " + ", ".join(f'round(t{c}, 5) AS "{c}"' for c in TRIANGLE) + " FROM TA JOIN O ON O.id = TA.object_id"


@query("scan_obj", TRI_OF("id"))
def scan_obj(spark, sf_dir):
    path = _folder(spark, "obj")
    sinks.write_obj(*_faces(spark, sf_dir), path)
    return rounded(sources.read_obj(spark, path), 5)


@query("scan_dispatch", TRI_OF("id"))
def scan_dispatch(spark, sf_dir):
    path = _folder(spark, "dataset") + ".OBJ"
    sinks.write_obj(*_faces(spark, sf_dir), path)
    return rounded(sources.load(spark, path), 5)


@query("scan_off_lines", TRI_OF("id"))
def scan_off_lines(spark, sf_dir):
    path = _folder(spark, "off")
    sinks.off_blocks(*_faces(spark, sf_dir), line="|").coalesce(1).sortWithinPartitions("object_id").select("text").write.text(path)
    return rounded(sources.read_off_lines(spark, path), 5)


@query("scan_off", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f'round(t{c}, 5) AS "{c}"' for c in TRIANGLE) + " FROM TA")
def scan_off(spark, sf_dir):
    """OFF text of every object, parsed from the table that holds it."""
    points, faces = sources.text.off_tables(sinks.off_blocks(*_faces(spark, sf_dir)))
    ring = [F.get("ring", F.lit(i)).alias(f"i{i}") for i in range(3)]
    return rounded(me.faces_to_triangles(points, faces.select("object_id", F.col("face_id").alias("tri_id"), *ring)), 5)


def _write_pre(spark, sf_dir) -> str:
    path = _folder(spark, "pre")
    spark.range(1).write.parquet(path + "-made")  # makes the shared folder
    a = cubes_a(spark, sf_dir)
    sinks_path = path + ".pre"
    sources.write_pre(a.triangles, a.edges, me.grid_stats(a.objects, CELL), CELL, sinks_path)
    return sinks_path


query("scan_pre", f"WITH {BOXES}, {triangles_sql('A')} SELECT object_id, tri_id, " + ", ".join(f'round(t{c}, 3) AS "{c}"' for c in TRIANGLE) + " FROM TA")(lambda s, d: rounded(sources.read_pre(s, _write_pre(s, d)).triangles, 3))
query("sink_pre", f"WITH {BOXES} SELECT id AS object_id, CAST(18 AS BIGINT) AS edges FROM A")(lambda s, d: sources.read_pre(s, _write_pre(s, d)).edges.groupBy("object_id").agg(F.count("*").alias("edges")))
query("scan_require_edges", "SELECT CAST(18*count(*) AS BIGINT) AS edges FROM part")(lambda s, d: sources.require_edges(sources.read_pre(s, _write_pre(s, d))).edges.agg(F.count("*").alias("edges")))
query("scan_pre_grid", "SELECT CAST(count(*) AS BIGINT) AS centers FROM part")(lambda s, d: sources.read_pre(s, _write_pre(s, d)).grid.agg(F.sum("center_count").alias("centers")))


_NPZ = "(VALUES " + ", ".join("({}, {})".format(n, ", ".join(str(x) for i in f for x in me.BOX_CORNERS[i])) for n, f in enumerate(me.BOX_FACES)) + f") AS t(n, {', '.join('t' + c for c in TRIANGLE)})"


@query("scan_npz", "SELECT row_number() OVER (PARTITION BY n ORDER BY r_regionkey) - 1 AS object_id, CAST(n AS BIGINT) AS tri_id, " + ", ".join(f'(t{c} + r_regionkey)::DOUBLE AS "{c}"' for c in TRIANGLE) + f" FROM region, {_NPZ}")
def scan_npz(spark, sf_dir):
    """An archive for each region, and one that cannot be read."""
    import pyarrow.fs as pafs

    path = _folder(spark, "npz")
    spark.range(1).write.parquet(path + "-made")
    store, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(root, recursive=True)
    for (k,) in fx.table(spark, sf_dir, "region").select("r_regionkey").collect():  # five rows
        buffer = io.BytesIO()
        np.savez(buffer, vertices=np.array(me.BOX_CORNERS, dtype=np.float32) + k, faces=np.array(me.BOX_FACES))
        with store.open_output_stream(f"{root}/{k}.npz") as out:
            out.write(buffer.getvalue())
    with store.open_output_stream(f"{root}/x.npz") as out:
        out.write(b"not an archive")
    return sources.read_npz(spark, path)


def _text(rows: DataFrame, path: str) -> str:
    rows.write.text(path)
    return path


query("scan_wkt_polygon", "SELECT CAST(p_partkey AS BIGINT) AS size, CAST(4 AS INT) AS outer_points, CAST(1 AS INT) AS holes FROM part")(
    lambda s, d: sources.read_wkt_polygons(s, _text(fx.table(s, d, "part").select(F.format_string("POLYGON ((0 0, %d 0, %d %d, 0 %d, 0 0), (1 1, 2 1, 1 2, 1 1), (3 3, 4 4, 3 3))", *["p_partkey"] * 4).alias("v")), _folder(s, "wkt"))).select(F.element_at("outer", 2)["x"].cast("long").alias("size"), F.size("outer").alias("outer_points"), F.size("holes").alias("holes"))
)
query("scan_manifest", "SELECT 'mesh/' || p_partkey || '.obj' AS path FROM part WHERE p_partkey % 3 = 0")(lambda s, d: sources.read_manifest(s, _text(fx.table(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  mesh/"), F.col("p_partkey").cast("string"), F.lit(".obj "))).when(F.col("p_partkey") % 3 == 1, "# note").otherwise(" ").alias("v")), _folder(s, "manifest"))))
query("scan_ids", "SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey % 2 = 0")(lambda s, d: sources.read_ids(s, _text(fx.table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(" # seen"))).otherwise("# none").alias("v")), _folder(s, "ids"))))
query("scan_pairs", f"WITH {BOXES} SELECT {PAIR} FROM BA a JOIN BB b ON {MEET}")(lambda s, d: sources.read_pairs(s, _text(jo.candidates(*both(s, d), CELL).select(F.concat_ws("  ", F.col("a_object_id").cast("string"), F.col("b_object_id").cast("string")).alias("v")), _folder(s, "pairs"))))
query("scan_nucleus_csv", f"WITH {BOXES} SELECT id AS nucleus_id, id % 3 AS root_id, round(x*4, 5) AS x, round(y*4, 5) AS y, round(z*40, 5) AS z, s AS volume FROM A WHERE id % 5 <> 0")(
    lambda s, d: rounded(sources.read_nuclei(s, _text(centers_a(s, d).select(F.when(F.col("object_id") % 5 == 0, "bad,row").otherwise(F.concat_ws(",", F.col("object_id").cast("string"), F.lit("a"), F.lit("b"), (F.col("object_id") % 3).cast("string"), *[F.col(c).cast("string") for c in "xyzs"])).alias("v")), _folder(s, "nuclei"))), 5)
)


def _csv(spark, rows: DataFrame, writer, schema: str) -> DataFrame:
    path = _folder(spark, "csv")
    writer(rows, path)
    return spark.read.csv(path, header=True, schema=schema)


query("sink_pairs_csv", f"SELECT a_object_id AS object_id_mesh1, b_object_id AS object_id_mesh2 FROM ({OVERLAP})")(lambda s, d: _csv(s, jo.overlap(*both(s, d)), sinks.write_pairs_csv, "object_id_mesh1 long, object_id_mesh2 long"))
query("sink_intersection_csv", f"WITH {BOXES} SELECT {PAIR} FROM BA a JOIN BB b ON {MEET}")(lambda s, d: _csv(s, jo.intersection(*both(s, d), cell=CELL), sinks.write_csv, "a_object_id long, b_object_id long"))
query("sink_containment_csv", f"WITH {BOXES} SELECT {PAIR}, 'containment' AS pair_type FROM BA a JOIN BB b ON {A_HOLDS_B} UNION ALL SELECT *, 'overlap' FROM ({OVERLAP})")(lambda s, d: _csv(s, jo.containment(*both(s, d), CELL, include_overlap=True), sinks.write_csv, "a_object_id long, b_object_id long, pair_type string"))
query("sink_pair_hits_csv", ORACLES["pair_hit_tracking"])(lambda s, d: _csv(s, jo.pair_hits(*both(s, d), CELL), sinks.write_csv, "direction string, source_object_id long, target_object_id long, target_ray_hits long, final_pair boolean"))
query("sink_containment_tracking_csv", ORACLES["containment_tracking"])(lambda s, d: _csv(s, jo.containment_tracking(jo.pair_hits(*both(s, d), CELL)), sinks.write_csv, "direction string, source_object_id long, iterations long, candidate_count long, candidate_overflow_events long"))
_V = ", ".join(f"printf('v %.6f %.6f %.6f', x + {i}*s/2, y + {j}*s/2, z + {k}*s/2)" for i, j, k in me.BOX_CORNERS)
query("sink_obj", f"WITH {BOXES}, O AS (SELECT *, 8*(row_number() OVER (ORDER BY id) - 1) AS base FROM A) SELECT id AS object_id, concat_ws(chr(10), 'o object_' || id, {_V}, " + ", ".join("printf('f %d %d %d', " + ", ".join(f"CAST(base + {i + 1} AS BIGINT)" for i in f) + ")" for f in me.BOX_FACES) + ") AS text FROM O")(lambda s, d: sinks.obj_blocks(*_faces(s, d)))
_P = ", ".join(f"printf('%.6f %.6f %.6f', x + {i}*s/2, y + {j}*s/2, z + {k}*s/2)" for i, j, k in me.BOX_CORNERS)
_F = ", ".join(f"'3 {i} {j} {k}'" for i, j, k in me.BOX_FACES)
OFF = f"WITH {BOXES} SELECT id AS object_id, concat_ws(chr(10), 'OFF', '8 12 0', {_P}, {_F}) AS text FROM A"
query("sink_off", OFF)(lambda s, d: sinks.off_blocks(*_faces(s, d)))
query("obj_to_off", OFF)(lambda s, d: sinks.off_blocks(*(t := _faces(s, d))).join(re_.validate(t[0], t[1].select("object_id", F.col("tri_id").alias("face_id"), F.array("i0", "i1", "i2").alias("ring"))).where("valid").select("object_id"), "object_id"))
query("sink_off_boxes", OFF)(lambda s, d: sinks.off_boxes(cubes_a(s, d).objects))
query("sink_off_points", f"WITH {BOXES} SELECT concat_ws(chr(10), 'OFF', count(*) || ' 0 0', string_agg(printf('%.6f %.6f %.6f', x, y, z), chr(10) ORDER BY id)) AS text FROM A")(lambda s, d: sinks.off_points(centers_a(s, d), "object_id"))
_C = lambda f: ", ".join(f"printf('%.6f %.6f %.6f', x + {me.BOX_CORNERS[i][0]}*s/2, y + {me.BOX_CORNERS[i][1]}*s/2, z + {me.BOX_CORNERS[i][2]}*s/2)" for i in f)
query("sink_off_triangles", f"WITH {BOXES} SELECT id AS object_id, concat_ws(chr(10), 'OFF', '36 12 0', " + ", ".join(_C(f) for f in me.BOX_FACES) + ", " + ", ".join(f"'3 {3 * n} {3 * n + 1} {3 * n + 2}'" for n in range(12)) + ") AS text FROM A")(lambda s, d: sinks.off_triangles(A(s, d)))
WKT = "'POLYHEDRALSURFACE Z (' || concat_ws(',', " + ", ".join(f"'((' || concat_ws(',', {_C((*f, f[0]))}) || '))'" for f in me.BOX_FACES) + ") || ')'"
query("sink_wkt", f"WITH {BOXES} SELECT id AS object_id, {WKT} AS wkt FROM A")(lambda s, d: sinks.wkt(A(s, d)))
query("sink_sql", f"WITH {BOXES} SELECT 'INSERT INTO meshes(id, hausdorff, phausdorff, geom) VALUES (' || id || printf(',%.6f,0.000000,ST_GeomFromEWKT(''', s/4) || {WKT} || '''));' AS statement FROM A")(lambda s, d: sinks.sql_inserts(sinks.wkt(A(s, d)).join(centers_a(s, d).select("object_id", (F.col("s") / 4).alias("hausdorff"), F.lit(0.0).alias("phausdorff")), "object_id"), "meshes"))


@query("sink_levels", f"WITH {BOXES}, {triangles_sql('A')} SELECT CAST(lod AS INT) AS lod, object_id, tri_id, " + ", ".join(f'round(t{c}, 5) AS "{c}"' for c in TRIANGLE) + " FROM TA, (SELECT unnest([20, 60, 100]) AS lod)")
def sink_levels(spark, sf_dir):
    path = _folder(spark, "levels")
    sinks.write_levels(A(spark, sf_dir).withColumn("lod", F.explode(F.array(*[F.lit(x) for x in (20, 60, 100)]))), path)
    return rounded(spark.read.parquet(path), 5)


@query("stream_static_join", f"WITH {BOXES} SELECT {PAIR} FROM BA a JOIN BB b ON {MEET}")
def stream_static_join(spark, sf_dir):
    """Boxes of A as a stream of files, joined to B as they come."""
    folder, out, state = _folder(spark, "stream"), _folder(spark, "streamed"), _folder(spark, "state")
    boxes = cubes_a(spark, sf_dir).objects.select("object_id", *BOX)
    boxes.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = stream_candidates(stream, cubes_b(spark, sf_dir).objects.select("object_id", *BOX), CELL)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("a_object_id long, b_object_id long").parquet(out)
from . import extra  # noqa: E402,F401  (registers the rest)

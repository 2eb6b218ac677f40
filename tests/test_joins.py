"""Properties that every join has to keep, and small cases of the other operators."""

import pytest
from pyspark.sql import functions as F

from meshloom.operators import distance as di
from meshloom.operators import estimate as es
from meshloom.operators import generate as ge
from meshloom.operators import grid as gr
from meshloom.operators import joins as jo
from meshloom.operators import mesh as me
from meshloom.operators import repair as re_
from meshloom.plans import fixtures as fx
from meshloom.schema import BOX


@pytest.fixture(scope="module")
def sides(spark, sf):
    return me.Mesh(fx.cubes_a(spark, sf).triangles.cache()), me.Mesh(fx.cubes_b(spark, sf).triangles.cache())


def pairs(df):
    return {(r["a_object_id"], r["b_object_id"]) for r in df.collect()}


def test_symmetry_and_set_algebra(sides):
    a, b = sides
    over, inside = pairs(jo.overlap(a, b, cell=8.0)), pairs(jo.containment(a, b, 8.0))
    other, both = {(y, x) for x, y in pairs(jo.containment(b, a, 8.0))}, pairs(jo.intersection(a, b, cell=8.0))
    assert over == {(y, x) for x, y in pairs(jo.overlap(b, a, cell=8.0))}
    assert not over & inside
    assert both == over | inside | other


@pytest.mark.parametrize("cell", [1.5, 8.0, 40.0])
def test_cell_size_changes_nothing(sides, cell):
    a, b = sides
    assert pairs(jo.overlap(a, b, cell=cell)) == pairs(jo.overlap(a, b))


BOX_SCHEMA = "object_id long, lx double, ly double, lz double, hx double, hy double, hz double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *[float(v) for v in low], *[float(v) + s for v in low]) for i, low, s in rows], BOX_SCHEMA)


def test_boxes_of_all_sizes_by_brute_force(spark):
    """One box is 1,000 times as large as the others: it is placed in a few cells, and no pair is lost or told twice."""
    import random

    rng = random.Random(5)
    place = lambda: [rng.uniform(0, 200) for _ in range(3)]
    one = [(i, place(), rng.choice([0.0, 0.2, 0.2, 0.2, 3.0, 20.0])) for i in range(300)] + [(300, [0, 0, 0], 200.0)]
    two = [(i, place(), rng.choice([0.2, 0.2, 1.0, 50.0])) for i in range(300)]
    meet = lambda a, b: all(a[1][k] <= b[1][k] + b[2] and b[1][k] <= a[1][k] + a[2] for k in range(3))
    want = sorted((a[0], b[0]) for a in one for b in two if meet(a, b))
    a, b = boxes(spark, one), boxes(spark, two)
    for cell in (None, 0.3, 7.0, 500.0):
        assert sorted((r[0], r[1]) for r in jo.box_pairs(a, b, cell).select("a_object_id", "b_object_id").collect()) == want
    found = gr.censuses({"a": (a, BOX), "b": (b, BOX)})
    grid = gr.grid_for(found["a"], found["b"])
    assert gr.placed(a, BOX, grid, True).groupBy("object_id").count().agg(F.max("count")).first()[0] <= 64 * 10


def test_no_place_meets_nothing(spark):
    nan = float("nan")
    bad = spark.createDataFrame([(1, None, 0.0, 0.0, 1.0, 1.0, 1.0), (2, nan, 0.0, 0.0, nan, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], BOX_SCHEMA)
    assert pairs(jo.box_pairs(bad, bad)) == {(3, 3)}
    assert pairs(di.knn_candidates(bad, bad, 2)) == {(3, 3)}


def test_large_meshes_in_bounded_rows(spark):
    """Two spheres of 8,192 triangles: edges meet the triangles of near clusters only, not all of the other's."""
    faces = ge.octasphere(5)
    ball = lambda x: me.Mesh(ge.place_template(spark.createDataFrame([(1, x, 0.0, 0.0, 1.0)], "object_id long, x double, y double, z double, s double"), faces))
    a, b, far, small = ball(0.0), ball(1.2), ball(3.0), me.Mesh(ge.place_template(spark.createDataFrame([(7, 0.1, 0.0, 0.0, 0.2)], "object_id long, x double, y double, z double, s double"), ge.octasphere(2)))
    assert pairs(jo.overlap(a, b)) == {(1, 1)}
    assert pairs(jo.overlap(a, far)) == pairs(jo.overlap(a, small)) == set()
    assert pairs(jo.containment(a, small)) == {(1, 7)}
    met = jo.cluster_pairs(a, b).join(a.clusters.selectExpr("cluster AS a_cluster", "n_tri AS n"), "a_cluster").join(b.clusters.selectExpr("cluster AS b_cluster", "n_tri AS m"), "b_cluster")
    assert met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] < len(faces) ** 2 / 10
    # two spheres of radius 1, centres 3 apart: the surfaces are 1 apart where the axis crosses them
    assert di.within(a, far, 1.1).first()["distance"] == pytest.approx(1.0, abs=1e-3)


def test_closed_is_one_shell(spark):
    """Two cubes under one id are closed each, but no one shell; the large way of telling gives the same."""
    centers = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0), (2, 5.0, 0.0, 0.0, 1.0), (3, 9.0, 0.0, 0.0, 1.0)], "object_id long, x double, y double, z double, s double")
    t = me.cube_mesh(centers).withColumn("tri_id", F.when(F.col("ax") > 4, F.col("tri_id") + 12).otherwise(F.col("tri_id"))).where("object_id <> 3 OR tri_id <> 15")
    want = {1: True, 2: False, 3: False}
    assert {r["object_id"]: r["closed"] for r in me.mesh_is_closed(t).collect()} == want
    most, me.LOCAL_TRIANGLES = me.LOCAL_TRIANGLES, 5
    try:
        assert {r["object_id"]: r["closed"] for r in me.mesh_is_closed(t).collect()} == want
    finally:
        me.LOCAL_TRIANGLES = most


def test_two_pass_places_are_gapless(sides):
    a, b = sides
    offsets, found = jo.overlap_two_pass(a, b)
    places = sorted(r["place"] for r in found.select("place").collect())
    assert places == list(range(len(places)))
    assert offsets.agg(F.sum("hits")).first()[0] == len(places)
    assert pairs(found) == pairs(jo.overlap(a, b))


def test_translation_and_scale(sides):
    a, b = sides
    moved = [me.Mesh(me.rescale_units(me.mesh_shift(m.triangles, -300.0, 7.0, 1000.0), 0.125)) for m in (a, b)]
    assert pairs(jo.overlap(*moved)) == pairs(jo.overlap(a, b))


def test_octahedra_by_edges_and_by_triangles(spark, sf):
    a, b = fx.octahedra(spark, sf, "a"), fx.octahedra(spark, sf, "b")
    assert pairs(jo.overlap(a, b)) == pairs(di.face_join(a, b))


def test_directions_are_checked(sides):
    with pytest.raises(ValueError, match="direction"):
        jo.overlap(*sides, direction="sideways")


def test_empty_side(spark, sides):
    a, _ = sides
    none = me.Mesh(a.triangles.limit(0))
    assert jo.overlap(a, none, cell=8.0).count() == jo.containment(none, a, 8.0).count() == 0


def test_knn_of_itself(sides):
    a, _ = sides
    found = di.knn(a, a, 1, exclude_self=True)
    assert found.count() == a.objects.count()
    assert found.where("a_object_id = b_object_id").count() == 0


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(-50, 1000, 3)], "k long, v long")
    total = 0
    for r in sorted(jo.prefix_sums(rows, "k", [], "v", parts=9).collect(), key=lambda r: r["k"]):
        assert r["offset"] == total
        total += r["v"]


def test_pack_and_unpack(spark):
    ids = [(0, 0), (1, 2), (2**31 - 1, 2**31 - 1), (2**31, 2**32 - 1), (2**32 - 1, 0)]
    packed = lambda rows: jo.pack_pairs(spark.createDataFrame(rows, "a_object_id long, b_object_id long"))
    assert pairs(jo.unpack_pairs(packed(ids))) == set(ids)
    for wrong in [(2**40, 2**40 + 5), (2**32, 1), (-1, 1)]:
        with pytest.raises(Exception, match="does not fit"):
            packed([wrong]).collect()


def test_repair_is_greedy_in_order(spark):
    vertices = spark.createDataFrame([(1, i, 0.0, 0.0, 0.0) for i in range(5)], "object_id long, vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(1, 0, [0, 1, 2]), (1, 1, [0, 1, 3]), (1, 2, [2, 1, 3, 4]), (1, 3, [0, 9, 1]), (1, 4, [0, 1]), (1, 5, [3, 3, 1])], "object_id long, face_id long, ring array<long>")
    kept, dropped = re_.repair(vertices, faces)
    assert {(r["i0"], r["i1"], r["i2"]) for r in kept.collect()} == {(0, 1, 2), (2, 1, 3), (2, 3, 4)}
    assert {r["reason"]: r["faces"] for r in dropped.collect()} == {"edge_used": 1, "bad_index": 1, "short": 1, "repeated": 1}


def test_estimates_and_sizes(spark):
    grid = spark.createDataFrame([], "ix long, iy long, iz long, center_count long, touch_count long, avg_size_mean double, vol_ratio double")
    row = es.estimate_pairs(grid, grid, 8.0).first()
    assert (row["raw"], row["estimated_pairs"]) == (0.0, 0)
    assert es.hash_table_size(10**12, join="containment") == (1 << 29) | 1
    assert es.hash_table_size(None) == 1 << 24
    assert es.hash_table_size(5, manual=7) == 7


def test_generators(spark):
    assert ge.universe_for_selectivity(2.0, 0.001) == pytest.approx(40.0)
    a = ge.gen_cubes(spark, 50, 10, 1, 2, seed=1)
    assert a.exceptAll(ge.gen_cubes(spark, 50, 10, 1, 2, seed=1)).count() == 0
    assert a.join(ge.gen_cubes(spark, 50, 10, 1, 2, seed=2), ["x", "y", "z"]).count() == 0
    assert len(ge.octasphere(2)) == 128


def test_sort_partition_is_even(spark):
    boxes = ge.gen_cubes(spark, 640, 100, 1, 2).select("object_id", *[(F.col(c) - F.col("s") / 2).alias(f"l{c}") for c in "xyz"], *[(F.col(c) + F.col("s") / 2).alias(f"h{c}") for c in "xyz"])
    sizes = [r["n"] for r in di.sort_partition(boxes, 4).groupBy("px", "py", "pz").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 64
    assert sum(sizes) == 640
    assert max(sizes) - min(sizes) <= 2


def test_copies_are_told_once_and_given_to_all(spark, monkeypatch):
    places = [(n, 7.0 * (n % 3), 0.1 * (n % 3), 0.0, 4.0) for n in range(12)]
    a = me.Mesh(me.cube_mesh(spark.createDataFrame([*places, (50, 7.0, 0.1, 0.0, 9.0)], "object_id long, x double, y double, z double, s double")))
    b = me.Mesh(me.cube_mesh(spark.createDataFrame([(n, x + 0.53, y + 0.57, z + 0.59, s - n % 2 * 3.5) for n, x, y, z, s in places], "object_id long, x double, y double, z double, s double")))
    assert a.counts == (13, 4) and b.counts == (12, 6)
    asked, edge_hits = [], jo.edge_hits
    monkeypatch.setattr(jo, "edge_hits", lambda a, b, *args, **more: (asked.append((a.objects.count(), b.objects.count())), edge_hits(a, b, *args, **more))[1])

    def told():
        found = [jo.overlap(a, b), jo.overlap(a, b, "a_to_b", max_hits_per_edge=1), jo.intersection(a, b), jo.containment(a, b), jo.point_in_mesh(a, b), jo.edge_hit_counts(a, b), jo.duplication(a, b)]
        return [sorted(map(tuple, x.collect())) for x in found]

    by_shape = told()
    assert asked and set(asked) == {(4, 6)}
    monkeypatch.setattr(me.Mesh, "copied", False)
    assert by_shape == told() and all(by_shape)


def test_shapes_are_told_apart(spark):
    rows = [(n, 0, *corners) for n, corners in enumerate([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, None), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, None, 1.0), (0.0, 0.0, -0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])]
    schema = "object_id long, tri_id long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")
    twice = [(5, *rows[0][1:]), (5, *rows[0][1:])]
    assert sorted(map(tuple, me.Mesh(spark.createDataFrame(rows + twice, schema)).members.collect())) == [(0, 0), (1, 1), (2, 2), (3, 0), (5, 5)]

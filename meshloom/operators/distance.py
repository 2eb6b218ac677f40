"""Joins by distance: within, nearest neighbours, triangle joins, and their indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.kernels import tri_tri_distance, tri_tri_intersects
from ..schema import BOX, TRIANGLE
from ..storage import exchanged, written
from .clusters import clustered
from .detail import facet_hausdorff
from .grid import censuses, grid_for, grid_join, is_box, number
from .joins import box_pairs, by_shape, cluster_pairs, names_of, sent_if_small, side_box
from .mesh import Mesh


#: Steps a side at which facets are sampled for Hausdorff values: samples are then no further apart than the term that is added for what lies between.
HAUSDORFF_STEPS = 7


def box_pairs_within(a: DataFrame, b: DataFrame, d: float, cell: float | None = None) -> DataFrame:
    """Pairs of (object_id, box) rows at most ``d`` apart, with their gap and the largest distance of their points."""
    side = lambda t, s: t.selectExpr(f"object_id AS {s}_object_id", *[f"{c} AS {s}_{c}" for c in BOX])
    x, y = side_box("a"), side_box("b")
    # a little more, so that boxes exactly d apart are not lost to rounding
    wider = [f"(a_{c} {'-' if c[0] == 'l' else '+'} {number(d * (1 + 1e-12))})" for c in BOX]
    near = grid_join(side(a, "a"), side(b, "b"), wider, names_of("b"), cell=cell)
    return near.withColumn("gap", g.box_gap(x, y)).withColumn("reach", g.box_reach(x, y)).where(F.col("gap") <= d)


def _corners(s: str) -> list[g.Vec]:
    return [g.vec(f"{s}{v}") for v in "abc"]


def _coordinates() -> list[Column]:
    return [F.col(f"{s}{c}") for s in "ab" for c in TRIANGLE]


def _measured(a: Mesh, b: Mesh, pairs: DataFrame, bound: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distances ``d`` of those triangle pairs that can be the nearest of their objects, for distances up to ``bound``.

    In two steps: clusters of triangles first, of which a pair is kept if its gap is
    no more than the least upper bound that any pair of clusters gives; then the
    triangles of these clusters, by object and cluster. With n triangles each, that
    is n pairs of clusters, not n * n pairs of triangles. ``extra``: columns of the
    triangles that are kept.
    """
    (ta, ca), (tb, cb) = clustered(a.triangles, a.objects), clustered(b.triangles, b.objects)
    part = lambda c, s: exchanged(c).select(F.col("object_id").alias(f"{s}_object_id"), F.col("cluster").alias(f"{s}_cluster"), *[F.col(x).alias(f"{s}k_{x}") for x in BOX])
    x, y = tuple(F.col(f"ak_{c}") for c in BOX), tuple(F.col(f"bk_{c}") for c in BOX)
    both = pairs.select("a_object_id", "b_object_id", bound.cast("double").alias("_bound")).join(part(ca, "a"), "a_object_id").join(part(cb, "b"), "b_object_id")
    # a little more, so that rounding loses nothing
    both = both.withColumn("_gap", g.box_gap(x, y)).withColumn("_least", F.least("_bound", F.min(g.box_reach(x, y)).over(Window.partitionBy("a_object_id", "b_object_id"))) * F.lit(1 + 1e-12) + F.lit(1e-300))
    kept = both.where(F.col("_gap") <= F.col("_least")).select("a_object_id", "b_object_id", "a_cluster", "b_cluster", "_least", *[f"bk_{c}" for c in BOX])
    mine = lambda t, s: exchanged(t).select(F.col("object_id").alias(f"{s}_object_id"), F.col("cluster").alias(f"{s}_cluster"), F.col("tri_id").alias(f"{s}_tri_id"), *[F.col(c).alias(f"{s}{c}") for c in TRIANGLE], *[F.col(c).alias(f"{s}_{c}") for c in extra])
    left = kept.join(mine(ta, "a"), ["a_object_id", "a_cluster"]).where(g.box_gap(g.tri_box(*_corners("a")), y) <= F.col("_least")).drop(*[f"bk_{c}" for c in BOX])
    rows = left.join(mine(tb, "b"), ["b_object_id", "b_cluster"]).where(g.box_gap(g.tri_box(*_corners("a")), g.tri_box(*_corners("b"))) <= F.col("_least"))
    return rows.withColumn("d", tri_tri_distance(*_coordinates()))


def mesh_distances(a: Mesh, b: Mesh, pairs: DataFrame, bound: Column) -> DataFrame:
    """(a, b, distance, nearest triangles) of candidate pairs, for distances up to ``bound``."""
    rows = _measured(a, b, pairs, bound)
    return rows.groupBy("a_object_id", "b_object_id").agg(F.min("d").alias("distance"), F.min_by(F.struct("a_tri_id", "b_tri_id"), F.struct("d", "a_tri_id", "b_tri_id")).alias("nearest")).select("a_object_id", "b_object_id", "distance", "nearest.*")


def mesh_distance_ranges(a: Mesh, b: Mesh, pairs: DataFrame) -> DataFrame:
    """(a, b, distance, min_dist, max_dist) of pairs of coarse meshes, whose triangles have ``hausdorff`` and ``proxy`` (see ``detail``).

    The distance of the original meshes is no less than ``min_dist``, the least of
    d - proxy - proxy over triangle pairs (0, if that is less), and no more than
    ``max_dist``, the least of d + hausdorff + hausdorff. Triangle pairs further
    apart than the least upper bound and the largest values together decide nothing.
    """
    most = [m.triangles.agg(F.max("hausdorff"), F.max("proxy")).first() for m in (a, b)]
    slack = max((most[0][i] or 0.0) + (most[1][i] or 0.0) for i in range(2))
    (ta, ca), (tb, cb) = [(t.withColumn("_h", F.col("hausdorff")).withColumn("_p", F.col("proxy")), c) for t, c in (clustered(m.triangles, m.objects) for m in (a, b))]
    part = lambda c, s: exchanged(c).select(F.col("object_id").alias(f"{s}_object_id"), F.col("cluster").alias(f"{s}_cluster"), *[F.col(x).alias(f"{s}k_{x}") for x in BOX])
    x, y = tuple(F.col(f"ak_{c}") for c in BOX), tuple(F.col(f"bk_{c}") for c in BOX)
    both = pairs.select("a_object_id", "b_object_id").join(part(ca, "a"), "a_object_id").join(part(cb, "b"), "b_object_id")
    least = F.min(g.box_reach(x, y)).over(Window.partitionBy("a_object_id", "b_object_id")) + F.lit(float(slack) * (1 + 1e-9) + 1e-300)
    kept = both.withColumn("_gap", g.box_gap(x, y)).withColumn("_least", least).where(F.col("_gap") <= F.col("_least")).select("a_object_id", "b_object_id", "a_cluster", "b_cluster", "_least")
    mine = lambda t, s: exchanged(t).select(F.col("object_id").alias(f"{s}_object_id"), F.col("cluster").alias(f"{s}_cluster"), F.col("_h").alias(f"{s}_h"), F.col("_p").alias(f"{s}_p"), *[F.col(c).alias(f"{s}{c}") for c in TRIANGLE])
    rows = kept.join(mine(ta, "a"), ["a_object_id", "a_cluster"]).join(mine(tb, "b"), ["b_object_id", "b_cluster"])
    rows = rows.where(g.box_gap(g.tri_box(*_corners("a")), g.tri_box(*_corners("b"))) <= F.col("_least")).withColumn("d", tri_tri_distance(*_coordinates()))
    low, high = F.greatest(F.lit(0.0), F.col("d") - F.col("a_p") - F.col("b_p")), F.col("d") + F.col("a_h") + F.col("b_h")
    return rows.groupBy("a_object_id", "b_object_id").agg(F.min("d").alias("distance"), F.min(low).alias("min_dist"), F.min(high).alias("max_dist"))


def progressive_within(a: dict[int, DataFrame], b: dict[int, DataFrame], pairs: DataFrame, d: float) -> DataFrame:
    """(a, b, within, lod): whether the surfaces of candidate pairs are at most ``d`` apart, and at which level that was decided.

    ``a`` and ``b`` have the triangles of the same levels, the last of which is the
    original. A level tells a range of distances from Hausdorff values; pairs whose
    range is on one side of ``d`` leave, and only the others come to the next level.
    The last level measures what is left. Values are 0 for an object whose level is
    the original.
    """
    *coarse, last = sorted(a)
    open_, told = written(pairs.select("a_object_id", "b_object_id").distinct(), "open"), None
    key = ["a_object_id", "b_object_id"]
    valued = _level_values((a, b), open_) if coarse else None
    for lod in coarse:
        if open_.isEmpty():
            break
        sides = [Mesh(exchanged(valued.where(f"side = {n} AND lod = {lod}").drop("side", "lod"))) for n in range(2)]
        ranges = mesh_distance_ranges(*sides, open_)
        decided = F.when(F.col("max_dist") <= d, True).when(F.col("min_dist") > d, False)
        done = written(ranges.select(*key, decided.alias("within"), F.lit(lod).alias("lod")).where("within is not null"), "decided")
        told = done if told is None else told.unionByName(done)
        open_ = written(exchanged(open_).join(done, key, "left_anti"), "open")
    exact = within(Mesh(a[last]), Mesh(b[last]), d, pairs=open_).select(*key, F.lit(True).alias("met"))
    rest = open_.join(exact, key, "left").select(*key, F.coalesce("met", F.lit(False)).alias("within"), F.lit(last).alias("lod"))
    return rest if told is None else told.unionByName(rest)


def _level_values(sides: tuple[dict[int, DataFrame], dict[int, DataFrame]], pairs: DataFrame) -> DataFrame:
    """(side, lod, object_id, tri_id, corners, hausdorff, proxy) of all coarse levels of the objects of the pairs, written: an object is measured against its original once, however many pairs ask."""
    *coarse, last = sorted(sides[0])
    here = full = None
    for n, (levels, name) in enumerate(zip(sides, ("a_object_id", "b_object_id"), strict=True)):
        wanted = exchanged(written(pairs.select(F.col(name).alias("object_id")).distinct(), "wanted"))
        mine = lambda t, *more: exchanged(t).join(wanted, "object_id", "left_semi").select(F.lit(n).alias("side"), *more, F.col("object_id").alias("id"), "tri_id", *TRIANGLE)  # noqa: B023, E731
        for lod in coarse:
            rows = mine(levels[lod], F.lit(lod).alias("lod"))
            here = rows if here is None else here.unionByName(rows)
        full = mine(levels[last]) if full is None else full.unionByName(mine(levels[last]))
    # written, because the values look at either table several times: the plan would have its making as often
    here, full = exchanged(written(here, "wanted")), exchanged(written(full, "wanted"))
    alike = [F.count("*").alias("_n"), *[F.bit_xor(F.xxhash64(F.lit(k), "tri_id", *TRIANGLE)).alias(f"_h{k}") for k in range(2)]]
    whole = full.groupBy("side", "id").agg(*alike).withColumn("_whole", F.lit(True))
    same = here.groupBy("side", "lod", "id").agg(*alike).join(whole, ["side", "id", "_n", "_h0", "_h1"], "left")
    same = exchanged(written(same.select("side", "lod", "id", F.coalesce("_whole", F.lit(False)).alias("same")), "same"))
    one = F.struct("side", "id").alias("object_id")
    values = here.join(same.where("same"), ["side", "lod", "id"], "left_semi").select("side", "lod", F.col("id").alias("object_id"), "tri_id", *TRIANGLE, F.lit(0.0).alias("hausdorff"), F.lit(0.0).alias("proxy"))
    for lod in coarse:
        changed = same.where(f"NOT same AND lod = {lod}").select("side", "id")
        level, original = (exchanged(t.join(changed, ["side", "id"], "left_semi").select(one, "tri_id", *TRIANGLE)) for t in (here.where(f"lod = {lod}"), full))
        found = facet_hausdorff(level, original, HAUSDORFF_STEPS, sure=True).withColumnRenamed("facet", "tri_id")
        rows = level.join(exchanged(found), ["object_id", "tri_id"])
        # each level by itself, so that no plan has all of them
        values = values.unionByName(written(rows.select("object_id.side", F.lit(lod).alias("lod"), F.col("object_id.id").alias("object_id"), "tri_id", *TRIANGLE, "hausdorff", "proxy"), f"level{lod}"))
    return values


def within_by_levels(a: Mesh, b: Mesh, levels: Callable[[DataFrame], dict[int, DataFrame]], reach: float, d: float, cell: float | None = None) -> DataFrame:
    """``progressive_within`` of all objects whose boxes are at most ``reach`` apart; ``levels`` makes the levels of an object from its triangles alone."""

    def told(a: Mesh, b: Mesh) -> DataFrame:
        # written: the objects of each shape are looked at several times
        a, b = (Mesh(exchanged(written(m.triangles, "triangles"))) for m in (a, b))
        near = box_pairs_within(a.objects, b.objects, reach, cell)
        # levels of both sides are made together
        one = lambda m, n: m.triangles.select(F.struct(F.lit(n).alias("side"), F.col("object_id").alias("id")).alias("object_id"), "tri_id", *TRIANGLE)
        made = levels(exchanged(written(one(a, 0).unionByName(one(b, 1)), "triangles")))
        mine = lambda n: {lod: t.where(f"object_id.side = {n}").select(F.col("object_id.id").alias("object_id"), "tri_id", *TRIANGLE) for lod, t in made.items()}
        return progressive_within(mine(0), mine(1), near, d)

    return by_shape(a, b, told)


def within(a: Mesh, b: Mesh, d: float, cell: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs whose surfaces are at most ``d`` apart, with their distance. A mesh inside another is as far as its surface.

    ``pairs``: the candidates (a_object_id, b_object_id), if they are known.
    """
    pairs = box_pairs_within(a.objects, b.objects, d, cell) if pairs is None else pairs
    return mesh_distances(a, b, pairs, F.lit(float(d))).where(F.col("distance") <= d).select("a_object_id", "b_object_id", "distance")


def knn_candidates(a: DataFrame, b: DataFrame, k: int, cell: float | None = None, exclude_self: bool = False) -> DataFrame:
    """For each a, every b that can be among its k nearest: box gap at most the k-th smallest upper bound.

    The search radius starts at a cell and doubles for the objects that do not yet
    have k candidates with an upper bound within it; decided objects leave. Every
    round is an equi-join on cells, never on all pairs, and is written, so that
    plans do not grow with the rounds. Rows whose box is null, NaN or infinite are
    near nothing.
    """
    a, b = a.where(is_box(BOX)).select("object_id", *BOX), b.where(is_box(BOX)).select("object_id", *BOX)
    found = censuses({"a": (a, BOX), "b": (b, BOX)})
    most = min(k, found["b"].n - (1 if exclude_self else 0))
    grid = grid_for(found["a"], found["b"], cell)
    radius = float(cell or (grid.cell if grid else max(found["a"].mean, found["b"].mean, 1.0)))
    if most <= 0 or not found["a"].n:
        return box_pairs_within(a.limit(0), b.limit(0), radius, cell).withColumn("kth", F.lit(0.0))
    # no two points of both sides are further apart
    reach = sum((max(found["a"].high[i], found["b"].high[i]) - min(found["a"].low[i], found["b"].low[i])) ** 2 for i in range(3)) ** 0.5
    open_, d, told = a, radius, None
    while True:
        last = d >= reach
        near = box_pairs_within(open_, b, d, max(radius, d))
        if exclude_self:
            near = near.where("a_object_id <> b_object_id")
        w = Window.partitionBy("a_object_id").orderBy("reach", "b_object_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = near.withColumn("kth", F.nth_value("reach", most).over(w))
        done = written(rows.where((F.col("kth") <= F.lit(float("inf") if last else d)) & (F.col("gap") <= F.col("kth"))), "near")
        told = done if told is None else told.unionByName(done)
        if last:
            return told
        open_ = written(exchanged(open_).join(done.select(F.col("a_object_id").alias("object_id")).distinct(), "object_id", "left_anti"), "open")
        if open_.isEmpty():
            return told
        d *= 2


def knn(a: Mesh, b: Mesh, k: int = 1, cell: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The k nearest objects of b for each object of a, by true surface distance; ties by id."""
    pairs = knn_candidates(a.objects, b.objects, k, cell, exclude_self)
    exact = mesh_distances(a, b, pairs, F.col("kth"))
    rank = F.row_number().over(Window.partitionBy("a_object_id").orderBy("distance", "b_object_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("a_object_id", "b_object_id", "distance", F.col("rank").cast("long").alias("rank"))


def self_join(mesh: Mesh, join, **options) -> DataFrame:
    """A join of a dataset with itself, no object with itself."""
    return join(mesh, mesh, **options).where("a_object_id <> b_object_id")


def face_join(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Pairs of objects of which some triangles meet, borders and coplanar faces included."""
    return by_shape(a, b, lambda a, b: _face_join(a, b, cell))


def _face_join(a: Mesh, b: Mesh, cell: float | None) -> DataFrame:
    box = lambda s: [f"{f}({', '.join(f'{s}{v}{c}' for v in 'abc')})" for f in ("least", "greatest") for c in "xyz"]
    meet = lambda x, y: " AND ".join(f"{x[i]} <= {y[i + 3]} AND {y[i]} <= {x[i + 3]}" for i in range(3))
    size = lambda m: m.census["cluster"].weight
    side = lambda m, s: sent_if_small(m.faces.selectExpr(f"object_id AS {s}_object_id", f"cluster AS {s}_cluster", *[f"{c} AS {s}{c}" for c in TRIANGLE]), size(m))
    pairs = cluster_pairs(a, b, cell)
    near = pairs.join(side(a, "a"), ["a_object_id", "a_cluster"]).where(meet(box("a"), names_of("b"))).drop(*names_of("a"), *names_of("b"), "a_cluster")
    met = near.join(side(b, "b"), ["b_object_id", "b_cluster"]).where(meet(box("a"), box("b")))
    return met.where(tri_tri_intersects(*_coordinates())).select("a_object_id", "b_object_id").distinct()


def touch_candidates(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    return box_pairs(a.objects, b.objects, cell).select("a_object_id", "b_object_id")


def touch_join(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Filter by boxes, refine by triangles; only the number of pairs is told."""
    return face_join(a, b, cell).agg(F.count("*").alias("pairs"))


def pairs_evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """True and false positives, false negatives, precision and recall (0 when empty) of a pair list."""
    key = ["a_object_id", "b_object_id"]
    both = predicted.distinct().withColumn("p", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), key, "full")
    counts = both.agg(F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    share = lambda other: F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0)), F.lit(0.0))
    return counts.select("tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))


def false_positives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return predicted.distinct().join(truth, ["a_object_id", "b_object_id"], "left_anti")


def voxel_pair_candidates(pairs: DataFrame, va: DataFrame, vb: DataFrame) -> DataFrame:
    """Voxel pairs of candidate objects with their distance range; those beyond the least upper bound of their objects are pruned.

    An object's voxels come in one row, so that a pair's are told apart where the pair is.
    """
    side = lambda v, s: exchanged(v.groupBy(F.col("object_id").alias(f"{s}_object_id")).agg(F.collect_list(F.struct("voxel_id", *BOX)).alias(f"_{s}")))
    rows = pairs.select("a_object_id", "b_object_id").join(side(va, "a"), "a_object_id").join(side(vb, "b"), "b_object_id")
    box = lambda v: tuple(v[c] for c in BOX)
    least = F.array_min(F.transform("_a", lambda u: F.array_min(F.transform("_b", lambda v: g.box_reach(box(u), box(v))))))
    rows = rows.select("a_object_id", "b_object_id", "_b", least.alias("least"), F.explode("_a").alias("u")).select("a_object_id", "b_object_id", "least", "u", F.explode("_b").alias("v"))
    x, y = box(F.col("u")), box(F.col("v"))
    rows = rows.select("a_object_id", "b_object_id", F.col("u.voxel_id").alias("a_voxel_id"), F.col("v.voxel_id").alias("b_voxel_id"), "least", g.box_gap(x, y).alias("mindist"), g.box_reach(x, y).alias("maxdist"))
    return rows.where(F.col("mindist") <= F.col("least")).drop("least")


def sort_partition(boxes: DataFrame, cuts: int) -> DataFrame:
    """Slices of boxes along x, then y, then z, by their low corners: ``cuts`` in each direction, of equal counts (but for one).

    Rows are numbered along x by running sums over ranges, within a slice along y and
    within that along z in the same way, so no task ever sorts more than a range.
    Ties go by object_id.
    """
    rows, keys = boxes, []
    for axis in "xyz":
        rows = _ntiles(rows, keys, f"l{axis}", cuts).withColumnRenamed("_tile", f"p{axis}")
        keys.append(f"p{axis}")
    return rows


def _ntiles(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """``_tile`` 1..n of each row within its group ``keys`` (of which there are few): as ``ntile``, with larger tiles first."""
    from .joins import prefix_sums

    first, *more = [*keys, order, "object_id"]
    numbered = prefix_sums(rows.withColumn("_one", F.lit(1)), first, more, "_one").drop("_one")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, "_n", F.coalesce(F.sum("_n").over(Window.orderBy(*keys or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    joined = numbered.join(F.broadcast(before), keys) if keys else numbered.crossJoin(F.broadcast(before))  # a row for each slice
    at, big, whole = F.col("offset") - F.col("_start"), F.pmod(F.col("_n"), F.lit(n)), F.floor(F.col("_n") / n)
    tile = F.when(at < big * (whole + 1), F.floor(at / (whole + 1))).otherwise(big + F.floor((at - big * (whole + 1)) / F.greatest(whole, F.lit(1))))
    return joined.withColumn("_tile", (tile + 1).cast("int")).drop("offset", "_n", "_start")


def str_tree(boxes: DataFrame, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """A tree over boxes, packed by their centres: leaves (object_id, leaf) and nodes (level, node, parent, box).

    Objects are sliced along x, y and z so that a leaf has up to ``fanout`` of them
    (about: slices are of equal counts); every level above merges as many
    neighbouring nodes in the order of the slices. Level 0 holds the leaves, the
    highest one node, whose parent is null.
    """
    total = boxes.count()
    leaves = max(1, -(-total // fanout))
    sx = max(1, round(leaves ** (1 / 3) + 0.4999))
    sy = max(1, round((leaves / sx) ** 0.5 + 0.4999))
    sz = max(1, -(-leaves // (sx * sy)))
    center = [((F.col(BOX[i]) + F.col(BOX[i + 3])) / 2).alias(f"c{c}") for i, c in enumerate("xyz")]
    rows, keys = boxes.select("object_id", *BOX, *center), []
    for axis, n in zip("xyz", (sx, sy, sz), strict=True):
        rows = _ntiles(rows, keys, f"c{axis}", n).withColumnRenamed("_tile", f"p{axis}")
        keys.append(f"p{axis}")
    leaf = ((F.col("px") - 1) * sy + F.col("py") - 1) * sz + F.col("pz") - 1
    rows = written(rows.select("object_id", *BOX, leaf.cast("long").alias("node")), "leaves")
    around = [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in BOX]
    nodes, level, tree = rows.groupBy("node").agg(*around), 0, None
    while True:
        nodes = written(nodes, "nodes")  # a level has half as many as the one below
        top = nodes.agg(F.max("node")).first()[0]
        last = not top
        told = nodes.select(F.lit(level).alias("level"), "node", (F.lit(None).cast("long") if last else F.floor(F.col("node") / fanout)).alias("parent"), *BOX)
        tree = told if tree is None else tree.unionByName(told)
        if last:
            return rows.select("object_id", F.col("node").alias("leaf")), tree
        nodes = nodes.withColumn("node", F.floor(F.col("node") / fanout)).groupBy("node").agg(*around)
        level += 1


def touch_assign(tree: DataFrame, boxes: DataFrame) -> DataFrame:
    """(object_id, level, node): each box goes down the tree while it meets exactly one child, and stays where it meets several, or in a leaf; a box that meets no child (or not the root) is assigned nowhere.

    A join of all open boxes with one level of nodes at a time, by their parent.
    """
    levels = tree.agg(F.max("level")).first()[0]
    if levels is None:
        return boxes.select("object_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node")).limit(0)
    named = lambda level: tree.where(F.col("level") == level).select(F.col("node").alias("_child"), F.col("parent").alias("_parent"), *[F.col(c).alias(f"n_{c}") for c in BOX])
    meets = g.box_overlaps_inclusive(g.box(), tuple(F.col(f"n_{c}") for c in BOX))
    # the root is one row
    open_ = boxes.where(is_box(BOX)).select("object_id", *BOX).crossJoin(F.broadcast(named(levels))).where(meets).select("object_id", *BOX, F.col("_child").alias("node"))
    done = None
    for level in range(levels, -1, -1):
        if not level:
            stay = open_.select("object_id", F.lit(level).alias("level"), "node")
        else:
            met = open_.join(named(level - 1), F.col("node") == F.col("_parent")).where(meets)
            counted = written(met.groupBy("object_id", "node", *BOX).agg(F.count("*").alias("n"), F.min("_child").alias("_child")), "assigned")
            stay = counted.where("n > 1").select("object_id", F.lit(level).alias("level"), "node")
            open_ = counted.where("n = 1").select("object_id", *BOX, F.col("_child").alias("node"))
        done = stay if done is None else done.unionByName(stay)
    return done


def region_filter(boxes: DataFrame, region: tuple[float, ...]) -> DataFrame:
    """Objects whose closed boxes meet a region (low corner, high corner)."""
    return boxes.where(g.box_overlaps_inclusive(g.box(), tuple(F.lit(float(x)) for x in region)))


def box_range_search(boxes: DataFrame, queries: DataFrame, cell: float | None = None) -> DataFrame:
    """What an R-tree is searched for: boxes that meet each query box."""
    return box_pairs(queries, boxes, cell).select(F.col("a_object_id").alias("query_id"), F.col("b_object_id").alias("object_id"))


def budget_limit(rows: DataFrame, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Rows in order until the sizes before reach the budget, and ``most`` at most."""
    from .joins import prefix_sums

    run = prefix_sums(rows, order, [], size).withColumnRenamed("offset", "_spent")
    return run.where(F.col("_spent") < budget).drop("_spent").orderBy(order).limit(most)


def voxel_ids(labels: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """The distinct labels of a volume but 0, in order."""
    found = labels.where(F.col(label) != 0).select(F.col(label).cast("long").alias("label")).distinct().orderBy("label")
    return found.limit(most) if most else found

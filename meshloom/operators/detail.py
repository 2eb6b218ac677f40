"""Levels of detail, surface samples, Hausdorff distances, skeletons and voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.kernels import point_tri_distance
from ..schema import BOX, TRIANGLE
from ..storage import exchanged, written
from .clusters import clustered, clustered_points, near_clusters
from .mesh import Mesh, objects


def sample_points(triangles: DataFrame, n: int, kept: Sequence[str] = ()) -> DataFrame:
    """Corners and a regular grid of n steps a side on every triangle: (object_id, tri_id, x, y, z), and the columns ``kept`` of the triangles."""
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n) - i), lambda j: F.struct((i / F.lit(float(n))).alias("u"), (j / F.lit(float(n))).alias("v")))))
    rows = exchanged(triangles.withColumn("_uv", F.explode(grid)))
    point = lambda c: F.col(f"a{c}") + F.col("_uv.u") * (F.col(f"b{c}") - F.col(f"a{c}")) + F.col("_uv.v") * (F.col(f"c{c}") - F.col(f"a{c}"))
    return rows.select("object_id", "tri_id", *[point(c).alias(c) for c in "xyz"], *kept)


def sampling_gap(triangles: DataFrame, rate: float = 30.0) -> DataFrame:
    """Area for each sample: the mesh's area over its triangles times the rate."""
    return triangles.groupBy("object_id").agg((F.sum(g.tri_area(g.vec("a"), g.vec("b"), g.vec("c"))) / (F.count("*") * F.lit(rate))).alias("gap"))


def cluster_simplify(triangles: DataFrame, cell: float) -> DataFrame:
    """A coarse level of detail: vertices of a cell become their mean, and triangles that collapse go."""
    corner = lambda v: F.struct(*[F.floor(F.col(f"{v}{c}") / F.lit(float(cell))).cast("long").alias(c) for c in "xyz"])
    rows = triangles.select("object_id", "tri_id", *[corner(v).alias(f"k{v}") for v in "abc"], *TRIANGLE)
    points = rows.select("object_id", F.explode(F.array(*[F.struct(F.col(f"k{v}").alias("k"), *[F.col(f"{v}{c}").alias(c) for c in "xyz"]) for v in "abc"])).alias("p")).select("object_id", "p.*").distinct().transform(exchanged)
    means = points.groupBy("object_id", "k").agg(*[F.avg(c).alias(c) for c in "xyz"])
    kept = rows.where((F.col("ka") != F.col("kb")) & (F.col("kb") != F.col("kc")) & (F.col("kc") != F.col("ka"))).select("object_id", "tri_id", "ka", "kb", "kc")
    for v in "abc":
        kept = kept.join(means.select("object_id", F.col("k").alias(f"k{v}"), *[F.col(c).alias(f"{v}{c}") for c in "xyz"]), ["object_id", f"k{v}"])
    return kept.select("object_id", "tri_id", *TRIANGLE)


def _nearest_facet(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(object_id, point columns, near_tri, d): the triangle of its object that is nearest to each point (px, py, pz), ties by number.

    Only triangles of clusters that can hold the nearest one are looked at.
    """
    faces, groups = clustered(triangles.select("object_id", "tri_id", *TRIANGLE), objects(triangles))
    keys = points.columns
    near = near_clusters(points, groups, ("px", "py", "pz")).join(exchanged(faces).withColumnRenamed("tri_id", "near_tri"), ["object_id", "cluster"])
    rows = near.withColumn("d", point_tri_distance("px", "py", "pz", *TRIANGLE))
    return rows.groupBy(*keys).agg(F.min("d").alias("d"), F.min_by("near_tri", F.struct("d", "near_tri")).alias("near_tri"))


def hausdorff(samples: DataFrame, triangles: DataFrame) -> DataFrame:
    """Per facet of the samples (object_id, tri_id, x, y, z): the largest distance of its samples to the object's other surface."""
    points = samples.select("object_id", F.col("tri_id").alias("facet"), *[F.col(c).alias(f"p{c}") for c in "xyz"]).distinct()
    return _nearest_facet(points, triangles).groupBy("object_id", "facet").agg(F.max("d").alias("hausdorff"))


def _between(steps: int) -> Column:
    """How far a place on a triangle can be from its nearest sample: samples cut it into small ones like itself, and a circle through corners of at most so long sides has no larger radius."""
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    return F.greatest(*[g.norm(g.sub(u, v)) for u, v in ((a, b), (b, c), (c, a))]) * F.lit((1 + 1e-9) / (steps * 3**0.5))


def facet_bounds(coarse: DataFrame, original: DataFrame, steps: int) -> DataFrame:
    """``facet_hausdorff`` with values that hold whatever the shapes and sizes of the triangles.

    On top of a sample's distance comes what lies between the samples of its own
    triangle, not of the mean one.
    """
    own = coarse.select("object_id", F.col("tri_id").alias("facet"), _between(steps).alias("_more"))
    one = exchanged(hausdorff(sample_points(coarse, steps), original)).join(exchanged(own), ["object_id", "facet"])
    back = sample_points(original.withColumn("_more", _between(steps)), steps, ["_more"]).select("object_id", "_more", *[F.col(c).alias(f"p{c}") for c in "xyz"]).distinct()
    two = _nearest_facet(back, coarse).groupBy("object_id", F.col("near_tri").alias("facet")).agg(F.max(F.col("d") + F.col("_more")).alias("proxy"))
    return exchanged(one).join(exchanged(two), ["object_id", "facet"], "left").select("object_id", "facet", (F.col("hausdorff") + F.col("_more")).alias("hausdorff"), F.coalesce("proxy", F.lit(0.0)).alias("proxy"))


def facet_hausdorff(coarse: DataFrame, original: DataFrame, steps: int = 4, rate: float = 30.0, sure: bool = False) -> DataFrame:
    """(object_id, facet, hausdorff, proxy) of every facet of a coarse level against the original.

    ``hausdorff``: the largest distance of the facet's samples to the original.
    ``proxy``: the largest distance of those samples of the original that are nearest
    to this facet; 0, if there are none. Both with the half diagonal of a sample's
    area, sqrt(gap / 2), on top, which no place between samples of a mean triangle
    exceeds; ``sure`` gives ``facet_bounds``.
    """
    if sure:
        return facet_bounds(coarse, original, steps)
    term = F.sqrt(F.col("gap") / 2)
    gaps = sampling_gap(coarse, rate)
    one = hausdorff(sample_points(coarse, steps), original)
    back = sample_points(original, steps).select("object_id", *[F.col(c).alias(f"p{c}") for c in "xyz"]).distinct()
    two = _nearest_facet(back, coarse).groupBy("object_id", F.col("near_tri").alias("facet")).agg(F.max("d").alias("proxy"))
    rows = exchanged(one).join(two, ["object_id", "facet"], "left").join(exchanged(gaps), "object_id")
    return rows.select("object_id", "facet", (F.col("hausdorff") + term).alias("hausdorff"), F.when(F.col("proxy").isNotNull(), F.col("proxy") + term).otherwise(F.lit(0.0)).alias("proxy"))


def hausdorff_global(facets: DataFrame) -> DataFrame:
    return facets.groupBy("object_id").agg(F.min("hausdorff").alias("min_hausdorff"), F.avg("hausdorff").alias("avg_hausdorff"), F.max("hausdorff").alias("max_hausdorff"))


def hausdorff_quantize(facets: DataFrame) -> DataFrame:
    """One byte for each facet: its share of the object's largest distance in 127 steps, rounded up."""
    most = facets.groupBy("object_id").agg(F.max("hausdorff").alias("_most"))
    return facets.join(most, "object_id").select("object_id", "facet", F.coalesce(F.ceil(F.col("hausdorff") / F.nullif(F.col("_most"), F.lit(0.0)) * 127), F.lit(0)).cast("int").alias("code"))


def _nearest(points: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """The seed (object_id, seed, sx, sy, sz) nearest to each point, ties by number; only seeds of clusters that can hold it are looked at."""
    held, groups = clustered_points(seeds.select("object_id", "seed", *[F.col(f"s{c}").alias(c) for c in "xyz"]))
    held = held.select("object_id", "cluster", "seed", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    d = sum(((F.col(c) - F.col(f"s{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return near_clusters(points, groups, ("x", "y", "z")).join(exchanged(held), ["object_id", "cluster"]).groupBy(*keys, "x", "y", "z").agg(F.min_by("seed", F.struct(d, F.col("seed"))).alias("seed"))


def skeleton_points(vertices: DataFrame, gap: int, rounds: int = 2) -> DataFrame:
    """Every gap-th vertex as a seed, moved to the mean of its nearest vertices in each round."""
    points = vertices.select("object_id", "vertex_id", "x", "y", "z")
    seeds = points.where(F.col("vertex_id") % gap == 0).select("object_id", F.col("vertex_id").alias("seed"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    for _ in range(rounds):
        seeds = _nearest(points, seeds, ["object_id", "vertex_id"]).groupBy("object_id", "seed").agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])
    return seeds


def facet_voxels(triangles: DataFrame, seeds: DataFrame) -> DataFrame:
    """(object_id, tri_id, voxel_id): the skeleton point nearest to each facet's barycentre."""
    mid = g.tri_barycenter(*[g.vec(v) for v in "abc"])
    points = triangles.select("object_id", "tri_id", *[x.alias(n) for x, n in zip(mid, "xyz", strict=True)])
    return _nearest(points, seeds, ["object_id", "tri_id"]).select("object_id", "tri_id", F.col("seed").alias("voxel_id"))


def voxels_by_seed(triangles: DataFrame, seeds: DataFrame) -> DataFrame:
    """Facets go to the nearest skeleton point; a voxel is the box around a point's facets. Points without facets have none."""
    box = g.tri_box(*[g.vec(v) for v in "abc"])
    return triangles.join(facet_voxels(triangles, seeds), ["object_id", "tri_id"]).groupBy("object_id", "voxel_id").agg(*[(F.min if n[0] == "l" else F.max)(x).alias(n) for x, n in zip(box, BOX, strict=True)], F.count("*").alias("n_tri"))


def voxelize(samples: DataFrame, boxes: DataFrame, steps: int) -> DataFrame:
    """The occupied cells of a grid of ``steps`` a side over each object's box, by its sampled points."""
    return _cells(samples.join(boxes.select("object_id", *BOX), "object_id"), steps)


def voxelize_mesh(mesh: Mesh, n: int, steps: int) -> DataFrame:
    """``voxelize`` of the samples of a mesh, n steps a side on every triangle, over its own boxes.

    Triangles get their box before they are sampled, so that samples never leave the
    task that made them.
    """
    own = exchanged(mesh.triangles).join(mesh.objects.select("object_id", *BOX), "object_id")
    return _cells(sample_points(own, n, BOX), steps)


def _cells(rows: DataFrame, steps: int) -> DataFrame:
    """The occupied cells of points with their object's box."""
    at = lambda i, c: F.least(F.lit(steps - 1), F.floor((F.col(c) - F.col(BOX[i])) / F.nullif(F.col(BOX[i + 3]) - F.col(BOX[i]), F.lit(0.0)) * steps).cast("int"))
    return rows.select("object_id", *[F.greatest(F.coalesce(at(i, c), F.lit(0)), F.lit(0)).alias(f"i{c}") for i, c in enumerate("xyz")]).distinct()


def fill_voxels(triangles: DataFrame, cores: DataFrame) -> DataFrame:
    """Each triangle's voxel: that of the core nearest to its first vertex."""
    points = triangles.select("object_id", "tri_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"))
    return _nearest(points, cores, ["object_id", "tri_id"]).select("object_id", "tri_id", F.col("seed").alias("voxel_id"))


def profile_distance(levels: DataFrame) -> DataFrame:
    """The mean distance of each level of detail, given (lod, distance)."""
    return levels.groupBy("lod").agg(F.avg("distance").alias("mean_distance"))


def progressive_decide(bounds: DataFrame, d: float) -> DataFrame:
    """Pairs decided level by level from (a, b, lod, low, high): the first level whose range is on one side of ``d``."""
    decided = F.when(F.col("high") <= d, True).when(F.col("low") > d, False)
    return bounds.withColumn("within", decided).where(F.col("within").isNotNull()).groupBy("a_object_id", "b_object_id").agg(F.min("lod").alias("lod"), F.min_by("within", "lod").alias("within"))


def levels_of(triangles: DataFrame, cells: dict[int, float], stored: bool = False) -> dict[int, DataFrame]:
    """Levels of detail by number, 100 the original: vertices are clustered with each level's cell; a level of an object without facets left is that of the next finer one.

    ``stored``: coarse levels are written, so that none is made again for each coarser one.
    """
    kept = (lambda df: exchanged(written(df, "level"))) if stored else (lambda df: df)
    out = {100: triangles}
    for lod in sorted(cells, reverse=True):
        finer = out[min(x for x in out if x > lod)]
        coarse = kept(cluster_simplify(triangles, cells[lod]))
        out[lod] = kept(coarse.unionByName(finer.select("object_id", "tri_id", *TRIANGLE).join(coarse.select("object_id").distinct(), "object_id", "left_anti")))
    return dict(sorted(out.items()))


def removal_error(rings: DataFrame) -> DataFrame:
    """(object_id, vertex_id, error) of taking out a vertex, given the polygon of its neighbours: (object_id, vertex_id, ring: array of x, y, z in order).

    The cube root of the volume between the polygon and the pyramid over its
    barycentre, times the number of corners, over the perimeter; 0 where the volume
    is not positive. The polygon's normal is that of its corners in order.
    """
    n = F.size("ring")
    nxt = lambda k: F.get("ring", (k + 1) % n)
    total = lambda f: F.aggregate(F.transform("ring", f), F.lit(0.0), lambda s, x: s + x)
    along = lambda c: lambda p: p[c]
    turn = lambda u, v: lambda p, k: (p[u] - nxt(k)[u]) * (p[v] + nxt(k)[v])
    rows = rings.where(n >= 3).select("*", *[(total(along(c)) / n).alias(f"_b{c}") for c in "xyz"])
    b = g.vec("_b")
    point = lambda p: tuple(p[c] for c in "xyz")
    # Newell's normal
    normal = [total(turn(u, v)) for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]
    rows = rows.select("*", *[x.alias(f"_n{c}") for x, c in zip(normal, "xyz", strict=True)], total(lambda p, k: g.norm(g.sub(point(nxt(k)), point(p)))).alias("_perimeter"), total(lambda p, k: g.tri_area(point(p), point(nxt(k)), b)).alias("_area"))
    size = F.nullif(g.norm(g.vec("_n")), F.lit(0.0))
    base = F.col("_area") * g.dot(b, g.scale(g.vec("_n"), F.lit(-1.0))) / size / 3
    # area times unit normal is half the cross product
    cone = total(lambda p, k: g.dot(point(p), g.tri_normal(point(p), point(nxt(k)), b)) / 6)
    volume = F.coalesce(base, F.lit(0.0)) + cone
    return rows.select("object_id", "vertex_id", F.when(volume > 0, F.cbrt(volume) * n / F.nullif(F.col("_perimeter"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("error"))


def violates_manifold(faces: DataFrame) -> DataFrame:
    """(object_id, vertex_id, violates): whether taking out a vertex would join two of its neighbours twice.

    ``faces`` is (object_id, face_id, ring: array of vertex numbers), a closed mesh.
    That is so where two neighbours of the vertex that follow each other around it are
    joined by an edge although the face between has more than three corners. (Two
    that do not follow each other may be joined: the patch has no edge there.)
    """
    ring, n = F.col("ring"), F.size("ring")
    corner = F.transform("ring", lambda v, k: F.struct(v.alias("v"), F.get(ring, (k + n - 1) % n).alias("before"), F.get(ring, (k + 1) % n).alias("after"), n.alias("degree")))
    corners = exchanged(faces).where(n >= 3).select("object_id", F.explode(corner).alias("c")).select("object_id", F.col("c.v").alias("vertex_id"), "c.before", "c.after", "c.degree")
    lows = lambda x, y: (F.least(x, y).alias("_lo"), F.greatest(x, y).alias("_hi"))
    joined = corners.select("object_id", *lows(F.col("vertex_id"), F.col("after"))).distinct().withColumn("_edge", F.lit(True))
    open_ = corners.where("degree > 3").select("object_id", "vertex_id", *lows(F.col("before"), F.col("after")))
    bad = open_.join(joined, ["object_id", "_lo", "_hi"], "left_semi").select("object_id", "vertex_id").distinct().withColumn("violates", F.lit(True))
    return corners.select("object_id", "vertex_id").distinct().join(bad, ["object_id", "vertex_id"], "left").select("object_id", "vertex_id", F.coalesce("violates", F.lit(False)).alias("violates"))


def object_boxes(triangles: DataFrame) -> DataFrame:
    return objects(triangles).select("object_id", *BOX)

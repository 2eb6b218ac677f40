"""Meshes as a bundle of lazy tables, and their preparation: edges, boxes, volumes, grid statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import BOX, EDGE, TRIANGLE
from ..storage import exchanged, written
from .components import components, solved
from .grid import Census, censuses, counted, named_box

#: Edges whose ends agree to this many units are one edge.
EDGE_GRID = 1e5
#: Shrinks the upper side of a box when its touched cells are counted.
TOUCH_EPSILON = 1e-5

#: Corner signs of a box mesh and its faces, outward; fixed values.
BOX_CORNERS = ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))
BOX_FACES = ((0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7))
#: An octahedron, likewise.
OCTA_CORNERS = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
OCTA_FACES = ((0, 4, 3), (3, 4, 1), (1, 4, 2), (2, 4, 0), (0, 3, 5), (3, 1, 5), (1, 2, 5), (2, 0, 5))


class Copies:
    """Objects told by the rows (object_id, …) of ``tables``, some of which may be copies of others."""

    @cached_property
    def members(self) -> DataFrame:
        """(object_id, shape) of all objects with an id, written; shape is the smallest id of the objects with the same rows, numbers included.

        Rows are the same if 128 bits of hashes are, whose halves are summed, so that no object has to meet in one task.
        """
        hashed = None
        for n, table in enumerate(self.tables):
            values = ", ".join(f"coalesce(`{c}`, cast('NaN' AS double))" if kind == "double" else f"`{c}`" for c, kind in table.dtypes if c != "object_id")  # a hash skips nulls
            rows = exchanged(table).where("object_id IS NOT NULL").selectExpr("object_id", *[f"xxhash64({2 * n + k}, {values}) AS _h{k}" for k in range(2)])
            hashed = rows if hashed is None else hashed.unionByName(rows)
        halves = [f"{part} AS _s{k}{i}" for k in range(2) for i, part in enumerate((f"sum(shiftrightunsigned(_h{k}, 32))", f"sum(_h{k} & 4294967295L)"))]
        told = written(hashed.groupBy("object_id").agg(F.expr("count(*) AS _n"), *map(F.expr, halves)), "shapes")
        same = [c for c in told.columns if c != "object_id"]
        least = told.groupBy(*same).agg(F.min("object_id").alias("shape"))
        return written(exchanged(told).join(least, same).select("object_id", "shape"), "members")

    @cached_property
    def counts(self) -> tuple[int, int]:
        """Objects with an id, and how many shapes they have."""
        return tuple(self.members.agg(F.expr("count(*)"), F.expr("count(CASE WHEN object_id = shape THEN 1 END)")).first())

    @property
    def copied(self) -> bool:
        """Whether so many objects are copies of others that it pays to ask for one of each shape."""
        return 0 < 2 * self.counts[1] <= self.counts[0]

    def ones_of(self, table: DataFrame) -> DataFrame:
        """The rows of one object of each shape, that of the smallest id."""
        return exchanged(table.join(exchanged(self.members.where("object_id = shape").select("object_id")), "object_id", "left_semi"))


@dataclass(frozen=True)
class Mesh(Copies):
    """A dataset of closed meshes: one row a triangle (object_id, tri_id, corners); the rest is derived when asked for."""

    triangles: DataFrame

    @cached_property
    def faces(self) -> DataFrame:
        """The triangles with their cluster."""
        return with_cluster(self.triangles)

    @cached_property
    def edges(self) -> DataFrame:
        return unique_edges(self.triangles)

    @cached_property
    def edge_set(self) -> DataFrame:
        """The edges without numbers, with the cluster of their first triangle: nothing has to meet by object to tell them."""
        return edge_set(self.faces).select("object_id", "cluster", *EDGE)

    @cached_property
    def objects(self) -> DataFrame:
        return objects(self.triangles)

    @cached_property
    def clusters(self) -> DataFrame:
        """(object_id, cluster, box, n_tri): some hundred neighbouring triangles of about the same size each, whatever the object's size."""
        around = [F.expr(f"{'min' if c[0] == 'l' else 'max'}({x}) AS {c}") for c, x in zip(BOX, TRI_BOX, strict=True)]
        return written(self.faces.groupBy("object_id", "cluster").agg(*around, F.expr("count(*) AS n_tri")), "clusters")

    @cached_property
    def boxes(self) -> DataFrame:
        """(object_id, box, first vertex), written once for all joins."""
        return written(self.objects.select("object_id", *BOX, "fx", "fy", "fz"), "boxes")

    @cached_property
    def box_census(self) -> Census:
        return censuses({"box": (self.boxes, BOX)})["box"]

    @cached_property
    def census(self) -> dict[str, Census]:
        """Censuses of the boxes of clusters, also as seen from above (``flat``); their weight is the number of triangles."""
        kinds = ["struct(" + ", ".join(named_box(name, box, "n_tri")) + ")" for name, box in (("cluster", BOX), ("flat", FLAT))]
        return counted(self.clusters.selectExpr(f"explode(array({', '.join(kinds)})) AS e").selectExpr("e.*"), {"cluster": 3, "flat": 2})

    @property
    def tables(self) -> tuple[DataFrame, ...]:
        return (self.triangles,)

    @cached_property
    def ones(self) -> Mesh:
        """One object of each shape, that of the smallest id."""
        return Mesh(self.ones_of(self.triangles))


@dataclass(frozen=True)
class Tables(Copies):
    """Objects told by several tables of rows (object_id, …); copies have the same rows in each."""

    tables: tuple[DataFrame, ...]

    @cached_property
    def ones(self) -> Tables:
        return Tables(tuple(map(self.ones_of, self.tables)))


#: Cells of clusters are two to this power times as large as the triangles in them.
CLUSTER_SPAN = 3
#: A box as seen from above.
FLAT = ("lx", "ly", "hx", "hy")
#: The box of a triangle and of an edge, as expressions.
TRI_BOX = tuple(f"{f}(a{c}, b{c}, c{c})" for f in ("least", "greatest") for c in "xyz")
EDGE_BOX = tuple(f"{f}(p{c}, q{c})" for f in ("least", "greatest") for c in "xyz")


def with_cluster(triangles: DataFrame) -> DataFrame:
    """Triangles with ``cluster``, a number of the cell that they lie in, of a grid for triangles of their size.

    That depends on the triangle alone. Cells with the same number by chance are one cluster, which is right too.
    """
    size = f"greatest(1e-300D, {', '.join(f'{TRI_BOX[i + 3]} - {TRI_BOX[i]}' for i in range(3))})"
    rows = triangles.selectExpr("*", f"pow(2D, ceil(log2({size})) + {CLUSTER_SPAN}) AS _span")
    middle = ", ".join(f"floor(({TRI_BOX[i]} + {TRI_BOX[i + 3]}) / 2 / _span)" for i in range(3))
    return exchanged(rows.selectExpr(*[f"`{c}`" for c in triangles.columns], f"xxhash64(_span, {middle}) AS cluster"))


def _placed_corner(signs) -> list[str]:
    """A corner of a template, as expressions over x, y, z and s."""
    return [f"{c} + {float(k)}D * s / 2" if k else f"cast({c} AS double)" for c, k in zip("xyz", signs, strict=True)]


def _listed(key: str, name: str, rows: list[list[str]], columns) -> str:
    """An explode of structs (key, columns)."""
    return f"explode(array({', '.join('struct(' + f'{n}L AS {key}, ' + ', '.join(f'{x} AS `{c}`' for x, c in zip(row, columns, strict=True)) + ')' for n, row in enumerate(rows))})) AS {name}"


def template_mesh(centers: DataFrame, corners=BOX_CORNERS, faces=BOX_FACES) -> DataFrame:
    """Triangles of a template around every (object_id, x, y, z, s): corners at half of s in each direction. No shuffle."""
    rows = [[x for i in face for x in _placed_corner(corners[i])] for face in faces]
    return exchanged(centers.selectExpr("object_id", _listed("tri_id", "t", rows, TRIANGLE)).selectExpr("object_id", "t.*"))


def cube_mesh(centers: DataFrame) -> DataFrame:
    return template_mesh(centers)


def template_vertices(centers: DataFrame, corners=BOX_CORNERS) -> DataFrame:
    """(object_id, vertex_id, x, y, z) of a template's corners."""
    return exchanged(centers.selectExpr("object_id", _listed("vertex_id", "v", [_placed_corner(c) for c in corners], "xyz")).selectExpr("object_id", "v.*"))


def box_mesh(boxes: DataFrame) -> DataFrame:
    """The twelve triangles of every (object_id, box)."""
    corners = [[BOX[i if k < 0 else i + 3] for i, k in enumerate(c)] for c in BOX_CORNERS]
    return boxes.selectExpr("object_id", _listed("tri_id", "t", [[x for i in face for x in corners[i]] for face in BOX_FACES], TRIANGLE)).selectExpr("object_id", "t.*").transform(exchanged)


def faces_to_triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles from indexed faces (object_id, tri_id, i0, i1, i2); faces with an index out of range are left out."""
    corner = lambda v, i: vertices.select("object_id", F.col("vertex_id").alias(f"i{i}"), *[F.col(c).alias(f"{v}{c}") for c in "xyz"])
    joined = faces
    for i, v in enumerate("abc"):
        joined = joined.join(corner(v, i), ["object_id", f"i{i}"])
    return joined.select("object_id", "tri_id", *TRIANGLE)


def _whole(x: str) -> str:
    """A coordinate in whole units of the edge grid, halves away from zero."""
    return f"CASE WHEN {x} < 0 THEN ceil({x} * {EDGE_GRID}D - 0.5D) ELSE floor({x} * {EDGE_GRID}D + 0.5D) END"


def _corner(v: str) -> str:
    """A corner in whole units."""
    return "struct(" + ", ".join(f"{_whole(v + c)} AS {c}" for c in "xyz") + ")"


#: Columns that name an edge within its object: both ends in whole units, the smaller first.
ENDS = tuple(f"{e}{c}" for e in ("lo_", "hi_") for c in "xyz")


def _half_edges(triangles: DataFrame) -> DataFrame:
    """The three sides of every triangle that have a length, with the columns ``ENDS`` and their place in the object."""
    side = lambda k, u, w: f"struct({k} AS k, " + ", ".join(f"{v}{c} AS {e}{c}" for v, e in ((u, "p"), (w, "q")) for c in "xyz") + ")"
    more = [c for c in ("cluster",) if c in triangles.columns]
    rows = triangles.selectExpr("object_id", "tri_id", *more, f"explode(array({side(0, 'a', 'b')}, {side(1, 'b', 'c')}, {side(2, 'c', 'a')})) AS e")
    rows = rows.selectExpr("object_id", *more, "tri_id * 3 + e.k AS place", *[f"e.{x} AS {x}" for x in EDGE])
    rows = rows.selectExpr("*", *[f"{_whole(e + c)} AS u{e}{c}" for e in "pq" for c in "xyz"])
    swap = "(uqx < upx OR (uqx = upx AND (uqy < upy OR (uqy = upy AND uqz < upz))))"
    rows = rows.where("upx <> uqx OR upy <> uqy OR upz <> uqz").selectExpr("*", f"{swap} AS turned")
    ends = [f"CASE WHEN turned THEN u{w}{c} ELSE u{v}{c} END AS {n}{c}" for n, v, w in (("lo_", "p", "q"), ("hi_", "q", "p")) for c in "xyz"]
    return exchanged(rows.selectExpr("object_id", *more, "place", *EDGE, *ends))


def edge_set(triangles: DataFrame) -> DataFrame:
    """The edges of every object once: ends agree if they round to the same 1e-5; the first occurrence's direction stays.

    One hash aggregate with partial sums: the edges of a large object are dealt to many tasks.
    """
    kept = [*EDGE, *[c for c in ("cluster",) if c in triangles.columns]]
    return _half_edges(triangles).groupBy("object_id", *ENDS).agg(*[F.expr(f"min_by({c}, place) AS {c}") for c in kept])


def unique_edges(triangles: DataFrame) -> DataFrame:
    """``edge_set`` with edges numbered by their ends within the object."""
    number = F.row_number().over(Window.partitionBy("object_id").orderBy(*ENDS)) - 1
    found = edge_set(triangles)
    return found.select("object_id", number.cast("long").alias("edge_id"), *EDGE, *[c for c in ("cluster",) if c in found.columns])


def objects(triangles: DataFrame) -> DataFrame:
    """(object_id, box, volume, vol_ratio, avg_size, first vertex, counts), in one aggregate.

    The volume is summed about each triangle's place relative to the object's first
    vertex after the box is known: sums of determinants are moved analytically, so
    no second pass over the triangles is needed.
    """
    side = lambda u, w: {c: f"({w}{c} - {u}{c})" for c in "xyz"}
    e, f = side("a", "b"), side("a", "c")
    normal = {c: f"({e[x]} * {f[y]} - {e[y]} * {f[x]})" for c, x, y in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    rows = exchanged(triangles).selectExpr("*", *[f"{normal[c]} AS _n{c}" for c in "xyz"])
    grouped = rows.groupBy("object_id").agg(
        *[F.expr(f"min(least(a{c}, b{c}, c{c})) AS l{c}") for c in "xyz"], *[F.expr(f"max(greatest(a{c}, b{c}, c{c})) AS h{c}") for c in "xyz"],
        # signed volume about a point o is a sum of (t - o).n: linear in o
        F.expr("sum(ax * _nx + ay * _ny + az * _nz) AS _v"), *[F.expr(f"sum(_n{c}) AS _n{c}") for c in "xyz"],
        *[F.expr(f"min_by(a{c}, tri_id) AS f{c}") for c in "xyz"], F.expr("count(*) AS n_tri"), F.expr("sum(0.5D * sqrt(_nx * _nx + _ny * _ny + _nz * _nz)) AS area"),
    )
    volume = "abs(_v - (lx + hx) / 2 * _nx - (ly + hy) / 2 * _ny - (lz + hz) / 2 * _nz) / 6"
    rows = grouped.selectExpr("*", f"{volume} AS volume")
    return rows.selectExpr("object_id", *BOX, "volume", "least(volume / greatest((hx - lx) * (hy - ly) * (hz - lz), 1e-9D), 1D) AS vol_ratio", "((hx - lx) + (hy - ly) + (hz - lz)) / 3 AS avg_size", "fx", "fy", "fz", "n_tri", "area")


def first_vertices(triangles: DataFrame) -> DataFrame:
    """The representative point of every object: the first corner of its first triangle."""
    return triangles.groupBy("object_id").agg(F.min("tri_id").alias("tri_id"), *[F.min_by(f"a{x}", "tri_id").alias(x) for x in "xyz"])


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def grid_stats(objs: DataFrame, cell_size: float) -> DataFrame:
    """Statistics of a sparse uniform grid: objects centred in a cell, objects touching it, and means over the latter.

    An object too thin to reach any cell touches the one of its low corner.
    """
    center = g.box_center(g.box())
    centers = objs.select(*[_cell(center[i], cell_size).alias(f"i{c}") for i, c in enumerate("xyz")]).groupBy("ix", "iy", "iz").agg(F.count("*").alias("center_count"))
    spans = [(_cell(F.col(BOX[i]), cell_size), _cell(F.col(BOX[i + 3]) - TOUCH_EPSILON, cell_size)) for i in range(3)]
    touched = objs.select("avg_size", "vol_ratio", *[F.sequence(lo, F.greatest(lo, hi)).alias(f"s{c}") for (lo, hi), c in zip(spans, "xyz", strict=True)])
    for c in "xyz":
        touched = touched.withColumn(f"i{c}", F.explode(f"s{c}")).drop(f"s{c}")
    touching = exchanged(touched).groupBy("ix", "iy", "iz").agg(F.count("*").alias("touch_count"), F.avg("avg_size").alias("avg_size_mean"), F.avg("vol_ratio").alias("vol_ratio"))
    return touching.join(centers, ["ix", "iy", "iz"], "full").select(
        "ix", "iy", "iz", F.coalesce("center_count", F.lit(0)).alias("center_count"), F.coalesce("touch_count", F.lit(0)).alias("touch_count"),
        F.coalesce("avg_size_mean", F.lit(0.0)).alias("avg_size_mean"), F.coalesce("vol_ratio", F.lit(0.0)).alias("vol_ratio"),
    )


def dataset_bbox(triangles: DataFrame) -> DataFrame:
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    return triangles.agg(*[F.min(F.least(a[i], b[i], c[i])).alias(BOX[i]) for i in range(3)], *[F.max(F.greatest(a[i], b[i], c[i])).alias(BOX[i + 3]) for i in range(3)])


def mesh_area(triangles: DataFrame) -> DataFrame:
    return triangles.groupBy("object_id").agg(F.sum(g.tri_area(g.vec("a"), g.vec("b"), g.vec("c"))).alias("area"))


def mesh_volume(triangles: DataFrame) -> DataFrame:
    """The signed volume: positive for outward faces."""
    return triangles.groupBy("object_id").agg((F.sum(g.signed_volume6(g.vec("a"), g.vec("b"), g.vec("c"))) / 6).alias("volume"))


def mesh_counts(triangles: DataFrame) -> DataFrame:
    """Vertices, edges and triangles of every object."""
    vertices = triangles.selectExpr("object_id", f"explode(array({', '.join(map(_corner, 'abc'))})) AS p").distinct().groupBy("object_id").agg(F.count("*").alias("n_vertices"))
    edges = edge_faces(triangles).groupBy("object_id").agg(F.count("*").alias("n_edges"))
    return triangles.groupBy("object_id").agg(F.count("*").alias("n_triangles")).join(vertices, "object_id").join(edges, "object_id")


def edge_faces(triangles: DataFrame) -> DataFrame:
    """How many triangles each edge of each object borders, with the least and the greatest of them."""
    tri = F.floor(F.col("place") / 3).cast("long")
    return _half_edges(triangles).groupBy("object_id", *ENDS).agg(F.count("*").alias("faces"), F.min(tri).alias("first_tri"), F.max(tri).alias("last_tri"))


#: Triangles up to which an object's shells are told by one task, together with others; larger objects are solved in rounds over the cluster.
LOCAL_TRIANGLES = 2_000_000
#: Triangle numbers of such large objects, in bits.
TRIANGLE_BITS = 40


def _closed_here(batches):
    """Of the objects of a task, given (object_id, faces, first_tri, last_tri) of their edges: whether each is one closed shell."""
    parts = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
    if not parts:
        return
    of, faces, u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    names, at = np.unique(of, return_inverse=True)
    # triangles of all objects as one sequence of numbers
    ends = np.stack([np.r_[at, at], np.r_[u, v]], axis=1)
    pairs, number = np.unique(ends, axis=0, return_inverse=True)
    number = number.reshape(-1)
    nodes, roots = solved(number[: len(at)], number[len(at) :])
    shells = np.bincount(pairs[:, 0], minlength=len(names)) - np.bincount(pairs[nodes[roots != nodes], 0], minlength=len(names))
    bad = np.bincount(at, weights=faces != 2, minlength=len(names))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array((bad == 0) & (shells == 1))], names=["object_id", "closed"])


def mesh_is_closed(triangles: DataFrame) -> DataFrame:
    """Whether an object is one closed shell: every edge borders exactly two triangles, and shared edges connect all of them."""
    edges = edge_faces(triangles).select(F.col("object_id").cast("long").alias("object_id"), "faces", "first_tri", "last_tri")
    large = triangles.groupBy(F.col("object_id").cast("long").alias("object_id")).agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_TRIANGLES)
    names = sorted(r["object_id"] for r in large.select("object_id").collect())  # at most all triangles / LOCAL_TRIANGLES
    rest = edges.where(~F.col("object_id").isin(names)) if names else edges
    done = rest.repartition("object_id").mapInArrow(_closed_here, "object_id long, closed boolean")
    if not names:
        return done
    few = F.broadcast(triangles.sparkSession.createDataFrame([(k, i) for i, k in enumerate(names)], "object_id long, _number long"))
    mine = edges.join(few, "object_id")
    node = lambda c: F.shiftleft("_number", TRIANGLE_BITS) + F.col(c)
    roots = components(mine.select(node("first_tri").alias("u"), node("last_tri").alias("v")))
    joined = roots.groupBy(F.shiftright("u", TRIANGLE_BITS).alias("_number")).agg(F.count("*").alias("joined"))
    held = large.join(few, "object_id").join(joined, "_number", "left")  # a shell of n triangles has n - 1 that are not its root
    even = mine.groupBy("object_id").agg(F.bool_and(F.col("faces") == 2).alias("even"))
    return done.unionByName(held.join(even, "object_id").select("object_id", (F.col("even") & (F.coalesce("joined", F.lit(0)) == F.col("n") - 1)).alias("closed")))


def mesh_shift(triangles: DataFrame, dx, dy, dz) -> DataFrame:
    move = dict(zip("xyz", (dx, dy, dz), strict=True))
    return triangles.select("object_id", "tri_id", *[(F.col(n) + move[n[1]]).alias(n) for n in TRIANGLE])


def _about_center(triangles: DataFrame, factor: Column) -> DataFrame:
    boxes = objects(triangles).select("object_id", *[x.alias(f"_{c}") for x, c in zip(g.box_center(g.box()), "xyz", strict=True)], F.greatest(*g.box_dims(g.box())).alias("_extent"))
    return triangles.join(boxes, "object_id").select("object_id", "tri_id", *[(F.col(f"_{n[1]}") + (F.col(n) - F.col(f"_{n[1]}")) * factor).alias(n) for n in TRIANGLE])


def mesh_shrink(triangles: DataFrame, factor: float) -> DataFrame:
    """Scale about the box centre by 1 / factor."""
    return _about_center(triangles, F.lit(1.0 / factor))


def mesh_expand(triangles: DataFrame, factor: float) -> DataFrame:
    return _about_center(triangles, F.lit(float(factor)))


def normalize_mesh(triangles: DataFrame) -> DataFrame:
    """Centre on the origin and divide by the largest extent (by 1, if that is 0)."""
    boxes = objects(triangles).select("object_id", *[x.alias(f"_{c}") for x, c in zip(g.box_center(g.box()), "xyz", strict=True)], F.greatest(*g.box_dims(g.box())).alias("_e"))
    size = F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.lit(1.0))
    return triangles.join(boxes, "object_id").select("object_id", "tri_id", *[((F.col(n) - F.col(f"_{n[1]}")) / size).alias(n) for n in TRIANGLE])


def rescale_units(triangles: DataFrame, divisor: float = 1000.0) -> DataFrame:
    return triangles.select("object_id", "tri_id", *[(F.col(n) / F.lit(divisor)).alias(n) for n in TRIANGLE])


def shuffle_objects(triangles: DataFrame, reach: float = 15.0, seed: int = 42) -> DataFrame:
    """Move every object by a vector in [-reach, reach)^3 that depends on its id and the seed alone."""
    step = lambda c: (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col("object_id")), F.lit(1 << 40)) / F.lit(float(1 << 40)) * 2 - 1) * F.lit(reach)
    return triangles.select("object_id", "tri_id", *[(F.col(n) + step(n[1])).alias(n) for n in TRIANGLE])


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """The unit sum of the face normals at every vertex, weighted by area."""
    n = g.tri_normal(g.vec("a"), g.vec("b"), g.vec("c"))
    rows = triangles.select("object_id", *[n[i].alias(f"n{c}") for i, c in enumerate("xyz")], F.explode(F.array(*[F.struct(*[F.col(f"{v}{c}").alias(c) for c in "xyz"]) for v in "abc"])).alias("p"))
    total = rows.groupBy("object_id", "p").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    size = F.nullif(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(0.0))
    return total.select("object_id", "p.*", *[(F.col(f"n{c}") / size).alias(f"n{c}") for c in "xyz"])


def fan_triangulate(polygons: DataFrame) -> DataFrame:
    """Triangles of faces given as (object_id, face_id, ring: array of vertex numbers): n - 2 from a fan about the first."""
    fan = F.transform(F.sequence(F.lit(1), F.size("ring") - 2), lambda k: F.struct(F.get("ring", F.lit(0)).alias("i0"), F.get("ring", k).alias("i1"), F.get("ring", k + 1).alias("i2")))
    return polygons.where(F.size("ring") >= 3).select("object_id", "face_id", F.posexplode(fan).alias("k", "t")).select("object_id", "face_id", F.col("k").cast("long").alias("k"), "t.*")

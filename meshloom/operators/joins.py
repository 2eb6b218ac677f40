"""Set-valued joins of two mesh datasets: overlap, containment, intersection.

The unit of all joins is a cluster: some hundred neighbouring triangles of an object
(a small object is one cluster, or a few). Boxes of clusters meet on a grid of
levels (see ``grid``); then the edges of one cluster that meet the other's box are
joined, by cluster, to its triangles. So an edge only meets triangles near it, and
no key has more than a cluster's triangles, however large an object is and however
many others it meets. Containment needs pairs of objects: points in boxes, then
vertical rays and the triangles of those clusters that they pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import BOX, EDGE, TRIANGLE
from ..storage import exchanged, written
from .grid import Census, grid_join, points_like
from .mesh import EDGE_BOX, FLAT, TRI_BOX, Copies, Mesh, unique_edges

DIRECTIONS = ("both", "a_to_b", "b_to_a")
#: Bytes of edges or triangles up to which they are sent to every task instead of being exchanged; their number is known. The driver holds several copies of them meanwhile.
SENT_BYTES = 16_000_000
#: Largest id that ``pack_pairs`` takes.
PACKED_BITS = 32


def _side(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.selectExpr(f"object_id AS {side}_object_id", *[f"{c} AS {side}_{c}" for c in BOX])


def names_of(side: str) -> tuple[str, ...]:
    """The columns of one side's box."""
    return tuple(f"{side}_{c}" for c in BOX)


def side_box(side: str) -> g.Box:
    return tuple(map(F.col, names_of(side)))


def box_pairs(a: DataFrame, b: DataFrame, cell: float | None = None, test=g.box_overlaps_inclusive, sides: tuple[Census, Census] | None = None) -> DataFrame:
    """Pairs of (object_id, box) rows whose boxes pass ``test`` (which implies that they meet), each once, with both boxes.

    Rows whose box is null, NaN or infinite meet nothing. ``cell`` is the smallest
    cell of the grid and changes nothing but the time taken.
    """
    met = grid_join(_side(a, "a"), _side(b, "b"), names_of("a"), names_of("b"), sides, cell=cell)
    if test is not g.box_overlaps_inclusive:
        met = met.where(test(side_box("a"), side_box("b")))
    return met.select("a_object_id", "b_object_id", *[f"{s}_{c}" for s in "ab" for c in BOX])


def candidates(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Pairs of objects whose closed boxes meet."""
    return box_pairs(a.boxes, b.boxes, cell, sides=(a.box_census, b.box_census))


#: Triangles of both sides up to which pairs of clusters are dealt out evenly before they are joined.
DEALT_TRIANGLES = 4_000_000


def sent_if_small(rows: DataFrame, n: float) -> DataFrame:
    """A table of about ``n`` rows, marked to be broadcast if that is at most ``SENT_BYTES``, and to be exchanged otherwise."""
    return F.broadcast(rows) if n * 8 * len(rows.columns) <= SENT_BYTES else exchanged(rows)


def by_shape(a: Copies, b: Copies, told: Callable[[Copies, Copies], DataFrame]) -> DataFrame:
    """``told(a, b)``, rows of pairs (a_object_id, b_object_id, …) that depend on both objects' tables (a mesh's triangles) alone."""
    return of_shapes({"a_object_id": a, "b_object_id": b}, told)


def of_shapes(sides: dict[str, Copies], told: Callable[..., DataFrame]) -> DataFrame:
    """``told(*sides)``, rows that name an object of each side in its key's column and depend on these objects' tables alone.

    Where many objects are copies of others (a mesh's: the same triangles at the same
    places), one of each shape is asked for, and its rows are given to all members.
    """
    if not any(m.copied for m in sides.values()):
        return told(*sides.values())
    rows = written(told(*[m.ones if m.copied else m for m in sides.values()]), "told")
    columns, few = rows.columns, rows.count() * 8 * len(rows.columns) <= SENT_BYTES
    for key, m in sides.items():
        if m.copied:
            mine = m.members.selectExpr(f"shape AS {key}", "object_id AS _member")
            if few:  # few rows give many: all cores shall make them
                rows, few = mine.repartition(4 * mine.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(rows), key), False
            else:
                rows = rows.join(sent_if_small(mine, m.counts[0]), key)
            rows = rows.drop(key).withColumnRenamed("_member", key)
    return rows.select(*columns)


def copies(m: Mesh, key: str, name: str) -> DataFrame:
    """(key, name): how many objects each shape has."""
    found = m.members.groupBy(F.col("shape").alias(key)).agg(F.count("*").alias(name))
    return sent_if_small(found, m.counts[1])


def cluster_pairs(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Pairs of clusters whose closed boxes meet: object, cluster and box of both sides."""
    side = lambda m, s: m.clusters.selectExpr(f"object_id AS {s}_object_id", f"cluster AS {s}_cluster", *[f"{c} AS {s}_{c}" for c in BOX])
    return grid_join(side(a, "a"), side(b, "b"), names_of("a"), names_of("b"), (a.census["cluster"], b.census["cluster"]), cell=cell)


def edge_hits(a: Mesh, b: Mesh, direction: str = "both", cell: float | None = None, numbered: bool = True) -> DataFrame:
    """Every hit of an edge of one side on a triangle of the other: (direction, a_object_id, b_object_id, edge_id, tri_id, at), one row each.

    ``direction`` 0 tells edges of a and triangles of b, 1 the other way round.
    ``numbered``: without numbers of edges, an object's edges need not meet in one
    task. Pairs of clusters are made once for both directions.
    """
    ways = [n for n, way in enumerate(("a_to_b", "b_to_a")) if way in _sides(direction)]
    number = ["edge_id"] if numbered else []
    pairs = cluster_pairs(a, b, cell)
    turned = ["struct(" + ", ".join([f"{n} AS direction", f"{u}_object_id AS s", f"{u}_cluster AS sk", f"{v}_object_id AS t", f"{v}_cluster AS tk", *[f"{v}_{c} AS t_{c}" for c in BOX]]) + ")" for n, u, v in ((0, "a", "b"), (1, "b", "a")) if n in ways]
    pairs = pairs.selectExpr(f"explode(array({', '.join(turned)})) AS p").selectExpr("p.*")
    edges = faces = None
    for n in ways:
        source, target = (a, b) if n == 0 else (b, a)
        mine = (unique_edges(source.faces) if numbered else source.edge_set).selectExpr(f"{n} AS direction", "object_id AS s", "cluster AS sk", *number, *EDGE, *[f"{x} AS e_{c}" for x, c in zip(EDGE_BOX, BOX, strict=True)])
        other = target.faces.selectExpr(f"{n} AS direction", "object_id AS t", "cluster AS tk", "tri_id", *TRIANGLE, *[f"{x} AS f_{c}" for x, c in zip(TRI_BOX, BOX, strict=True)])
        edges, faces = (mine, other) if edges is None else (edges.unionByName(mine), faces.unionByName(other))
    size = a.census["cluster"].weight + b.census["cluster"].weight
    if size <= DEALT_TRIANGLES:  # few clusters give many pairs: all cores shall make them
        pairs = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    meet = lambda x, y: " AND ".join(f"{x}l{c} <= {y}h{c} AND {y}l{c} <= {x}h{c}" for c in "xyz")
    near = pairs.join(sent_if_small(edges, 1.5 * size), ["direction", "s", "sk"]).where(meet("e_", "t_")).select("direction", "s", "t", "tk", *number, *EDGE, *[f"e_{c}" for c in BOX])
    met = near.join(sent_if_small(faces, size), ["direction", "t", "tk"]).where(meet("e_", "f_"))
    names, keys = ("_det", "_u", "_v", "_t"), ["direction", "s", "t", *number, "tri_id"]
    terms = [x.alias(n) for x, n in zip(g.segment_terms(*[g.vec(v) for v in "pqabc"]), names, strict=True)]
    # the row number keeps the optimizer from writing the terms out again in every comparison of the filter
    rows = met.select(*keys, *terms, F.monotonically_increasing_id().alias("_row"))
    hit = rows.where((F.col("_row") >= 0) & g.terms_hit(*map(F.col, names)))
    return hit.selectExpr("direction", "if(direction = 0, s, t) AS a_object_id", "if(direction = 0, t, s) AS b_object_id", *number, "tri_id", "_t / nullif(_det, 0D) AS at")


def directed_hits(a: Mesh, b: Mesh, direction: str, cell: float | None = None, numbered: bool = True) -> DataFrame:
    """Hits as (a_object_id, b_object_id, edge_id, tri_id, at), in one direction."""
    return edge_hits(a, b, direction, cell, numbered).drop("direction")


def _sides(direction: str) -> list[str]:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    return ["a_to_b", "b_to_a"] if direction == "both" else [direction]


def overlap(a: Mesh, b: Mesh, direction: str = "both", cell: float | None = None, max_hits_per_edge: int | None = None) -> DataFrame:
    """Pairs whose surfaces meet: an edge of one hits a triangle of the other. A set; containment alone is no overlap.

    One direction alone may miss pairs. ``max_hits_per_edge`` keeps the nearest
    places of each edge (all triangles hit at one place count as one); by default
    nothing is left out.
    """
    return by_shape(a, b, lambda a, b: _overlap(a, b, direction, cell, max_hits_per_edge))


def _overlap(a: Mesh, b: Mesh, direction: str, cell: float | None, max_hits_per_edge: int | None) -> DataFrame:
    hits = edge_hits(a, b, direction, cell, numbered=bool(max_hits_per_edge))
    if max_hits_per_edge:  # copies are hit at one place
        source = F.when(F.col("direction") == 0, F.col("a_object_id")).otherwise(F.col("b_object_id"))
        hits = edge_multi_hit(hits.withColumn("_s", source), ["direction", "_s"], max_hits_per_edge)
    return hits.select("a_object_id", "b_object_id").distinct()


def edge_multi_hit(hits: DataFrame, source: list[str], most: int) -> DataFrame:
    """The hits at the nearest ``most`` places along each edge."""
    return hits.withColumn("_k", F.dense_rank().over(Window.partitionBy(*source, "edge_id").orderBy("at"))).where(F.col("_k") <= most).drop("_k")


def overlap_two_pass(a: Mesh, b: Mesh, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The overlap in two passes: hits of every edge and where each edge writes, and the pairs in these places.

    The first table (direction, object_id, edge_id, hits, offset) has every edge; the
    second (place, a_object_id, b_object_id) holds the hits at offset + 0, 1, … in
    the order of the triangles hit, copies included: sort and unique give ``overlap``.
    """
    mine = lambda x, y: f"if(direction = 0, {x}, {y})"
    hits = edge_hits(a, b, "both", cell).selectExpr("direction", f"{mine('a_object_id', 'b_object_id')} AS object_id", "edge_id", f"{mine('b_object_id', 'a_object_id')} AS other", "tri_id")
    edges = unique_edges(a.faces).selectExpr("0 AS direction", "object_id", "edge_id").unionByName(unique_edges(b.faces).selectExpr("1 AS direction", "object_id", "edge_id"))
    hits = written(hits, "hits")
    keys = ["direction", "object_id", "edge_id"]
    counted = exchanged(edges).join(hits.groupBy(*keys).agg(F.count("*").alias("hits")), keys, "left").select(*keys, F.coalesce("hits", F.lit(0)).alias("hits"))
    offsets = written(prefix_sums(counted, "direction", ["object_id", "edge_id"], "hits"), "offsets")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("other", "tri_id")) - 1
    first = F.col("direction") == 0
    placed = hits.withColumn("_n", nth).join(offsets.where("hits > 0").select(*keys, "offset"), keys)
    pairs = placed.select((F.col("offset") + F.col("_n")).alias("place"), F.when(first, F.col("object_id")).otherwise(F.col("other")).alias("a_object_id"), F.when(first, F.col("other")).otherwise(F.col("object_id")).alias("b_object_id"))
    return offsets, pairs


def point_hits(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Crossings of the upward ray from each b object's first vertex with a's surfaces: (a_object_id, b_object_id, hits).

    Only pairs with the vertex inside a's box can have an odd count; only these are told.
    """
    points = b.boxes.selectExpr("object_id AS b_object_id", "fx AS px", "fy AS py", "fz AS pz")
    inside = grid_join(points, _side(a.boxes, "a"), ("px", "py", "pz") * 2, names_of("a"), (replace(b.box_census, orders={-996: b.box_census.n}, mean=0.0), a.box_census), cell=cell).select("a_object_id", "b_object_id", "px", "py", "pz")
    flat = a.census["flat"]
    parts = a.clusters.selectExpr("object_id AS a_object_id", "cluster", *[f"{c} AS k_{c}" for c in (*FLAT, "hz")])
    above = grid_join(inside, parts, ("px", "py") * 2, [f"k_{c}" for c in FLAT], (points_like(flat), flat), on=["a_object_id"]).where("k_hz >= pz").select("a_object_id", "b_object_id", "cluster", "px", "py", "pz")
    faces = a.faces.selectExpr("object_id AS a_object_id", "cluster", *TRIANGLE)
    rows = above.join(sent_if_small(faces, flat.weight), ["a_object_id", "cluster"]).where(f"px BETWEEN {TRI_BOX[0]} AND {TRI_BOX[3]} AND py BETWEEN {TRI_BOX[1]} AND {TRI_BOX[4]} AND {TRI_BOX[5]} >= pz")
    return rows.where(g.ray_up_hits(*[g.vec(v) for v in "pabc"])).groupBy("a_object_id", "b_object_id").agg(F.expr("count(*) AS hits"))


def point_in_mesh(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Pairs in which b's first vertex lies inside a: an odd count of crossings."""
    return by_shape(a, b, lambda a, b: point_hits(a, b, cell).where(F.col("hits") % 2 == 1).select("a_object_id", "b_object_id"))


def parity(a: Mesh, b: Mesh, direction: str, cell: float | None = None) -> DataFrame:
    """Containment by parity, of the target's objects around the source's vertices, as (a_object_id, b_object_id, hits).

    ``a_to_b``: vertices of a inside b. ``b_to_a``: vertices of b inside a.
    """
    if direction == "b_to_a":
        return point_hits(a, b, cell)
    return point_hits(b, a, cell).select(F.col("b_object_id").alias("a_object_id"), F.col("a_object_id").alias("b_object_id"), "hits")


def containment(a: Mesh, b: Mesh, cell: float | None = None, include_overlap: bool = False) -> DataFrame:
    """Pairs with b strictly inside a: its first vertex inside, and no overlap in either direction.

    With ``include_overlap``, overlapping pairs are told too, tagged by pair_type.
    """
    return by_shape(a, b, lambda a, b: _containment(a, b, cell, include_overlap))


def _containment(a: Mesh, b: Mesh, cell: float | None, include_overlap: bool) -> DataFrame:
    met = overlap(a, b, "both")
    inside = point_in_mesh(a, b, cell).join(met, ["a_object_id", "b_object_id"], "left_anti")
    if not include_overlap:
        return inside
    return inside.withColumn("pair_type", F.lit("containment")).unionByName(met.withColumn("pair_type", F.lit("overlap")))


def intersection(a: Mesh, b: Mesh, direction: str = "both", cell: float | None = None) -> DataFrame:
    """Pairs that overlap or of which one contains the other's first vertex; ``direction`` gates both."""
    return by_shape(a, b, lambda a, b: _intersection(a, b, direction, cell))


def _intersection(a: Mesh, b: Mesh, direction: str, cell: float | None) -> DataFrame:
    found = edge_hits(a, b, direction, numbered=False).select("a_object_id", "b_object_id")
    for side in _sides(direction):
        found = found.unionByName(parity(a, b, side, cell).where("hits % 2 = 1").select("a_object_id", "b_object_id"))
    return found.distinct()


# The two-pass form: counts, offsets, and what they add up to.


def edge_hit_counts(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Triangles of b that each edge of a hits, none included."""
    one, two = [m.ones if m.copied else m for m in (a, b)]
    hits = directed_hits(one, two, "a_to_b", cell).select(F.col("a_object_id").alias("object_id"), "edge_id", "b_object_id")
    if b.copied:  # every copy is hit where its shape is
        hits = hits.groupBy("object_id", "edge_id", "b_object_id").agg(F.count("*").alias("_n")).join(copies(b, "b_object_id", "_copies"), "b_object_id").groupBy("object_id", "edge_id").agg(F.sum(F.col("_n") * F.col("_copies")).alias("hits"))
    else:
        hits = hits.groupBy("object_id", "edge_id").agg(F.count("*").alias("hits"))
    counts = one.edges.select("object_id", "edge_id").join(hits, ["object_id", "edge_id"], "left").select("object_id", "edge_id", F.coalesce("hits", F.lit(0)).alias("hits"))
    if not a.copied:
        return counts
    counts = written(counts, "counts")
    mine = a.members.selectExpr("shape AS _shape", "object_id AS _member")
    return mine.join(sent_if_small(counts, counts.count()).withColumnRenamed("object_id", "_shape"), "_shape").select(F.col("_member").alias("object_id"), "edge_id", "hits")


def prefix_sums(rows: DataFrame, key: str, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Exclusive running sums of ``value`` over (key, order), in two levels.

    Rows are dealt to ranges of (key, order) by a sample and written with their
    range's number: the input is made once. Sums of ranges are few and run in one
    small window, rows run within their range.
    """
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return run.join(F.broadcast(before), "_part").withColumn("offset", (F.col("_before") + F.col("_run")).cast("long")).drop("_part", "_before", "_run")


def overlap_summary(a: Mesh, b: Mesh, pairs: DataFrame) -> DataFrame:
    """Triangles and objects of both sides, and distinct pairs, in one row."""
    side = lambda m, s: m.triangles.agg(F.count("*").alias(f"triangles_{s}"), F.count_distinct("object_id").alias(f"objects_{s}"))
    return side(a, "a").crossJoin(side(b, "b")).crossJoin(pairs.agg(F.count_distinct("a_object_id", "b_object_id").alias("pairs")))


def duplication(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Raw hits, distinct pairs, and how often a pair is found: what de-duplication has to remove."""
    rows = edge_hits(*[m.ones if m.copied else m for m in (a, b)], "both", cell, False).groupBy("a_object_id", "b_object_id").agg(F.count("*").alias("n")).withColumn("pairs", F.lit(1).cast("long"))
    for key, m in (("a_object_id", a), ("b_object_id", b)):
        if m.copied:  # each copy has its shape's pairs
            rows = rows.join(copies(m, key, "_copies"), key).withColumn("n", F.col("n") * F.col("_copies")).withColumn("pairs", F.col("pairs") * F.col("_copies")).drop("_copies")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_hits"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("distinct_pairs"))


def pack_pairs(pairs: DataFrame) -> DataFrame:
    """One long for each pair of ids from 0 to 2^32 - 1 (a from 2^31 on gives a negative key); any other id is an error, not a wrong key."""
    fits = lambda c: F.col(c).between(0, (1 << PACKED_BITS) - 1)
    wrong = F.raise_error(F.format_string("pack_pairs: (%s, %s) does not fit into two times 32 bits", F.col("a_object_id").cast("string"), F.col("b_object_id").cast("string"))).cast("long")
    return pairs.select(F.when(fits("a_object_id") & fits("b_object_id"), F.shiftleft("a_object_id", PACKED_BITS).bitwiseOR(F.col("b_object_id"))).otherwise(wrong).alias("pair_key"))


def unpack_pairs(keys: DataFrame) -> DataFrame:
    return keys.select(F.shiftrightunsigned("pair_key", PACKED_BITS).alias("a_object_id"), F.col("pair_key").bitwiseAND(F.lit((1 << PACKED_BITS) - 1)).alias("b_object_id"))


# Hit tracking and profiles.


def pair_hits(a: Mesh, b: Mesh, cell: float | None = None, only_odd: bool = True) -> DataFrame:
    """(direction, source_object_id, target_object_id, target_ray_hits, final_pair): crossings of targets with an odd count.

    A pair with an odd count is in the intersection by that alone; the overlap is only asked for others.
    """
    one = parity(a, b, "a_to_b", cell).select(F.lit("a_to_b").alias("direction"), "a_object_id", "b_object_id", "hits")
    two = parity(a, b, "b_to_a", cell).select(F.lit("b_to_a").alias("direction"), "a_object_id", "b_object_id", "hits")
    rows = one.unionByName(two)
    if only_odd:
        rows = rows.where(F.col("hits") % 2 == 1).withColumn("final_pair", F.lit(True))
    else:
        final = intersection(a, b, "both", cell).withColumn("final_pair", F.lit(True))
        rows = rows.join(final, ["a_object_id", "b_object_id"], "left")
    source, target = F.when(F.col("direction") == "a_to_b", F.col("a_object_id")).otherwise(F.col("b_object_id")), F.when(F.col("direction") == "a_to_b", F.col("b_object_id")).otherwise(F.col("a_object_id"))
    return rows.select("direction", source.alias("source_object_id"), target.alias("target_object_id"), F.col("hits").alias("target_ray_hits"), F.coalesce("final_pair", F.lit(False)).alias("final_pair"))


def containment_tracking(hits: DataFrame) -> DataFrame:
    """Per source: iterations (always one), targets with an odd count, overflows (none)."""
    return hits.groupBy("direction", "source_object_id").agg(F.lit(1).cast("long").alias("iterations"), F.count_distinct("target_object_id").alias("candidate_count"), F.lit(0).cast("long").alias("candidate_overflow_events"))


def tracking_summary(hits: DataFrame) -> DataFrame:
    """Per source: candidates, tracked targets and hits, and how many are final pairs."""
    return hits.groupBy("direction", "source_object_id").agg(
        F.lit(1).cast("long").alias("iterations"), F.count_distinct("target_object_id").alias("candidate_count"), F.count_distinct("target_object_id").alias("tracked_target_count"),
        F.sum("target_ray_hits").alias("tracked_hit_total"), F.lit(0).cast("long").alias("candidate_overflow_events"), F.count(F.when(F.col("final_pair"), 1)).alias("final_pair_count"), F.count(F.when(F.col("final_pair"), 1)).alias("tracked_final_pair_count"),
    )


def profile(a: Mesh, b: Mesh, cell: float | None = None) -> DataFrame:
    """Counters of the join: edges traced, hits, the most of an edge, rays, ray hits, containers, and averages in thousandths."""
    counts = edge_hit_counts(a, b, cell).agg(F.count("*").alias("edges"), F.sum("hits").alias("hits"), F.max("hits").alias("most_hits"))
    rays = b.objects.agg(F.count("*").alias("rays"))
    crossed = point_hits(a, b, cell).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("ray_hits"), F.count("*").alias("candidates"), F.count(F.when(F.col("hits") % 2 == 1, 1)).alias("containers"))
    return counts.crossJoin(rays).crossJoin(crossed).withColumn("hits_per_edge_milli", F.floor(F.col("hits") * 1000 / F.nullif(F.col("edges"), F.lit(0))).cast("long"))

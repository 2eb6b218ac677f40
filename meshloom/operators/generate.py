"""Deterministic generators: cubes, spheres, tissue, and the sizes of their universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import TRIANGLE


def _unit(seed: int, what: str, key: Column) -> Column:
    """A number in [0, 1) from the seed, a name and the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def gen_cubes(spark: SparkSession, n: int, extent: float, smallest: float, largest: float, seed: int = 42) -> DataFrame:
    """n cubes (object_id, x, y, z, s), centred in [0, extent)^3, with uniform sizes."""
    key = F.col("id")
    place = [(_unit(seed, c, key) * extent).alias(c) for c in "xyz"]
    return spark.range(n).select(key.alias("object_id"), *place, (F.lit(float(smallest)) + _unit(seed, "s", key) * (largest - smallest)).alias("s"))


def universe_for_selectivity(mean_size: float, sigma: float) -> float:
    """The extent at which pairs of cubes of this mean size overlap with chance sigma."""
    return 2 * mean_size / sigma ** (1 / 3)


def sphere_universe(smallest: float, largest: float, sigma: float) -> float:
    """The same for spheres of uniform diameter: from the moments of the size."""
    from math import pi

    def moment(k: int) -> float:
        return smallest**k if largest == smallest else (largest ** (k + 1) - smallest ** (k + 1)) / ((k + 1) * (largest - smallest))

    return (pi / 3 * (moment(3) + 3 * moment(2) * moment(1)) / sigma) ** (1 / 3)


def verify_selectivity(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The share of all pairs of cubes whose boxes overlap (open) without one holding the other (closed).

    ``pairs`` are candidates with both boxes, so the share is exact without all pairs.
    """
    from ..schema import BOX

    x, y = tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX)
    found = pairs.where(g.box_intersects(x, y) & ~g.box_contains_box(x, y) & ~g.box_contains_box(y, x)).agg(F.count("*").alias("pairs"))
    total = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))  # one row each
    return found.crossJoin(total).select("pairs", (F.col("pairs") / F.nullif(F.col("na") * F.col("nb"), F.lit(0))).alias("selectivity"))


def reservoir_sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, each set of k as likely: those with the smallest seeded hashes of their key. A top-k, not a sort."""
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_h", key).limit(k).drop("_h")


def octasphere(level: int) -> list[tuple[tuple[float, float, float], ...]]:
    """Triangles of a unit sphere: an octahedron whose faces are split in four, ``level`` times."""
    from math import sqrt

    from .mesh import OCTA_CORNERS, OCTA_FACES

    def middle(p, q):
        m = tuple((x + y) / 2 for x, y in zip(p, q, strict=True))
        size = sqrt(sum(x * x for x in m))
        return tuple(x / size for x in m)

    faces = [tuple(tuple(float(x) for x in OCTA_CORNERS[i]) for i in f) for f in OCTA_FACES]
    for _ in range(level):
        faces = [t for a, b, c in faces for ab, bc, ca in [(middle(a, b), middle(b, c), middle(c, a))] for t in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))]
    return faces


def place_template(centers: DataFrame, faces: list, spark: SparkSession | None = None) -> DataFrame:
    """Triangles of a template (a list of faces, whose length the template bounds) at every (object_id, x, y, z, s), scaled by s."""
    spark = spark or centers.sparkSession
    rows = [(i, *[float(x) for p in f for x in p]) for i, f in enumerate(faces)]
    template = F.broadcast(spark.createDataFrame(rows, "tri_id long, " + ", ".join(f"t{c} double" for c in TRIANGLE)))
    return centers.crossJoin(template).select("object_id", "tri_id", *[(F.col(c[1]) + F.col("s") * F.col(f"t{c}")).alias(c) for c in TRIANGLE])


def gen_spheres(spark: SparkSession, n: int, smallest: float, largest: float, sigma: float, level: int = 1, seed: int = 42) -> DataFrame:
    centers = gen_cubes(spark, n, sphere_universe(smallest, largest, sigma), smallest, largest, seed).withColumn("s", F.col("s") / 2)
    return place_template(centers, octasphere(level))


def gen_tissue(spark: SparkSession, slots: int, taken: DataFrame, nuclei: int, size: float) -> DataFrame:
    """Nuclei around vessels: every gap-th free slot of a cubic grid of slots, in order, with gap = free / nuclei.

    ``taken`` (slot) are the vessel's. Returns (object_id, slot, x, y, z): low corners.
    """
    grid = spark.range(slots**3).select(F.col("id").alias("slot")).join(taken.select(F.col("slot").cast("long").alias("slot")).distinct(), "slot", "left_anti")
    free = grid.count()
    gap = max(1, free // max(1, nuclei))
    parts = F.floor(F.col("slot") / F.lit(slots * slots)).cast("long")  # layers
    counts = grid.groupBy(parts.alias("_layer")).count()
    before = counts.select("_layer", F.coalesce(F.sum("count").over(Window.orderBy("_layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = grid.withColumn("_layer", parts).join(F.broadcast(before), "_layer").withColumn("k", F.col("_before") + F.row_number().over(Window.partitionBy("_layer").orderBy("slot")) - 1)
    # after gap free slots are passed over, the next is used
    chosen = ranked.where(F.col("k") % (gap + 1) == gap)
    at = lambda x: (x * F.lit(float(size)))
    return chosen.select(F.floor(F.col("k") / F.lit(gap + 1)).cast("long").alias("object_id"), "slot", at(F.col("slot") % slots).alias("x"), at(F.floor(F.col("slot") / slots) % slots).alias("y"), at(F.floor(F.col("slot") / (slots * slots))).alias("z"))


def gen_nuclei_random(spark: SparkSession, n: int, extent: tuple[float, float, float], amplify: float, seed: int = 42) -> DataFrame:
    """n places in a box amplified about its origin."""
    return spark.range(n).select(F.col("id").alias("object_id"), *[(_unit(seed, c, F.col("id")) * F.lit(e * amplify)).alias(c) for c, e in zip("xyz", extent, strict=True)])


def selectivity_sweep(spark: SparkSession, low: float, high: float, steps: int, log: bool = False) -> DataFrame:
    """(step, sigma): evenly spaced values, or evenly spaced exponents."""
    share = F.col("id") / F.lit(float(max(1, steps - 1)))
    value = F.lit(float(low)) * F.pow(F.lit(high / low), share) if log else F.lit(float(low)) + share * F.lit(float(high - low))
    return spark.range(steps).select(F.col("id").alias("step"), value.alias("sigma"))


def alternating_split(rows: DataFrame, order: str) -> DataFrame:
    """Rows in order, alternately to sides A and B."""
    from .joins import prefix_sums

    numbered = prefix_sums(rows.withColumn("_one", F.lit(1)), order, [], "_one")
    return numbered.withColumn("side", F.when(F.col("offset") % 2 == 0, "A").otherwise("B")).drop("_one", "offset")


def aggregate_meshes(parts: list[DataFrame]) -> DataFrame:
    """One dataset of several, with ids (part, object) made unique by the part's number in the high bits."""
    out = None
    for i, t in enumerate(parts):
        t = t.withColumn("object_id", F.lit(i).cast("long") * (1 << 40) + F.col("object_id"))
        out = t if out is None else out.unionByName(t)
    return out


def sphere_radius(volume: Column, least: float = 0.0) -> Column:
    """The radius of a sphere of this volume, and no less than ``least``."""
    return F.greatest(F.cbrt(volume * F.lit(3.0) / F.lit(4.0 * 3.141592653589793)), F.lit(float(least)))


def nucleus_proxies(nuclei: DataFrame, roots: DataFrame, region: tuple[float, ...], least: float, level: int = 1) -> DataFrame:
    """A sphere for each nucleus (nucleus_id, root_id, x, y, z, volume) whose root is wanted and whose centre lies in the region."""
    inside = g.box_contains_point(tuple(F.lit(float(v)) for v in region), tuple(F.col(c) for c in "xyz"))
    chosen = nuclei.join(roots.select("root_id").distinct(), "root_id", "left_semi").where(inside)
    centers = chosen.select(F.col("nucleus_id").alias("object_id"), "x", "y", "z", sphere_radius(F.col("volume"), least).alias("s"))
    return place_template(centers, octasphere(level))

"""Readers of OBJ, OFF and WKT text.

Text files are split: lines are numbered within their split, and the splits of a
file are shifted by the counts of those before, so that one large file is read by
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TRIANGLE
from ..storage import exchanged


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line, value): order within a split is that of ``line``."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _running(lines: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """For each name, how many lines up to and with this one, from the file's start, meet its condition."""
    sums = lines.groupBy("file", "split").agg(*[F.sum(c.cast("long")).alias(f"_{n}") for n, c in counted.items()])
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("file", "split", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in counted])
    within = Window.partitionBy("file", "split").orderBy("line")
    rows = lines.select("*", *[F.sum(c.cast("long")).over(within).alias(n) for n, c in counted.items()]).join(F.broadcast(shift), ["file", "split"])  # a row for each split
    return rows.select(*lines.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in counted])


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of an OBJ file or folder: every shape (``o`` or ``g``) is an object.

    A shape is left out whole if it has no faces, a face that is no triangle, or an
    index that names no vertex. Ids are dense over the shapes that stay, in the
    order of files and lines. Face tokens may carry texture and normal indices;
    negative indices count back from the last vertex.
    """
    v, f, o = F.col("value").startswith("v "), F.col("value").startswith("f "), F.col("value").rlike("^[og] ")
    rows = _running(_lines(spark, path).where(v | f | o), {"nv": v, "nf": f, "no": o})
    parts = F.split(F.trim("value"), r"\s+")
    points = exchanged(rows).where(v).select("file", F.col("nv").alias("vno"), *[F.element_at(parts, i + 2).cast("double").alias(c) for i, c in enumerate("xyz")])
    index = lambda t: F.split(t, "/")[0].cast("long")
    ring = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda t: F.when(index(t) < 0, F.col("nv") + 1 + index(t)).otherwise(index(t)))
    faces = exchanged(rows).where(f).select("file", "no", "nf", ring.alias("ring"))
    corners = faces.where(F.size("ring") == 3)
    for i, c in enumerate("abc"):
        corners = corners.withColumn("vno", F.get("ring", F.lit(i))).join(points.select("file", "vno", *[F.col(x).alias(f"{c}{x}") for x in "xyz"]), ["file", "vno"], "left").drop("vno")
    whole = corners.groupBy("file", "no").agg(F.count("*").alias("n"), F.bool_and(F.col("ax").isNotNull() & F.col("bx").isNotNull() & F.col("cx").isNotNull()).alias("found"), F.min("nf").alias("first"))
    given = faces.groupBy("file", "no").agg(F.count("*").alias("all"))
    kept = whole.join(given, ["file", "no"]).where((F.col("n") == F.col("all")) & F.col("found")).select("file", "no", "first")
    ids = kept.withColumn("object_id", _dense(kept, "no"))
    return exchanged(corners).join(ids, ["file", "no"]).select("object_id", (F.col("nf") - F.col("first")).alias("tri_id"), *TRIANGLE)


def _dense(kept: DataFrame, order: str) -> Column:
    """Numbers from 0 over (file, order), with one window over the shapes alone."""
    return F.row_number().over(Window.orderBy("file", order)).cast("long") - 1


def parse_off(text: Column) -> tuple[Column, Column]:
    """Vertices (array of x, y, z) and rings (arrays of vertex numbers) of OFF text, whose lines may end in ``|``."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"\|", "\n"), "\n"), lambda s: F.trim(F.regexp_replace(s, r"#.*$", ""))), lambda s: s != "")
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    n = F.split(F.element_at(lines, 2), r"\s+")[0].cast("int")
    numbers = lambda s: F.split(s, r"\s+")
    vertices = F.transform(F.slice(body, 1, n), lambda s: F.struct(*[numbers(s)[i].cast("double").alias(c) for i, c in enumerate("xyz")]))
    rings = F.transform(F.slice(body, n + 1, F.greatest(F.size(body) - n, F.lit(0))), lambda s: F.slice(numbers(s), 2, numbers(s)[0].cast("int")).cast("array<long>"))
    return vertices, rings


def off_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(object_id, vertex_id, x, y, z) and (object_id, face_id, ring) of (object_id, text) rows with OFF text."""
    vertices, rings = parse_off(F.col("text"))
    points = texts.select("object_id", F.posexplode(vertices).alias("vertex_id", "v")).select("object_id", F.col("vertex_id").cast("long").alias("vertex_id"), "v.*").transform(exchanged)
    faces = texts.select("object_id", F.posexplode(rings).alias("face_id", "ring")).select("object_id", F.col("face_id").cast("long").alias("face_id"), "ring")
    return points, faces


def _off_triangles(texts: DataFrame) -> DataFrame:
    vertices, rings = parse_off(F.col("text"))
    parsed = texts.select("object_id", vertices.alias("v"), F.posexplode(rings).alias("face_id", "ring")).where(F.size("ring") == 3)
    corner = lambda i: F.get("v", F.get("ring", F.lit(i)).cast("int"))
    return parsed.select("object_id", F.col("face_id").cast("long").alias("tri_id"), *[corner(i)[c].alias(f"{n}{c}") for i, n in enumerate("abc") for c in "xyz"])


def read_off(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of OFF files, one object a file, numbered by path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    ids = files.select("file").withColumn("object_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    return _off_triangles(files.join(ids, "file"))


def read_off_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Triangles of a file with one OFF mesh a line, the first ``most`` of them if that is given."""
    rows = _running(_lines(spark, path).where(F.trim("value") != ""), {"n": F.lit(True)})
    texts = rows.select((F.col("n") - 1).alias("object_id"), F.col("value").alias("text"))
    return _off_triangles(texts.where(F.col("object_id") < most) if most is not None else texts)


def polygons_of(text: Column) -> Column:
    """The polygons of WKT text: arrays of rings, each an array of points without the closing one. Rings of fewer than three points go."""
    bodies = F.regexp_extract_all(text, F.lit(r"\(\s*(\((?:[^()]*)\)(?:\s*,\s*\([^()]*\))*)\s*\)"), F.lit(1))

    def ring(s: Column) -> Column:
        points = F.transform(F.split(F.btrim(s, F.lit("() ")), r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
        return F.when((F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, 1, F.size(points) - 1)).otherwise(points)

    return F.transform(bodies, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"\(([^()]*)\)"), F.lit(1)), ring))


def read_wkt_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(line, part, outer, holes) of lines with POLYGON or MULTIPOLYGON; outer rings of fewer than three points are left out, and such holes too."""
    lines = _running(_lines(spark, path), {"n": F.lit(True)}).where(F.upper("value").contains("POLYGON"))
    rows = lines.select((F.col("n") - 1).alias("line"), F.posexplode(polygons_of(F.col("value"))).alias("part", "rings"))
    return rows.where(F.size(F.element_at("rings", 1)) >= 3).select("line", F.col("part").cast("long").alias("part"), F.element_at("rings", 1).alias("outer"), F.filter(F.slice("rings", 2, F.size("rings")), lambda r: F.size(r) >= 3).alias("holes"))

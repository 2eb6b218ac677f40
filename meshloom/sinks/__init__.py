"""Writers of mesh formats, pairs, reports and SQL text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BOX, TRIANGLE
from ..storage import exchanged


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """Overlap pairs, under the column names of their two sides."""
    pairs.select(F.col("a_object_id").alias("object_id_mesh1"), F.col("b_object_id").alias("object_id_mesh2")).write.csv(path, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    """Intersection and containment pairs, hits, summaries: as they are, with a header."""
    rows.write.csv(path, header=True)


def _number(c: Column) -> Column:
    return F.format_string("%.6f", c)


def _ordered(lines: Column, by: Column) -> Column:
    """Lines of a group joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by.alias("k"), lines.alias("s")))), lambda x: x["s"]), "\n")


def obj_blocks(vertices: DataFrame, faces: DataFrame, name: str = "object") -> DataFrame:
    """OBJ text of every object (object_id, text); vertex numbers count on over the objects in order of their ids, from 1.

    ``faces`` is (object_id, tri_id, i0, i1, i2), with vertex ids that count from 0.
    """
    from ..operators.joins import prefix_sums

    sizes = vertices.groupBy("object_id").agg(F.count("*").alias("n"))
    base = prefix_sums(sizes, "object_id", [], "n").select("object_id", F.col("offset").alias("base"))
    v = exchanged(vertices).groupBy("object_id").agg(_ordered(F.format_string("v %.6f %.6f %.6f", "x", "y", "z"), F.col("vertex_id")).alias("v"))
    f = exchanged(faces).join(base, "object_id").groupBy("object_id").agg(_ordered(F.format_string("f %d %d %d", *[F.col(i) + F.col("base") + 1 for i in ("i0", "i1", "i2")]), F.col("tri_id")).alias("f"))
    return v.join(f, "object_id").select("object_id", F.concat_ws("\n", F.format_string(f"o {name}_%d", "object_id"), "v", "f").alias("text"))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, name: str = "object") -> None:
    """Write an OBJ dataset as a folder with one file: vertex numbers run through all of it, as the format wants."""
    obj_blocks(vertices, faces, name).coalesce(1).sortWithinPartitions("object_id").select("text").write.text(path)


def off_blocks(vertices: DataFrame, faces: DataFrame, line: str = "\n") -> DataFrame:
    """OFF text of every object; with ``line`` = '|' each is one line."""
    v = exchanged(vertices).groupBy("object_id").agg(F.count("*").alias("nv"), _ordered(F.concat_ws(" ", _number(F.col("x")), _number(F.col("y")), _number(F.col("z"))), F.col("vertex_id")).alias("v"))
    f = exchanged(faces).groupBy("object_id").agg(F.count("*").alias("nf"), _ordered(F.format_string("3 %d %d %d", "i0", "i1", "i2"), F.col("tri_id")).alias("f"))
    text = F.concat_ws("\n", F.lit("OFF"), F.format_string("%d %d 0", "nv", "nf"), "v", "f")
    return v.join(f, "object_id").select("object_id", F.regexp_replace(text, "\n", line).alias("text"))


def off_points(points: DataFrame, key: str) -> DataFrame:
    """One OFF text of a point set (x, y, z), in order of ``key``."""
    body = _ordered(F.concat_ws(" ", _number(F.col("x")), _number(F.col("y")), _number(F.col("z"))), F.col(key))
    return points.agg(F.concat_ws("\n", F.lit("OFF"), F.format_string("%d 0 0", F.count("*")), body).alias("text"))


def off_triangles(triangles: DataFrame) -> DataFrame:
    """OFF text of every object as loose triangles: three vertices each."""
    corner = lambda v: F.concat_ws(" ", *[_number(F.col(f"{v}{c}")) for c in "xyz"])
    number = F.row_number().over(Window.partitionBy("object_id").orderBy("tri_id")) - 1
    rows = triangles.withColumn("k", number)
    v = _ordered(F.concat_ws("\n", corner("a"), corner("b"), corner("c")), F.col("k"))
    f = _ordered(F.format_string("3 %d %d %d", F.col("k") * 3, F.col("k") * 3 + 1, F.col("k") * 3 + 2), F.col("k"))
    return rows.groupBy("object_id").agg(F.concat_ws("\n", F.lit("OFF"), F.format_string("%d %d 0", F.count("*") * 3, F.count("*")), v, f).alias("text"))


def off_boxes(boxes: DataFrame) -> DataFrame:
    """OFF text of every box as a cube."""
    from ..operators.mesh import BOX_CORNERS, BOX_FACES

    corners = [F.concat_ws(" ", *[_number(F.col(BOX[i if k < 0 else i + 3])) for i, k in enumerate(c)]) for c in BOX_CORNERS]
    faces = [F.lit("3 {} {} {}".format(*f)) for f in BOX_FACES]
    return boxes.select("object_id", F.concat_ws("\n", F.lit("OFF"), F.lit(f"{len(BOX_CORNERS)} {len(BOX_FACES)} 0"), *corners, *faces).alias("text"))


def wkt(triangles: DataFrame) -> DataFrame:
    """POLYHEDRALSURFACE Z text of every object, faces in order, rings closed."""
    point = lambda v: F.concat_ws(" ", *[_number(F.col(f"{v}{c}")) for c in "xyz"])
    face = F.concat(F.lit("(("), F.concat_ws(",", point("a"), point("b"), point("c"), point("a")), F.lit("))"))
    faces = F.transform(F.sort_array(F.collect_list(F.struct("tri_id", face.alias("s")))), lambda x: x["s"])
    return triangles.groupBy("object_id").agg(F.concat(F.lit("POLYHEDRALSURFACE Z ("), F.array_join(faces, ","), F.lit(")")).alias("wkt"))


def sql_inserts(meshes: DataFrame, table: str) -> DataFrame:
    """An INSERT statement for every (object_id, hausdorff, phausdorff, wkt)."""
    return meshes.select(F.format_string(f"INSERT INTO {table}(id, hausdorff, phausdorff, geom) VALUES (%d,%.6f,%.6f,ST_GeomFromEWKT('%s'));", "object_id", "hausdorff", "phausdorff", "wkt").alias("statement"))


def write_levels(levels: DataFrame, path: str) -> None:
    """Triangles of several levels of detail, partitioned by ``lod``."""
    levels.select("lod", "object_id", "tri_id", *TRIANGLE).write.partitionBy("lod").parquet(path)


def timing_json(phases: DataFrame, counters: dict[str, int] | None = None) -> str:
    """The report of one run's phases (phase, duration_us, duration_ms), which are few: phases, counters, total."""
    rows = phases.orderBy("phase").collect()
    total = sum(r["duration_us"] for r in rows)
    return json.dumps({"phases": {r["phase"]: {"duration_us": r["duration_us"], "duration_ms": r["duration_ms"]} for r in rows}, "counters": counters or {}, "total": {"duration_us": total, "duration_ms": total / 1000}}, indent=2)


def timing_reports(phases: DataFrame) -> DataFrame:
    """One JSON text for each run of (run, phase, duration_us, duration_ms): phases by name, counters (none), and the total."""
    entry = F.struct("phase", F.struct("duration_us", "duration_ms").alias("d"))
    rows = phases.groupBy("run").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("phases"), F.sum("duration_us").alias("us"))
    total = F.struct(F.col("us").alias("duration_us"), (F.col("us") / F.lit(1000.0)).alias("duration_ms"))
    return rows.select(F.to_json(F.struct("run", "phases", F.create_map().cast("map<string,long>").alias("counters"), total.alias("total"))).alias("value"))


def write_raw_tiles(levels: DataFrame, path: str) -> None:
    """Levels of detail decoded: triangles by voxel with their Hausdorff values (lod, object_id, voxel_id, tri_id, corners, hausdorff, proxy), partitioned by ``lod``."""
    levels.select("lod", "object_id", "voxel_id", "tri_id", *TRIANGLE, "hausdorff", "proxy").write.partitionBy("lod").parquet(path)

"""Validation and repair of indexed meshes, and conversion reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_face_tokens(tokens) -> object:
    """Vertex indices (from 0) of face tokens ``v``, ``v/vt``, ``v/vt/vn`` and ``v//vn``."""
    return F.transform(tokens, lambda t: F.split(t, "/")[0].cast("long") - 1)


def validate(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per object: faces that are no triangles, indices out of range, isolated vertices, sizes, and whether all is well.

    ``faces`` has (object_id, face_id, ring).
    """
    n = vertices.groupBy("object_id").agg(F.count("*").alias("n_vertices"))
    shape = faces.groupBy("object_id").agg(F.count("*").alias("n_faces"), F.count(F.when(F.size("ring") != 3, 1)).alias("non_triangles"))
    corners = faces.select("object_id", F.explode("ring").alias("vertex_id"))
    known = vertices.select("object_id", "vertex_id")
    bad = corners.join(known, ["object_id", "vertex_id"], "left_anti").groupBy("object_id").agg(F.count("*").alias("bad_indices"))
    alone = known.join(corners, ["object_id", "vertex_id"], "left_anti").groupBy("object_id").agg(F.count("*").alias("isolated_vertices"))
    rows = n.join(shape, "object_id", "full").join(bad, "object_id", "left").join(alone, "object_id", "left").na.fill(0)
    ok = (F.col("non_triangles") == 0) & (F.col("bad_indices") == 0) & (F.col("isolated_vertices") == 0) & (F.col("n_vertices") >= 4) & (F.col("n_faces") >= 1)
    return rows.select("object_id", "n_vertices", "n_faces", "non_triangles", "bad_indices", "isolated_vertices", ok.alias("valid"))


def repair(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles that can be kept, and a count of what was dropped by reason.

    Faces with an index out of range, under three corners or a repeated corner are
    dropped by filters; the others become fans. A triangle whose directed edge an
    earlier kept triangle has used is dropped too: that depends on the order, and
    runs for each object by itself.
    """
    n = vertices.groupBy("object_id").agg(F.count("*").alias("_n"))
    reason = (
        F.when(F.size("ring") < 3, "short").when(F.exists("ring", lambda v: (v < 0) | (v >= F.col("_n"))), "bad_index").when(F.size(F.array_distinct("ring")) < F.size("ring"), "repeated")
    )
    judged = faces.join(n, "object_id", "left").na.fill(0, ["_n"]).withColumn("reason", reason)
    fan = F.transform(F.sequence(F.lit(1), F.size("ring") - 2), lambda k: F.struct(F.get("ring", F.lit(0)).alias("i0"), F.get("ring", k).alias("i1"), F.get("ring", k + 1).alias("i2")))
    triangles = judged.where(F.col("reason").isNull()).select("object_id", "face_id", F.posexplode(fan).alias("k", "t")).select("object_id", "face_id", "k", "t.*")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["face_id", "k"])
        used: set[tuple[int, int]] = set()
        keep = []
        for a, b, c in zip(pdf.i0, pdf.i1, pdf.i2, strict=True):
            mine = {(a, b), (b, c), (c, a)}
            keep.append(not mine & used)
            if keep[-1]:
                used |= mine
        return pdf.assign(kept=keep)

    told = triangles.groupBy("object_id").applyInPandas(greedy, "object_id long, face_id long, k int, i0 long, i1 long, i2 long, kept boolean")
    dropped = judged.where(F.col("reason").isNotNull()).select("object_id", "reason").unionByName(told.where(~F.col("kept")).select("object_id", F.lit("edge_used").alias("reason")))
    return told.where("kept").select("object_id", "face_id", F.col("k").cast("long").alias("k"), "i0", "i1", "i2"), dropped.groupBy("reason").agg(F.count("*").alias("faces"))


def convert_report(manifest: DataFrame, validity: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Status of every manifest row (obj_id): ok, missing_obj, validator_rejected, or off_repair_empty."""
    rows = manifest.join(validity.select(F.col("object_id").alias("obj_id"), "valid"), "obj_id", "left")
    if repaired is not None:
        rows = rows.join(repaired.groupBy(F.col("object_id").alias("obj_id")).agg(F.count("*").alias("n_kept")), "obj_id", "left")
        empty = F.coalesce("n_kept", F.lit(0)) == 0
    else:
        empty = F.lit(False)
    status = F.when(F.col("valid").isNull(), "missing_obj").when(~F.col("valid"), "validator_rejected").when(empty, "off_repair_empty").otherwise("ok")
    return rows.select("obj_id", status.alias("reason"), (status == "ok").alias("success"))

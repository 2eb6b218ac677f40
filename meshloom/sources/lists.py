"""Readers of lists: manifests, ids, pairs, nuclei."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths, one a line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("#"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers, one a line, with # comments; anything else is left out."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).try_cast("long").alias("id")).where(F.col("id").isNotNull())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of ids separated by white space, as a set."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    return rows.select(F.col("p")[0].try_cast("long").alias("a_object_id"), F.col("p")[1].try_cast("long").alias("b_object_id")).where("a_object_id is not null and b_object_id is not null").distinct()


def read_nuclei(spark: SparkSession, path: str, voxel_nm: tuple[float, float, float] = (4.0, 4.0, 40.0)) -> DataFrame:
    """Nuclei from CSV rows of eight fields or more: id, root, centre (scaled to nm) and volume. Bad rows are left out."""
    f = F.split("value", ",")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 8)
    number = lambda i, kind: F.trim(F.col("f")[i]).try_cast(kind)
    table = rows.select(number(0, "long").alias("nucleus_id"), number(3, "long").alias("root_id"), *[(number(4 + i, "double") * F.lit(v)).alias(c) for i, (c, v) in enumerate(zip("xyz", voxel_nm, strict=True))], number(7, "double").alias("volume"))
    return table.na.drop()


def read_bucket_ids(spark: SparkSession, path: str, ending: str = "swc", most: int | None = None) -> DataFrame:
    """The ids that name files of a store, ``<id>.<ending>``, in order (the first ``most``, if given); other names are passed over. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(path).select(F.regexp_extract("path", rf"(?:^|/)(\d+)\.{ending}$", 1).alias("id"))
    found = files.where("id <> ''").select(F.col("id").cast("long").alias("id")).distinct()
    return found.orderBy("id").limit(most) if most else found

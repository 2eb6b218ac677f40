"""Intermediate tables in storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, one of our own: on one machine a temporary folder, on a
    cluster a folder in the warehouse. A warehouse on one machine's disk is no
    place for a cluster's tables: then this is an error that names the setting.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="meshloom-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if "://" not in warehouse or warehouse.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            found = f"{warehouse.rstrip('/')}/_meshloom"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; the folder itself is made by whoever writes first."""
    return f"{shared_dir(spark)}/meshloom-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def exchanged(df: DataFrame) -> DataFrame:
    """A table that no join sends to every task, through the driver, on the optimizer's word.

    The optimizer takes an exploded table for as small as the one it was made from,
    and does not take such a choice back. The mark reaches all joins but those behind
    another join or a union; what is counted and small is marked by ``F.broadcast``
    after it, which goes first.
    """
    return df.hint("merge")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

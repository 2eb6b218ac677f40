"""Streams of object boxes against a static mesh dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import censuses, joined_on, open_grid
from ..operators.joins import names_of
from ..schema import BOX


def stream_candidates(stream: DataFrame, boxes: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs of streamed (object_id, box) rows and static boxes that meet: a stream-static equi-join on cells, without state.

    A pair is told in its reference cell alone, so nothing has to be remembered to
    remove copies. Streamed boxes may have any size: the static ones are placed at
    every level above their own.
    """
    side = lambda df, s: df.selectExpr(f"object_id AS {s}_object_id", *[f"{c} AS {s}_{c}" for c in BOX])
    grid = open_grid(censuses({"b": (boxes, BOX)})["b"], cell)
    if grid is None:  # no static box: nothing ever meets
        return stream.where(F.lit(False)).select(F.col("object_id").alias("a_object_id"), F.col("object_id").alias("b_object_id"))
    return joined_on(grid, side(stream, "a"), side(boxes, "b"), names_of("a"), names_of("b")).select("a_object_id", "b_object_id")

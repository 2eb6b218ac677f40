"""Table schemas of the engine. Geometry is stored flat, one DOUBLE column for each coordinate."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = ("x", "y", "z")
TRIANGLE = tuple(f"{v}{c}" for v in "abc" for c in POINT)
EDGE = tuple(f"{v}{c}" for v in "pq" for c in POINT)
BOX = ("lx", "ly", "lz", "hx", "hy", "hz")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _doubles(names) -> list[tuple[str, T.DataType]]:
    return [(n, T.DoubleType()) for n in names]


VERTICES = _schema(("object_id", T.LongType()), ("vertex_id", T.LongType()), *_doubles(POINT))
FACES = _schema(("object_id", T.LongType()), ("tri_id", T.LongType()), ("i0", T.LongType()), ("i1", T.LongType()), ("i2", T.LongType()))
TRIANGLES = _schema(("object_id", T.LongType()), ("tri_id", T.LongType()), *_doubles(TRIANGLE))
EDGES = _schema(("object_id", T.LongType()), ("edge_id", T.LongType()), *_doubles(EDGE))
GRID_CELLS = _schema(("ix", T.LongType()), ("iy", T.LongType()), ("iz", T.LongType()), ("center_count", T.LongType()), ("touch_count", T.LongType()), ("avg_size_mean", T.DoubleType()), ("vol_ratio", T.DoubleType()))
PAIRS = _schema(("a_object_id", T.LongType()), ("b_object_id", T.LongType()))

"""Hand goldens and properties of the predicates."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.functions.kernels import triangle_distance, triangles_meet

T0 = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]])


def moved(dx=0.0, dy=0.0, dz=0.0):
    return T0 + np.array([dx, dy, dz])


@pytest.mark.parametrize(
    ("other", "distance", "meet"),
    [
        (moved(dz=2), 2.0, False),
        (moved(dx=3), 2.0, False),
        (moved(), 0.0, True),  # coplanar, equal
        (moved(dx=0.2, dy=0.2), 0.0, True),  # coplanar, overlapping
        (moved(dx=1), 0.0, True),  # touching in a corner
        (np.array([[0.2, 0.2, -1], [0.2, 0.2, 1], [0.3, 0.2, 1]]), 0.0, True),  # piercing
        (np.array([[0.1, 0.1, 0.5], [0.2, 0.1, 3], [0.1, 0.2, 3]]), 0.5, False),  # corner over the face
        (np.array([[0.1, 0.1, 0.0], [0.2, 0.1, 0], [0.1, 0.2, 0]]), 0.0, True),  # coplanar, inside
    ],
)
def test_triangle_pairs(other, distance, meet):
    for x, y in ((T0, other), (other, T0)):
        assert triangle_distance(x[None], y[None])[0] == pytest.approx(distance)
        assert bool(triangles_meet(x[None], y[None])[0]) is meet


numbers = st.floats(-5, 5, allow_nan=False, width=32)
triangles = st.lists(numbers, min_size=9, max_size=9).map(lambda v: np.array(v, dtype=float).reshape(3, 3))


@settings(max_examples=60, deadline=None)
@given(triangles, triangles)
def test_distance_is_below_any_pair_of_points(x, y):
    rng = np.random.default_rng(0)
    u, v = rng.dirichlet([1, 1, 1], 200) @ x, rng.dirichlet([1, 1, 1], 200) @ y
    least = np.sqrt(((u[:, None] - v[None]) ** 2).sum(-1)).min()
    d = triangle_distance(x[None], y[None])[0]
    assert d <= least + 1e-6
    assert triangle_distance(y[None], x[None])[0] == pytest.approx(d, abs=1e-6)


def test_degenerate_values_never_raise(spark):
    o = tuple(F.lit(0.0) for _ in range(3))
    row = spark.range(1).select(
        g.segment_hits(o, o, o, o, o).alias("hit"), g.segment_parameter(o, o, o, o, o).alias("t"), g.point_tri_distance(o, o, o, o).alias("d"),
        g.seg_seg_distance(o, o, o, o).alias("s"), g.ray_up_hits(o, o, o, o).alias("up"), g.tri_area_heron(o, o, o).alias("area"),
    ).first()
    assert (row["hit"], row["t"], row["d"], row["s"], row["up"], row["area"]) == (False, None, 0.0, 0.0, False, 0.0)


def test_shared_edge_is_crossed_once(spark):
    """A ray through the diagonal of a square of two triangles, and through their corner, counts once."""
    p = lambda x, y, z: tuple(F.lit(float(v)) for v in (x, y, z))
    square = [(p(0, 0, 1), p(1, 0, 1), p(1, 1, 1)), (p(0, 0, 1), p(1, 1, 1), p(0, 1, 1))]
    for x, y in ((0.5, 0.5), (0.25, 0.25)):
        row = spark.range(1).select(*[g.ray_up_hits(p(x, y, 0), *t).alias(f"h{i}") for i, t in enumerate(square)]).first()
        assert row["h0"] + row["h1"] == 1

"""Triangle kernels in numpy, for Arrow functions: what is too branched for one Column expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a, b):
    return np.einsum("...i,...i->...", a, b)


def _point_segment2(p, a, b):
    d = b - a
    dd = _dot(d, d)
    t = np.clip(np.where(dd > 0, _dot(p - a, d) / np.where(dd > 0, dd, 1), 0), 0, 1)
    w = p - (a + t[..., None] * d)
    return _dot(w, w)


def _segment_segment2(p1, q1, p2, q2):
    d1, d2, r = q1 - p1, q2 - p2, p1 - p2
    a, e, b, c, f = _dot(d1, d1), _dot(d2, d2), _dot(d1, d2), _dot(d1, r), _dot(d2, r)
    det = a * e - b * b
    safe = np.where(det > 0, det, 1)
    s, t = (b * f - c * e) / safe, (a * f - b * c) / safe
    within = (det > 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    w = (p1 + s[..., None] * d1) - (p2 + t[..., None] * d2)
    ends = np.minimum(np.minimum(_point_segment2(p1, p2, q2), _point_segment2(q1, p2, q2)), np.minimum(_point_segment2(p2, p1, q1), _point_segment2(q2, p1, q1)))
    return np.where(within, np.minimum(_dot(w, w), ends), ends)


def _point_triangle2(p, a, b, c):
    e1, e2, w = b - a, c - a, p - a
    n = np.cross(e1, e2)
    nn = _dot(n, n)
    safe = np.where(nn > 0, nn, 1)
    u, v = _dot(np.cross(w, e2), n) / safe, _dot(np.cross(e1, w), n) / safe
    inside = (nn > 0) & (u >= 0) & (v >= 0) & (u + v <= 1)
    sides = np.minimum(np.minimum(_point_segment2(p, a, b), _point_segment2(p, b, c)), _point_segment2(p, c, a))
    return np.where(inside, _dot(w, n) ** 2 / safe, sides)


def _segment_meets(p, q, a, b, c):
    e1, e2, d, s = b - a, c - a, q - p, p - a
    h, k = np.cross(d, e2), np.cross(s, e1)
    det = _dot(e1, h)
    sign = np.where(det < 0, -1.0, 1.0)
    size, u, v, t = np.abs(det), sign * _dot(s, h), sign * _dot(d, k), sign * _dot(e2, k)
    return (size > 0) & (u >= 0) & (v >= 0) & (u + v <= size) & (t >= 0) & (t <= size)


def _coplanar_meet(x, y):
    """Coplanar triangles meet if their closest features are at distance zero or one holds a corner of the other."""
    found = np.zeros(x.shape[:-2], dtype=bool)
    for i in range(3):
        found |= _point_triangle2(x[..., i, :], y[..., 0, :], y[..., 1, :], y[..., 2, :]) <= 0
        found |= _point_triangle2(y[..., i, :], x[..., 0, :], x[..., 1, :], x[..., 2, :]) <= 0
        for j in range(3):
            found |= _segment_segment2(x[..., i, :], x[..., (i + 1) % 3, :], y[..., j, :], y[..., (j + 1) % 3, :]) <= 0
    return found


def triangles_meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether triangles (n, 3, 3) meet, borders and coplanar ones included."""
    found = np.zeros(len(x), dtype=bool)
    for i in range(3):
        j = (i + 1) % 3
        found |= _segment_meets(x[:, i], x[:, j], y[:, 0], y[:, 1], y[:, 2])
        found |= _segment_meets(y[:, i], y[:, j], x[:, 0], x[:, 1], x[:, 2])
    n = np.cross(x[:, 1] - x[:, 0], x[:, 2] - x[:, 0])
    size = np.maximum(1e-300, np.sqrt(_dot(n, n)))
    flat = ~found & (np.abs(_dot(y - x[:, :1], n[:, None, :])).max(axis=1) <= 1e-12 * size)
    if flat.any():
        found[flat] = _coplanar_meet(x[flat], y[flat])
    return found


def triangle_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of triangles (n, 3, 3): nine pairs of sides, six pairs of corner and face, zero where they meet."""
    best = np.full(len(x), np.inf)
    for i in range(3):
        best = np.minimum(best, _point_triangle2(x[:, i], y[:, 0], y[:, 1], y[:, 2]))
        best = np.minimum(best, _point_triangle2(y[:, i], x[:, 0], x[:, 1], x[:, 2]))
        for j in range(3):
            best = np.minimum(best, _segment_segment2(x[:, i], x[:, (i + 1) % 3], y[:, j], y[:, (j + 1) % 3]))
    return np.where(triangles_meet(x, y), 0.0, np.sqrt(best))


def _stack(columns) -> tuple[np.ndarray, np.ndarray]:
    flat = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)
    return flat[:, :9].reshape(-1, 3, 3), flat[:, 9:].reshape(-1, 3, 3)


@F.pandas_udf(T.DoubleType())
def tri_tri_distance(*columns: pd.Series) -> pd.Series:
    """Distance of two triangles, given their eighteen coordinates."""
    return pd.Series(triangle_distance(*_stack(columns)))


@F.pandas_udf(T.BooleanType())
def tri_tri_intersects(*columns: pd.Series) -> pd.Series:
    """Whether two triangles meet, given their eighteen coordinates."""
    return pd.Series(triangles_meet(*_stack(columns)))


@F.pandas_udf(T.DoubleType())
def point_tri_distance(*columns: pd.Series) -> pd.Series:
    """Distance of a point to a triangle, given their twelve coordinates."""
    flat = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1).reshape(-1, 4, 3)
    return pd.Series(np.sqrt(_point_triangle2(flat[:, 0], flat[:, 1], flat[:, 2], flat[:, 3])))

"""Geometry as Column expressions: vectors, boxes, segments and triangles.

Vectors are triples of Columns. Everything stays inside whole-stage code
generation; quotients go through nullif, so that ANSI mode never raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOX, POINT

Vec = tuple[Column, Column, Column]


def vec(name: str, alias: str = "") -> Vec:
    """The columns of a point, as in ('p') -> px, py, pz."""
    dot_ = f"{alias}." if alias else ""
    return tuple(F.col(f"{dot_}{name}{c}") for c in POINT)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dist2(a: Vec, b: Vec) -> Column:
    return dot(sub(a, b), sub(a, b))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


# Boxes. A box is six Columns: three low corners, then three high ones.

Box = tuple[Column, ...]


def box(alias: str = "") -> Box:
    dot_ = f"{alias}." if alias else ""
    return tuple(F.col(f"{dot_}{c}") for c in BOX)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def box_intersects(a: Box, b: Box) -> Column:
    """Interiors meet: boxes that only touch do not."""
    return _all((a[i] < b[i + 3]) & (b[i] < a[i + 3]) for i in range(3))


def box_overlaps_inclusive(a: Box, b: Box) -> Column:
    """Closed boxes meet: boxes that touch do."""
    return _all((a[i] <= b[i + 3]) & (b[i] <= a[i + 3]) for i in range(3))


def box_contains_box(a: Box, b: Box) -> Column:
    return _all((a[i] <= b[i]) & (b[i + 3] <= a[i + 3]) for i in range(3))


def box_contains_point(a: Box, p: Vec) -> Column:
    return _all((a[i] <= p[i]) & (p[i] <= a[i + 3]) for i in range(3))


def box_dims(a: Box) -> Vec:
    return tuple(a[i + 3] - a[i] for i in range(3))


def box_center(a: Box) -> Vec:
    return tuple((a[i] + a[i + 3]) / 2 for i in range(3))


def box_volume(a: Box) -> Column:
    d = box_dims(a)
    return d[0] * d[1] * d[2]


def box_diagonal(a: Box) -> Column:
    return norm(box_dims(a))


def box_gap(a: Box, b: Box) -> Column:
    """The least distance of two boxes."""
    return F.sqrt(reduce(lambda x, y: x + y, (F.pow(F.greatest(F.lit(0.0), a[i] - b[i + 3], b[i] - a[i + 3]), F.lit(2)) for i in range(3))))


def box_reach(a: Box, b: Box) -> Column:
    """The largest distance of two boxes' points: an upper bound for whatever they hold."""
    return F.sqrt(reduce(lambda x, y: x + y, (F.pow(F.greatest(a[i + 3] - b[i], b[i + 3] - a[i]), F.lit(2)) for i in range(3))))


def center_distance(a: Box, b: Box) -> Column:
    return F.sqrt(dist2(box_center(a), box_center(b)))


def box_expand(a: Box, b: Box) -> Box:
    """The least box around both."""
    return tuple(F.least(a[i], b[i]) for i in range(3)) + tuple(F.greatest(a[i], b[i]) for i in range(3, 6))


def box_buffer(a: Box, d) -> Box:
    return tuple(a[i] - d for i in range(3)) + tuple(a[i] + d for i in range(3, 6))


# Distance ranges (least, largest), compared as intervals.


def range_valid(r) -> Column:
    return (r[0] >= 0) & (r[0] <= r[1])


def range_less(r, s) -> Column:
    return r[1] < s[0]


def range_greater(r, s) -> Column:
    return r[0] > s[1]


def range_equal(r, s) -> Column:
    """Neither is surely less: the intervals meet."""
    return ~range_less(r, s) & ~range_greater(r, s)


# Segments and triangles.


def segment_hits(p: Vec, q: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Whether the segment p-q meets the triangle a, b, c, from either side.

    The start of a segment does not count and its end does; a segment without
    length, or parallel to the plane, never hits. The test is the sign-normalised
    form of the ray-triangle test, free of divisions.
    """
    e1, e2, d, s = sub(b, a), sub(c, a), sub(q, p), sub(p, a)
    h, k = cross(d, e2), cross(s, e1)
    det = dot(e1, h)
    sign = F.when(det < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    size, u, v, t = F.abs(det), sign * dot(s, h), sign * dot(d, k), sign * dot(e2, k)
    return (size > 0) & (u >= 0) & (v >= 0) & (u + v <= size) & (t > 0) & (t <= size)


def segment_terms(p: Vec, q: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Column, Column, Column, Column]:
    """The four determinants of ``segment_hits``, for plans that compute them once and test them after."""
    e1, e2, d, s = sub(b, a), sub(c, a), sub(q, p), sub(p, a)
    h, k = cross(d, e2), cross(s, e1)
    return dot(e1, h), dot(s, h), dot(d, k), dot(e2, k)


def terms_hit(det: Column, u: Column, v: Column, t: Column) -> Column:
    """``segment_hits`` from its determinants."""
    up = (u >= 0) & (v >= 0) & (u + v <= det) & (t > 0) & (t <= det)
    down = (u <= 0) & (v <= 0) & (u + v >= det) & (t < 0) & (t >= det)
    return ((det > 0) & up) | ((det < 0) & down)


def segment_parameter(p: Vec, q: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Where on the segment (0 at p, 1 at q) its line meets the triangle's plane; null if parallel."""
    e1, e2, d = sub(b, a), sub(c, a), sub(q, p)
    return dot(e2, cross(sub(p, a), e1)) / F.nullif(dot(e1, cross(d, e2)), F.lit(0.0))


def ray_up_hits(p: Vec, a: Vec, b: Vec, c: Vec, far: float = 1e10) -> Column:
    """Whether the ray from p in direction +Z crosses the triangle within ``far``.

    A half-open rule on the projected edges gives a shared edge or corner to one of
    its triangles only, so that crossings can be counted.
    """

    def edge(u: Vec, v: Vec) -> Column:
        return (v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0])

    area = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sign = F.when(area < 0, F.lit(-1.0)).otherwise(F.lit(1.0))

    def inside(u: Vec, v: Vec) -> Column:
        e, dx, dy = sign * edge(u, v), sign * (v[0] - u[0]), sign * (v[1] - u[1])
        return (e > 0) | ((e == 0) & ((dy > 0) | ((dy == 0) & (dx < 0))))

    height = (edge(b, c) * a[2] + edge(c, a) * b[2] + edge(a, b) * c[2]) / F.nullif(area, F.lit(0.0)) - p[2]
    return (area != 0) & inside(a, b) & inside(b, c) & inside(c, a) & (height > 0) & (height < far)


def tri_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return cross(sub(b, a), sub(c, a))


def tri_area(a: Vec, b: Vec, c: Vec) -> Column:
    return F.lit(0.5) * norm(tri_normal(a, b, c))


def tri_area_heron(a: Vec, b: Vec, c: Vec) -> Column:
    """From the side lengths; rounding below zero counts as zero."""
    u, v, w = norm(sub(b, a)), norm(sub(c, b)), norm(sub(a, c))
    h = (u + v + w) / 2
    return F.sqrt(F.greatest(F.lit(0.0), h * (h - u) * (h - v) * (h - w)))


def tri_barycenter(a: Vec, b: Vec, c: Vec) -> Vec:
    return tuple((a[i] + b[i] + c[i]) / 3 for i in range(3))


def tri_box(a: Vec, b: Vec, c: Vec) -> Box:
    return tuple(F.least(a[i], b[i], c[i]) for i in range(3)) + tuple(F.greatest(a[i], b[i], c[i]) for i in range(3))


def signed_volume6(a: Vec, b: Vec, c: Vec) -> Column:
    """Six times the signed volume of the tetrahedron to the origin."""
    return dot(cross(a, b), c)


def project_to_plane(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    n = tri_normal(a, b, c)
    k = dot(sub(p, a), n) / F.nullif(dot(n, n), F.lit(0.0))
    return tuple(p[i] - k * n[i] for i in range(3))


def in_prism(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Whether the projection of p onto the plane lies in the triangle, by the sum of areas (within 1e-7 of the whole)."""
    o = project_to_plane(p, a, b, c)
    whole = tri_area(a, b, c)
    return F.abs(tri_area(o, a, b) + tri_area(o, b, c) + tri_area(o, c, a) - whole) <= whole * F.lit(1e-7)


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def point_segment_distance2(p: Vec, a: Vec, b: Vec) -> Column:
    d = sub(b, a)
    t = F.coalesce(_clamp(dot(sub(p, a), d) / F.nullif(dot(d, d), F.lit(0.0))), F.lit(0.0))
    return dist2(p, tuple(a[i] + t * d[i] for i in range(3)))


def point_tri_distance(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """The distance of a point to a triangle: to its plane over the inside, else to the nearest side."""
    n, e1, e2, w = tri_normal(a, b, c), sub(b, a), sub(c, a), sub(p, a)
    nn = F.nullif(dot(n, n), F.lit(0.0))
    u, v = dot(cross(w, e2), n) / nn, dot(cross(e1, w), n) / nn
    inside = F.coalesce((u >= 0) & (v >= 0) & (u + v <= 1), F.lit(False))
    plane = F.abs(dot(w, n)) / F.sqrt(nn)
    sides = F.sqrt(F.least(point_segment_distance2(p, a, b), point_segment_distance2(p, b, c), point_segment_distance2(p, c, a)))
    return F.when(inside, plane).otherwise(sides)


def seg_seg_distance(p1: Vec, q1: Vec, p2: Vec, q2: Vec) -> Column:
    """The least distance of two segments: where the lines come closest, if within both, else from an end."""
    d1, d2, r = sub(q1, p1), sub(q2, p2), sub(p1, p2)
    a, e, b, c, f = dot(d1, d1), dot(d2, d2), dot(d1, d2), dot(d1, r), dot(d2, r)
    det = F.nullif(a * e - b * b, F.lit(0.0))
    s, t = (b * f - c * e) / det, (a * f - b * c) / det
    within = F.coalesce((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), F.lit(False))
    lines = dist2(tuple(p1[i] + s * d1[i] for i in range(3)), tuple(p2[i] + t * d2[i] for i in range(3)))
    ends = F.least(point_segment_distance2(p1, p2, q2), point_segment_distance2(q1, p2, q2), point_segment_distance2(p2, p1, q1), point_segment_distance2(q2, p1, q1))
    return F.sqrt(F.when(within, F.least(lines, ends)).otherwise(ends))

"""Plane polygons with holes: triangulation by ear clipping, and simple tests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]


def _area2(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _holds(a: Point, b: Point, c: Point, p: Point) -> bool:
    """Whether p lies in the counter-clockwise triangle, its border included but not its corners."""
    return p not in (a, b, c) and _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0


def _crosses(a: Point, b: Point, p: Point, q: Point) -> bool:
    """Whether two segments without a common end meet."""
    if {a, b} & {p, q}:
        return False
    u, v, w, x = _turn(a, b, p), _turn(a, b, q), _turn(p, q, a), _turn(p, q, b)
    if u == v == 0:
        return max(min(a, b), min(p, q)) <= min(max(a, b), max(p, q))
    return (u <= 0 <= v or v <= 0 <= u) and (w <= 0 <= x or x <= 0 <= w)


def _bridged(outer: list[Point], holes: list[list[Point]]) -> list[Point]:
    """One ring of the outer one and all holes, each joined by the shortest bridge that crosses nothing."""
    ring = outer if _area2(outer) > 0 else outer[::-1]
    waiting = [h if _area2(h) < 0 else h[::-1] for h in holes]
    while waiting:
        sides = [s for r in [ring, *waiting] for s in zip(r, r[1:] + r[:1], strict=True)]
        choices = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, i, j, k) for k, hole in enumerate(waiting) for i, p in enumerate(ring) for j, q in enumerate(hole))
        for _, i, j, k in choices:
            if not any(_crosses(ring[i], waiting[k][j], *s) for s in sides):
                hole = waiting.pop(k)
                ring = ring[: i + 1] + hole[j:] + hole[: j + 1] + ring[i:]
                break
        else:
            waiting.pop()  # a hole outside its polygon
    return ring


def triangulate(outer: list[Point], holes: list[list[Point]]) -> list[tuple[Point, Point, Point]]:
    """Triangles of a polygon: ears are cut until three corners are left. Rings without area are left out."""
    if len(outer) < 3 or _area2(outer) == 0:
        return []
    ring = _bridged(outer, [h for h in holes if len(h) >= 3 and _area2(h) != 0])
    found = []
    while len(ring) > 3:
        n = len(ring)
        for i in range(n):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % n]
            turn = _turn(a, b, c)
            if turn > 0 and not any(_holds(a, b, c, p) for p in ring) or turn == 0:
                if turn > 0:
                    found.append((a, b, c))
                ring = ring[:i] + ring[i + 1 :]
                break
        else:
            return found  # rings that cross themselves: what could be cut
    if len(ring) == 3 and _turn(*ring) > 0:
        found.append(tuple(ring))
    return found


def polygon_triangulate(polygons: DataFrame) -> DataFrame:
    """(poly_id, tri_id, ax, ay, bx, by, cx, cy) of (poly_id, outer, holes); one polygon is one row's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        point = lambda p: (float(p["x"]), float(p["y"]))
        for pdf in batches:
            rows = [(of, n, *a, *b, *c) for of, outer, holes in zip(pdf.poly_id, pdf.outer, pdf.holes, strict=True) for n, (a, b, c) in enumerate(triangulate([point(p) for p in outer], [[point(p) for p in h] for h in holes]))]
            yield pd.DataFrame(rows, columns=["poly_id", "tri_id", "ax", "ay", "bx", "by", "cx", "cy"])

    return polygons.select("poly_id", "outer", "holes").mapInPandas(run, "poly_id long, tri_id long, ax double, ay double, bx double, by double, cx double, cy double")


def polygon_triangle_count(triangles: DataFrame) -> DataFrame:
    return triangles.groupBy("poly_id").agg(F.count("*").alias("triangles"))


def is_convex(ring: Column) -> Column:
    """Whether all turns of a ring (array of x, y) go one way."""
    n = F.size(ring)
    at = lambda k: F.get(ring, F.pmod(k, n).cast("int"))
    turn = lambda k: (at(k + 1)["x"] - at(k)["x"]) * (at(k + 2)["y"] - at(k)["y"]) - (at(k + 1)["y"] - at(k)["y"]) * (at(k + 2)["x"] - at(k)["x"])
    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    return F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)


def is_planar(ring: Column, tolerance: float = 1e-9) -> Column:
    """Whether all points of a ring (array of x, y, z) lie in the plane of its first three."""
    p = [F.get(ring, F.lit(i)) for i in range(3)]
    u, v = [[p[k][c] - p[0][c] for c in "xyz"] for k in (1, 2)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return F.forall(ring, lambda q: F.abs(sum(((q[c] - p[0][c]) * n[i] for i, c in enumerate("xyz")), F.lit(0.0))) <= tolerance)

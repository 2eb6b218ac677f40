"""Joins of boxes on a grid of levels: what every geometric join here is made of.

Cells double from level to level. A box has its *own* level, the lowest at which it
touches at most three cells in a direction, and is also placed at those higher levels
that are the own level of some box of the other side. Two boxes meet at the higher
of their own levels, and are told in their *reference cell* there: the one of the
larger of both low corners. So the rows that a box is placed in depend neither on
its size nor on how many sizes there are between, each pair is told once without
any exchange to remove copies, and small boxes are never paired off in a large cell.

What has to be known beforehand is a census: how many boxes there are of each binary
order of magnitude, and the box around all, which is one small aggregate.

Boxes are given as SQL expressions, the low corners first: a plan of some hundred
operators is then built by a few calls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import floor, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import exchanged

Box = Sequence[str]

#: Bits of a cell's key that number cells; the others tell the level and which side is at its own.
CELL_BITS = 54
#: Rows of a side, once for each of its cells, up to which it is sent to every task; rows of the other up to which they are dealt out evenly before.
SENT_ROWS, DEALT_ROWS = 100_000, 4_000_000
#: Coordinates beyond this, infinities and NaN are no places.
FAR = "1e300D"


def number(x: float) -> str:
    """A double as SQL has it."""
    return f"({float(x)!r}D)"


def _size(box: Box) -> str:
    half = len(box) // 2
    return "greatest(0D, " + ", ".join(f"{box[i + half]} - {box[i]}" for i in range(half)) + ")"


def _order(size: str) -> str:
    """The binary order of a size: it is at most two to this power."""
    return f"cast(ceil(log2(greatest({size}, 1e-300D))) AS int)"


def is_box(box: Box) -> str:
    """Whether all corners are finite and in order: null and NaN are no places."""
    half = len(box) // 2
    return " AND ".join(f"coalesce({box[i]} >= -{FAR} AND {box[i]} <= {box[i + half]} AND {box[i + half]} <= {FAR}, false)" for i in range(half))


@dataclass(frozen=True)
class Census:
    """How many boxes there are of each binary order, their mean size, the box around all of them, and the sum of what they hold."""

    orders: dict[int, int]
    mean: float
    low: tuple[float, ...]
    high: tuple[float, ...]
    weight: int = 0

    @property
    def n(self) -> int:
        return sum(self.orders.values())


def points_like(other: Census) -> Census:
    """The census of points, which are all of one order, anywhere in the other's box."""
    return Census({-996: 1}, 0.0, other.low, other.high)


def counted(rows: DataFrame, dims: dict[str, int]) -> dict[str, Census]:
    """Censuses of named boxes, rows (name, weight, l0, l1, l2, h0, h1, h2), in one job that gives a row for each name and order; ``dims`` tells each name's dimensions."""
    size = {half: _size([f"l{i}" for i in range(half)] + [f"h{i}" for i in range(half)]) for half in set(dims.values())}
    kind = "CASE name " + " ".join(f"WHEN '{n}' THEN {size[half]}" for n, half in dims.items()) + " END"
    most = max(dims.values())
    rows = rows.where(is_box([*[f"l{i}" for i in range(most)], *[f"h{i}" for i in range(most)]])).selectExpr("*", f"{kind} AS size")
    found = rows.selectExpr("*", f"{_order('size')} AS `order`").groupBy("name", "order").agg(F.expr("count(*) AS n"), F.expr("sum(size) AS size"), F.expr("sum(weight) AS weight"), *[F.expr(f"{f}({c}{i}) AS {c}{i}") for c, f in (("l", "min"), ("h", "max")) for i in range(most)]).collect()
    out = {}
    for name, half in dims.items():
        mine = [r for r in found if r["name"] == name]
        low = tuple(min((r[f"l{i}"] for r in mine), default=0.0) for i in range(half))
        high = tuple(max((r[f"h{i}"] for r in mine), default=0.0) for i in range(half))
        out[name] = Census({r["order"]: r["n"] for r in mine}, sum(r["size"] for r in mine) / max(1, sum(r["n"] for r in mine)), low, high, sum(r["weight"] for r in mine))
    return out


def named_box(name: str, box: Box, weight: str = "1") -> list[str]:
    """The columns that ``counted`` wants; coordinates of dimensions that a box does not have are 0."""
    half = len(box) // 2
    return [f"'{name}' AS name", f"cast({weight} AS bigint) AS weight", *[f"cast({box[i + at * half] if i < half else 0} AS double) AS {c}{i}" for at, c in enumerate("lh") for i in range(3)]]


def censuses(tables: dict[str, tuple[DataFrame, Box]]) -> dict[str, Census]:
    """The census of each table's boxes, in one job."""
    parts = [df.selectExpr(*named_box(name, box)) for name, (df, box) in tables.items()]
    return counted(reduce(DataFrame.unionByName, parts), {name: len(box) // 2 for name, (_, box) in tables.items()})


@dataclass(frozen=True)
class Grid:
    """Cells of both sides: the size of the smallest, the box that they fill, and the levels that each side has."""

    cell: float
    low: tuple[float, ...]
    high: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]

    def _shift(self) -> int:
        return floor(log2(self.cell)) + 1

    def own_of(self, order: int) -> int:
        return max(0, order - self._shift())

    def own(self, box: Box) -> str:
        return f"greatest(0, {_order(_size(box))} - ({self._shift()}))"

    def counts(self, level: int) -> list[int]:
        side = self.cell * 2.0**level
        return [floor((h - l) / side) + 1 for l, h in zip(self.low, self.high, strict=True)]

    def index(self, x: str, i: int, side: str) -> str:
        return f"floor(({x} - {number(self.low[i])}) / {side})"

    def by_level(self, level: str, values: dict[int, str]) -> str:
        """The value of a level, of those that either side has."""
        every = sorted({*self.left, *self.right})
        return values[every[0]] if len(every) == 1 else f"CASE {level} " + " ".join(f"WHEN {v} THEN {values[v]}" for v in every) + " END"

    def side(self, level: str) -> str:
        return self.by_level(level, {v: number(self.cell * 2.0**v) for v in {*self.left, *self.right}})

    def key(self, indices: Sequence[str], level: str, which: str) -> str:
        """One number for each cell of a level: no two cells share one."""
        text = indices[-1]
        for i in range(len(indices) - 2, -1, -1):
            size = self.by_level(level, {v: f"{self.counts(v)[i]}L" for v in {*self.left, *self.right}})
            text = f"({text} * {size} + {indices[i]})"
        return f"(({text} * 64L + {level}) * 2L + {which})"


def _top(cell: float, low: Sequence[float], high: Sequence[float]) -> int:
    """The level above which one cell holds everything, so that there is nothing to tell apart."""
    return max(0, floor(log2(max(max(h - l for l, h in zip(low, high, strict=True)), cell) / cell)) + 2)


def grid_for(left: Census, right: Census, cell: float | None = None, share: float = 2.0) -> Grid | None:
    """The grid of two sides; none if one is empty or they are apart.

    ``cell``: the smallest cell, or ``share`` times the smaller of the mean sizes. It
    is enlarged where its cells could not be numbered.
    """
    low = tuple(max(a, b) for a, b in zip(left.low, right.low, strict=True))
    high = tuple(min(a, b) for a, b in zip(left.high, right.high, strict=True))
    if not left.n or not right.n or any(l > h for l, h in zip(low, high, strict=True)):
        return None
    extent = max(h - l for l, h in zip(low, high, strict=True))
    if not cell:
        means = [c.mean for c in (left, right) if c.mean > 0]
        cell = share * min(means) if means else extent / 1024 or 1.0
    cell = max(float(cell), extent * 1e-9, 1e-150)
    while reduce(lambda a, b: a * b, Grid(cell, low, high, (), ()).counts(0), 1) >= 1 << CELL_BITS:
        cell *= 2
    grid, top = Grid(cell, low, high, (), ()), _top(cell, low, high)
    return Grid(cell, low, high, *[tuple(sorted({min(top, grid.own_of(o)) for o in c.orders})) for c in (left, right)])


def open_grid(right: Census, cell: float | None = None) -> Grid | None:
    """A grid whose left side is not known beforehand, as of a stream: it may have boxes of any size, so the right one is placed at every higher level."""
    grid = grid_for(right, right, cell)
    return grid and Grid(grid.cell, grid.low, grid.high, tuple(range(_top(grid.cell, grid.low, grid.high) + 1)), grid.right)


def placed(rows: DataFrame, box: Box, grid: Grid, left: bool) -> DataFrame:
    """The rows with ``_cell`` (and the left ones with ``_level`` and ``_which``), once for each cell of the grid that they are placed in."""
    mine, other = (grid.left, grid.right) if left else (grid.right, grid.left)
    half = len(box) // 2
    own = f"least({max(mine)}, {grid.own(box)})"
    columns = [f"`{c}`" for c in rows.columns]
    meets = " AND ".join(f"{box[i]} <= {number(grid.high[i])} AND {box[i + half]} >= {number(grid.low[i])}" for i in range(half))
    rows = rows.where(f"{is_box(box)} AND {meets}")
    if len({*mine, *other}) == 1:
        rows, at = rows.selectExpr(*columns), (str(max(mine)), "0")
    else:
        # 0: the left side is at its own level, and the right one at that or below; 1: the right side is, and the left one below
        rows = rows.selectExpr(*columns, f"{own} AS _own")
        here = f"CASE WHEN _own {'>=' if left else '>'} {min(other)} THEN array(named_struct('l', _own, 'w', {0 if left else 1})) ELSE array() END"
        above = f"transform(filter(array({', '.join(map(str, other))}), v -> v {'>' if left else '>='} _own), v -> named_struct('l', v, 'w', {1 if left else 0}))"
        rows = rows.selectExpr(*columns, f"explode(concat({here}, {above})) AS _at").selectExpr(*columns, "_at.l AS _level", "_at.w AS _which")
        columns, at = [*columns, "_level", "_which"], ("_level", "_which")
    side = grid.side(at[0])
    for i in range(half):
        first = f"greatest(0L, {grid.index(box[i], i, side)})"
        last = f"least({grid.index(number(grid.high[i]), i, side)}, {grid.index(box[i + half], i, side)})"
        rows = rows.selectExpr(*columns, f"explode(sequence({first}, greatest({first}, {last}))) AS _i{i}")
        columns.append(f"_i{i}")
    kept = [c for c in columns if not c.startswith("_i") and (left or c not in ("_level", "_which"))]
    return exchanged(rows.selectExpr(*kept, f"{grid.key([f'_i{i}' for i in range(half)], *at)} AS _cell"))


def grid_join(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, sides: tuple[Census, Census] | None = None, on: Sequence[str] = (), cell: float | None = None, share: float = 2.0) -> DataFrame:
    """All pairs of rows whose closed boxes meet (and whose columns ``on`` are equal), each once.

    The columns of both sides must have different names but for ``on``; the boxes
    are expressions over either side. Rows with a null, NaN or infinite corner meet
    nothing. ``sides``: the censuses, if they are known. ``cell`` and ``share``: see
    ``grid_for``; they change nothing but the time taken.
    """
    if sides is None:
        found = censuses({"left": (left, left_box), "right": (right, right_box)})
        sides = found["left"], found["right"]
    grid = grid_for(*sides, cell=cell, share=share)
    return _none(left, right, on) if grid is None else joined_on(grid, left, right, left_box, right_box, on, sides)


def joined_on(grid: Grid, left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, on: Sequence[str] = (), sides: tuple[Census, Census] | None = None) -> DataFrame:
    """``grid_join`` on a grid that is known."""
    half = len(left_box) // 2
    columns = [f"`{c}`" for c in [*left.columns, *[c for c in right.columns if c not in on]]]
    rows = [sum(c.orders.values()) * min(64, 2**half * len(levels)) for c, levels in zip(sides, (grid.right, grid.left), strict=True)] if sides and not on else []
    small = bool(rows) and min(rows) <= SENT_ROWS and max(rows) <= DEALT_ROWS * 8
    if small:  # few rows give many pairs: all cores shall make them
        cores = left.sparkSession.sparkContext.defaultParallelism
        left, right = (left.repartition(cores), right) if rows[1] <= rows[0] else (left, right.repartition(cores))
    one, two = placed(left, left_box, grid, True), placed(right, right_box, grid, False)
    if small:
        one, two = (one, F.broadcast(two)) if rows[1] <= rows[0] else (F.broadcast(one), two)
    met = one.join(two, [*on, "_cell"])
    at = (str(grid.left[0]), "0") if len({*grid.left, *grid.right}) == 1 else ("_level", "_which")
    side = grid.side(at[0])
    reference = [f"greatest(0L, {grid.index(f'greatest({left_box[i]}, {right_box[i]})', i, side)})" for i in range(half)]
    meet = " AND ".join(f"{left_box[i]} <= {right_box[i + half]} AND {right_box[i]} <= {left_box[i + half]}" for i in range(half))
    return met.where(f"{meet} AND _cell = {grid.key(reference, *at)}").selectExpr(*columns)


def _none(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An empty table with the columns of both."""
    kinds = dict(right.dtypes)
    return left.where("false").selectExpr("*", *[f"cast(null AS {kinds[c]}) AS `{c}`" for c in right.columns if c not in on])

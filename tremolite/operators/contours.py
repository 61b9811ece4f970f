"""Regions and polygons of bands, by strips: what lies in a strip of raster rows is found there, then strips are linked."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MMI_BAND_LEVELS
from ..functions import motion as M

#: Rows of a strip: what bounds a task's memory is a strip of one event, so many rows of the raster's width.
STRIP = 64


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each is connected with by the links (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


# --- regions of cells


def _runs(row: np.ndarray, col: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(band, row, c0, c1) of the runs of one band in a row, from cells; in order of row and column."""
    order = np.lexsort((col, row))
    row, col, band = row[order], col[order], band[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (band[1:] != band[:-1])
    at = np.flatnonzero(first)
    return band[at], row[at], col[at], col[np.append(at[1:], len(row)) - 1]


def overlaps(band: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of one band that share a column in rows next to each other. Runs of a row don't overlap, so those that a
    run meets stand one after the other."""
    wide = int(c1.max(initial=0)) + 2
    low, high = row * wide + c0, row * wide + c1
    a = np.searchsorted(high, (row + 1) * wide + c0)
    b = np.searchsorted(low, (row + 1) * wide + c1, "right")
    n = np.maximum(b - a, 0)
    u = np.repeat(np.arange(len(row)), n)
    v = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    same = band[u] == band[v]
    return u[same], v[same]


_RUN = "event_id long, mmi_lower int, row int, c0 int, c1 int, at_row int, at_col int"


def _strip_regions(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
    band, row, c0, c1 = _runs(*(cells.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "mmi_lower")))
    label = components(len(row), *overlaps(band, row, c0, c1))
    columns = [band, row, c0, c1, row[label], c0[label]]
    return pa.table([pa.array(np.full(len(row), key[0].as_py(), np.int64)), *(pa.array(c.astype(np.int32)) for c in columns)], names=[c.split()[0] for c in _RUN.split(", ")])


_LINK = "event_id long, mmi_lower int, at_row int, at_col int, to_row int, to_col int"


def _linked(key: tuple[pa.Scalar, ...], links: pa.Table) -> pa.Table:
    """The least region that each one of an event's band is connected with, across strips."""
    a, b = (np.stack([links.column(f"{side}_{c}").to_numpy().astype(np.int64) for c in ("row", "col")], 1) for side in ("at", "to"))
    names, place = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    place = place.reshape(-1)
    to = names[components(len(names), place[: len(a)], place[len(a) :])]
    known = [np.full(len(names), k.as_py()) for k in key]
    return pa.table([pa.array(c.astype(t)) for c, t in zip([*known, *names.T, *to.T], [np.int64, *[np.int32] * 5], strict=True)], names=[c.split()[0] for c in _LINK.split(", ")])


def region_runs(bands: DataFrame, strip: int = STRIP) -> DataFrame:
    """(event_id, mmi_lower, row, c0, c1, region_id): runs of a band's cells in a raster row and the region of each, a struct
    of row and col. A region is what is connected (four neighbours), named by its least cell.

    Regions are found inside strips of raster rows, one task for each strip of an event. Regions that meet at a strip's edge
    are links, few enough for one task a band of an event, and name each other there. The strips' runs are checkpointed, so
    the session needs a checkpoint folder (``spark.checkpoint.dir``, or ``setCheckpointDir``).
    """
    key = ["event_id", "mmi_lower"]
    cells = bands.select(F.col("event_id").cast("long"), F.col("mmi_lower").cast("int"), F.col("row").cast("int"), F.col("col").cast("int"))
    runs = cells.groupBy("event_id", F.floor(F.col("row") / strip).alias("strip")).applyInArrow(_strip_regions, _RUN).checkpoint()
    edge = lambda n, name: runs.filter(F.pmod("row", F.lit(strip)) == n).select(*key, "row", F.explode(F.sequence("c0", "c1")).alias("col"), F.col("at_row").alias(f"{name}_row"), F.col("at_col").alias(f"{name}_col"))
    met = edge(strip - 1, "at").withColumn("row", F.col("row") + 1).join(edge(0, "to"), [*key, "row", "col"])
    to = met.select(*key, "at_row", "at_col", "to_row", "to_col").distinct().groupBy(*key).applyInArrow(_linked, _LINK)
    named = runs.join(to, [*key, "at_row", "at_col"], "left")
    region = F.struct(F.coalesce("to_row", "at_row").alias("row"), F.coalesce("to_col", "at_col").alias("col"))
    return named.select(*key, "row", "c0", "c1", region.alias("region_id"))


# --- polygons of bands

#: Sides of a quad of cell centres; by which corners (1 north-west, 2 north-east, 4 south-east, 8 south-west) are at a
#: level or above it, the segments of the isoline, the higher ground on their left. 5 and 10 are saddles with a low middle.
NORTH, EAST, SOUTH, WEST = range(4)
SEGMENTS = {
    1: [(WEST, NORTH)], 2: [(NORTH, EAST)], 3: [(WEST, EAST)], 4: [(EAST, SOUTH)], 6: [(NORTH, SOUTH)], 7: [(WEST, SOUTH)], 8: [(SOUTH, WEST)], 9: [(SOUTH, NORTH)],
    11: [(SOUTH, EAST)], 12: [(EAST, WEST)], 13: [(EAST, NORTH)], 14: [(NORTH, WEST)], 5: [(WEST, NORTH), (EAST, SOUTH)], 10: [(NORTH, EAST), (SOUTH, WEST)],
}
#: Saddles with a high middle.
HIGH = {5: [(EAST, NORTH), (WEST, SOUTH)], 10: [(NORTH, WEST), (SOUTH, EAST)]}
#: The same as arrays: first and second segment, side from and to, by corners and 16 more for a high middle; -1 for none.
_SEGMENT = np.full((2, 2, 32), -1)
for _code, _pairs in [*SEGMENTS.items(), *((c + 16, pairs) for c, pairs in HIGH.items())]:
    for _n, _pair in enumerate(_pairs):
        _SEGMENT[_n, :, _code] = _pair


class Strip:
    """Cell centres of one event in a strip: rows ``r0`` on and columns ``c0`` on of a raster of ``height`` and ``width``.

    A side joins two neighbouring centres. Sides are numbered: first those along rows, then those along columns. An isoline
    crosses a side at a point that both quads beside it compute alike, so the number of the side and the level name the point.
    """

    def __init__(self, mmi: np.ndarray, r0: int, c0: int, grid: tuple) -> None:
        self.mmi, self.r0, self.c0 = mmi, r0, c0
        self.x0, self.y0, self.dx, self.dy, self.width, self.height = grid
        h, w = mmi.shape
        self.h, self.w, self.n_across = h, w, h * (w - 1)
        self.n_sides = self.n_across + (h - 1) * w

    @cached_property
    def sides(self) -> np.ndarray:
        return self.sides_of(*np.mgrid[0 : self.h - 1, 0 : self.w - 1])

    def sides_of(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The four sides of quads."""
        return np.stack([r * (self.w - 1) + c, self.n_across + r * self.w + c + 1, (r + 1) * (self.w - 1) + c, self.n_across + r * self.w + c])

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest intensity of each side."""
        p, q = (np.concatenate([self.mmi[a].ravel(), self.mmi[b].ravel()]) for a, b in ((np.s_[:, :-1], np.s_[:-1]), (np.s_[:, 1:], np.s_[1:])))
        return np.minimum(p, q), np.maximum(p, q)

    @cached_property
    def middle(self) -> np.ndarray:
        mmi = self.mmi
        return (mmi[:-1, :-1] + mmi[:-1, 1:] + mmi[1:, 1:] + mmi[1:, :-1]) / 4

    def code(self, level: float) -> np.ndarray:
        m = (self.mmi >= level).astype(np.int8)
        return m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, 1:] + 8 * m[1:, :-1]

    def segments(self, level: float) -> tuple[np.ndarray, np.ndarray]:
        """The isoline's segments as sides from and to."""
        code = self.code(level).ravel()
        at = np.flatnonzero((code != 0) & (code != 15))
        code, r, c = code[at].astype(np.int64), at // (self.w - 1), at % (self.w - 1)
        saddle = np.flatnonzero((code == 5) | (code == 10))
        code[saddle[self.middle[r[saddle], c[saddle]] >= level] if len(saddle) else saddle] += 16
        sides, quad = self.sides_of(r, c), np.arange(len(at))
        u, v = (sides[_SEGMENT[0, k, code], quad] for k in (0, 1))
        if len(saddle):
            u, v = (np.append(one, sides[_SEGMENT[1, k, code[saddle]], saddle]) for k, one in ((0, u), (1, v)))
        return u, v

    def parts(self, lower: float, upper: float) -> np.ndarray:
        """For each side that lies in the band somewhere, the part of the band that it belongs to; -1 for others."""
        least, most = self.ends
        inside = (least < upper) & (most >= lower)
        code, next_code = self.code(lower), self.code(upper)
        # a saddle splits the band inside a quad: by a low middle around its high corners, by a high one around its low ones
        low, high = self.middle < lower, self.middle >= upper
        west_north = (code == 5) & low | (next_code == 10) & high  # the two parts are at the north-west and south-east
        north_east = (code == 10) & low | (next_code == 5) & high
        whole = ~west_north & ~north_east
        u, v = [], []
        for a, b, where in ((NORTH, WEST, whole | west_north), (EAST, SOUTH, whole | west_north), (NORTH, EAST, whole | north_east), (SOUTH, WEST, whole | north_east), (NORTH, SOUTH, whole), (EAST, WEST, whole)):
            both = where & inside[self.sides[a]] & inside[self.sides[b]]
            u.append(self.sides[a][both])
            v.append(self.sides[b][both])
        return np.where(inside, components(self.n_sides, np.concatenate(u), np.concatenate(v)), -1)

    def rim(self, lower: float, upper: float) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the raster's rim that lie in the band, the raster on their left, as nodes (``node``) from and to."""
        h, w = self.h, self.w
        around = []  # centres along the rim, in order
        if self.c0 == 0:
            around.append([(r, 0) for r in range(h)])
        if self.r0 + h == self.height:
            around.append([(h - 1, c) for c in range(w)])
        if self.c0 + w == self.width:
            around.append([(r, w - 1) for r in reversed(range(h))])
        if self.r0 == 0:
            around.append([(0, c) for c in reversed(range(w))])
        u, v = [], []
        for line in around:
            for (r, c), (s, d) in zip(line, line[1:], strict=False):
                side = min(r, s) * (w - 1) + min(c, d) if r == s else self.n_across + min(r, s) * w + c
                a, b = self.mmi[r, c], self.mmi[s, d]
                if max(a, b) < lower or min(a, b) >= upper:
                    continue
                at = lambda m, here, side=side: self.node(side, int(m >= upper)) if not lower <= m < upper else self.corner(*here)
                u.append(at(a, (r, c)))
                v.append(at(b, (s, d)))
        return np.array(u, np.int64), np.array(v, np.int64)

    def node(self, side: np.ndarray, upper: int) -> np.ndarray:
        """The point where the lower or upper level of a band crosses a side."""
        return 2 * side + upper

    def corner(self, r: int, c: int) -> int:
        return 2 * self.n_sides + r * self.w + c

    def points(self, nodes: np.ndarray, lower: float, upper: float) -> tuple[np.ndarray, np.ndarray]:
        """Longitude and latitude of nodes."""
        corner = nodes >= 2 * self.n_sides
        side, level = np.where(corner, 0, nodes // 2), np.where(nodes % 2 == 1, upper, lower)
        along = side >= self.n_across
        n = np.where(along, side - self.n_across, side)
        row, col = np.where(along, n // self.w, n // max(1, self.w - 1)), np.where(along, n % self.w, n % max(1, self.w - 1))
        p, q = self.mmi[row, col], self.mmi[row + along, np.where(along, col, np.minimum(col + 1, self.w - 1))]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (level - p) / (q - p)
        own = nodes - 2 * self.n_sides
        row = np.where(corner, own // self.w, row + np.where(along, t, 0))
        col = np.where(corner, own % self.w, col + np.where(along, 0, t))
        return self.x0 + (self.c0 + col + 0.5) * self.dx, self.y0 - (self.r0 + row + 0.5) * self.dy

    def name(self, node: int) -> int:
        """A node on the first or last row, as the strip beside it names it too."""
        if node >= 2 * self.n_sides:
            row, col = divmod(node - 2 * self.n_sides, self.w)
            return -1 - ((self.r0 + row) * self.width + self.c0 + col)
        row, col = divmod(node // 2, self.w - 1)
        return 2 * ((self.r0 + row) * self.width + self.c0 + col) + node % 2


def _paths(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[bool, list[int]]]:
    """(closed, nodes) of the lines that segments make; each node begins one and ends one at most."""
    to = dict(zip(u.tolist(), v.tolist(), strict=True))
    for begin in sorted(set(u.tolist()) - set(v.tolist())):
        line = [begin]
        while (n := to.pop(line[-1], None)) is not None:
            line.append(n)
        yield False, line
    while to:
        begin, n = to.popitem()
        line = [begin]
        while n != begin:
            line.append(n)
            n = to.pop(n)
        yield True, line


def _areas(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The areas of lines that end where ``ends`` say, by the shoelace formula: positive if a line runs counter-clockwise.
    Taken from each line's first point, to keep digits."""
    if not len(ends):
        return np.zeros(0)
    begins = np.append(0, ends[:-1])
    after = np.arange(1, len(x) + 1)
    after[ends - 1] = begins
    x, y = (c - np.repeat(c[begins], ends - begins) for c in (x, y))
    return np.add.reduceat(x * y[after] - x[after] * y, begins) / 2


PIECE = "event_id long, mmi_lower int, part long, kind string, begin long, end long, area double, x array<double>, y array<double>, sides array<long>"
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
_PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _as_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECE_NAMES)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)


def pieces_of(event: int, n: int, grown: np.ndarray, r0: int, c0: int, grid: tuple, levels: tuple[int, ...], strip: int) -> list[tuple]:
    """Rings of an event in strip ``n`` and, of parts that reach the strip's edge, open lines and the sides by which they go on."""
    out: list[tuple] = []
    if min(grown.shape) < 2:
        return out
    s, top, w = Strip(grown, r0, c0, grid), float(grown.max()), grown.shape[1]
    line_of = {level: s.segments(level) for level in levels if level <= top}
    for lower, upper in zip(levels, [*levels[1:], np.inf], strict=True):
        if lower > top:
            break
        part = s.parts(lower, upper)
        (u, v), (p, q) = line_of[lower], line_of.get(upper, (np.zeros(0, np.int64),) * 2)
        a, b = s.rim(lower, upper)
        u, v = np.concatenate([s.node(u, 0), s.node(q, 1), a]), np.concatenate([s.node(v, 0), s.node(p, 1), b])
        across = np.arange(s.n_across)
        edge = across[((across // (w - 1) + r0 == n * strip) & (n > 0) | (across // (w - 1) + r0 == (n + 1) * strip)) & (part[: s.n_across] >= 0)]
        going = set(part[edge].tolist())
        whole = lambda p: n << 40 | int(p)
        for p in going:
            sides = [s.name(2 * int(e)) for e in edge[part[edge] == p]]
            out.append((event, lower, whole(p), "sides", None, None, None, None, None, sides))
        found = list(_paths(u, v))
        x, y = s.points(np.array([i for _, line in found for i in line], np.int64), lower, upper)
        ends = np.cumsum([len(line) for _, line in found])
        for (closed, line), area, b in zip(found, _areas(x, y, ends), ends.tolist(), strict=True):
            side = next((i // 2 for i in line if i < 2 * s.n_sides), None)
            if side is None:  # corners of the raster alone: the band holds all of it that lies here
                side = int(np.flatnonzero(part >= 0)[0])
            p, at = int(part[side]), slice(b - len(line), b)
            if not closed:
                out.append((event, lower, whole(p), "line", s.name(line[0]), s.name(line[-1]), None, x[at], y[at], None))
            elif area or p in going:
                out.append((event, lower, whole(p), "open ring" if p in going else "ring", None, None, float(area), x[at], y[at], None))
    return out


def rings_of(grown: np.ndarray, r0: int, c0: int, grid: tuple, levels: tuple[int, ...]) -> Iterator[tuple]:
    """(lower, part, area, x, y) of the rings of an event that lies in one strip, parts numbered by band.

    On a row of centres a band goes from one crossing to the next. Such pieces link the rings of a part and no others: a
    hole's westernmost one leads to a ring further west, and so on to the outer ring.
    """
    if min(grown.shape) < 2:
        return
    s, top, w = Strip(grown, r0, c0, grid), float(grown.max()), grown.shape[1]
    nothing = (np.zeros(0, np.int64),) * 2
    line_of = {level: s.segments(level) for level in levels if level <= top}
    for lower, upper in zip(levels, [*levels[1:], np.inf], strict=True):
        if lower > top:
            break
        (u, v), (p, q), (a, b) = line_of[lower], line_of.get(upper, nothing), s.rim(lower, upper)
        lines = [line for _, line in _paths(np.concatenate([s.node(u, 0), s.node(q, 1), a]), np.concatenate([s.node(v, 0), s.node(p, 1), b]))]
        if not lines:
            continue
        nodes, many = np.array([i for line in lines for i in line], np.int64), np.array([len(line) for line in lines])
        x, y = s.points(nodes, lower, upper)
        ends = np.cumsum(many)
        label = np.zeros(len(lines), np.int64)
        if len(lines) > 1:
            # where nodes lie on the rows of centres, in order, and whether the band goes on after them
            ring = np.repeat(np.arange(len(lines)), many)
            at = np.flatnonzero(nodes < 2 * s.n_across)
            side, level = nodes[at] // 2, nodes[at] % 2
            row, col = side // (w - 1), side % (w - 1)
            rising = grown[row, col] < grown[row, col + 1]
            place, on = 4 * side + 1 + (level == rising), (level == 0) == rising
            corner = np.flatnonzero(nodes >= 2 * s.n_sides)
            if len(corner):
                r, c = np.divmod(nodes[corner] - 2 * s.n_sides, w)
                of = (c == 0) | (c == w - 1)
                corner, r, first = corner[of], r[of], c[of] == 0
                at, row, on = np.append(at, corner), np.append(row, r), np.append(on, first)
                place = np.append(place, np.where(first, 4 * r * (w - 1), 4 * (r + 1) * (w - 1) - 1))
            order = np.argsort(place)
            row, on, ring = row[order], on[order], ring[at[order]]
            link = on[:-1] & (row[1:] == row[:-1]) & (ring[1:] != ring[:-1])
            label = components(len(lines), ring[:-1][link], ring[1:][link])
        for part, area, b, n in zip(label.tolist(), _areas(x, y, ends).tolist(), ends.tolist(), many.tolist(), strict=True):
            if area:
                yield lower, part, area, x[b - n : b], y[b - n : b]


def _strip_pieces(grid: tuple, levels: tuple[int, ...], strip: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        row, col, mmi = (cells.column(c).to_numpy() for c in ("row", "col", "mmi"))
        r0, c0 = int(row.min()), int(col.min())
        grown = np.full((int(np.ptp(row)) + 1, int(np.ptp(col)) + 1), -1.0)
        grown[row - r0, col - c0] = mmi
        return _as_table(pieces_of(key[0].as_py(), key[1].as_py(), grown, r0, c0, grid, levels, strip))

    return run


def _joined(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
    """The rings of an event's band that lie in several strips; parts that share a side are one, the least of them."""
    event, lower = (k.as_py() for k in key)
    rows = pieces.to_pylist()
    parts = sorted({r["part"] for r in rows})
    place = {p: n for n, p in enumerate(parts)}
    owner: dict[int, int] = {}
    u, v = [], []
    for r in rows:
        for side in r["sides"] or ():
            u.append(place[r["part"]])
            v.append(owner.setdefault(side, place[r["part"]]))
    label = components(len(parts), np.array(u, np.int64), np.array(v, np.int64))
    of = {p: parts[label[n]] for p, n in place.items()}
    out = []
    lines = {r["begin"]: r for r in rows if r["kind"] == "line"}
    for r in rows:
        if r["kind"] == "open ring" and r["area"]:
            out.append((event, lower, of[r["part"]], "ring", None, None, r["area"], r["x"], r["y"], None))
    while lines:
        _, line = lines.popitem()
        begin, end, x, y = line["begin"], line["end"], line["x"][:-1], line["y"][:-1]
        while end != begin:
            more = lines.pop(end)
            end, x, y = more["end"], x + more["x"][:-1], y + more["y"][:-1]
        area = float(_areas(np.array(x), np.array(y), np.array([len(x)]))[0])
        if area:
            out.append((event, lower, of[line["part"]], "ring", None, None, area, x, y, None))
    return _as_table(out)


def band_rings(surface: DataFrame, grid: tuple, levels: tuple[int, ...] = MMI_BAND_LEVELS, strip: int = STRIP) -> DataFrame:
    """(event_id, mmi_lower, part, hole, area, x, y): the rings of filled bands, corners in order and not repeated at the end.

    Between two cell centres intensity is linear; a band holds what is at its level or above and below the next one. Outer
    rings run counter-clockwise and have a positive area, holes the other way; the rings of one part of a band are a polygon
    with its holes. ``surface`` has to hold the neighbours of each cell at the least level or above (``intensity.surfaces``
    with ``margin``), ``grid`` is (x0, y0, dx, dy, width, height).

    A strip of raster rows of one event is a task: it joins segments by their ends and finds which sides a part reaches. Parts
    that end there are done; of the others lines and rings meet once more, one task for what of an event's band reaches a
    strip's edge. The strips' pieces are checkpointed, so the session needs a checkpoint folder.
    """
    cells = surface.select(F.col("event_id").cast("long"), F.col("row").cast("int"), F.col("col").cast("int"), F.col("mmi").cast("double"))
    own = F.floor(F.col("row") / strip)
    both = F.when((F.pmod("row", F.lit(strip)) == 0) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    pieces = cells.withColumn("strip", F.explode(both)).groupBy("event_id", "strip").applyInArrow(_strip_pieces(grid, levels, strip), PIECE).checkpoint()
    return joined_rings(pieces)


def joined_rings(pieces: DataFrame) -> DataFrame:
    """The rings of ``band_rings`` from the pieces that ``pieces_of`` makes of each strip; they are read twice."""
    joined = pieces.filter("kind <> 'ring'").groupBy("event_id", "mmi_lower").applyInArrow(_joined, PIECE)
    rings = pieces.filter("kind = 'ring'").unionByName(joined)
    return rings.select("event_id", "mmi_lower", "part", (F.col("area") < 0).alias("hole"), "area", "x", "y")


def closed_ring(x: Column, y: Column) -> Column:
    points = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.transform(F.concat(points, F.slice(points, 1, 1)), lambda p: F.array(p["x"], p["y"]))


def band_polygons(rings: DataFrame, min_area: float = 0.0) -> DataFrame:
    """(event_id, mmi_lower, part, area, n_holes, geometry): a GeoJSON polygon for each part of a band, its outer ring first,
    then its holes by place; those below ``min_area`` square degrees go. geometry is array<array<array<double>>>, rings closed."""
    ring = F.struct("hole", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"), closed_ring(F.col("x"), F.col("y")).alias("points"))
    polygons = rings.groupBy("event_id", "mmi_lower", "part").agg(F.sum("area").alias("area"), F.sum(F.col("hole").cast("int")).alias("n_holes"), F.array_sort(F.collect_list(ring)).alias("rings"))
    return polygons.filter((F.col("area") >= min_area) & (F.col("area") > 0)).select("event_id", "mmi_lower", "part", "area", "n_holes", F.transform("rings", lambda r: r["points"]).alias("geometry"))


def polygon_features(polygons: DataFrame) -> DataFrame:
    """(event_id, mmi_lower, part, feature): a GeoJSON feature for each polygon, with the band's bounds, colour and label."""
    low = F.col("mmi_lower")
    props = F.struct("mmi_lower", M.band_upper(low).alias("mmi_upper"), M.band_color(low).alias("color"), M.mmi_class_label(low).alias("label"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("geometry").alias("coordinates"))
    return polygons.select("event_id", "mmi_lower", "part", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def _read_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read, points, ends, of = [], [np.zeros((0, 2))], [], []
        for feature in batch.column(1):
            f = json.loads(feature.as_py())
            rings = f["geometry"]["coordinates"]
            of += [len(read)] * len(rings)
            ends += [len(r) for r in rings]
            points.append(np.array([corner for r in rings for corner in r]))
            read.append(f["properties"])
        at = np.concatenate(points)
        area = np.bincount(of, _areas(at[:, 0], at[:, 1], np.cumsum(np.array(ends, np.int64))), len(read))
        columns = [pa.array([r[c] for r in read], t) for c, t in (("mmi_lower", pa.int32()), ("mmi_upper", pa.int32()), ("color", pa.string()), ("label", pa.string()))]
        yield pa.record_batch([batch.column(0), *columns, pa.array(area, pa.float64())], names=["event_id", "mmi_lower", "mmi_upper", "color", "label", "area"])


def read_features(features: DataFrame) -> DataFrame:
    """(event_id, mmi_lower, mmi_upper, color, label, area): the properties of GeoJSON features of polygons, and the area within their
    rings' corners, from each ring's first one, so that the digits of far corners don't cancel."""
    return features.select("event_id", "feature").mapInArrow(_read_features, "event_id long, mmi_lower int, mmi_upper int, color string, label string, area double")


def export_polygons(polygons: DataFrame, levels: tuple[int, ...] | None = None) -> DataFrame:
    """(event_id, mmi_low, mmi_high, color, geometry): rows to export, of the given levels or all; each polygon as a multi-polygon of one."""
    chosen = polygons.filter(F.col("mmi_lower").isin(*levels)) if levels is not None else polygons
    low = F.col("mmi_lower")
    return chosen.select("event_id", low.alias("mmi_low"), M.band_upper(low).alias("mmi_high"), M.band_color(low).alias("color"), F.array("geometry").alias("geometry"))

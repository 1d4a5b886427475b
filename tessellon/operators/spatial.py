"""Spatial predicates over cells, and multi-order coverage.

A target is a cap, a lon/lat box, or a geometry (points, lines, polygons with holes) given in degrees. A query descends
level by level: a cell goes on only if its subtree's cap meets the target's, which is exact enough for a frontier the
size of the target's border; exact predicates are decided on the leaves. The frontier is kept in numpy on the driver up
to DRIVER_CELLS cells and in a DataFrame beyond that, so a query over a large part of a fine level stays distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellon.functions import sphere
from tessellon.operators import regions
from tessellon.systems.base import GridSystem, system

#: A frontier of more cells than this is descended on the executors.
DRIVER_CELLS = 200_000
#: Degrees between the points put on the sides of a box, whose parallels are no great circles.
BOX_STEP = 2.0

PREDICATES = ("intersects", "within", "contains", "covers", "coveredby", "touches", "overlaps", "equals", "disjoint", "crosses")


@dataclass
class Target:
    """kind: cap, polygon, line or point; parts are rings (exterior first), lines, or points on the sphere."""

    kind: str
    parts: list[list[np.ndarray]] = field(default_factory=list)
    centre: np.ndarray | None = None
    radius: float = 0.0
    #: A box of more than a quarter of all longitudes, in degrees: it may hold more than a hemisphere, so that the area of
    #: its ring does not tell its inside; the degrees do.
    wide: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if self.kind == "cap":
            return
        points = np.concatenate([r for p in self.parts for r in p])
        c = points.sum(0)
        size = np.linalg.norm(c)
        self.centre = c / size if size > 1e-9 else points[0]
        self.radius = float(sphere.distance(points, self.centre).max()) * sphere.CAP_SLACK
        if self.radius >= np.pi / 2:
            self.radius = np.pi
        if self.kind == "polygon":
            # Exteriors counter-clockwise, holes clockwise; wide boxes are made so.
            if self.wide is not None:
                self.radius = np.pi
            self.parts = self.parts if self.wide is not None else [[_wound(r, k == 0) for k, r in enumerate(p)] for p in self.parts]
        rings = [r for p in self.parts for r in p]
        if self.kind == "polygon":
            self.a = np.concatenate(rings)
            self.b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
        elif self.kind == "line":
            self.a = np.concatenate([r[:-1] for r in rings])
            self.b = np.concatenate([r[1:] for r in rings])

    def holds(self, p: np.ndarray) -> np.ndarray:
        """1 inside, 0 outside, -1 on the border."""
        if self.kind == "cap":
            d = sphere.distance(p, self.centre)
            return (d <= self.radius).astype(int)
        if self.kind != "polygon":
            return np.zeros(len(p), int)
        if self.wide is not None:
            return _in_box(p, self.a, self.b, self.wide)
        out = np.zeros(len(p), int)
        for part in self.parts:
            state = np.stack([sphere.point_in_ring(r if k == 0 else r[::-1], p) for k, r in enumerate(part)])
            inside = (state[0] == 1) & (state[1:] == 0).all(0)
            border = (state == -1).any(0)
            out = np.where(inside, 1, np.where(border & (out == 0), -1, out))
        return out


def _in_box(p: np.ndarray, a: np.ndarray, b: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """1, 0 or -1 (on the border) by degrees; near a parallel by the side of the border's arc, which runs off it."""
    x0, x1, y0, y1 = box
    lon, lat = sphere.lonlat(p)
    along = np.mod(lon - x0, 360.0)
    # The arc between two points of a parallel rises towards the pole: its latitude at a longitude, from the middle's.
    steps = max(2, int((x1 - x0) / BOX_STEP) + 2) - 1
    width = np.radians((x1 - x0) / steps)
    off = np.radians(np.mod(along, (x1 - x0) / steps)) - width / 2
    low, high = (np.degrees(np.arctan(np.tan(np.radians(y)) * np.cos(off) / np.cos(width / 2))) if abs(y) < 90 else np.full(len(p), y * 2.0) for y in (y0, y1))
    out = ((along < x1 - x0) & (along > 0) & (lat > low) & (lat < high)).astype(int)
    tol = 1e-10
    side = ((np.abs(along) < tol) | (np.abs(along - (x1 - x0)) < tol) | (np.abs(along - 360) < tol)) & (lat >= low - tol) & (lat <= high + tol)
    edge = (along <= x1 - x0 + tol) & ((np.abs(lat - low) < tol) | (np.abs(lat - high) < tol))
    return np.where((side | edge) & (np.abs(lat) < 90), -1, out)


def _wound(ring: np.ndarray, ccw: bool) -> np.ndarray:
    if len(ring) > 1 and np.allclose(ring[0], ring[-1], atol=1e-15):
        ring = ring[:-1]
    positive = sphere.ring_area(ring[None])[0] > 0
    return ring if positive == ccw else ring[::-1]


def cap(lon: float, lat: float, radius_degrees: float) -> Target:
    return Target("cap", centre=sphere.unit_point(np.array([lon]), np.array([lat]))[0], radius=float(np.radians(radius_degrees)))


def box(x0: float, x1: float, y0: float, y1: float) -> Target:
    """A lon/lat box; an antimeridian box (x0 > x1) and a band of all longitudes away from the poles are refused."""
    if x0 > x1:
        raise ValueError("a box across the antimeridian must be split in two")
    if x1 - x0 >= 360:
        if y1 >= 90:
            return cap(0, 90, 90 - y0)
        if y0 <= -90:
            return cap(0, -90, 90 + y1)
        raise ValueError("a box of all longitudes has no border of its own; use polar boxes")

    def side(a, b):
        return np.linspace(a, b, max(2, int(abs(b - a) / BOX_STEP) + 2))[:-1]

    lon = np.concatenate([side(x0, x1), np.full(len(side(y0, y1)), x1), side(x1, x0), np.full(len(side(y1, y0)), x0)])
    lat = np.concatenate([np.full(len(side(x0, x1)), y0), side(y0, y1), np.full(len(side(x1, x0)), y1), side(y1, y0)])
    return Target("polygon", [[sphere.unit_point(lon, lat)]], wide=(x0, x1, y0, y1) if x1 - x0 > 90 else None)


def polygon(*rings) -> Target:
    """Rings of (lon, lat): the first is the exterior, the others holes."""
    return multipolygon([rings])


def multipolygon(polygons) -> Target:
    return Target("polygon", [[sphere.unit_point(*np.asarray(r, float).T) for r in p] for p in polygons])


def line(*lines) -> Target:
    return Target("line", [[sphere.unit_point(*np.asarray(r, float).T)] for r in lines])


def points(lonlats) -> Target:
    return Target("point", [[sphere.unit_point(*np.asarray(lonlats, float).T)]])


def as_target(t) -> Target:
    """A Target, a box (x0, x1, y0, y1), or rings of (lon, lat)."""
    if isinstance(t, Target):
        return t
    if len(t) == 4 and all(np.isscalar(v) for v in t):
        return box(*t)
    return polygon(*t)


# --- cells against a target ---------------------------------------------------------------------------------------


def relate(s: GridSystem, pos: np.ndarray, level: int, target: Target) -> pd.DataFrame:
    """For each cell: whether the interiors meet, whether the border is crossed, whether the cell lies within, and
    whether it holds the target."""
    rings = s.boundary(pos, level)
    centre = s.centroid(pos, level)
    n = len(pos)
    if target.kind == "cap":
        d = sphere.distance(centre, target.centre)
        # The nearest and farthest points of the ring from the cap's centre.
        near, far = np.zeros(n), np.zeros(n)
        reach = np.nanmax(sphere.distance(rings, centre[:, None]), 1) * sphere.CAP_SLACK
        apart = d > target.radius + reach
        near[apart], far[apart] = 10.0, 10.0
        # Cells that the cap's border may pass; the others are apart from it or within.
        for i in np.flatnonzero(~apart & ~(d + reach < target.radius)):
            r = rings[i][~np.isnan(rings[i][:, 0])]
            near[i] = sphere.arc_distance(r, np.roll(r, -1, axis=0), target.centre[None]).min()
            far[i] = np.pi - sphere.arc_distance(r, np.roll(r, -1, axis=0), -target.centre[None]).min()
        holds_centre = _cells_hold(s, rings, centre, np.broadcast_to(target.centre, (n, 3)))
        meets = (d <= target.radius) | (near <= target.radius) | holds_centre
        antipode = _cells_hold(s, rings, centre, np.broadcast_to(-target.centre, (n, 3)))
        within = (far <= target.radius) & ~antipode
        return pd.DataFrame({"meets": meets, "touches": meets & (near == target.radius), "within": within, "holds": holds_centre & (near >= target.radius), "border": meets & ~within})
    meets, within, holds, border, edge = (np.zeros(n, bool) for _ in range(5))
    state = target.holds(centre)
    todo = range(n)
    if target.kind != "point" and n:
        # Cells whose cap is clear of the target's border lie within it or apart from it, as their centre does.
        reach = np.nanmax(sphere.distance(rings, centre[:, None]), 1)
        near = np.empty(n)
        step = max(1, 4_000_000 // (8 * len(target.a)))
        for lo in range(0, n, step):
            near[lo : lo + step] = sphere.arc_distance(target.a, target.b, centre[lo : lo + step]).min(1)
        clear = near > reach * sphere.CAP_SLACK
        meets[clear] = state[clear] != 0
        within[clear] = (state[clear] == 1) & (target.kind == "polygon")
        todo = np.flatnonzero(~clear)
    for i in todo:
        r = rings[i][~np.isnan(rings[i][:, 0])]
        nxt = np.roll(r, -1, axis=0)
        if target.kind == "point":
            inside = sphere.point_in_ring(r, target.parts[0][0])
            meets[i], border[i], holds[i], edge[i] = (inside != 0).any(), (inside == -1).any(), (inside != 0).all(), (inside != 1).all() and (inside == -1).any()
            continue
        reach = sphere.distance(r, centre[i]).max()
        near = sphere.arc_distance(target.a, target.b, centre[i][None])[0]
        close = near <= reach * sphere.CAP_SLACK
        crossed = sphere.arcs_cross(r, nxt, target.a[close], target.b[close]).any() if close.any() else False
        vertex = sphere.point_in_ring(r, target.a[close]) if close.any() else np.zeros(0, int)
        border[i] = crossed or (vertex != 0).any()
        meets[i] = border[i] or state[i] != 0
        if target.kind == "polygon":
            corners = target.holds(r)
            # Within: no border of the target inside the cell, every corner in or on it, the centre inside.
            mid = target.holds((r + nxt) / np.linalg.norm(r + nxt, axis=1, keepdims=True))
            proper = _proper_crossing(r, nxt, target.a[close], target.b[close]) if close.any() else False
            within[i] = state[i] == 1 and (corners != 0).all() and (mid != 0).all() and not proper and not (vertex == 1).any()
            inner = state[i] == 1 or (corners == 1).any() or (mid == 1).any() or proper or (vertex == 1).any()
            edge[i] = meets[i] and not inner
            all_in = sphere.point_in_ring(r, target.a)
            holds[i] = (all_in != 0).all() and not proper and target.radius < np.pi / 2
        else:
            all_in = sphere.point_in_ring(r, np.concatenate([target.a, target.b]))
            proper = _proper_crossing(r, nxt, target.a[close], target.b[close]) if close.any() else False
            holds[i] = (all_in != 0).all() and not proper
            edge[i] = meets[i] and not proper and not (all_in == 1).any()
    return pd.DataFrame({"meets": meets, "touches": edge, "within": within, "holds": holds, "border": border})


def _proper_crossing(a, b, c, d) -> bool:
    """Whether some arcs cross with all four ends off the other's plane."""
    n1, n2 = np.cross(a, b), np.cross(c, d)
    s1, s2 = n1 @ c.T, n1 @ d.T
    s3, s4 = (n2 @ a.T).T, (n2 @ b.T).T
    eps = 1e-14
    proper = (np.abs(s1) > eps) & (np.abs(s2) > eps) & (np.abs(s3) > eps) & (np.abs(s4) > eps)
    return bool((proper & sphere.arcs_cross(a, b, c, d)).any())


def _cells_hold(s, rings, centre, p) -> np.ndarray:
    out = np.zeros(len(rings), bool)
    reach = np.nanmax(sphere.distance(rings, centre[:, None]), 1)
    for i in np.flatnonzero(sphere.distance(centre, p) <= reach * sphere.CAP_SLACK):
        r = rings[i][~np.isnan(rings[i][:, 0])]
        out[i] = sphere.point_in_ring(r, p[i : i + 1])[0] != 0
    return out


def matches(s: GridSystem, pos: np.ndarray, level: int, target: Target, predicate: str) -> np.ndarray:
    if predicate == "crosses":
        raise NotImplementedError("crosses is not offered")
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}; known: {', '.join(PREDICATES)}")
    if target.kind == "cap" and predicate not in ("intersects", "within", "disjoint"):
        raise ValueError(f"{predicate} of a cap is not offered")
    r = relate(s, pos, level, target)
    if predicate == "intersects":
        return r["meets"].to_numpy()
    if predicate == "disjoint":
        return ~r["meets"].to_numpy()
    if predicate in ("within", "coveredby"):
        return r["within"].to_numpy()
    if predicate in ("contains", "covers"):
        return r["holds"].to_numpy()
    if predicate == "touches":
        return r["touches"].to_numpy()
    if predicate == "equals":
        return (r["within"] & r["holds"]).to_numpy()
    return (r["meets"] & ~r["touches"] & ~r["within"] & ~r["holds"]).to_numpy()


# --- query ------------------------------------------------------------------------------------------------------


def _near(s: GridSystem, pos: np.ndarray, level: int, target: Target) -> np.ndarray:
    centre, radius = s.node_cap(pos, level)
    return pos[(radius >= np.pi) | (target.radius >= np.pi) | sphere.caps_meet(centre, radius, target.centre, target.radius)]


def _columns(s: GridSystem, f: Callable[[np.ndarray], np.ndarray]):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"pos": f(b["pos"].to_numpy(np.int64))})

    return run


def query(spark: SparkSession, sys: str | GridSystem, target, predicate: str = "intersects", level: int = 0, clip: DataFrame | None = None) -> DataFrame:
    """(pos) of the level's cells that stand in the relation to the target, ascending when ordered by position."""
    s, target, predicate = system(sys), as_target(target), predicate.lower()
    s.check_level(level)
    if predicate == "disjoint":
        every = regions.dense(clip) if clip is not None else s.levelgrid(spark, level)
        return every.join(query(spark, s, target, "intersects", level), "pos", "left_anti")
    matches(s, np.zeros(0, np.int64) + 1, s.levels[0], target, predicate) if predicate == "crosses" else None
    at, pos = s.levels[0], np.arange(1, s.ncells(s.levels[0]) + 1)
    pos = _near(s, pos, at, target)
    while at < level and len(pos) <= DRIVER_CELLS:
        kids = s.children_pos(pos, at)
        pos, at = (np.concatenate(kids) if kids else np.zeros(0, np.int64)), at + 1
        pos = _near(s, pos, at, target)
    if at == level and len(pos) <= 4096:
        found = pos[matches(s, pos, level, target, predicate)] if len(pos) else pos
        out = spark.createDataFrame([(int(p),) for p in np.sort(found)], "pos long")
    else:
        df = spark.createDataFrame(pd.DataFrame({"pos": pos}))
        for k in range(at, level):
            df = regions.children(df, s, k).select("pos").mapInPandas(_columns(s, lambda p, k=k: _near(s, p, k + 1, target)), "pos long")
        slots = spark.sparkContext.defaultParallelism * 4
        out = df.repartition(slots).mapInPandas(_columns(s, lambda p: p[matches(s, p, level, target, predicate)] if len(p) else p), "pos long")
    return out if clip is None else out.join(regions.dense(clip).distinct(), "pos", "left_semi")


# --- multi-order coverage ------------------------------------------------------------------------------------------

MOC_SCHEMA = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("key", T.LongType()), T.StructField("contained", T.BooleanType())])


@dataclass
class Coverage:
    """A mixed-level set: (level, pos, key, contained) in curve order, and the level that keys refer to."""

    system: GridSystem
    reference_level: int
    cells: pd.DataFrame

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.cells.astype({"level": "int32", "pos": "int64", "key": "int64", "contained": "bool"}), MOC_SCHEMA)


def coverage(sys: str | GridSystem, target, level: int | None = None, maxcells: int | None = None, maxlevel: int | None = None) -> Coverage:
    """Cells of several levels that cover a target: whole ones where they lie within, crossing ones at the last level.

    Either down to a level, or by a budget of cells: crossing cells are refined coarsest first, in curve order, skipping
    a replacement that would not fit; a seed over the budget is returned whole.
    """
    s, target = system(sys), as_target(target)
    if (level is None) == (maxcells is None):
        raise ValueError("give exactly one of level and maxcells")
    if maxlevel is not None and maxcells is None:
        raise ValueError("maxlevel goes with maxcells")
    if maxcells is not None and maxcells < 1:
        raise ValueError("maxcells is at least 1")
    last = s.check_level(level) if level is not None else s.maxlevel if maxlevel is None else s.check_level(maxlevel)

    def judge(pos: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells within, and crossing ones, among cells whose subtrees may meet the target."""
        pos = _near(s, pos, at, target)
        if not len(pos):
            return pos, pos
        r = relate(s, pos, at, target)
        # The subtree of a cell may reach beyond it where children do not nest: such cells are refined, too.
        within = r["within"].to_numpy() & (at < last)
        keep = ~within & (r["meets"].to_numpy() | ((at < last) & (s.cap_inflation > 1)))
        return pos[within], pos[keep]

    root = np.arange(1, s.ncells(s.levels[0]) + 1)
    whole, cross = judge(root, s.levels[0])
    out: list[tuple[int, int, bool]] = []
    if level is not None:
        at = s.levels[0]
        while True:
            out += [(at, int(p), True) for p in whole]
            if at == level:
                out += [(at, int(p), False) for p in cross]
                break
            kids = s.children_pos(cross, at)
            at += 1
            whole, cross = judge(np.concatenate(kids) if kids else cross, at)
        return _ordered(s, out, last)
    done: list[tuple[int, int, bool]] = [(s.levels[0], int(p), True) for p in whole]
    open_: dict[int, list[int]] = {s.levels[0]: [int(p) for p in cross]}
    count = len(done) + len(cross)
    at = s.levels[0]
    while at <= last:
        for p in sorted(open_.get(at, [])):
            if at == last:
                done.append((at, p, False))
                continue
            w, c = judge(s.children_pos(np.array([p]), at)[0], at + 1)
            if count - 1 + len(w) + len(c) > maxcells:
                done.append((at, p, False))
                continue
            count += len(w) + len(c) - 1
            done += [(at + 1, int(q), True) for q in w]
            open_.setdefault(at + 1, []).extend(int(q) for q in c)
        at += 1
    return _ordered(s, done, max((x[0] for x in done), default=s.levels[0]))


def _ordered(s: GridSystem, cells: list[tuple[int, int, bool]], reference: int) -> Coverage:
    df = pd.DataFrame(cells, columns=["level", "pos", "contained"])
    if s.has_sorted_subtrees:
        df["key"] = 0
        for at, group in df.groupby("level"):
            df.loc[group.index, "key"] = s.descendant_range(group["pos"].to_numpy(np.int64), int(at), reference)[0]
        df = df.sort_values(["key", "level"], kind="stable")
    else:
        df["key"] = df["pos"]
        df = df.sort_values(["level", "pos"], kind="stable")
    return Coverage(s, reference, df[["level", "pos", "key", "contained"]].reset_index(drop=True))


def coarsest_contained(c: Coverage) -> tuple[int, int] | None:
    """(level, pos) of the first of the coarsest cells proven inside."""
    inside = c.cells[c.cells["contained"]]
    if inside.empty:
        return None
    first = inside.sort_values(["level", "key"], kind="stable").iloc[0]
    return int(first["level"]), int(first["pos"])


def level_ranges(spark: SparkSession, c: Coverage, level: int) -> DataFrame:
    """(lo, hi) of the set at a level, merged and ascending."""
    s = c.system
    if not s.has_sorted_subtrees:
        raise ValueError(f"{s.name} has no ranges")
    if level < c.cells["level"].max():
        raise ValueError(f"the set has cells finer than level {level}")
    lo, hi = [], []
    for at, group in c.cells.groupby("level"):
        a, b = s.descendant_range(group["pos"].to_numpy(np.int64), int(at), level)
        lo.append(a)
        hi.append(b)
    lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lo, hi))
    order = np.argsort(lo)
    lo, hi = lo[order], hi[order]
    new = np.append(True, lo[1:] > hi[:-1] + 1) if len(lo) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    merged = pd.DataFrame({"lo": lo[at], "hi": hi[np.append(at[1:] - 1, len(hi) - 1)] if len(at) else hi})
    return spark.createDataFrame(merged, "lo long, hi long")


def cellindices(spark: SparkSession, c: Coverage, level: int) -> DataFrame:
    """(pos) of the set at a level, explicitly."""
    return regions.dense(level_ranges(spark, c, level))


def covering(data: DataFrame, sys: str | GridSystem, level: int, target, pos: str = "pos", unique: bool = False) -> DataFrame:
    """Rows of data whose cell covers part of the target: the coverage's ranges joined block by block. unique: data has each
    cell once."""
    c = coverage(sys, target, level=level)
    if c.system.has_sorted_subtrees:
        return regions.in_ranges(data, level_ranges(data.sparkSession, c, level), pos, unique=unique)
    hits = c.df(data.sparkSession)
    out = None
    for at in sorted(set(c.cells["level"])):
        own = hits.filter(F.col("level") == int(at)).select(F.col("pos").alias("_a"))
        part = data.withColumn("_a", c.system.ancestor_col(F.col(pos), level, int(at))).join(own, "_a", "left_semi").drop("_a")
        out = part if out is None else out.unionByName(part)
    return data.limit(0) if out is None else out


def zonal(data: DataFrame, sys: str | GridSystem, level: int, zones: dict[str, object], value: str = "value", pos: str = "pos") -> DataFrame:
    """(zone, n, mean): the area-weighted mean of a field over each zone's covering cells.

    Values are counted and summed up by cell before cells meet zones.
    """
    s, parts = system(sys), []
    rows = data.select(F.col(pos).alias("pos"), F.col(value).cast("double").alias("v"))
    cells = rows.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("pos").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    for name, target in zones.items():
        area = s.area_col(F.col("pos"), level)
        parts.append(covering(cells, s, level, target, unique=True).select(F.lit(name).alias("zone"), "n", "v", area.alias("a")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("zone").agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("a")) / F.sum(F.col("n") * F.col("a"))).alias("mean"))


def member_neighbors(c: Coverage, level: int, pos: int, connectivity: str = "vertex") -> pd.DataFrame:
    """(level, pos) of the set's members adjacent to one member, across levels, counter-clockwise from the smallest."""
    s, ref = c.system, c.reference_level
    lo, hi = (int(x[0]) for x in s.descendant_range(np.array([pos]), level, ref))
    own = np.arange(lo, hi + 1)
    ring = s.one_ring(own, ref, connectivity)
    out = np.unique(ring[(ring > 0) & ((ring < lo) | (ring > hi))])
    keys = c.cells["key"].to_numpy(np.int64)
    ends = np.array([int(s.descendant_range(np.array([p]), int(v), ref)[1][0]) for v, p in zip(c.cells["level"], c.cells["pos"], strict=True)])
    order = np.argsort(keys, kind="stable")
    at = np.searchsorted(keys[order], out, "right") - 1
    hit = order[at[(at >= 0) & (out <= ends[order[np.maximum(at, 0)]])]]
    found = c.cells.iloc[sorted(set(hit.tolist()))][["level", "pos"]].sort_values(["level", "pos"]).reset_index(drop=True)
    if found.empty:
        return found
    centre = s.centroid(np.array([pos]), level)[0]
    there = np.stack([s.centroid(np.array([p]), int(v))[0] for v, p in zip(found["level"], found["pos"], strict=True)])
    phase = np.mod(sphere.azimuth(centre, there) - sphere.azimuth(centre, there[:1])[0], 2 * np.pi)
    phase[phase > 2 * np.pi - 1e-9] = 0
    return found.iloc[np.argsort(phase, kind="stable")].reset_index(drop=True)


# --- size -------------------------------------------------------------------------------------------------------


def cellsize(sys: str | GridSystem, level: int, radius: float = 6371007.180918474, samples: int = 256) -> float:
    """Metres: the root of the median cell area over a golden-ratio sample of positions."""
    s = system(sys)
    n = s.ncells(level)
    k = np.arange(min(samples, n))
    pos = k + 1 if n <= samples else np.floor(np.mod((k + 0.5) * 0.6180339887498949, 1.0) * n).astype(np.int64) + 1
    return float(np.sqrt(np.median(s.area(pos, level))) * radius)


def levelfor(sys: str | GridSystem, metres: float, radius: float = 6371007.180918474) -> int:
    """The level whose cell area is nearest to metres squared in log ratio."""
    s = system(sys)
    best, at = np.inf, s.levels[0]
    for level in s.levels:
        miss = abs(np.log(cellsize(s, level, radius) / metres))
        if miss > best:
            break
        best, at = miss, level
    return at

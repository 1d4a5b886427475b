"""Regridding: a weights relation (dst, src, w) once, applied to any number of fields.

Spaces are cell collections: a grid level (`DGGSpace`) or a separable raster (`RasterGrid`). Conservative weights are
overlap areas: source and destination cells are each listed under the coarse cells that they may touch, joined on those,
deduplicated, and clipped exactly in Arrow batches. Application is one join and one grouped sum; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import sphere
from tessellon.systems.base import GridSystem, system
from tessellon.systems.healpix import HEALPix


class DGGSpace:
    """The cells of a level, or of a region of it."""

    def __init__(self, sys: str | GridSystem, level: int, region: DataFrame | None = None):
        self.system, self.level, self.region = system(sys), level, region

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.system.levelgrid(spark, self.level) if self.region is None else self.region.select("pos")

    def polygons(self, pos: np.ndarray) -> np.ndarray:
        return self.system.boundary(pos, self.level)

    def centres(self, pos: np.ndarray) -> np.ndarray:
        return self.system.centroid(pos, self.level)

    def locate_col(self, lon: Column, lat: Column) -> Column:
        return self.system.cellat_col(lon, lat, self.level)

    @property
    def size(self) -> float:
        return float(np.sqrt(4 * np.pi / self.system.ncells(self.level)))


class RasterGrid:
    """A lon/lat raster by its cell edges in degrees; pos = ix + (iy - 1) * nx with 1-based ix, iy."""

    def __init__(self, lon_edges, lat_edges):
        self.x, self.y = np.asarray(lon_edges, float), np.asarray(lat_edges, float)
        for e in (self.x, self.y):
            if len(e) < 2 or not ((np.diff(e) > 0).all() or (np.diff(e) < 0).all()):
                raise ValueError("raster edges must be strictly monotone")
        self.y = np.clip(self.y, -90, 90)
        self.nx, self.ny = len(self.x) - 1, len(self.y) - 1

    @staticmethod
    def from_points(lon, lat, step_x: float | None = None, step_y: float | None = None) -> RasterGrid:
        """Edges at midpoints, the end half-widths mirrored; a single point needs a step."""

        def edges(p, step):
            p = np.asarray(p, float)
            if len(p) == 1:
                if step is None:
                    raise ValueError("a single point needs a step")
                return np.array([p[0] - step / 2, p[0] + step / 2])
            mid = (p[1:] + p[:-1]) / 2
            return np.concatenate([[2 * p[0] - mid[0]], mid, [2 * p[-1] - mid[-1]]])

        return RasterGrid(edges(lon, step_x), edges(lat, step_y))

    @staticmethod
    def from_bounds(lon_bounds, lat_bounds) -> RasterGrid:
        """Edges from intervals (n, 2), which must abut."""

        def edges(b):
            b = np.asarray(b, float)
            b = b if b[0, 0] < b[0, 1] or len(b) == 1 else b
            if len(b) > 1 and np.abs(b[1:, 0] - b[:-1, 1]).max() > 1e-8 * max(1.0, np.abs(np.diff(b, axis=1)).max()):
                raise ValueError("raster intervals must abut")
            return np.append(b[:, 0], b[-1, 1])

        return RasterGrid(edges(lon_bounds), edges(lat_bounds))

    @property
    def periodic(self) -> bool:
        return abs(abs(self.x[-1] - self.x[0]) - 360) <= 1e-9 * 360

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.range(1, self.nx * self.ny + 1).withColumnRenamed("id", "pos")

    def edges(self, pos: np.ndarray):
        ix, iy = (pos - 1) % self.nx, (pos - 1) // self.nx
        return self.x[ix], self.x[ix + 1], self.y[iy], self.y[iy + 1]

    def polygons(self, pos: np.ndarray) -> np.ndarray:
        """Counter-clockwise from outside, whichever way the axes run."""
        x0, x1, y0, y1 = self.edges(pos)
        x0, x1 = np.minimum(x0, x1), np.maximum(x0, x1)
        y0, y1 = np.minimum(y0, y1), np.maximum(y0, y1)
        return np.stack([sphere.unit_point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))], 1)

    def centres(self, pos: np.ndarray) -> np.ndarray:
        x0, x1, y0, y1 = self.edges(pos)
        return sphere.unit_point((x0 + x1) / 2, (y0 + y1) / 2)

    def locate(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Positions, 0 outside; longitudes are brought into the raster's turn first."""
        x0 = min(self.x[0], self.x[-1])
        lon = np.mod(lon - x0, 360.0) + x0

        def index(edges, v):
            up = edges[-1] > edges[0]
            e = edges if up else edges[::-1]
            i = np.searchsorted(e, v, "right") - 1
            i = np.where((i == len(e) - 1) & (v == e[-1]), len(e) - 2, i)
            ok = (i >= 0) & (i <= len(e) - 2)
            return np.where(ok, i if up else len(e) - 2 - i, -1)

        ix, iy = index(self.x, lon), index(self.y, lat)
        return np.where((ix >= 0) & (iy >= 0), ix + iy * self.nx + 1, 0)

    def locate_col(self, lon: Column, lat: Column) -> Column:
        step_x, step_y = np.diff(self.x), np.diff(self.y)
        if np.ptp(step_x) < 1e-9 * abs(step_x[0]) and np.ptp(step_y) < 1e-9 * abs(step_y[0]):
            # Regular axes: arithmetic.
            x0 = float(min(self.x[0], self.x[-1]))
            x = F.pmod(lon - x0, F.lit(360.0)) + x0
            ix, iy = F.floor((x - float(self.x[0])) / float(step_x[0])), F.floor((lat - float(self.y[0])) / float(step_y[0]))
            iy = F.when(lat == float(self.y[-1]), F.lit(self.ny - 1).cast("long")).otherwise(iy)
            ok = (ix >= 0) & (ix < self.nx) & (iy >= 0) & (iy < self.ny)
            return F.when(ok, ix + iy * self.nx + 1)

        def f(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(self.locate(a.to_numpy(float), b.to_numpy(float)))

        found = F.pandas_udf(f, "long")(lon, lat)
        return F.when(found > 0, found)

    @property
    def size(self) -> float:
        return float(np.radians(max(np.abs(np.diff(self.x)).max(), np.abs(np.diff(self.y)).max())))


Space = DGGSpace | RasterGrid


def as_space(target, level: int | None = None, like: Space | None = None) -> Space:
    """A space as given; a system at a level; a bare system at the level that matches another space's size."""
    if isinstance(target, DGGSpace | RasterGrid):
        return target
    s = system(target)
    if level is None:
        if like is None:
            raise ValueError("a bare system has no size of its own; give a level")
        level = min(s.levels, key=lambda k: abs(np.log(np.sqrt(4 * np.pi / s.ncells(k)) / like.size)))
    return DGGSpace(s, level)


def chunk_level(sys: str | GridSystem, level: int, cells: int = 4096) -> int:
    """The ancestor level whose cells hold nearest to `cells` of the level's, in log ratio."""
    s = system(sys)
    return min(range(s.levels[0], level + 1), key=lambda k: abs(np.log(s.ncells(level) / s.ncells(k) / cells)))


# --- weights ----------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """weights (dst, src, w), and denominators (dst, total): the reference weights that policies compare with."""

    weights: DataFrame
    denominators: DataFrame | None
    source: Space
    destination: Space
    method: str

    def persist(self) -> Plan:
        self.weights, self.denominators = self.weights.persist(), self.denominators.persist()
        return self

    def spill(self, path: str) -> Plan:
        """Weights written once and read from there from now on, in destination ranges; denominators beside them."""
        spark, beside = self.weights.sparkSession, f"{path.rstrip('/')}.denominators"
        self.weights.repartitionByRange("dst").write.mode("errorifexists").parquet(path)
        self.weights = spark.read.parquet(path)
        denominators_of(self.weights).write.mode("errorifexists").parquet(beside)
        self.denominators = spark.read.parquet(beside)
        return self


def denominators_of(weights: DataFrame) -> DataFrame:
    """(dst, total): each cell's reference weight, from the weights alone."""
    return weights.groupBy("dst").agg(F.sum("w").alias("total"))


def _bins(space: Space, level: int, margin: float):
    """Listing of cells under every coarse pixel whose cap meets theirs."""
    grid = HEALPix()
    top = np.arange(1, grid.ncells(level) + 1)
    centre, radius = grid.cap(top, level)

    def run(batches):
        for b in batches:
            pos = b["pos"].to_numpy(np.int64)
            c, r = sphere.rings_cap(space.centres(pos), space.polygons(pos))
            rows, pixels = [], []
            for lo in range(0, len(pos), 1024):
                d = 2 * np.arcsin(np.minimum(1, np.sqrt(np.maximum(0, 2 - 2 * c[lo : lo + 1024] @ centre.T)) / 2))
                i, p = np.nonzero(d <= r[lo : lo + 1024, None] + radius + margin)
                rows.append(i + lo)
                pixels.append(p)
            i, p = np.concatenate(rows), np.concatenate(pixels)
            yield pd.DataFrame({"pos": pos[i], "bin": p.astype(np.int64)})

    return run


def conservative_weights(spark: SparkSession, source: Space, destination: Space) -> DataFrame:
    """(dst, src, w): areas of the overlaps; one of two cells should be convex (else the destination is cut in triangles)."""
    # Coarse pixels some ten times the larger cells, so that a cell lists under few and few cells meet in one.
    level = int(np.clip(np.floor(np.log2(1.0 / (8 * max(source.size, destination.size)))), 0, 5))
    sides = []
    for space, name in ((source, "src"), (destination, "dst")):
        cells = space.cells(spark).repartition(spark.sparkContext.defaultParallelism * 2)
        sides.append(cells.mapInPandas(_bins(space, level, 1e-9), "pos long, bin long").select("bin", F.col("pos").alias(name)))
    pairs = sides[0].join(sides[1], "bin").select("src", "dst").distinct()

    def clip(batches):
        for b in batches:
            if not len(b):
                continue
            out = []
            for space_rows in np.array_split(np.arange(len(b)), max(1, len(b) // 4096)):
                part = b.iloc[space_rows]
                src, dst = part["src"].to_numpy(np.int64), part["dst"].to_numpy(np.int64)
                a, c = source.polygons(src), destination.polygons(dst)
                ca, ra = sphere.rings_cap(source.centres(src), a)
                cc, rc = sphere.rings_cap(destination.centres(dst), c)
                near = np.flatnonzero(sphere.caps_meet(ca, ra, cc, rc))
                w = np.zeros(len(part))
                for i in near:
                    w[i] = sphere.overlap_area(a[i][~np.isnan(a[i][:, 0])], c[i][~np.isnan(c[i][:, 0])])
                keep = w > 1e-18
                out.append(pd.DataFrame({"dst": dst[keep], "src": src[keep], "w": w[keep]}))
            yield pd.concat(out)

    return pairs.mapInPandas(clip, "dst long, src long, w double")


def nearest_weights(spark: SparkSession, source: Space, destination: Space) -> DataFrame:
    """(dst, src, 1): the source cell that holds the destination's centre; none outside the source."""
    rows = _centre_rows(spark, destination)
    return rows.select("dst", source.locate_col(F.col("lon"), F.col("lat")).alias("src"), F.lit(1.0).alias("w")).filter("src is not null")


def bilinear_weights(spark: SparkSession, source: RasterGrid, destination: Space) -> DataFrame:
    """(dst, src, w): four raster points about the destination's centre; edges clamp, a full turn wraps."""
    if not isinstance(source, RasterGrid):
        raise ValueError("bilinear interpolation reads a raster")
    mx, my = (source.x[1:] + source.x[:-1]) / 2, (source.y[1:] + source.y[:-1]) / 2

    def run(batches):
        for b in batches:
            lon, lat = b["lon"].to_numpy(float), b["lat"].to_numpy(float)

            def axis(points, v, n):
                up = n == 1 or points[-1] > points[0]
                p = points if up else points[::-1]
                i = np.clip(np.searchsorted(p, v, "right") - 1, 0, max(n - 2, 0))
                f = np.clip((v - p[i]) / (p[i + 1] - p[i]), 0, 1) if n > 1 else np.zeros(len(v))
                return (i, np.minimum(i + 1, n - 1), f) if up else (n - 1 - i, n - 1 - np.minimum(i + 1, n - 1), f)

            middle = (source.x[0] + source.x[-1]) / 2
            lon = np.mod(lon - middle + 180, 360) - 180 + middle
            if source.periodic:
                k = np.argsort(mx)
                p = np.concatenate([[mx[k[-1]] - 360], mx[k], [mx[k[0]] + 360]])
                own = np.concatenate([[k[-1]], k, [k[0]]])
                i = np.clip(np.searchsorted(p, lon, "right") - 1, 0, len(p) - 2)
                fx = (lon - p[i]) / (p[i + 1] - p[i])
                x0, x1 = own[i], own[i + 1]
            else:
                x0, x1, fx = axis(mx, lon, source.nx)
            y0, y1, fy = axis(my, lat, source.ny)
            out = [pd.DataFrame({"dst": b["dst"], "src": x + y * source.nx + 1, "w": w}) for x, y, w in ((x0, y0, (1 - fx) * (1 - fy)), (x1, y0, fx * (1 - fy)), (x0, y1, (1 - fx) * fy), (x1, y1, fx * fy))]
            every = pd.concat(out)
            yield every[every["w"] > 0]

    return _centre_rows(spark, destination).mapInPandas(run, "dst long, src long, w double").groupBy("dst", "src").agg(F.sum("w").alias("w"))


def _centre_rows(spark: SparkSession, space: Space) -> DataFrame:
    def run(batches):
        for b in batches:
            lon, lat = sphere.lonlat(space.centres(b["pos"].to_numpy(np.int64)))
            yield pd.DataFrame({"dst": b["pos"], "lon": lon, "lat": lat})

    return space.cells(spark).mapInPandas(run, "dst long, lon double, lat double")


METHODS = {"conservative": conservative_weights, "nearest": nearest_weights, "bilinear": bilinear_weights}


def register_method(name: str, build) -> None:
    """build(spark, source, destination) -> weights (dst, src, w)."""
    METHODS[name] = build


def plan_regrid(spark: SparkSession, source: Space, destination, method: str = "conservative", level: int | None = None) -> Plan:
    """Geometry only; reads no values."""
    if not isinstance(source, DGGSpace | RasterGrid):
        raise ValueError("a bare system is no source; give a level")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    destination = as_space(destination, level, source)
    weights = METHODS[method](spark, source, destination)
    return Plan(weights, denominators_of(weights), source, destination, method)


# --- application --------------------------------------------------------------------------------------------------


def _valid(value: Column, sentinel: float | None) -> Column:
    ok = value.isNotNull() & ~F.isnan(value)
    return ok if sentinel is None else ok & (value != sentinel)


def weighted(threshold: float = 0.5):
    """num / cover; blank where nothing covers, or less than threshold of what the source could cover."""
    return lambda num, cover, total: F.when((cover > 0) & (cover >= threshold * total), num / cover)


def extensive():
    """The sum itself, never blank."""
    return lambda num, cover, total: F.coalesce(num, F.lit(0.0))


extensive.uses_total = False


#: Parts into which cells and slices are each dealt where they are paired.
PARTS = 16


def _every_slice(cells: DataFrame, slices: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(dst, dims...): every cell with every slice, by an equi-join on (part of the cells, part of the slices)."""
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(PARTS)).cast("int")
    left = cells.select("dst", part("dst").alias("_i"), every.alias("_j"))
    right = slices.select(*dims, part(*dims).alias("_j"), every.alias("_i"))
    return left.join(right, ["_i", "_j"]).select("dst", *dims)


def regrid(data: DataFrame, plan: Plan, policy=None, pos: str = "pos", value: str = "value", dims: tuple[str, ...] = (), sentinel: float | None = None, blank: str = "null") -> DataFrame:
    """(pos, dims..., value) on the destination, as double.

    Missing source values (NULL, NaN, the sentinel) don't count; the reference weight of a cell is the sum of all its
    weights, missing or not, and so comes from the weights alone. blank: "null" or "nan" for what the policy leaves out.
    """
    policy = policy or weighted()
    v = F.col(value).cast("double")
    src = data.select(F.col(pos).alias("src"), *dims, F.when(_valid(v, sentinel), v).alias("v"))
    total = denominators_of(plan.weights) if plan.denominators is None else plan.denominators
    sums = plan.weights.join(src, "src").groupBy("dst", *dims).agg(F.sum(F.col("w") * F.col("v")).alias("num"), F.sum(F.when(F.col("v").isNotNull(), F.col("w")).otherwise(0.0)).alias("cover"))
    cells = plan.destination.cells(data.sparkSession).withColumnRenamed("pos", "dst")
    if dims:
        # NULL is a slice as well.
        frame = _every_slice(cells, src.select(*dims).distinct(), dims)
        own = sums.select(F.col("dst").alias("_dst"), *(F.col(d).alias(f"_{d}") for d in dims), "num", "cover")
        same = F.col("dst") == F.col("_dst")
        for d in dims:
            same &= F.col(d).eqNullSafe(F.col(f"_{d}"))
        out = frame.join(total, "dst", "left").join(own, same, "left")
    else:
        out = cells.join(total, "dst", "left").join(sums, "dst", "left")
    result = policy(F.col("num"), F.coalesce("cover", F.lit(0.0)), F.coalesce("total", F.lit(0.0)))
    if blank == "nan":
        result = F.coalesce(result, F.lit(float("nan")))
    return out.select(F.col("dst").alias("pos"), *dims, result.alias(value))


def regrid_into(data: DataFrame, plan: Plan, path: str, **options) -> None:
    """regrid() written as Parquet, destination ranges together; never over an existing path."""
    regrid(data, plan, **options).repartitionByRange("pos").write.mode("errorifexists").parquet(path)


def pyramid(data: DataFrame, sys: str | GridSystem, level: int, coarser: int, value: str = "value") -> DataFrame:
    """(pos, value): a sampling pyramid; each coarser cell takes the fine cell at its centre."""
    space = DGGSpace(sys, coarser)
    fine = DGGSpace(sys, level)
    at = _centre_rows(data.sparkSession, space).select(F.col("dst").alias("coarse"), fine.locate_col(F.col("lon"), F.col("lat")).alias("pos"))
    return at.join(data.select("pos", value), "pos").select(F.col("coarse").alias("pos"), value)

"""Stencils over fields (pos, value, other dimensions...): neighbour joins, terrain operators, flow.

A stencil explodes each cell's one-ring, joins the field on the neighbour's position, and folds by cell: one shuffle of
the exploded side and one of the field, both on position, then a grouped aggregate with partial aggregation. Other
dimensions (time, band) ride along as further keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.systems.base import GridSystem, system


def _pairs(field: DataFrame, sys: str | GridSystem, level: int, value: str, dims: list[str], connectivity: str) -> DataFrame:
    """(pos, dims..., z, slot, nbr, zn): every cell with each neighbour that has a row; cells without any keep one row."""
    s = system(sys)
    own = field.select("pos", *dims, F.col(value).alias("z"))
    rel = own.select("*", F.posexplode_outer(s.one_ring_col(F.col("pos"), level, connectivity)).alias("slot", "nbr"))
    near = own.select(F.col("pos").alias("nbr"), *dims, F.col("z").alias("zn"), F.lit(True).alias("there"))
    return rel.join(near, ["nbr", *dims], "left")


def map_neighbors(field: DataFrame, sys: str | GridSystem, level: int, aggregates: dict[str, Callable[[Column, Column], Column]], value: str = "value", dims: tuple[str, ...] = (), connectivity: str = "vertex") -> DataFrame:
    """(pos, dims..., one column an aggregate): each is made from (own value, neighbour's value) Columns.

    Neighbours outside the field are absent: the neighbour's value is NULL, which aggregates skip.
    """
    dims = list(dims)
    pairs = _pairs(field, sys, level, value, dims, connectivity)
    return pairs.groupBy("pos", *dims).agg(*(f(F.first("z"), F.col("zn")).alias(name) for name, f in aggregates.items()))


def map_neighbors_pandas(field: DataFrame, sys: str | GridSystem, level: int, f: Callable[[int, float, list], float], value: str = "value", dims: tuple[str, ...] = (), connectivity: str = "vertex") -> DataFrame:
    """(pos, dims..., result) of an arbitrary f(pos, own value, neighbours' values in ring order)."""
    dims = list(dims)
    pairs = _pairs(field, sys, level, value, dims, connectivity)
    held = F.filter(F.array_sort(F.collect_list(F.struct("slot", "there", "zn"))), lambda x: x["there"])
    rows = pairs.groupBy("pos", *dims).agg(F.first("z").alias("z"), F.transform(held, lambda x: x["zn"]).alias("zs"))

    def call(p: pd.Series, z: pd.Series, zs: pd.Series) -> pd.Series:
        out = []
        for pos, own, near in zip(p, z, zs, strict=True):
            try:
                out.append(float(f(int(pos), own, list(near))))
            except Exception as error:
                raise NeighborCallbackError(int(pos), error) from error
        return pd.Series(out)

    return rows.select("pos", *dims, F.pandas_udf(call, "double")("pos", "z", "zs").alias("result"))


class NeighborCallbackError(RuntimeError):
    """A callback failed at a position."""

    def __init__(self, pos: int, error: Exception):
        super().__init__(f"the neighbour callback failed at position {pos}: {error!r}")
        self.pos = pos


def foreach_neighbors(field: DataFrame, sys: str | GridSystem, level: int, f: Callable[[int, float, list], None], value: str = "value", connectivity: str = "vertex") -> None:
    """Calls f for its side effects, on the executors."""
    pairs = _pairs(field, sys, level, value, [], connectivity)
    held = F.filter(F.array_sort(F.collect_list(F.struct("slot", "there", "zn"))), lambda x: x["there"])
    rows = pairs.groupBy("pos").agg(F.first("z").alias("z"), F.transform(held, lambda x: x["zn"]).alias("zs"))

    def each(part) -> None:
        for r in part:
            f(r["pos"], r["z"], r["zs"])

    rows.foreachPartition(each)


def slices(field: DataFrame, sys: str | GridSystem, level: int, value: str = "value", dims: tuple[str, ...] = (), connectivity: str = "vertex") -> DataFrame:
    """(pos, nbr_slices): per neighbour in ring order, its values over all other dimensions as (dims..., value)."""
    dims = list(dims)
    per = field.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(*dims, F.col(value).alias("value")))).alias("s"))
    rel = per.select("pos", F.posexplode(system(sys).one_ring_col(F.col("pos"), level, connectivity)).alias("slot", "nbr"))
    near = per.select(F.col("pos").alias("nbr"), F.col("s").alias("sn"))
    return rel.join(near, "nbr").groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "nbr", "sn"))), lambda x: F.struct(x["nbr"].alias("nbr"), x["sn"].alias("slice"))).alias("nbr_slices"))


# --- smoothing --------------------------------------------------------------------------------------------------


def smooth(field: DataFrame, sys: str | GridSystem, level: int, value: str = "value", connectivity: str = "vertex") -> DataFrame:
    """(pos, value): the mean of a cell and its neighbours."""
    pairs = _pairs(field, sys, level, value, [], connectivity)
    return pairs.groupBy("pos").agg(((F.first("z") + F.coalesce(F.sum("zn"), F.lit(0.0))) / (1 + F.count("there"))).alias(value))


def laplacian(field: DataFrame, sys: str | GridSystem, level: int, value: str = "value", connectivity: str = "vertex") -> DataFrame:
    """(pos, value): the neighbours' mean less the cell's value."""
    return map_neighbors(field, sys, level, {value: lambda z, n: F.avg(n) - z}, value, (), connectivity)


def diffuse(field: DataFrame, sys: str | GridSystem, level: int, steps: int, rate: float = 0.5, value: str = "value", connectivity: str = "vertex", cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """steps times value + rate * laplacian; cut (say DataFrame.checkpoint) bounds the lineage of many steps."""
    out = field.select("pos", F.col(value).alias("value"))
    for _ in range(steps):
        out = map_neighbors(out, sys, level, {"value": lambda z, n: z + F.lit(rate) * F.coalesce(F.avg(n) - z, F.lit(0.0))}, "value", (), connectivity)
        out = cut(out) if cut else out
    return out.select("pos", F.col("value").alias(value))


# --- terrain ----------------------------------------------------------------------------------------------------

_NAN = float("nan")


def topographic_position(field, sys, level, value="z", connectivity="vertex") -> DataFrame:
    """(pos, tpi): the value less the neighbours' mean; NaN without neighbours."""
    return map_neighbors(field, sys, level, {"tpi": lambda z, n: F.coalesce(z - F.avg(n), F.lit(_NAN))}, value, (), connectivity)


def ruggedness(field, sys, level, value="z", normalize: bool = False, squared: bool = True, connectivity="vertex") -> DataFrame:
    """(pos, tri): the root of the summed (or, normalised, mean) squared differences; absolute ones if not squared; 0 without neighbours."""

    def f(z, n):
        d = F.col("z") - n
        fold = F.avg if normalize else F.sum
        return F.coalesce(F.sqrt(fold(d * d)) if squared else fold(F.abs(d)), F.lit(0.0))

    return map_neighbors(field, sys, level, {"tri": f}, value, (), connectivity)


def roughness(field, sys, level, value="z", connectivity="vertex") -> DataFrame:
    """(pos, roughness): the largest absolute difference; NaN poisons; 0 without neighbours."""
    return map_neighbors(field, sys, level, {"roughness": lambda z, n: F.coalesce(F.max(F.abs(F.col("z") - n)), F.lit(0.0))}, value, (), connectivity)


def prominence(field, sys, level, value="z", connectivity="vertex") -> DataFrame:
    """(pos, prominence): how many neighbours are not higher."""
    return map_neighbors(field, sys, level, {"prominence": lambda z, n: F.sum(F.when(n <= F.col("z"), 1).otherwise(0))}, value, (), connectivity)


def _with_geometry(field: DataFrame, sys: str | GridSystem, level: int, value: str, connectivity: str, radius: float) -> DataFrame:
    """Pairs with the distance d and the neighbour's east and north offsets in the cell's tangent plane, times radius."""
    s = system(sys)
    pairs = _pairs(field, sys, level, value, [], connectivity)

    def measure(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        from tessellon.functions import sphere

        a, b = s.centroid(p.to_numpy(np.int64), level), s.centroid(q.to_numpy(np.int64), level)
        d = sphere.distance(a, b)
        t = sphere.azimuth(a, b)
        return pd.DataFrame({"d": d * radius, "e": d * np.cos(t) * radius, "n": d * np.sin(t) * radius})

    return pairs.filter("there").withColumn("m", F.pandas_udf(measure, "d double, e double, n double")("pos", "nbr")).select("pos", "z", "nbr", "zn", "slot", "m.*")


def _for_all(field: DataFrame, made: DataFrame, missing: dict[str, float]) -> DataFrame:
    """made (pos, ...) with a row for every cell of the field: cells without neighbours get what is missing."""
    rows = field.select("pos").join(made.withColumn("_made", F.lit(True)), "pos", "left")
    return rows.select("pos", *(F.when(F.col("_made"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in missing.items()))


def slope_mdg(field, sys, level, value="z", radius: float = 1.0, connectivity="vertex", downward: bool = False) -> DataFrame:
    """(pos, slope): degrees of the steepest (or steepest downward) gradient to a neighbour; 0 in a pit or without neighbours."""
    g = (F.col("z") - F.col("zn")) / F.col("d")
    best = F.max(F.greatest(g, F.lit(0.0))) if downward else F.max(F.abs(g))
    return _for_all(field, _with_geometry(field, sys, level, value, connectivity, radius).groupBy("pos").agg(F.degrees(F.atan(best)).alias("slope")), {"slope": 0.0})


def plane_fit(field, sys, level, value="z", radius: float = 1.0, connectivity="vertex") -> DataFrame:
    """(pos, slope, aspect): least squares through the cell in its east-north frame; aspect clockwise from north,
    pointing downhill; NaN where the neighbours lie on a line or there are none."""
    dz = F.col("zn") - F.col("z")
    sums = _with_geometry(field, sys, level, value, connectivity, radius).groupBy("pos").agg(F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("e") * F.col("n")).alias("en"), F.sum(F.col("e") * dz).alias("ez"), F.sum(F.col("n") * dz).alias("nz"))
    det = F.col("ee") * F.col("nn") - F.col("en") * F.col("en")
    # Neighbours on a line leave nothing but rounding.
    det = F.when(det > 1e-12 * (F.col("ee") + F.col("nn")) * (F.col("ee") + F.col("nn")), det)
    gx = (F.col("ez") * F.col("nn") - F.col("nz") * F.col("en")) / det
    gy = (F.col("nz") * F.col("ee") - F.col("ez") * F.col("en")) / det
    nan = F.lit(_NAN)
    fitted = sums.select("pos", F.coalesce(F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))), nan).alias("slope"), F.coalesce(F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)), nan).alias("aspect"))
    return _for_all(field, fitted, {"slope": _NAN, "aspect": _NAN})


def curvature(field, sys, level, value="z", radius: float = 1.0, connectivity="vertex") -> DataFrame:
    """(pos, curvature): four times the mean of difference over squared distance; NaN without neighbours."""
    return _for_all(field, _with_geometry(field, sys, level, value, connectivity, radius).groupBy("pos").agg((4 * F.avg((F.col("zn") - F.col("z")) / (F.col("d") * F.col("d")))).alias("curvature")), {"curvature": _NAN})


def flow_direction(field, sys, level, value="z", connectivity="vertex") -> DataFrame:
    """(pos, dir): the neighbour of steepest descent, the smallest position on ties; a pit flows to itself."""
    s = system(sys)
    g = (F.col("z") - F.col("zn")) / F.col("d")
    best = _with_geometry(field, sys, level, value, connectivity, 1.0).filter(g > 0).groupBy("pos").agg(F.max_by("nbr", F.struct(g, -F.col("nbr"))).alias("dir"))
    del s
    return field.select("pos").join(best, "pos", "left").select("pos", F.coalesce("dir", "pos").alias("dir"))


def lowest_neighbor(field, sys, level, value="z", connectivity="vertex") -> DataFrame:
    """(pos, downhill): the lowest neighbour below the cell, the smallest position on ties; else NULL."""
    pairs = _pairs(field, sys, level, value, [], connectivity)
    return pairs.groupBy("pos").agg(F.min_by("nbr", F.when(F.col("zn") < F.col("z"), F.struct("zn", "nbr"))).alias("downhill"))


def flow_accumulation(directions: DataFrame, weight: str | None = None, cut: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int = 64) -> DataFrame:
    """(pos, accumulation): the weight of all cells that drain through a cell, itself included.

    Pointer doubling: round k knows each cell's sum over paths of up to 2^k steps and the cell 2^k steps on, so a river
    of n cells takes log2(n) rounds of one join and one grouped sum. Directions must be free of cycles but for pits.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    state = directions.select("pos", F.when(F.col("dir") != F.col("pos"), F.col("dir")).alias("nxt"), w.alias("acc"))
    before = None
    for _ in range(max_rounds):
        state = cut(state) if cut else state.persist()
        # Counting holds every part of the new state, so that the one before it may go.
        under_way = state.filter("nxt is not null").count()
        if before is not None:
            before.unpersist()
        before = None if cut else state
        if not under_way:
            return state.select("pos", F.col("acc").alias("accumulation"))
        # acc(x) = own sums over shorter paths + those of the cells whose 2^k-th successor is x.
        inflow = state.filter("nxt is not null").groupBy("nxt").agg(F.sum("acc").alias("more"))
        ahead = state.select(F.col("pos").alias("nxt"), F.col("nxt").alias("nn"))
        state = state.join(ahead, "nxt", "left").join(inflow.select(F.col("nxt").alias("pos"), "more"), "pos", "left").select("pos", F.col("nn").alias("nxt"), (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc"))
    raise RuntimeError("the directions hold a cycle")

"""Cell-axis encodings: dense ids, inclusive id ranges, or an implicit whole level (or prefix of it).

Rank and select arithmetic on ids is total: an id that names no cell has the rank of the next cell. Validation and range
detection are windows by block of positions, never one global sort in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.operators import regions
from tessellon.sources.errors import DGGSFormatError
from tessellon.systems.base import GridSystem, system

_ENCODINGS: dict[str, type] = {}


def register_encoding(name: str, kind: type) -> None:
    _ENCODINGS[name] = kind


def encoding(name: str):
    if name not in _ENCODINGS:
        raise DGGSFormatError("encoding", declared=name, observed=sorted(_ENCODINGS))
    return _ENCODINGS[name]()


@dataclass
class DenseEncoding:
    """One id a cell."""

    name: str = "none"

    def encode(self, region: DataFrame, sys: GridSystem, level: int) -> DataFrame:
        return regions.dense(region).select(sys.id_col(F.col("pos"), level).alias("cell"))

    def decode(self, stored: DataFrame, sys: GridSystem, level: int) -> DataFrame:
        pos = sys.pos_col(F.col("cell"), level)
        bad = F.raise_error(F.concat(F.lit(f"no {sys.name} cell of level {level}: "), F.coalesce(F.col("cell").cast("string"), F.lit("NULL"))))
        return stored.select(F.when(pos.isNull(), bad).otherwise(pos).cast("long").alias("pos"))


@dataclass
class RangesEncoding:
    """Inclusive (first, last) ids; an id inside a range may name no cell."""

    name: str = "ranges"

    def encode(self, region: DataFrame, sys: GridSystem, level: int) -> DataFrame:
        return idranges(region, sys, level)

    def decode(self, stored: DataFrame, sys: GridSystem, level: int) -> DataFrame:
        first, last = idrank_col(sys, F.col("first"), level), idrank_col(sys, F.col("last"), level, upper=True)
        return stored.select(first.alias("lo"), last.alias("hi")).filter("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("pos"))


@dataclass
class ImplicitEncoding:
    """No axis at all: positions 1..n of the level."""

    name: str = "implicit"

    def encode(self, region: DataFrame, sys: GridSystem, level: int) -> DataFrame:
        r = regions.dense(region).agg(F.count("*").alias("n"), F.max("pos").alias("m"), F.countDistinct("pos").alias("d")).first()
        if not r["n"] == r["d"] == (r["m"] or 0):
            raise DGGSFormatError("implicit", declared="positions 1..n", observed=f"{r['n']} cells up to position {r['m']}")
        return region.sparkSession.createDataFrame([(r["n"],)], "n long")

    def decode(self, stored: DataFrame, sys: GridSystem, level: int) -> DataFrame:
        n = stored.first()["n"]
        if n > sys.ncells(level):
            raise DGGSFormatError("count", declared=n, observed=sys.ncells(level))
        return stored.sparkSession.range(1, n + 1).withColumnRenamed("id", "pos")


for _kind in (DenseEncoding, RangesEncoding, ImplicitEncoding):
    register_encoding(_kind().name, _kind)


# --- rank and select ----------------------------------------------------------------------------------------------


def idvalid(sys: str | GridSystem, ids, level: int) -> np.ndarray:
    return system(sys).id_to_pos(np.asarray(ids, np.int64), level) > 0


def idselect(sys: str | GridSystem, ranks, level: int) -> np.ndarray:
    """Ids of 1-based ranks."""
    return system(sys).pos_to_id(np.asarray(ranks, np.int64), level)


def _unsigned(ids: np.ndarray) -> np.ndarray:
    return np.asarray(ids, np.int64).view(np.uint64)


def idrank(sys: str | GridSystem, ids, level: int, upper: bool = False) -> np.ndarray:
    """For any integer: the position of the first cell whose id is not smaller (upper: of the last not larger).

    Exact for the systems whose ids ascend with position; a binary search on the select function, so no id is refused.
    """
    s = system(sys)
    want = _unsigned(ids)
    lo, hi = np.ones(len(want), np.int64), np.full(len(want), s.ncells(level) + 1)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        here = _unsigned(s.pos_to_id(np.minimum(mid, s.ncells(level)), level))
        below = ((here <= want) if upper else (here < want)) & (mid <= s.ncells(level))
        open_ = lo < hi
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo - 1 if upper else lo


def idcount_between(sys: str | GridSystem, first, last, level: int) -> np.ndarray:
    return np.maximum(0, idrank(sys, last, level, upper=True) - idrank(sys, first, level) + 1)


def idrank_col(sys: str | GridSystem, ids, level: int, upper: bool = False):
    s = system(sys)

    def f(x: pd.Series) -> pd.Series:
        return pd.Series(idrank(s, x.to_numpy(np.int64), level, upper))

    return F.pandas_udf(f, "long")(ids)


# --- ranges -----------------------------------------------------------------------------------------------------


def idranges(region: DataFrame, sys: str | GridSystem, level: int, merge: str = "rank") -> DataFrame:
    """(first, last) inclusive ids: merge "rank" joins consecutive cells, "step" consecutive integers."""
    s = system(sys)
    if merge == "rank":
        runs = regions.compress(regions.dense(region))
        return runs.orderBy("lo").select(s.id_col(F.col("lo"), level).alias("first"), s.id_col(F.col("hi"), level).alias("last"))
    if merge != "step":
        raise ValueError("merge is 'rank' or 'step'")
    # A 64-bit pattern orders as unsigned once its sign bit is flipped.
    flip = F.lit(-(1 << 63))
    ids = regions.dense(region).distinct().select(s.id_col(F.col("pos"), level).alias("id"))
    keyed = ids.select(F.col("id").bitwiseXOR(flip).alias("pos"))
    return regions.compress(keyed).orderBy("lo").select(F.col("lo").bitwiseXOR(flip).alias("first"), F.col("hi").bitwiseXOR(flip).alias("last"))


def validate_ranges(ranges: DataFrame, expected: int | None = None, sys: str | GridSystem | None = None, level: int = 0) -> int:
    """Checks that (first, last) ascend without overlap and, if asked, that they hold `expected` cells; gives the count."""
    s = system(sys) if sys is not None else None
    lo, hi = (idrank_col(s, F.col("first"), level), idrank_col(s, F.col("last"), level, True)) if s else (F.col("first"), F.col("last"))
    r = ranges.select(lo.alias("lo"), hi.alias("hi"))
    if not r.filter("hi < lo").isEmpty():
        raise DGGSFormatError("ranges", declared="first <= last", observed="a range runs backwards")
    # Overlaps are found block by block.
    cutted = regions.split_ranges(r)
    w = Window.partitionBy("block").orderBy("lo", "hi")
    if not cutted.withColumn("before", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("before >= lo").isEmpty():
        raise DGGSFormatError("ranges", declared="disjoint", observed="two ranges overlap")
    n = r.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    checkcount(n, expected)
    return n


def checkcount(observed: int, expected: int | None) -> None:
    if expected is not None and observed != expected:
        raise DGGSFormatError("count", declared=expected, observed=observed)


def write_eligible(name: str, region: DataFrame, sys: str | GridSystem, level: int) -> bool:
    """Whether a region may be written so: distinct cells of the level, and the whole level for implicit."""
    r = regions.dense(region).agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    total = system(sys).ncells(level)
    ok = r["n"] == r["d"] and (r["n"] == 0 or (r["lo"] >= 1 and r["hi"] <= total))
    return bool(ok and (name != "implicit" or r["n"] == total))


# --- chunks -----------------------------------------------------------------------------------------------------


def nchunks(n: int, length: int) -> int:
    return -(-n // length)


def chunkof(k, length: int):
    """1-based chunk of a 1-based place."""
    return (k - 1) // length + 1


def chunkof_col(k, length: int):
    return F.floor((k - 1) / length) + 1


def chunkbounds(chunk: int, n: int, length: int) -> tuple[int, int]:
    return (chunk - 1) * length + 1, min(n, chunk * length)


def chunk_manifest(region: DataFrame, sys: str | GridSystem, level: int, length: int) -> DataFrame:
    """(chunk, first_id, last_id, length, offset) of a region's chunks of `length` cells each."""
    s = system(sys)
    placed = regions.ranked(region).withColumn("chunk", chunkof_col(F.col("rank"), length))
    m = placed.groupBy("chunk").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("length"))
    return m.select("chunk", s.id_col(F.col("lo"), level).alias("first_id"), s.id_col(F.col("hi"), level).alias("last_id"), "length", ((F.col("chunk") - 1) * length).alias("offset"))


def chunk_plan(sys: str | GridSystem, level: int, target: int = 1_000_000) -> int:
    """The ancestor level whose whole subtrees are the largest runs of at most `target` cells."""
    s = system(sys)
    for k in range(s.levels[0], level + 1):
        if s.ncells(level) / s.ncells(k) <= target:
            return k
    return level

"""The grid-system interface.

A position is a dense 1-based number within one level; an id is an identity that knows its own level. Relations are
keyed by position, which sorts alike everywhere; ids are 64-bit patterns. Every method works on numpy arrays; Column
methods wrap them in Arrow-vectorised functions unless a system has closed-form expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import sphere

XYZ = "struct<x:double,y:double,z:double>"
MODULES = ["healpix", "s2", "isea4r", "igeo7", "h3", "a5", "dem"]
_SYSTEMS: dict[str, Callable[[], GridSystem]] = {}


def register_system(name: str, make: Callable[[], GridSystem]) -> None:
    _SYSTEMS[name.lower()] = make


def system(name: str | GridSystem) -> GridSystem:
    """The system of that name; a registered name, in any case."""
    if isinstance(name, GridSystem):
        return name
    from importlib import import_module

    for module in MODULES:
        import_module(f"tessellon.systems.{module}")

    if name.lower() not in _SYSTEMS:
        raise ValueError(f"unknown grid system {name!r}; known: {', '.join(sorted(_SYSTEMS))}")
    return _SYSTEMS[name.lower()]()


def systems() -> list[str]:
    """Names of the six global systems (the raster lattice is not among them)."""
    return ["IGeo7", "H3", "HEALPix", "A5", "S2", "ISEA4R"]


class GridSystem:
    name: str = ""
    levels: range = range(0)
    has_sorted_subtrees = True
    equal_area = False
    maxneighbors = {"vertex": 8, "edge": 4}
    cap_inflation = 1.2

    def __reduce__(self):
        return (system, (self.name,))

    def __eq__(self, other):
        return type(self) is type(other) and self.__reduce__() == other.__reduce__()

    def __hash__(self):
        return hash(self.name)

    @property
    def maxlevel(self) -> int:
        return self.levels[-1]

    def check_level(self, level: int) -> int:
        if level not in self.levels:
            raise ValueError(f"{self.name} has levels {self.levels.start}:{self.levels.stop - 1}, not {level}")
        return level

    # --- to be given by a system -------------------------------------------------------------------------------

    def ncells(self, level: int) -> int:
        raise NotImplementedError

    def pos_to_id(self, pos: np.ndarray, level: int) -> np.ndarray:
        """Ids as signed bit patterns."""
        return np.asarray(pos, np.int64) - 1

    def id_to_pos(self, ids: np.ndarray, level: int) -> np.ndarray:
        """Positions; 0 for what is no cell of the level."""
        ids = np.asarray(ids, np.int64)
        return np.where((ids >= 0) & (ids < self.ncells(level)), ids + 1, 0)

    def parent_pos(self, pos: np.ndarray, level: int) -> np.ndarray:
        raise NotImplementedError

    def child_range(self, pos: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last position of the children one level down (sorted subtrees)."""
        raise NotImplementedError

    def centroid(self, pos: np.ndarray, level: int) -> np.ndarray:
        raise NotImplementedError

    def boundary(self, pos: np.ndarray, level: int) -> np.ndarray:
        """(n, vertices, 3) open rings, counter-clockwise from outside; NaN pads shorter rings at the end."""
        raise NotImplementedError

    def cellat(self, xyz: np.ndarray, level: int) -> np.ndarray:
        raise NotImplementedError

    def one_ring(self, pos: np.ndarray, level: int, connectivity: str = "vertex") -> np.ndarray:
        """(n, k) neighbouring positions counter-clockwise from the system's start; 0 pads at the end."""
        raise NotImplementedError

    # --- derived -----------------------------------------------------------------------------------------------

    def children_pos(self, pos: np.ndarray, level: int) -> list[np.ndarray]:
        lo, hi = self.child_range(pos, level)
        return [np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]

    def ancestor_pos(self, pos: np.ndarray, level: int, to: int) -> np.ndarray:
        if to > level:
            raise ValueError(f"level {to} is below level {level}")
        for at in range(level, to, -1):
            pos = self.parent_pos(pos, at)
        return np.asarray(pos, np.int64)

    def descendant_range(self, pos: np.ndarray, level: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last position of the descendants at level `to`."""
        if not self.has_sorted_subtrees:
            raise ValueError(f"descendants of {self.name} cells are not contiguous")
        lo = hi = np.asarray(pos, np.int64)
        for at in range(level, to):
            lo, hi = self.child_range(lo, at)[0], self.child_range(hi, at)[1]
        return lo, hi

    def area(self, pos: np.ndarray, level: int) -> np.ndarray:
        """Steradians."""
        if self.equal_area:
            return np.full(len(pos), 4 * np.pi / self.ncells(level))
        return sphere.ring_area(self.boundary(pos, level))

    def cap(self, pos: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(centre, radius) of a cap that covers each cell."""
        return sphere.rings_cap(self.centroid(pos, level), self.boundary(pos, level))

    def node_cap(self, pos: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A cap that covers a cell and all its descendants."""
        centre, radius = self.cap(pos, level)
        return centre, np.where(radius >= np.pi / 2, np.pi, np.minimum(np.pi, radius * self.cap_inflation))

    def neighbors(self, pos: np.ndarray, level: int, k: int = 1, connectivity: str = "vertex") -> list[np.ndarray]:
        """Rings 1..k of each cell, concatenated outward."""
        return [np.concatenate(r) if r else np.zeros(0, np.int64) for r in self.shells(pos, level, k, connectivity)]

    def ring(self, pos: np.ndarray, level: int, k: int, connectivity: str = "vertex") -> list[np.ndarray]:
        """The cells at distance exactly k; the cell itself for 0."""
        if k == 0:
            return [np.array([p]) for p in pos]
        return [r[k - 1] if len(r) >= k else np.zeros(0, np.int64) for r in self.shells(pos, level, k, connectivity)]

    def shells(self, pos: np.ndarray, level: int, k: int, connectivity: str = "vertex") -> list[list[np.ndarray]]:
        """Breadth-first shells; from the second on wound by azimuth about the cell, starting on the first spoke."""
        if k < 0:
            raise ValueError("the number of steps is negative")
        pos = np.asarray(pos, np.int64)
        out: list[list[np.ndarray]] = [[] for _ in pos]
        row = seen_row = np.arange(len(pos))
        last = seen = pos
        centre = spoke = None
        for step in range(k):
            if not len(last):
                break
            ring = self.one_ring(last, level, connectivity)
            own, cell = np.repeat(row, ring.shape[1]), ring.ravel()
            own, cell = own[cell > 0], cell[cell > 0]
            # Pairs of row and cell as single numbers; new ones in the order in which they are first met.
            _, code = np.unique(np.concatenate([seen, cell]), return_inverse=True)
            key = np.concatenate([seen_row, own]) * (len(code) + 1) + code
            fresh = np.flatnonzero(~np.isin(key[len(seen) :], key[: len(seen)]))
            _, first = np.unique(key[len(seen) :][fresh], return_index=True)
            at = fresh[np.sort(first)]
            own, cell = own[at], cell[at]
            if not len(cell):
                break
            if step == 0:
                order = np.argsort(own, kind="stable")
                own, cell = own[order], cell[order]
                centre = self.centroid(pos, level)
                spoke = np.zeros(len(pos))
                head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                spoke[own[head]] = sphere.azimuth(centre[own[head]], self.centroid(cell[head], level))
            else:
                phase = np.mod(sphere.azimuth(centre[own], self.centroid(cell, level)) - spoke[own], 2 * np.pi)
                phase = np.where(phase > 2 * np.pi - 1e-9, 0.0, phase)
                order = np.lexsort((cell, phase, own))
                own, cell = own[order], cell[order]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for r, shell in zip(own[begin].tolist(), np.split(cell, begin[1:]), strict=True):
                out[r].append(shell)
            seen_row, seen = np.concatenate([seen_row, own]), np.concatenate([seen, cell])
            row, last = own, cell
        return out

    # --- Columns -----------------------------------------------------------------------------------------------

    def levelgrid(self, spark: SparkSession, level: int, partitions: int | None = None) -> DataFrame:
        """(pos) of the complete level."""
        n = self.ncells(self.check_level(level))
        return (spark.range(1, n + 1) if partitions is None else spark.range(1, n + 1, 1, partitions)).withColumnRenamed("id", "pos")

    def _udf(self, returns: str, f: Callable):
        return F.pandas_udf(f, returns)

    def id_col(self, pos: Column, level: int) -> Column:
        def f(p: pd.Series) -> pd.Series:
            return pd.Series(self.pos_to_id(p.to_numpy(np.int64), level))

        return self._udf("long", f)(pos)

    def pos_col(self, ids: Column, level: int) -> Column:
        """NULL where an id is no cell of the level."""

        def f(p: pd.Series) -> pd.Series:
            return pd.Series(self.id_to_pos(p.fillna(-1).to_numpy(np.int64), level))

        found = self._udf("long", f)(ids)
        return F.when(ids.isNotNull() & (found > 0), found)

    def parent_col(self, pos: Column, level: int) -> Column:
        if level <= self.levels[0]:
            raise ValueError("a root cell has no parent")
        return self.ancestor_col(pos, level, level - 1)

    def ancestor_col(self, pos: Column, level: int, to: int) -> Column:
        if to > level:
            raise ValueError(f"level {to} is below level {level}")

        def f(p: pd.Series) -> pd.Series:
            return pd.Series(self.ancestor_pos(p.to_numpy(np.int64), level, to))

        return self._udf("long", f)(pos)

    def descendant_range_col(self, pos: Column, level: int, to: int) -> Column:
        """struct(lo, hi)."""
        if not self.has_sorted_subtrees:
            raise ValueError(f"descendants of {self.name} cells are not contiguous")

        def f(p: pd.Series) -> pd.DataFrame:
            lo, hi = self.descendant_range(p.to_numpy(np.int64), level, to)
            return pd.DataFrame({"lo": lo, "hi": hi})

        return self._udf("lo long, hi long", f)(pos)

    def children_col(self, pos: Column, level: int) -> Column:
        """Ascending positions one level down."""
        if self.has_sorted_subtrees:
            r = self.descendant_range_col(pos, level, level + 1)
            return F.sequence(r["lo"], r["hi"])

        def f(p: pd.Series) -> pd.Series:
            return pd.Series([c.tolist() for c in self.children_pos(p.to_numpy(np.int64), level)])

        return self._udf("array<long>", f)(pos)

    def cellat_col(self, lon: Column, lat: Column, level: int) -> Column:
        """Position of the cell at degrees; NULL where a coordinate is."""

        def f(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(self.cellat(sphere.unit_point(a.to_numpy(float), b.to_numpy(float)), level))

        both = lon.isNotNull() & lat.isNotNull()
        return F.when(both, self._udf("long", f)(F.coalesce(lon.cast("double"), F.lit(0.0)), F.coalesce(lat.cast("double"), F.lit(0.0))))

    def centroid_col(self, pos: Column, level: int) -> Column:
        def f(p: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(self.centroid(p.to_numpy(np.int64), level), columns=["x", "y", "z"])

        return self._udf("x double, y double, z double", f)(pos)

    def boundary_col(self, pos: Column, level: int) -> Column:
        """Open ring as array of (x, y, z)."""

        def f(p: pd.Series) -> pd.Series:
            rings = self.boundary(p.to_numpy(np.int64), level)
            return pd.Series([[{"x": v[0], "y": v[1], "z": v[2]} for v in r if not np.isnan(v[0])] for r in rings])

        return self._udf(f"array<{XYZ}>", f)(pos)

    def polygon_col(self, pos: Column, level: int) -> Column:
        """Closed ring."""
        ring = self.boundary_col(pos, level)
        return F.concat(ring, F.slice(ring, 1, 1))

    def area_col(self, pos: Column, level: int) -> Column:
        if self.equal_area:
            return F.lit(4 * np.pi / self.ncells(level))

        def f(p: pd.Series) -> pd.Series:
            return pd.Series(self.area(p.to_numpy(np.int64), level))

        return self._udf("double", f)(pos)

    def extent_col(self, pos: Column, level: int) -> Column:
        """Conservative (x0, x1, y0, y1) in degrees."""

        def f(p: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(sphere.rings_extent(self.boundary(p.to_numpy(np.int64), level)), columns=["x0", "x1", "y0", "y1"])

        return self._udf("x0 double, x1 double, y0 double, y1 double", f)(pos)

    def node_cap_col(self, pos: Column, level: int) -> Column:
        def f(p: pd.Series) -> pd.DataFrame:
            centre, radius = self.node_cap(p.to_numpy(np.int64), level)
            return pd.DataFrame({"x": centre[:, 0], "y": centre[:, 1], "z": centre[:, 2], "radius": radius})

        return self._udf("x double, y double, z double, radius double", f)(pos)

    def one_ring_col(self, pos: Column, level: int, connectivity: str = "vertex") -> Column:
        """Neighbouring positions, counter-clockwise from outside."""

        def f(p: pd.Series) -> pd.Series:
            return pd.Series([r[r > 0].tolist() for r in self.one_ring(p.to_numpy(np.int64), level, connectivity)])

        return self._udf("array<long>", f)(pos)

    def neighbors_col(self, pos: Column, level: int, k: int = 1, connectivity: str = "vertex") -> Column:
        def f(p: pd.Series) -> pd.Series:
            return pd.Series([r.tolist() for r in self.neighbors(p.to_numpy(np.int64), level, k, connectivity)])

        return self._udf("array<long>", f)(pos)

    def ring_col(self, pos: Column, level: int, k: int, connectivity: str = "vertex") -> Column:
        def f(p: pd.Series) -> pd.Series:
            return pd.Series([r.tolist() for r in self.ring(p.to_numpy(np.int64), level, k, connectivity)])

        return self._udf("array<long>", f)(pos)

    def neighborcount_col(self, pos: Column, level: int, connectivity: str = "vertex") -> Column:
        return F.size(self.one_ring_col(pos, level, connectivity))

"""The tiled elevation lattice: 64 800 one-degree tiles (level 0), their pixels (level 1), fewer columns towards the poles.

A tile's column count follows its equatorward edge. Tiles run from north to south, west to east; pixels tile by tile,
row by row from the north. A point belongs to the pixel with west <= lon < east and south <= lat < north.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.functions import sphere
from tessellon.systems.base import GridSystem, register_system

#: Latitude of the equatorward edge from which twice the reduction of columns holds.
BAND_EDGES = (0, 50, 60, 70, 80, 85)
BAND_FACTOR2 = (2, 3, 4, 6, 10, 20)
ROWS, COLUMNS = 180, 360


def band_factor2(lat_s: int) -> int:
    """Twice the reduction factor of the tile whose southern edge is lat_s."""
    if not -90 <= lat_s <= 89:
        raise ValueError(f"tile latitude {lat_s} is outside -90:89")
    edge = min(abs(lat_s), abs(lat_s + 1))
    return max(f for e, f in zip(BAND_EDGES, BAND_FACTOR2, strict=True) if edge >= e)


class ElevationLattice(GridSystem):
    levels = range(2)
    maxneighbors = {"vertex": None, "edge": 6}

    def __init__(self, n: int = 3600):
        if n <= 0 or n % 30:
            raise ValueError(f"a lattice needs a multiple of 30 rows a degree, not {n}")
        self.n = n
        self.name = f"DEM{n}"

    def __reduce__(self):
        return (ElevationLattice, (self.n,))

    @cached_property
    def columns(self) -> np.ndarray:
        """Pixels across a tile, by tile row from the north."""
        return np.array([2 * self.n // band_factor2(89 - r) for r in range(ROWS)], np.int64)

    @cached_property
    def rowbase(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(COLUMNS * self.columns * self.n)])

    def ncells(self, level):
        return ROWS * COLUMNS if level == 0 else int(self.rowbase[-1])

    def decode(self, ids, level: int):
        """(tile row, tile column, pixel row, pixel column)."""
        ids = np.asarray(ids, np.int64)
        if level == 0:
            return ids // COLUMNS, ids % COLUMNS, np.zeros_like(ids), np.zeros_like(ids)
        r = np.searchsorted(self.rowbase, ids, "right") - 1
        nc = self.columns[r]
        q, rest = np.divmod(ids - self.rowbase[r], nc * self.n)
        return r, q, rest // nc, rest % nc

    def encode(self, r, q, j, i):
        return self.rowbase[r] + q * self.columns[r] * self.n + j * self.columns[r] + i

    def tile(self, lat_s: int, lon_w: int) -> int:
        """Level-0 id of the tile with that lower-left corner."""
        band_factor2(lat_s)
        if not -180 <= lon_w <= 179:
            raise ValueError(f"tile longitude {lon_w} is outside -180:179")
        return (89 - lat_s) * COLUMNS + lon_w + 180

    def tilecorner(self, ids, level: int):
        r, q, _, _ = self.decode(ids, level)
        return 89 - r, q - 180

    def parent_pos(self, pos, level):
        if level <= 0:
            raise ValueError("a tile has no parent")
        r, q, _, _ = self.decode(np.asarray(pos, np.int64) - 1, 1)
        return r * COLUMNS + q + 1

    def child_range(self, pos, level):
        r, q, _, _ = self.decode(np.asarray(pos, np.int64) - 1, 0)
        lo = self.encode(r, q, 0, 0) + 1
        return lo, lo + self.columns[r] * self.n - 1

    def bounds(self, pos, level):
        """(west, east, south, north) in degrees."""
        r, q, j, i = self.decode(np.asarray(pos, np.int64) - 1, level)
        if level == 0:
            return q - 180.0, q - 179.0, 89.0 - r, 90.0 - r
        nc = self.columns[r]
        return q - 180 + i / nc, q - 180 + (i + 1) / nc, 90 - r - (j + 1) / self.n, 90 - r - j / self.n

    def centroid(self, pos, level):
        w, e, s, n = self.bounds(pos, level)
        return sphere.unit_point((w + e) / 2, (s + n) / 2)

    def boundary(self, pos, level):
        w, e, s, n = self.bounds(pos, level)
        return np.stack([sphere.unit_point(a, b) for a, b in ((w, s), (e, s), (e, n), (w, n))], 1)

    def area(self, pos, level):
        w, e, s, n = (np.radians(x) for x in self.bounds(pos, level))
        return (e - w) * (np.sin(n) - np.sin(s))

    def cellat(self, xyz, level):
        lon, lat = sphere.lonlat(np.asarray(xyz, float))
        return self.cellat_degrees(lon, lat, level)

    def cellat_degrees(self, lon, lat, level):
        lon = np.mod(np.asarray(lon, float) + 180, 360)
        lat = np.asarray(lat, float)
        r = np.clip(89 - np.floor(lat), 0, ROWS - 1).astype(np.int64)
        q = np.minimum(np.floor(lon), COLUMNS - 1).astype(np.int64)
        if level == 0:
            return r * COLUMNS + q + 1
        nc = self.columns[r]
        i = np.minimum(np.floor((lon - q) * nc), nc - 1).astype(np.int64)
        up = lat - (89.0 - r)
        j = np.clip(self.n - 1 - np.floor(up * self.n), 0, self.n - 1).astype(np.int64)
        return self.encode(r, q, j, i) + 1

    def cellat_col(self, lon: Column, lat: Column, level: int) -> Column:
        """Closed form with a ladder over the latitude bands."""
        x = F.pmod(lon.cast("double") + 180, F.lit(360.0))
        r = F.least(F.greatest(F.lit(89) - F.floor(lat), F.lit(0).cast("long")), F.lit(ROWS - 1).cast("long"))
        q = F.least(F.floor(x), F.lit(COLUMNS - 1).cast("long"))
        if level == 0:
            return r * COLUMNS + q + 1
        nc = F.element_at(F.lit([int(c) for c in self.columns]), (r + 1).cast("int")).cast("long")
        base = F.element_at(F.lit([int(c) for c in self.rowbase]), (r + 1).cast("int")).cast("long")
        i = F.least(F.floor((x - q) * nc), nc - 1)
        up = lat.cast("double") - (F.lit(89.0) - r)
        j = F.least(F.greatest(F.lit(self.n - 1) - F.floor(up * self.n), F.lit(0).cast("long")), F.lit(self.n - 1).cast("long"))
        return base + q * nc * self.n + j * nc + i + 1

    def one_ring(self, pos, level, connectivity="vertex"):
        """Counter-clockwise from east; neighbours across a change of band are those whose sides overlap (or touch)."""
        pos = np.asarray(pos, np.int64)
        found = []
        for p in pos:
            r, q, j, i = (int(a[0]) for a in self.decode(np.array([p - 1]), level))
            n, nc = (1, 1) if level == 0 else (self.n, int(self.columns[r]))
            total, col, row = COLUMNS * nc, q * nc + i, r * n + j

            def make(rr: int, cc: int, level=level, n=n) -> int:
                tile = rr // n
                if level == 0:
                    return tile * COLUMNS + cc % COLUMNS + 1
                width = int(self.columns[tile])
                cc %= COLUMNS * width
                return int(self.encode(np.array([tile]), cc // width, rr % n, cc % width)[0]) + 1

            def facing(rr: int, col=col, total=total, n=n, level=level, make=make) -> list[int]:
                """Cells of another row whose side overlaps ours (touches it, for vertex), west to east."""
                if not 0 <= rr < ROWS * n:
                    return []
                width = COLUMNS * (1 if level == 0 else int(self.columns[rr // n]))
                lo, hi = col * width, (col + 1) * width  # in units of 1 / (total * width)
                first, last = lo // total, -(-hi // total) - 1
                if connectivity == "vertex":
                    first -= lo % total == 0
                    last += hi % total == 0
                return [make(rr, c) for c in range(first, last + 1)]

            ring = [make(row, col + 1), *reversed(facing(row - 1)), make(row, col - 1), *facing(row + 1)]
            found.append(list(dict.fromkeys(c for c in ring if c != p)))
        out = np.zeros((len(pos), max(map(len, found), default=1)), np.int64)
        for k, ring in enumerate(found):
            out[k, : len(ring)] = ring
        return out

    def nesting_factor(self, fine: ElevationLattice) -> int:
        if fine.n % self.n:
            raise ValueError(f"{fine.n} rows a degree are no refinement of {self.n}")
        return fine.n // self.n

    def refine(self, fine: ElevationLattice, pos: int, level: int = 1) -> np.ndarray:
        """The fine lattice's cells of one cell, in raster order."""
        k = self.nesting_factor(fine)
        r, q, j, i = (int(a[0]) for a in self.decode(np.array([pos - 1]), level))
        if level == 0:
            return np.array([pos])
        rows, cols = np.divmod(np.arange(k * k), k)
        return fine.encode(np.full(k * k, r), q, k * j + rows, k * i + cols) + 1

    def coarsen(self, coarse: ElevationLattice, pos, level: int = 1) -> np.ndarray:
        k = coarse.nesting_factor(self)
        r, q, j, i = self.decode(np.asarray(pos, np.int64) - 1, level)
        return np.asarray(pos) if level == 0 else coarse.encode(r, q, j // k, i // k) + 1


for _n in (30, 1200, 3600):
    register_system(f"DEM{_n}", lambda n=_n: ElevationLattice(n))

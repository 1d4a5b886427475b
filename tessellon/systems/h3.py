"""H3: identity, hierarchy and positions of the 122 base cells' aperture-7 subtrees.

The published face tables that geometry and adjacency need are not available here, so cellat, boundaries and rings raise
NotImplementedError; everything that follows from the id's bits is complete.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.systems.base import GridSystem, register_system

#: The twelve pentagon base cells; a pentagon has no child 1 (the deleted direction).
PENTAGONS = np.array([4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117])
BASES, DIGITS, DELETED = 122, 15, 1
MODE = np.int64(1) << 59


class H3(GridSystem):
    name, levels = "H3", range(16)
    maxneighbors = {"vertex": 6, "edge": 6}

    def ncells(self, level):
        return 120 * 7**level + 2

    @staticmethod
    def base(ids):
        return (np.asarray(ids, np.int64) >> 45) & 127

    @staticmethod
    def resolution(ids):
        return (np.asarray(ids, np.int64) >> 52) & 15

    @staticmethod
    def digit(ids, k: int):
        return (np.asarray(ids, np.int64) >> (45 - 3 * k)) & 7

    @staticmethod
    def is_pentagon(ids):
        out = np.isin(H3.base(ids), PENTAGONS)
        for k in range(1, DIGITS + 1):
            d = H3.digit(ids, k)
            out &= (d == 0) | (d == 7)
        return out

    @staticmethod
    def is_valid(ids):
        ids = np.asarray(ids, np.int64)
        base, res = H3.base(ids), H3.resolution(ids)
        ok = ((ids >> 56) == 8) & (base < BASES)
        zero = np.isin(base, PENTAGONS)
        for k in range(1, DIGITS + 1):
            d = H3.digit(ids, k)
            ok &= np.where(k <= res, d != 7, d == 7) & ~(zero & (d == DELETED))
            zero &= d == 0
        return ok

    @staticmethod
    def _sizes(depth: int) -> tuple[int, int]:
        return 1 + 5 * (7**depth - 1) // 6, 7**depth

    def _ends(self, level: int) -> np.ndarray:
        pent, six = self._sizes(level)
        return np.cumsum(np.where(np.isin(np.arange(BASES), PENTAGONS), pent, six))

    def pos_to_id(self, pos, level):
        rest = np.asarray(pos, np.int64) - 1
        ends = self._ends(level)
        base = np.searchsorted(ends, rest, "right")
        rest = rest - np.where(base > 0, ends[base - 1], 0)
        pent = np.isin(base, PENTAGONS)
        ids = MODE | (np.int64(level) << 52) | (base.astype(np.int64) << 45) | ((np.int64(1) << (45 - 3 * level)) - 1)
        for k in range(1, level + 1):
            own, six = self._sizes(level - k)
            d = np.where(pent, np.where(rest < own, 0, 1 + (rest - own) // six), rest // six)
            rest = rest - np.where(pent, np.where(d > 0, own + (d - 1) * six, 0), d * six)
            ids = ids | (np.where(pent & (d >= DELETED), d + 1, d).astype(np.int64) << (45 - 3 * k))
            pent &= d == 0
        return ids

    def id_to_pos(self, ids, level):
        ids = np.asarray(ids, np.int64)
        ok = self.is_valid(ids) & (self.resolution(ids) == level)
        base = np.minimum(self.base(ids), BASES - 1)
        ends = self._ends(level)
        rank, pent = np.where(base > 0, ends[base - 1], 0), np.isin(base, PENTAGONS)
        for k in range(1, level + 1):
            own, six = self._sizes(level - k)
            d = self.digit(ids, k)
            rank = rank + np.where(pent, np.where(d > 0, own + (d - 2) * six, 0), d * six)
            pent &= d == 0
        return np.where(ok, rank + 1, 0)

    def parent_pos(self, pos, level):
        if level <= 0:
            raise ValueError("a root cell has no parent")
        return self.id_to_pos(self.ancestor_id(self.pos_to_id(pos, level), level - 1), level - 1)

    @staticmethod
    def ancestor_id(ids, to: int):
        ids = np.asarray(ids, np.int64)
        return (ids & ~(np.int64(15) << 52)) | (np.int64(to) << 52) | ((np.int64(1) << (45 - 3 * to)) - 1)

    @staticmethod
    def ancestor_id_col(ids: Column, to: int) -> Column:
        clear = ids.bitwiseAND(F.lit(~(15 << 52)))
        return clear.bitwiseOR(F.lit(to << 52)).bitwiseOR(F.lit((1 << (45 - 3 * to)) - 1))

    def child_range(self, pos, level):
        ids = self.pos_to_id(pos, level)
        first = (ids & ~(np.int64(15) << 52) & ~(np.int64(7) << (42 - 3 * level))) | (np.int64(level + 1) << 52)
        lo = self.id_to_pos(first, level + 1)
        return lo, lo + np.where(self.is_pentagon(ids), 5, 6)

    def get_pentagons(self, level: int) -> np.ndarray:
        ids = np.array([self.pos_to_id(np.array([b + 1]), 0)[0] for b in PENTAGONS])
        for at in range(level):
            ids = self.pos_to_id(self.child_range(self.id_to_pos(ids, at), at)[0], at + 1)
        return ids

    @staticmethod
    def max_disk_size(k: int) -> int:
        return 1 + 3 * k * (k + 1)

    def _missing(self, *_):
        raise NotImplementedError("H3 geometry and adjacency need published tables that are not available here")

    centroid = boundary = cellat = one_ring = cap = _missing

    def neighborcount(self, pos, level):
        """Structural: 5 about a pentagon, else 6."""
        return np.where(self.is_pentagon(self.pos_to_id(pos, level)), 5, 6)


register_system("H3", H3)

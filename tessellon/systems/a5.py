"""A5: identity and hierarchy. Ids carry a quintant (six bits) and a Hilbert place of two bits a level with a stop bit.

Level 0 has 12 faces, level 1 five quintants a face, and every further level four cells a cell. Subtrees are not
contiguous in position order at the top (a face's five quintants hold their subtrees apart), so a face's descendants
have no range. The pentagonal geometry (an equal-area dodecahedral projection with Hilbert anchors) is not offered:
cellat, boundaries and rings raise NotImplementedError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.systems.base import GridSystem, register_system


class A5(GridSystem):
    name, levels, has_sorted_subtrees = "A5", range(30), False
    maxneighbors = {"vertex": 11, "edge": 5}
    cap_inflation = 1.75

    def ncells(self, level):
        return 12 if level == 0 else 60 << (2 * (level - 1))

    def rank(self, pos, level):
        """(face, quintant within the face, Hilbert place); the quintant is -1 on level 0."""
        p = np.asarray(pos, np.int64) - 1
        if level == 0:
            return p, np.full_like(p, -1), np.zeros_like(p)
        quintant = p >> (2 * (level - 1))
        return quintant // 5, quintant % 5, p & ((1 << (2 * (level - 1))) - 1)

    def pos_to_id(self, pos, level):
        """Quintant in the top six bits, then the place, closed by a single 1 bit that tells the level."""
        face, quintant, place = self.rank(pos, level)
        if level == 0:
            return (face << 58) | (np.int64(1) << 57)
        shift = 58 - 2 * level
        return ((face * 5 + quintant) << 58) | (place << (shift + 2)) | (np.int64(1) << shift) if level > 0 else face

    @staticmethod
    def level_of(ids):
        """From the lowest set bit."""
        ids = np.asarray(ids, np.int64)
        low = ids & -ids
        at = np.where(low > 0, np.log2(np.maximum(low, 1).astype(float)), 63).astype(np.int64)
        return np.where(at == 57, 0, (58 - at) // 2)

    def id_to_pos(self, ids, level):
        ids = np.asarray(ids, np.int64)
        top = (ids >> 58) & 63
        if level == 0:
            return np.where((self.level_of(ids) == 0) & (top < 12), top + 1, 0)
        ok = (self.level_of(ids) == level) & (top < 60)
        place = (ids >> (60 - 2 * level)) & ((1 << (2 * (level - 1))) - 1)
        return np.where(ok, (top << (2 * (level - 1))) + place + 1, 0)

    def parent_pos(self, pos, level):
        if level <= 0:
            raise ValueError("a root cell has no parent")
        p = np.asarray(pos, np.int64) - 1
        return (p // 5 if level == 1 else p >> 2) + 1

    def children_pos(self, pos, level):
        fan = 5 if level == 0 else 4
        return [np.arange((p - 1) * fan + 1, p * fan + 1) for p in np.asarray(pos, np.int64)]

    def children_col(self, pos: Column, level: int) -> Column:
        fan = 5 if level == 0 else 4
        return F.sequence((pos - 1) * fan + 1, pos * fan)

    def ancestor_col(self, pos: Column, level: int, to: int) -> Column:
        if to > level:
            raise ValueError(f"level {to} is below level {level}")
        if to == level:
            return pos
        if to >= 1:
            return F.shiftright(pos - 1, 2 * (level - to)) + 1
        return F.floor(F.shiftright(pos - 1, 2 * (level - 1)) / 5) + 1

    def _missing(self, *_):
        raise NotImplementedError("A5 geometry is not offered")

    centroid = boundary = cellat = one_ring = cap = _missing


register_system("A5", A5)

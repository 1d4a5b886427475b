"""Systems on congruent faces with an aligned 2^l x 2^l lattice: id = face * 4^l + curve code, position = id + 1.

Faces are joined by geometry: two face edges are one when the chart maps their sample points to the same places. The
ring about a cell is walked edge by edge and, about each corner, cell by cell, so vertices of three, four and five
cells need no tables. Hierarchy is pure bit arithmetic, as numpy and as Spark expressions alike.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.functions import bits
from tessellon.systems.base import GridSystem

#: Edge d leaves the lattice in direction +s, +t, -s, -t; its ends lie counter-clockwise.
_OUT = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])


class QuadFaceSystem(GridSystem):
    faces = 0
    #: The edge at which a ring starts, and chart samples of a cell's edge.
    start_edge = 0
    edge_segments = 1

    def chart(self, s: np.ndarray, t: np.ndarray, face: np.ndarray) -> np.ndarray:
        """Points of face coordinates in [0, 1]^2, counter-clockwise from outside."""
        raise NotImplementedError

    def encode(self, ix: np.ndarray, iy: np.ndarray, face: np.ndarray, level: int) -> np.ndarray:
        return (face << (2 * level)) | bits.morton_encode(ix, iy)

    def decode(self, ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = ids & ((1 << (2 * level)) - 1)
        ix, iy = bits.morton_decode(code)
        return ix, iy, ids >> (2 * level)

    def ncells(self, level: int) -> int:
        return self.faces << (2 * level)

    def parent_pos(self, pos, level):
        return ((np.asarray(pos, np.int64) - 1) >> 2) + 1

    def child_range(self, pos, level):
        lo = ((np.asarray(pos, np.int64) - 1) << 2) + 1
        return lo, lo + 3

    def centroid(self, pos, level):
        ix, iy, face = self.decode(np.asarray(pos, np.int64) - 1, level)
        n = 1 << level
        return self.chart((ix + 0.5) / n, (iy + 0.5) / n, face)

    def boundary(self, pos, level):
        """From the corner (1, 1), then (0, 1), (0, 0), (1, 0)."""
        ix, iy, face = (a[:, None] for a in self.decode(np.asarray(pos, np.int64) - 1, level))
        n, m = 1 << level, self.edge_segments
        k = np.arange(m)
        ds = np.concatenate([m - k, np.zeros(m), k, np.full(m, m)]) / m
        dt = np.concatenate([np.full(m, m), m - k, np.zeros(m), k]) / m
        return self.chart((ix + ds) / n, (iy + dt) / n, face)

    @cached_property
    def seams(self) -> np.ndarray:
        """[face, edge] -> (face, edge, 1 if the edges run against each other, as counter-clockwise rings do, else 0)."""
        at = np.array([0.25, 0.75])
        points = {}
        for f in range(self.faces):
            for d in range(4):
                s, t = (1.0 if d == 0 else 0.0, at) if d in (0, 2) else (at, 1.0 if d == 1 else 0.0)
                points[f, d] = self.chart(np.broadcast_to(s, 2).astype(float), np.broadcast_to(t, 2).astype(float), np.full(2, f))
        out = np.zeros((self.faces, 4, 3), np.int64)
        for key, p in points.items():
            for other, q in points.items():
                if key == other:
                    continue
                if np.abs(p - q).max() < 1e-9:
                    out[key] = (*other, 0)
                elif np.abs(p - q[::-1]).max() < 1e-9:
                    out[key] = (*other, 1)
        return out

    def cross(self, ix, iy, face, edge, n):
        """The cell behind an edge, and the edge of it that was crossed."""
        x, y = ix + _OUT[edge, 0], iy + _OUT[edge, 1]
        inside = (x >= 0) & (x < n) & (y >= 0) & (y < n)
        g, d, flip = np.moveaxis(self.seams[face, edge], -1, 0)
        along = np.where(edge % 2 == 0, iy, ix)
        along = np.where(flip == 1, n - 1 - along, along)
        far = np.where(d < 2, n - 1, 0)
        return (
            np.where(inside, x, np.where(d % 2 == 0, far, along)),
            np.where(inside, y, np.where(d % 2 == 0, along, far)),
            np.where(inside, face, g),
            np.where(inside, (edge + 2) % 4, d),
        )

    def one_ring(self, pos, level, connectivity="vertex"):
        pos = np.asarray(pos, np.int64)
        n = 1 << level
        cell = self.decode(pos - 1, level)
        found = []
        behind = [self.cross(*cell, np.full(len(pos), d), n) for d in range(4)]
        for step in range(4):
            d = (self.start_edge + step) % 4
            found.append(self.encode(*behind[d][:3], level))
            if connectivity == "vertex":
                # About the corner between edge d and the next, counter-clockwise, until the next edge's neighbour.
                last = self.encode(*behind[(d + 1) % 4][:3], level)
                x, y, f, e = behind[d]
                open_ = np.ones(len(pos), bool)
                for _ in range(2):
                    x, y, f, e = self.cross(x, y, f, (e - 1) % 4, n)
                    near = self.encode(x, y, f, level)
                    open_ &= (near != last) & (near != pos - 1)
                    found.append(np.where(open_, near, -1))
        ring = np.stack(found, 1) + 1
        ring[ring == pos[:, None]] = 0
        for k in range(1, ring.shape[1]):
            ring[:, k][(ring[:, :k] == ring[:, k : k + 1]).any(1)] = 0
        order = np.argsort(ring == 0, axis=1, kind="stable")
        ring = np.take_along_axis(ring, order, 1)
        return ring[:, : max(1, int((ring > 0).sum(1).max(initial=1)))]

    # --- Columns in closed form --------------------------------------------------------------------------------

    def id_col(self, pos: Column, level: int) -> Column:
        return pos - 1

    def pos_col(self, ids: Column, level: int) -> Column:
        return F.when((ids >= 0) & (ids < self.ncells(level)), ids + 1)

    def ancestor_col(self, pos: Column, level: int, to: int) -> Column:
        if to > level:
            raise ValueError(f"level {to} is below level {level}")
        return F.shiftright(pos - 1, 2 * (level - to)) + 1

    def descendant_range_col(self, pos: Column, level: int, to: int) -> Column:
        k = 2 * (to - level)
        return F.struct((F.shiftleft(pos - 1, k) + 1).alias("lo"), F.shiftleft(pos, k).alias("hi"))

    def children_col(self, pos: Column, level: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.shiftleft(pos - 1, 2) + k)

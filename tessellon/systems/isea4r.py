"""ISEA4R: ten rhombi of two icosahedron faces each, split into 4^l equal-area cells; Morton codes within a rhombus."""

from __future__ import annotations

import numpy as np

from tessellon.systems import icosahedron as ico
from tessellon.systems.base import register_system
from tessellon.systems.quadface import QuadFaceSystem

#: Fixed values of the numbering: vertices at the corners (0,0), (1,0), (1,1), (0,1) of rhombus 0 to 9.
CORNERS = np.array([[1, 6, 2, 0], [2, 7, 3, 0], [3, 8, 4, 0], [4, 9, 5, 0], [5, 10, 1, 0], [10, 11, 6, 1], [6, 11, 7, 2], [7, 11, 8, 3], [8, 11, 9, 4], [9, 11, 10, 5]])
#: Triangles (0,0)-(1,1)-(0,1), which owns the diagonal, and (0,0)-(1,0)-(1,1).
UPPER, LOWER = CORNERS[:, [0, 2, 3]], CORNERS[:, [0, 1, 2]]


class ISEA4R(QuadFaceSystem):
    name, faces, levels, equal_area = "ISEA4R", 10, range(30), True
    start_edge, edge_segments, cap_inflation = 0, 8, 1.0
    maxneighbors = {"vertex": 9, "edge": 4}

    def chart(self, s, t, face):
        s, t, face = np.broadcast_arrays(np.asarray(s, float), np.asarray(t, float), face)
        up = t >= s
        corners = ico.VERTICES[np.where(up[..., None], UPPER[face], LOWER[face])]
        weights = np.where(up[..., None], np.stack([1 - t, s, t - s], -1), np.stack([1 - s, s - t, t], -1))
        return ico.to_sphere(corners, weights)

    def cellat(self, xyz, level):
        p = np.asarray(xyz, float)
        face = ico.nearest_face(p)
        # The rhombus and half that stand on each face.
        table = np.zeros((20, 2), np.int64)
        for d in range(10):
            for half, tri in ((0, UPPER[d]), (1, LOWER[d])):
                table[next(f for f in range(20) if set(ico.FACES[f]) == set(tri))] = d, half
        d, half = table[face].T
        tri = np.where(half[:, None] == 0, UPPER[d], LOWER[d])
        w = ico.to_weights(ico.VERTICES[tri], p)
        s = np.where(half == 0, w[:, 1], w[:, 1] + w[:, 2])
        t = np.where(half == 0, w[:, 1] + w[:, 2], w[:, 2])
        n = 1 << level
        ix, iy = (np.clip(np.floor(c * n).astype(np.int64), 0, n - 1) for c in (s, t))
        return self.encode(ix, iy, d, level) + 1

    @staticmethod
    def rowmajor(ix, iy, face, level: int):
        return (face << (2 * level)) + (iy << level) + ix


register_system("ISEA4R", ISEA4R)

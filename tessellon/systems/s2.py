"""S2: six cube faces, quadratic projection, Hilbert codes; ids are face * 4^l + Hilbert position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions import staged
from tessellon.systems.base import register_system
from tessellon.systems.quadface import QuadFaceSystem

#: Fixed values of the published face frames: normal, u axis, v axis of faces 0 to 5.
NORMAL = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1]], float)
U_AXIS = np.array([[0, 1, 0], [-1, 0, 0], [-1, 0, 0], [0, 0, -1], [0, 0, -1], [0, 1, 0]], float)
V_AXIS = np.array([[0, 0, 1], [0, 0, 1], [0, -1, 0], [0, -1, 0], [1, 0, 0], [1, 0, 0]], float)
#: Fixed values of the published curve: by orientation (bit 0 swaps the axes, bit 1 inverts them) the place of quadrant
#: 2i + j, and by place the change of orientation.
PLACE = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
TURN = np.array([1, 0, 0, 3])
QUADRANT = np.argsort(PLACE, 1)
#: Bits of each coordinate that the curve goes through in one step of an expression.
STEP_BITS = 3


def _steps(bits: int) -> list[int]:
    """By orientation, then by that many bits of ix and of iy: the places on the curve times 4, plus the orientation after them."""
    turn, ix, iy = (a.ravel() for a in np.meshgrid(range(4), range(1 << bits), range(1 << bits), indexing="ij"))
    code = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        place = PLACE[turn, 2 * ((ix >> b) & 1) + ((iy >> b) & 1)]
        code, turn = (code << 2) | place, turn ^ TURN[place]
    return ((code << 2) | turn).tolist()


class S2(QuadFaceSystem):
    name, faces, levels = "S2", 6, range(31)
    cap_inflation = 1.0

    @staticmethod
    def st_to_uv(s):
        return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)

    @staticmethod
    def uv_to_st(u):
        return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.maximum(u, 0)), 1 - 0.5 * np.sqrt(1 - 3 * np.minimum(u, 0)))

    def chart(self, s, t, face):
        u, v = (self.st_to_uv(np.asarray(c, float))[..., None] for c in (s, t))
        p = NORMAL[face] + u * U_AXIS[face] + v * V_AXIS[face]
        return p / np.linalg.norm(p, axis=-1, keepdims=True)

    def encode(self, ix, iy, face, level):
        turn, code = face & 1, np.zeros_like(face)
        for b in range(level - 1, -1, -1):
            place = PLACE[turn, 2 * ((ix >> b) & 1) + ((iy >> b) & 1)]
            code, turn = (code << 2) | place, turn ^ TURN[place]
        return (face << (2 * level)) | code

    def decode(self, ids, level):
        ids = np.asarray(ids, np.int64)
        face = ids >> (2 * level)
        turn, ix, iy = face & 1, np.zeros_like(ids), np.zeros_like(ids)
        for b in range(level - 1, -1, -1):
            place = (ids >> (2 * b)) & 3
            q = QUADRANT[turn, place]
            ix, iy, turn = (ix << 1) | (q >> 1), (iy << 1) | (q & 1), turn ^ TURN[place]
        return ix, iy, face

    @staticmethod
    def rowmajor(ix, iy, face, level: int):
        return (face << (2 * level)) + (iy << level) + ix

    @staticmethod
    def from_rowmajor(q, level: int):
        q = np.asarray(q, np.int64)
        n = 1 << level
        return q & (n - 1), (q >> level) & (n - 1), q >> (2 * level)

    def cellat(self, xyz, level):
        p = np.asarray(xyz, float)
        a = np.abs(p)
        axis = np.where((a[..., 0] >= a[..., 1]) & (a[..., 0] >= a[..., 2]), 0, np.where(a[..., 1] >= a[..., 2], 1, 2))
        major = np.take_along_axis(p, axis[..., None], -1)[..., 0]
        face = np.where(major >= 0, axis, axis + 3)
        w = (p * NORMAL[face]).sum(-1)
        n = 1 << level
        ix, iy = (np.clip(np.floor(self.uv_to_st((p * ax[face]).sum(-1) / w) * n).astype(np.int64), 0, n - 1) for ax in (U_AXIS, V_AXIS))
        return self.encode(ix, iy, face, level) + 1

    # --- Columns in stages: the curve goes through tables of a few bits ------------------------------------------

    @staticmethod
    def _curve_stages(level: int) -> list[staged.Stage]:
        """hit0, hit1, ... of ix, iy and face: entries of _steps, from the highest bits on."""
        out, low = [], level
        while low:
            n = low % STEP_BITS or STEP_BITS
            low -= n

            def step(v, k=len(out), n=n, low=low):
                turn = v[f"hit{k - 1}"].bitwiseAND(F.lit(3)) if k else v["face"].bitwiseAND(F.lit(1))
                ix, iy = (F.shiftright(v[c], low).bitwiseAND(F.lit((1 << n) - 1)) for c in ("ix", "iy"))
                at = F.shiftleft(turn, 2 * n) + F.shiftleft(ix, n) + iy + 1
                return {f"hit{k}": F.element_at(F.lit(_steps(n)), at.cast("int")).cast("long")}

            out.append(step)
        return out

    @staticmethod
    def _position(level: int):
        def at(v):
            out, left = F.shiftleft(v["face"], 2 * level), level
            for k in range(-(-level // STEP_BITS)):
                left -= left % STEP_BITS or STEP_BITS
                out = out + F.shiftleft(F.shiftright(v[f"hit{k}"], 2), 2 * left)
            return out + 1

        return at

    @staticmethod
    def _locate_stages(level: int) -> list[staged.Stage]:
        n = 1 << level

        def axis(v):
            x, y, z = (F.abs(v[c]) for c in "xyz")
            return {"axis": F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)}

        def major(v):
            return {"major": F.when(v["axis"] == 0, v["x"]).when(v["axis"] == 1, v["y"]).otherwise(v["z"])}

        def face(v):
            return {"face": F.when(v["major"] >= 0, v["axis"]).otherwise(v["axis"] + 3).cast("long")}

        def along(v, axes):
            out = F.lit(0.0)
            for f in range(6):
                c = int(np.flatnonzero(axes[f])[0])
                out = F.when(v["face"] == f, v["xyz"[c]] * float(axes[f][c])).otherwise(out)
            return out / F.abs(v["major"])

        def plane(v):
            return {"u": along(v, U_AXIS), "v": along(v, V_AXIS)}

        def lattice(u):
            st = F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * u)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * u))
            return F.least(F.greatest(F.floor(st * n), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))

        return [axis, major, face, plane, lambda v: {"ix": lattice(v["u"]), "iy": lattice(v["v"])}, *S2._curve_stages(level)]

    def encode_col(self, ix: Column, iy: Column, face: Column, level: int) -> Column:
        return staged.column({"ix": ix, "iy": iy, "face": face}, self._curve_stages(level), self._position(level)) - 1

    def cellat_xyz_col(self, x: Column, y: Column, z: Column, level: int) -> Column:
        return staged.column({"x": x, "y": y, "z": z}, self._locate_stages(level), self._position(level))

    def with_cell_xyz(self, df: DataFrame, x: str, y: str, z: str, level: int, out: str = "pos") -> DataFrame:
        """df with the position column; stays in generated code."""
        return staged.frame(df, {"x": F.col(x), "y": F.col(y), "z": F.col(z)}, self._locate_stages(level), {out: self._position(level)})

    def cellat_col(self, lon: Column, lat: Column, level: int) -> Column:
        a, b = F.radians(lon), F.radians(lat)
        return self.cellat_xyz_col(F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b), level)


register_system("S2", S2)

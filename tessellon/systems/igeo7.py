"""IGeo7: aperture-7 hexagons on the icosahedron with Z7 ids: 4 bits of base vertex, twenty 3-bit digits, 7 pads.

About its base vertex a cell has a place in a plane of five 60-degree sectors (the sixth is missing). A digit moves by a
lattice unit, each level's lattice being the last one's divided by 2 - w or 3 + w (w a cube root of unity) in turn; a
path whose first step lies past the missing sector is turned back by 60 degrees. So a centre is a sum of complex
steps, and a point's cell is the nearest lattice place, read back into digits by remainders modulo 7.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellon.systems import icosahedron as ico
from tessellon.systems.base import GridSystem, register_system

#: Fixed values of the published encoding: the lattice direction (multiples of 60 degrees) of digits 1 to 6, the digit
#: that pentagons lack below base vertices 0 to 5 and 6 to 11, and the vertex towards which each base's plane is laid.
DIRECTION = np.array([-1, 5, 3, 4, 1, 0, 2])
MISSING = np.array([2] * 6 + [5] * 6)
TOWARDS = [1, 10, 6, 7, 8, 9, 11, 11, 11, 11, 11, 8]
DIGITS, PAD = 20, (1 << 60) - 1

OMEGA = np.exp(2j * np.pi / 3)
UNITS = np.exp(1j * np.pi / 3 * np.arange(6))
#: The same units as pairs (a, b) of a + b w.
PAIRS = np.array([[1, 0], [1, 1], [0, 1], [-1, 0], [-1, -1], [0, -1]])
RINGS = np.array([ico.neighbours_ccw(b, f) for b, f in enumerate(TOWARDS)])
EDGE = 3**0.5 * ico.RADIUS
_STEP = [3 + OMEGA if k % 2 == 0 else 2 - OMEGA for k in range(DIGITS + 1)]
SCALE = np.concatenate([[1], np.cumprod(_STEP[1:])])
#: Digit of each remainder modulo 7 of a + r b, for the two kinds of level.
_ROOT = {0: 4, 1: 2}
_DIGIT = {kind: np.array([next((d for d in range(1, 7) if (PAIRS[DIRECTION[d]] @ [1, r]) % 7 == m), 0) for m in range(7)]) for kind, r in _ROOT.items()}


def _degrees(u):
    """In [0, 360); what rounding has put just below 360 is 0."""
    out = np.mod(np.degrees(np.angle(u)), 360.0)
    return np.where(out > 360.0 - 1e-6, 0.0, out)


class IGeo7(GridSystem):
    name, levels, equal_area = "IGeo7", range(20), True
    maxneighbors = {"vertex": 6, "edge": 6}

    def ncells(self, level):
        return 10 * 7**level + 2

    # --- Z7 ids -------------------------------------------------------------------------------------------------

    @staticmethod
    def base(z):
        return (np.asarray(z, np.int64) >> 60) & 15

    @staticmethod
    def digit(z, k: int):
        return (np.asarray(z, np.int64) >> (60 - 3 * k)) & 7

    @staticmethod
    def resolution(z):
        """Digits before the first pad."""
        z = np.asarray(z, np.int64)
        out, open_ = np.zeros(z.shape, np.int64), np.ones(z.shape, bool)
        for k in range(1, DIGITS + 1):
            open_ &= IGeo7.digit(z, k) != 7
            out += open_
        return out

    @staticmethod
    def is_pentagon(z):
        out = np.ones(np.shape(z), bool)
        for k in range(1, DIGITS + 1):
            d = IGeo7.digit(z, k)
            out &= (d == 0) | (d == 7)
        return out

    @staticmethod
    def is_valid(z):
        base, ok, padded, zero = IGeo7.base(z), np.ones(np.shape(z), bool), np.zeros(np.shape(z), bool), np.ones(np.shape(z), bool)
        for k in range(1, DIGITS + 1):
            d = IGeo7.digit(z, k)
            ok &= ~(padded & (d != 7)) & ~(zero & (d == MISSING[np.minimum(base, 11)]))
            padded |= d == 7
            zero &= d == 0
        return ok & (base < 12)

    @staticmethod
    def to_string(z: int) -> str:
        z = int(z) & (1 << 64) - 1
        digits = "".join(str(z >> (60 - 3 * k) & 7) for k in range(1, DIGITS + 1))
        return f"{z >> 60:02d}" + digits.rstrip("7")

    @staticmethod
    def from_string(s: str) -> int:
        if not (2 <= len(s) <= 22 and s.isdigit() and int(s[:2]) < 12 and all(c < "7" for c in s[2:])):
            raise ValueError(f"{s!r} is no Z7 string")
        z = int(s[:2]) << 60
        for k in range(1, DIGITS + 1):
            z |= (int(s[1 + k]) if 1 + k < len(s) else 7) << (60 - 3 * k)
        z = z - (1 << 64) if z >= 1 << 63 else z
        if not IGeo7.is_valid(np.array([z]))[0]:
            raise ValueError(f"{s!r} names a cell that the pentagon lacks")
        return z

    @staticmethod
    def to_hex(z: int) -> str:
        return f"{int(z) & (1 << 64) - 1:016x}"

    @staticmethod
    def from_hex(s: str) -> int:
        z = int(s, 16)
        return z - (1 << 64) if z >= 1 << 63 else z

    def _digits(self, z, level):
        return np.stack([self.digit(z, k) for k in range(1, level + 1)], 1) if level else np.zeros((len(z), 0), np.int64)

    @staticmethod
    def _pack(base, digits):
        level = digits.shape[1]
        z = np.asarray(base, np.int64) << 60
        for k in range(level):
            z = z | (digits[:, k].astype(np.int64) << (57 - 3 * k))
        return z | (PAD >> (3 * level))

    # --- positions ------------------------------------------------------------------------------------------------

    @staticmethod
    def _sizes(depth: int) -> tuple[int, int]:
        """Descendants of a pentagon and of a hexagon."""
        return (5 * 7**depth + 1) // 6, 7**depth

    def pos_to_id(self, pos, level):
        rest = np.asarray(pos, np.int64) - 1
        base, rest = np.divmod(rest, self._sizes(level)[0])
        digits, pent = np.zeros((len(rest), level), np.int64), np.ones(len(rest), bool)
        for k in range(level):
            own, six = self._sizes(level - k - 1)
            d = np.where(pent, np.where(rest < own, 0, 1 + (rest - own) // six), rest // six)
            rest = rest - np.where(pent, np.where(d > 0, own + (d - 1) * six, 0), d * six)
            digits[:, k] = np.where(pent & (d >= MISSING[base]), d + 1, d)
            pent &= d == 0
        return self._pack(base, digits)

    def id_to_pos(self, ids, level):
        z = np.asarray(ids, np.int64)
        ok = self.is_valid(z) & (self.resolution(z) == level)
        base = np.minimum(self.base(z), 11)
        rank, pent = base * self._sizes(level)[0], np.ones(len(z), bool)
        for k in range(level):
            own, six = self._sizes(level - k - 1)
            d = self.digit(z, k + 1)
            less = d - (MISSING[base] < d)
            rank = rank + np.where(pent, np.where(d > 0, own + (less - 1) * six, 0), d * six)
            pent &= d == 0
        return np.where(ok, rank + 1, 0)

    def parent_pos(self, pos, level):
        if level <= 0:
            raise ValueError("a root cell has no parent")
        z = self.pos_to_id(pos, level)
        return self.id_to_pos(z | (7 << (60 - 3 * level)), level - 1)

    def child_range(self, pos, level):
        z = self.pos_to_id(pos, level)
        first = self.id_to_pos(z & ~(np.int64(7) << (57 - 3 * level)), level + 1)
        return first, first + np.where(self.is_pentagon(z), 5, 6)

    def descendant_range(self, pos, level, to):
        z = self.pos_to_id(pos, level)
        first = z
        for k in range(level, to):
            first = first & ~(np.int64(7) << (57 - 3 * k))
        pent, six = self._sizes(to - level)
        lo = self.id_to_pos(first, to)
        return lo, lo + np.where(self.is_pentagon(z), pent, six) - 1

    # --- the plane about a base vertex --------------------------------------------------------------------------

    def _place(self, z, level):
        """(base, complex place in units of an icosahedron edge, within the five sectors)."""
        base, digits = self.base(z), self._digits(z, level)
        u, first, step = np.zeros(len(base), complex), np.full(len(base), -1.0), np.zeros(len(base), np.int64)
        for k in range(level):
            d = digits[:, k]
            u = u + np.where(d > 0, UNITS[DIRECTION[d]], 0) / SCALE[k + 1]
            fresh = (first < 0) & (d > 0)
            first = np.where(fresh, np.mod(60.0 * DIRECTION[d] - np.degrees(np.angle(SCALE[k + 1])), 360), first)
            step = np.where(fresh, k + 1, step)
        gap = np.mod(60.0 * DIRECTION[MISSING[base]] - np.degrees(np.angle(SCALE[step])), 360)
        past = first > gap
        u = np.where(past, u * np.conj(UNITS[1]), u)
        slot = np.mod(np.where(past, first - 60, first), 360)
        at = slot + np.mod(_degrees(u) - slot + 180, 360) - 180
        return base, np.where(first < 0, 0, np.where(at < -1e-9, u * np.conj(UNITS[1]), np.where(at >= 300 - 1e-9, u * UNITS[1], u)))

    @staticmethod
    def _wrapped(u, near):
        """A place beside the seam brought back into the sectors, on the side of `near`."""
        out = _degrees(u) >= 300 - 1e-9
        return np.where(out & (np.abs(u) > 1e-12), u * np.where(_degrees(near) > 150, UNITS[1], np.conj(UNITS[1])), u)

    @staticmethod
    def _lift(base, u):
        angle = _degrees(u)
        k = np.minimum(4, np.floor(angle / 60).astype(np.int64))
        v = u * np.conj(UNITS[k])
        second = v.imag / np.sin(np.pi / 3)
        first = v.real - second / 2
        w = np.stack([1 - first - second, first, second], -1)
        corners = ico.VERTICES[np.stack([base, RINGS[base, k], RINGS[base, (k + 1) % 5]], -1)]
        return ico.to_sphere(corners, w)

    def centroid(self, pos, level):
        base, u = self._place(self.pos_to_id(pos, level), level)
        return np.where((np.abs(u) < 1e-13)[:, None], ico.VERTICES[base], self._lift(base, u))

    def boundary(self, pos, level):
        z = self.pos_to_id(pos, level)
        base, u = self._place(z, level)
        out = np.full((len(u), 6, 3), np.nan)
        corner = (UNITS + np.roll(UNITS, -1)) / 3 / SCALE[level]
        for j in range(6):
            out[:, j] = self._lift(base, self._wrapped(u + corner[j], u))
        pent = np.flatnonzero(self.is_pentagon(z))
        if len(pent):
            b = base[pent]
            gap = 60.0 * DIRECTION[MISSING[b]] - np.degrees(np.angle(SCALE[level]))
            for k in range(5):
                turned = np.mod(gap + 60.0 * (k + 1) - 30, 300)
                out[pent, k] = self._lift(b, np.exp(1j * np.radians(turned)) / 3**0.5 / abs(SCALE[level]))
            out[pent, 5] = np.nan
        return out

    def area(self, pos, level):
        six = 4 * np.pi / (10 * 7.0**level)
        return np.where(self.is_pentagon(self.pos_to_id(pos, level)), 5 / 6 * six, six)

    def area_col(self, pos, level):
        return GridSystem.area_col(_Unequal(self), pos, level)

    def cellat(self, xyz, level):
        p = np.asarray(xyz, float)
        tri = ico.FACES[ico.nearest_face(p)]
        w = ico.to_weights(ico.VERTICES[tri], p)
        out = np.zeros(len(p), np.int64)
        order = np.argsort(-w, axis=1, kind="stable")
        for shift in (0.0, 1e-9, -1e-9j):
            for c in range(3):
                live = np.flatnonzero(out == 0)
                if not len(live):
                    return out
                at = order[live, c]
                base = tri[live, at]
                nxt = (at + 1) % 3
                k = np.argmax(RINGS[base] == tri[live, nxt][:, None], 1)
                rows = np.arange(len(live))
                u = (w[live][rows, nxt] + w[live][rows, (at + 2) % 3] * UNITS[1]) * UNITS[k]
                z = self._nearest(base, u + shift / abs(SCALE[level]), level)
                out[live] = np.where(z == -1, 0, self.id_to_pos(z, level))
        if (out == 0).any():
            # On a tie of rounding: the nearest centre among the cells about a point drawn a little inwards.
            for i in np.flatnonzero(out == 0):
                q = p[i] + 1e-7 * ico.CENTRES[ico.nearest_face(p[i : i + 1])[0]]
                out[i] = self.cellat((q / np.linalg.norm(q))[None], level)[0]
        return out

    def _nearest(self, base, u, level):
        """Ids of the lattice cells nearest to places, -1 where that is no cell of the base's."""
        q = u * SCALE[level]
        b = 2 * q.imag / 3**0.5
        a = q.real + b / 2
        # Rounding to the nearest lattice point in three coordinates that sum to zero.
        x, y, s = a, b - a, -b
        rx, ry, rs = np.rint(x), np.rint(y), np.rint(s)
        ex, ey, es = np.abs(rx - x), np.abs(ry - y), np.abs(rs - s)
        off = rx + ry + rs != 0
        rx = np.where(off & (ex >= ey) & (ex >= es), -ry - rs, rx)
        rs = np.where(off & ~((ex >= ey) & (ex >= es)) & (ey < es), -rx - ry, rs)
        la, lb = rx.astype(np.int64), -rs.astype(np.int64)
        # A lattice place past the seam is a cell on its other side.
        want = self._wrapped((la + lb * OMEGA) / SCALE[level], u)
        out = np.full(len(u), -1, np.int64)
        for turn in (0, 1, 5, 2, 4):
            ca, cb = la, lb
            for _ in range(turn):
                ca, cb = ca - cb, ca
            digits = np.zeros((len(u), level), np.int64)
            for k in range(level, 0, -1):
                kind = k % 2
                d = _DIGIT[kind][(ca + _ROOT[kind] * cb) % 7]
                step = np.where((d > 0)[:, None], PAIRS[DIRECTION[d]], 0)
                ca, cb = ca - step[:, 0], cb - step[:, 1]
                ca, cb = ((2 * ca + cb) // 7, (3 * cb - ca) // 7) if kind == 0 else ((3 * ca - cb) // 7, (ca + 2 * cb) // 7)
                digits[:, k - 1] = d
            z = self._pack(base, digits)
            ok = (ca == 0) & (cb == 0) & self.is_valid(z) & (out == -1)
            if ok.any():
                rows = np.flatnonzero(ok)
                back = self._place(z[rows], level)[1]
                same = np.abs(back - want[rows]) < 1e-6 / abs(SCALE[level])
                out[rows[same]] = z[rows[same]]
        return out

    def one_ring(self, pos, level, connectivity="vertex"):
        pos = np.asarray(pos, np.int64)
        base, u = self._place(self.pos_to_id(pos, level), level)
        ring = np.stack([self.cellat(self._lift(base, self._wrapped(u + UNITS[j] / SCALE[level], u)), level) for j in range(6)], 1)
        ring[ring == pos[:, None]] = 0
        for k in range(1, 6):
            ring[:, k][(ring[:, :k] == ring[:, k : k + 1]).any(1)] = 0
        return np.take_along_axis(ring, np.argsort(ring == 0, axis=1, kind="stable"), 1)

    # --- Columns of the id codec ---------------------------------------------------------------------------------

    @staticmethod
    def base_col(z: Column) -> Column:
        return F.shiftrightunsigned(z, 60)

    @staticmethod
    def digit_col(z: Column, k: int) -> Column:
        return F.shiftrightunsigned(z, 60 - 3 * k).bitwiseAND(F.lit(7))

    @staticmethod
    def resolution_col(z: Column) -> Column:
        out = F.lit(DIGITS)
        for k in range(DIGITS, 0, -1):
            out = F.when(IGeo7.digit_col(z, k) == 7, F.lit(k - 1)).otherwise(out)
        return out

    @staticmethod
    def ancestor_id_col(z: Column, to: int) -> Column:
        """The ancestor's id: digits below its level padded."""
        return z.bitwiseOR(F.lit(PAD >> (3 * to)))

    @staticmethod
    def hex_col(z: Column) -> Column:
        return F.lower(F.lpad(F.hex(z), 16, "0"))

    @staticmethod
    def string_col(z: Column) -> Column:
        digits = [IGeo7.digit_col(z, k).cast("string") for k in range(1, DIGITS + 1)]
        return F.concat(F.lpad(IGeo7.base_col(z).cast("string"), 2, "0"), F.rtrim(F.lit("7"), F.concat(*digits)))


class _Unequal:
    """A system whose cells, though of equal design area, differ at pentagons."""

    equal_area = False

    def __init__(self, system):
        self._system = system

    def __getattr__(self, name):
        return getattr(self._system, name)


register_system("IGeo7", IGeo7)

"""HEALPix: 12 * 4^l equal-area pixels, NESTED ids, RING as an alternate numbering.

The chart is the published one: on face f with base ring r = 2, 3, 4 and base column p, the point (s, t) lies on ring
coordinate j = r - s - t (poles at 0 and 4), equatorial between 1 and 3 and polar beyond.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions import bits, sphere, staged
from tessellon.systems.base import register_system
from tessellon.systems.quadface import QuadFaceSystem

#: Fixed values of the base pixels: ring and column.
BASE_RING = np.repeat([2, 3, 4], 4)
BASE_COLUMN = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


class HEALPix(QuadFaceSystem):
    name, faces, levels, equal_area = "HEALPix", 12, range(30), True
    start_edge, edge_segments, cap_inflation = 2, 8, 1.0

    def chart(self, s, t, face):
        j = BASE_RING[face] - s - t
        width = np.where(j < 1, j, np.where(j > 3, 4 - j, 1.0))
        z = np.where(j < 1, 1 - width**2 / 3, np.where(j > 3, width**2 / 3 - 1, (2 - j) * 2 / 3))
        # sin(colatitude) without cancellation at the poles: 1 - z^2 = (1 - |z|)(1 + |z|).
        polar = (j < 1) | (j > 3)
        sine = np.where(polar, width * np.sqrt((1 + np.abs(z)) / 3), np.sqrt(np.maximum(0.0, 1 - z * z)))
        column = BASE_COLUMN[face] * width + s - t
        phi = np.pi / 4 * np.divide(column, width, out=np.zeros(np.broadcast(column, width).shape), where=width > 0)
        return np.stack([sine * np.cos(phi), sine * np.sin(phi), z], -1)

    def cellat(self, xyz, level):
        n = 1 << level
        x, y, z = np.moveaxis(np.asarray(xyz, float), -1, 0)
        za, quarter = np.abs(z), np.mod(np.arctan2(y, x) * (2 / np.pi), 4.0)
        belt = za <= 2 / 3
        up = np.floor(n * (0.5 + quarter) - n * (z * 0.75)).astype(np.int64)
        down = np.floor(n * (0.5 + quarter) + n * (z * 0.75)).astype(np.int64)
        fu, fd = up >> level, down >> level
        face_b = np.where(fu == fd, (fu & 3) | 4, np.where(fu < fd, fu, fd + 8))
        sector = np.minimum(3, np.floor(quarter).astype(np.int64))
        part = quarter - sector
        width = n * np.where(za < 0.99, np.sqrt(np.maximum(0.0, 3 * (1 - za))), np.hypot(x, y) / np.sqrt((1 + za) / 3))
        right = np.minimum(np.floor(part * width).astype(np.int64), n - 1)
        left = np.minimum(np.floor((1 - part) * width).astype(np.int64), n - 1)
        north = z >= 0
        ix = np.where(belt, down & (n - 1), np.where(north, n - left - 1, right))
        iy = np.where(belt, n - (up & (n - 1)) - 1, np.where(north, n - right - 1, left))
        face = np.where(belt, face_b, sector + np.where(north, 0, 8))
        return self.encode(ix, iy, face, level) + 1

    # --- RING ---------------------------------------------------------------------------------------------------

    @staticmethod
    def ring_nlon(ring, level: int):
        """Pixels of ring 1..4n-1."""
        n = 1 << level
        return 4 * np.minimum(n, np.minimum(ring, 4 * n - ring))

    @staticmethod
    def ring_first(ring, level: int):
        """1-based id of a ring's first pixel."""
        n, ring = 1 << level, np.asarray(ring, np.int64)
        return 1 + np.where(ring <= n, 2 * ring * (ring - 1), np.where(ring <= 3 * n, 2 * n * (n - 1) + (ring - n) * 4 * n, 12 * n * n - 2 * (4 * n - ring) * (4 * n - ring + 1)))

    def nested_to_ring(self, nested, level: int):
        """0-based NESTED ids to 1-based RING ids."""
        n = 1 << level
        ix, iy, face = self.decode(np.asarray(nested, np.int64), level)
        ring = BASE_RING[face] * n - ix - iy - 1
        width = np.minimum(n, np.minimum(ring, 4 * n - ring))
        shift = np.where((ring < n) | (ring > 3 * n), 0, (ring - n) & 1)
        column = (BASE_COLUMN[face] * width + ix - iy + 1 + shift) // 2
        column = np.where(column > 4 * width, column - 4 * width, np.where(column < 1, column + 4 * width, column))
        return self.ring_first(ring, level) + column - 1

    def ring_to_nested(self, ring_id, level: int):
        """1-based RING ids to 0-based NESTED ids, through the pixel centre's exact ring coordinates."""
        n = 1 << level
        p = np.asarray(ring_id, np.int64) - 1
        cap, belt = 2 * n * (n - 1), 12 * n * n - 2 * n * (n - 1)

        def root(q):
            r = np.floor((1 + np.sqrt(1 + 2 * q.astype(float))) / 2).astype(np.int64)
            r = np.where(2 * r * (r - 1) > q, r - 1, r)
            return np.where(2 * r * (r + 1) <= q, r + 1, r)

        north, south = root(np.maximum(p, 0)), root(np.maximum(12 * n * n - 1 - p, 0))
        ring = np.where(p < cap, north, np.where(p < belt, (p - cap) // (4 * n) + n, 4 * n - south))
        column = p - (self.ring_first(ring, level) - 1)
        width = np.minimum(n, np.minimum(ring, 4 * n - ring))
        polar = (ring < n) | (ring > 3 * n)
        shift = np.where(polar, 0, (ring - n) & 1)
        # Twice the column coordinate of the centre, in units of an eighth of the ring.
        twice = 2 * column + 1 - shift
        candidates = []
        for f in range(12):
            diff = twice - BASE_COLUMN[f] * width
            diff = np.mod(diff + 4 * width, 8 * width) - 4 * width
            total = BASE_RING[f] * n - 1 - ring
            ok = ((total + diff) % 2 == 0) & (total + diff >= 0) & (total - diff >= 0)
            ix, iy = (total + diff) // 2, (total - diff) // 2
            candidates.append((ok & (ix < n) & (iy < n), ix, iy))
        face = np.argmax(np.stack([c[0] for c in candidates]), 0)
        ix = np.choose(face, [c[1] for c in candidates])
        iy = np.choose(face, [c[2] for c in candidates])
        return self.encode(ix, iy, face, level)

    # --- Columns in closed form --------------------------------------------------------------------------------

    @staticmethod
    def _locate_stages(level: int) -> list[staged.Stage]:
        """From lon (degrees) and z to ix, iy, face: no trigonometry, a square root in the caps only."""
        n, size = 1 << level, F.lit(float(1 << level))

        def polar(v):
            return {"t": F.pmod(v["lon"], F.lit(360.0)) / 90.0, "za": F.abs(v["z"])}

        def lines(v):
            sector = F.least(F.lit(3).cast("long"), F.floor(v["t"]))
            return {
                "up": F.floor(size * (F.lit(0.5) + v["t"]) - size * (v["z"] * 0.75)),
                "down": F.floor(size * (F.lit(0.5) + v["t"]) + size * (v["z"] * 0.75)),
                "sector": sector,
                "part": v["t"] - sector,
                "w": size * F.sqrt(F.greatest(F.lit(0.0), F.lit(3.0) * (F.lit(1.0) - v["za"]))),
            }

        def sides(v):
            last = F.lit(n - 1).cast("long")
            return {"right": F.least(F.floor(v["part"] * v["w"]), last), "left": F.least(F.floor((F.lit(1.0) - v["part"]) * v["w"]), last), "fu": F.shiftright(v["up"], level), "fd": F.shiftright(v["down"], level)}

        def lattice(v):
            belt, north = v["za"] <= 2 / 3, v["z"] >= 0
            face_b = F.when(v["fu"] == v["fd"], v["fu"].bitwiseAND(F.lit(3)).bitwiseOR(F.lit(4))).when(v["fu"] < v["fd"], v["fu"]).otherwise(v["fd"] + 8)
            return {
                "ix": F.when(belt, v["down"].bitwiseAND(F.lit(n - 1))).when(north, F.lit(n - 1) - v["left"]).otherwise(v["right"]),
                "iy": F.when(belt, F.lit(n - 1) - v["up"].bitwiseAND(F.lit(n - 1))).when(north, F.lit(n - 1) - v["right"]).otherwise(v["left"]),
                "face": F.when(belt, face_b).when(north, v["sector"]).otherwise(v["sector"] + 8),
            }

        return [polar, lines, sides, lattice]

    @staticmethod
    def _position(level: int):
        return lambda v: F.shiftleft(v["face"], 2 * level) + bits.morton_encode_col(v["ix"], v["iy"]) + 1

    def cellat_z_col(self, lon: Column, z: Column, level: int) -> Column:
        """Position at longitude in degrees and z = sin(latitude)."""
        return staged.column({"lon": lon, "z": z}, self._locate_stages(level), self._position(level))

    def with_cell_z(self, df: DataFrame, lon: str, z: str, level: int, out: str = "pos") -> DataFrame:
        """df with the position column; stays in generated code."""
        return staged.frame(df, {"lon": F.col(lon), "z": F.col(z)}, self._locate_stages(level), {out: self._position(level)})

    def cellat_col(self, lon: Column, lat: Column, level: int) -> Column:
        return self.cellat_z_col(lon.cast("double"), F.sin(F.radians(lat)), level)

    @staticmethod
    def _ring_stages(level: int) -> list[staged.Stage]:
        n = 1 << level

        def split(v):
            ids = v["pos"] - 1
            return {"code": ids.bitwiseAND(F.lit((1 << (2 * level)) - 1)), "face": F.shiftright(ids, 2 * level)}

        def lattice(v):
            ix, iy = bits.morton_decode_col(v["code"])
            return {"ix": ix, "iy": iy, "base": F.shiftright(v["face"], 2) + 2}

        def ring(v):
            return {"column": F.when(v["base"] == 3, (v["face"] - 4) * 2).otherwise((v["face"] % 4) * 2 + 1), "ring": v["base"] * n - v["ix"] - v["iy"] - 1}

        def width(v):
            return {"width": F.least(F.lit(n).cast("long"), v["ring"], F.lit(4 * n) - v["ring"])}

        return [split, lattice, ring, width]

    @staticmethod
    def _centre_stages(level: int) -> list[staged.Stage]:
        n = 1 << level

        def height(v):
            w = v["width"] / F.lit(float(n))
            z = F.when(v["ring"] < n, 1 - w * w / 3).when(v["ring"] > 3 * n, w * w / 3 - 1).otherwise((F.lit(2.0 * n) - v["ring"]) * 2 / (3.0 * n))
            return {"w": w, "z": z, "phi": F.lit(np.pi / 4) * (v["column"] * v["width"] + v["ix"] - v["iy"]) / v["width"]}

        def sine(v):
            return {"sine": F.when((v["ring"] < n) | (v["ring"] > 3 * n), v["w"] * F.sqrt((1 + F.abs(v["z"])) / 3)).otherwise(F.sqrt(1 - v["z"] * v["z"]))}

        return [*HEALPix._ring_stages(level), height, sine]

    @staticmethod
    def _centre(v) -> Column:
        return F.struct((v["sine"] * F.cos(v["phi"])).alias("x"), (v["sine"] * F.sin(v["phi"])).alias("y"), v["z"].alias("z"))

    def centroid_col(self, pos: Column, level: int) -> Column:
        return staged.column({"pos": pos}, self._centre_stages(level), self._centre)

    def with_centroid(self, df: DataFrame, level: int, out: str = "centre", pos: str = "pos") -> DataFrame:
        return staged.frame(df, {"pos": F.col(pos)}, self._centre_stages(level), {out: self._centre})

    @staticmethod
    def _ring_number(level: int):
        n = 1 << level

        def place(v):
            shift = F.when((v["ring"] < n) | (v["ring"] > 3 * n), F.lit(0)).otherwise((v["ring"] - n) % 2)
            return {"k": F.floor((v["column"] * v["width"] + v["ix"] - v["iy"] + 1 + shift) / 2)}

        def number(v):
            k, ring, width = v["k"], v["ring"], v["width"]
            k = F.when(k > 4 * width, k - 4 * width).when(k < 1, k + 4 * width).otherwise(k)
            first = F.when(ring <= n, 2 * ring * (ring - 1)).when(ring <= 3 * n, F.lit(2 * n * (n - 1)) + (ring - n) * (4 * n)).otherwise(F.lit(12 * n * n) - 2 * (4 * n - ring) * (4 * n - ring + 1))
            return first + k

        return place, number

    def ring_id_col(self, pos: Column, level: int) -> Column:
        """1-based RING id of a position."""
        place, number = self._ring_number(level)
        return staged.column({"pos": pos}, [*self._ring_stages(level), place], number)

    def with_ring_id(self, df: DataFrame, level: int, out: str = "ring_id", pos: str = "pos") -> DataFrame:
        place, number = self._ring_number(level)
        return staged.frame(df, {"pos": F.col(pos)}, [*self._ring_stages(level), place], {out: number})

    def lonlat_of(self, pos, level: int):
        return sphere.lonlat(self.centroid(pos, level))


register_system("HEALPix", HEALPix)

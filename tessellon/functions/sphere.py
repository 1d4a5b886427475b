"""Geometry on the unit sphere, for arrays of points (n, 3) and rings (n, vertices, 3); NaN pads rings at the end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cap is widened by this factor against rounding; wider than a hemisphere it is the whole sphere.
CAP_SLACK = 1.0001


def unit_point(lon, lat) -> np.ndarray:
    """Degrees to (n, 3)."""
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], -1)


def lonlat(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(p[..., 1], p[..., 0])), np.degrees(np.arctan2(p[..., 2], np.hypot(p[..., 0], p[..., 1])))


def unit_point_col(lon: Column, lat: Column) -> Column:
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(b) * F.cos(a)).alias("x"), (F.cos(b) * F.sin(a)).alias("y"), F.sin(b).alias("z"))


def lonlat_col(p: Column) -> Column:
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(F.atan2(p["z"], F.hypot(p["x"], p["y"]))).alias("lat"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distance in radians from the chord, exact for near points."""
    return 2 * np.arcsin(np.minimum(1.0, np.linalg.norm(a - b, axis=-1) / 2))


def distance_col(a: Column, b: Column) -> Column:
    chord = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)
    return 2 * F.asin(F.least(F.lit(1.0), chord / 2))


def frame(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """East and north at a point; at a pole, along x's direction."""
    east = np.stack([-c[..., 1], c[..., 0], np.zeros(c.shape[:-1])], -1)
    size = np.linalg.norm(east, axis=-1, keepdims=True)
    east = np.where(size > 1e-12, east / np.maximum(size, 1e-300), np.array([0.0, 1.0, 0.0]))
    return east, np.cross(c, east)


def azimuth(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angle of p about c, counter-clockwise from outside, from east."""
    east, north = frame(c)
    return np.arctan2((p * north).sum(-1), (p * east).sum(-1))


def bearing_col(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees clockwise from north, [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def next_vertex(rings: np.ndarray) -> np.ndarray:
    """Each vertex's successor; the last real one is followed by the first."""
    after = np.roll(rings, -1, axis=1)
    return np.where(np.isnan(after), rings[:, :1], after)


def ring_area(rings: np.ndarray) -> np.ndarray:
    """Signed area in steradians, positive counter-clockwise; triangles fanned from the ring's mean direction."""
    centre = np.nansum(rings, 1)
    centre /= np.linalg.norm(centre, axis=-1, keepdims=True)
    a, b = rings, next_vertex(rings)
    c = centre[:, None]
    triple = (c * np.cross(a, b)).sum(-1)
    dots = 1 + (a * b).sum(-1) + (a * c).sum(-1) + (b * c).sum(-1)
    return np.nansum(2 * np.arctan2(triple, dots), 1)


def rings_cap(centre: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    radius = np.nanmax(distance(rings, centre[:, None]), 1) * CAP_SLACK
    return centre, np.where(radius >= np.pi / 2, np.pi, radius)


def merge_caps(c1, r1, c2, r2) -> tuple[np.ndarray, float]:
    """The smallest cap over two."""
    d = float(distance(c1, c2))
    if d + r2 <= r1:
        return c1, r1
    if d + r1 <= r2:
        return c2, r2
    r = min(np.pi, (d + r1 + r2) / 2)
    if d >= np.pi - 1e-12 or r >= np.pi:
        return c1, np.pi
    t = (r - r1) / d
    c = (np.sin((1 - t) * d) * c1 + np.sin(t * d) * c2) / np.sin(d) if d > 0 else c1
    return c, r


def cap_contains_col(p: Column, x: float, y: float, z: float, radius: float) -> Column:
    """Whether a point struct lies in a cap."""
    chord = (p["x"] - x) ** 2 + (p["y"] - y) ** 2 + (p["z"] - z) ** 2
    return F.lit(True) if radius >= np.pi else chord <= F.lit(float((2 * np.sin(radius / 2)) ** 2))


def caps_meet(c1, r1, c2, r2) -> np.ndarray:
    return distance(c1, c2) <= r1 + r2


def rings_extent(rings: np.ndarray) -> np.ndarray:
    """(n, 4) conservative lon/lat boxes in degrees; all longitudes where a ring holds a pole or crosses the antimeridian."""
    nxt = next_vertex(rings)
    lon, lat = lonlat(rings)
    lon2, lat2 = lonlat(nxt)
    # The highest and lowest latitude of an arc may lie inside it.
    normal = np.cross(rings, nxt)
    normal /= np.maximum(np.linalg.norm(normal, axis=-1, keepdims=True), 1e-300)
    top = np.stack([-normal[..., 0] * normal[..., 2], -normal[..., 1] * normal[..., 2], 1 - normal[..., 2] ** 2], -1)
    size = np.linalg.norm(top, axis=-1, keepdims=True)
    top /= np.maximum(size, 1e-300)
    inside = (np.cross(normal, rings) * top).sum(-1) * (np.cross(normal, nxt) * top).sum(-1) < 0
    high = inside & ((top * (rings + nxt)).sum(-1) > 0) & (size[..., 0] > 1e-12)
    low = inside & ((top * (rings + nxt)).sum(-1) < 0) & (size[..., 0] > 1e-12)
    y1 = np.nanmax(np.where(high, lonlat(top)[1], np.fmax(lat, lat2)), 1)
    y0 = np.nanmin(np.where(low, lonlat(-top)[1], np.fmin(lat, lat2)), 1)
    turn = np.mod(lon2 - lon + 180, 360) - 180
    around = np.abs(np.nansum(turn, 1)) > 180
    crosses = np.nanmax(np.abs(lon2 - lon), 1) > 180
    x0, x1 = np.nanmin(lon, 1), np.nanmax(lon, 1)
    wide = around | crosses
    north = around & (np.nanmean(lat, 1) > 0)
    south = around & ~north
    return np.stack([np.where(wide, -180, x0), np.where(wide, 180, x1), np.where(south, -90, y0), np.where(north, 90, y1)], 1)


def point_in_ring(ring: np.ndarray, p: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """1 inside, 0 outside, -1 undecidable (on the border), for points against one ring smaller than a hemisphere side
    chosen by its winding: the inside is left of its edges."""
    a, b = ring, np.roll(ring, -1, axis=0)
    # Sum of turning angles about p of the ring's vertices.
    east, north = frame(p)
    x, y = a @ east.T, a @ north.T
    angle = np.arctan2(y, x)
    turn = np.mod(np.roll(angle, -1, axis=0) - angle + np.pi, 2 * np.pi) - np.pi
    winding = np.rint(turn.sum(0) / (2 * np.pi)).astype(int)
    normal = np.cross(a, b)
    size = np.linalg.norm(normal, axis=1)
    ok = size > 0
    normal, ra, rb = normal[ok] / size[ok, None], a[ok], b[ok]
    off = np.abs(normal @ p.T)
    between = (np.cross(normal, ra) @ p.T >= -tol) & (np.cross(rb, normal) @ p.T >= -tol)
    border = ((off <= tol) & between).any(0)
    area = ring_area(ring[None])[0]
    inside = winding != 0
    # The antipode of the ring's inside also winds; it is told apart by its side of the mean direction.
    mean = ring.mean(0)
    if np.linalg.norm(mean) > 1e-6:
        reach = distance(ring, mean / np.linalg.norm(mean)).max()
        if reach < np.pi / 2:
            inside &= p @ mean > 0
    if area < 0:
        inside = ~inside
    return np.where(border, -1, inside.astype(int))


def arc_distance(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Radians from points p (n, 3) to arcs a-b (m, 3): (n, m)."""
    normal = np.cross(a, b)
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    normal = normal / np.maximum(size, 1e-300)
    ends = np.minimum(distance(p[:, None], a[None]), distance(p[:, None], b[None]))
    between = (p @ np.cross(normal, a).T >= 0) & (p @ np.cross(b, normal).T >= 0) & (size[:, 0] > 0)
    return np.where(between, np.minimum(ends, np.arcsin(np.minimum(1.0, np.abs(p @ normal.T)))), ends)


def arcs_cross(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether arcs a-b (n, 3) and c-d (m, 3) cross or touch: (n, m)."""
    n1, n2 = np.cross(a, b), np.cross(c, d)
    s1, s2 = n1 @ c.T, n1 @ d.T
    s3, s4 = (n2 @ a.T).T, (n2 @ b.T).T
    line = np.cross(n1[:, None], n2[None])
    # Opposite sides of each other's planes, and the crossing on both arcs (not at the antipode).
    same = ((line * (a + b)[:, None]).sum(-1) * (line * (c + d)[None]).sum(-1)) > 0
    return (s1 * s2 <= 0) & (s3 * s4 <= 0) & same


def clip_area(subject: np.ndarray, window: np.ndarray) -> float:
    """Area of a ring inside a convex ring, both counter-clockwise: the ring is cut by each edge's half-space in turn."""
    ring = subject
    window = window[np.linalg.norm(np.roll(window, -1, axis=0) - window, axis=1) > 1e-14]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(ring):
            return 0.0
        normal = np.cross(a, b)
        side = ring @ normal
        nxt, nside = np.roll(ring, -1, axis=0), np.roll(side, -1)
        out = []
        for p, q, s, t in zip(ring, nxt, side, nside, strict=True):
            if s >= 0:
                out.append(p)
            if (s > 0 > t) or (s < 0 < t):
                m = p * t - q * s
                m = m / np.linalg.norm(m)
                out.append(m if m @ (p + q) > 0 else -m)
        ring = np.array(out)
    return max(0.0, float(ring_area(ring[None])[0])) if len(ring) >= 3 else 0.0


def is_convex(ring: np.ndarray, tol: float = 1e-12) -> bool:
    """Whether a counter-clockwise ring turns left everywhere (repeated vertices aside)."""
    keep = np.linalg.norm(np.roll(ring, -1, axis=0) - ring, axis=1) > 1e-14
    r = ring[keep]
    normal = np.cross(r, np.roll(r, -1, axis=0))
    return bool(((normal * np.roll(r, -2, axis=0)).sum(1) >= -tol * np.linalg.norm(normal, axis=1)).all())


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area common to two rings: the other is clipped by a convex one, else by b's triangles about its mean direction
    (exact where that sees all of b's border)."""
    if is_convex(b):
        return clip_area(a, b)
    if is_convex(a):
        return clip_area(b, a)
    c = b.mean(0) / np.linalg.norm(b.mean(0))
    return sum(clip_area(a, np.stack([c, p, q])) for p, q in zip(b, np.roll(b, -1, axis=0), strict=True))

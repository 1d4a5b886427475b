"""The icosahedron and Snyder's equal-area projection of its faces, in barycentric coordinates of a face.

A face's plane triangle has the face's share of the sphere as its area. The projection keeps each third of the triangle
(between two corners and the centre) on the matching third of the face, so it needs no table of faces: any spherical
triangle of the icosahedron, given by its corners counter-clockwise, is mapped alike.
"""

from __future__ import annotations

import numpy as np

GOLDEN = (1 + 5**0.5) / 2
#: Fixed values of the standard orientation: twelve vertices, numbered 0 to 11, turned about the axis by 11.25 degrees.
_VERTICES = np.array(
    [
        [1, 0, GOLDEN], [-1, 0, GOLDEN], [0, -GOLDEN, 1], [GOLDEN, -1, 0], [GOLDEN, 1, 0], [0, GOLDEN, 1],
        [-GOLDEN, -1, 0], [0, -GOLDEN, -1], [1, 0, -GOLDEN], [0, GOLDEN, -1], [-GOLDEN, 1, 0], [-1, 0, -GOLDEN],
    ]
)
TURN_DEGREES = 11.25
_c, _s = np.cos(np.radians(TURN_DEGREES)), np.sin(np.radians(TURN_DEGREES))
VERTICES = (_VERTICES / np.sqrt(GOLDEN + 2)) @ np.array([[_c, _s, 0], [-_s, _c, 0], [0, 0, 1]])
ADJACENT = np.abs(VERTICES @ VERTICES.T - 5**-0.5) < 1e-9

# Snyder's constants for the icosahedron: centre-to-corner arc g, corner angle G, and the plane's half-angle of 30 degrees.
COS_CORNER, SIN_CORNER = np.cos(np.radians(36)), np.sin(np.radians(36))
COS_ARC = (1 / np.tan(np.radians(60))) * (1 / np.tan(np.radians(36)))
TAN_ARC = np.tan(np.arccos(COS_ARC))
COT_HALF = 3**0.5
#: Circumradius of the equal-area plane triangle on the unit sphere.
RADIUS = np.sqrt(4 * np.pi / (15 * 3**0.5))
SECTOR = 2 * np.pi / 3


def _triangles() -> np.ndarray:
    out = []
    for a in range(12):
        for b in range(a + 1, 12):
            for c in range(b + 1, 12):
                if ADJACENT[a, b] and ADJACENT[b, c] and ADJACENT[a, c]:
                    turned = np.linalg.det(VERTICES[[a, b, c]]) < 0
                    out.append((a, c, b) if turned else (a, b, c))
    return np.array(out)


#: Vertex triples of the twenty faces, counter-clockwise, smallest first.
FACES = _triangles()
CENTRES = VERTICES[FACES].sum(1) / np.linalg.norm(VERTICES[FACES].sum(1), axis=1, keepdims=True)


def neighbours_ccw(base: int, first: int) -> list[int]:
    """The five adjacent vertices counter-clockwise from outside, from a given one."""
    others = np.flatnonzero(ADJACENT[base])
    v, ref = VERTICES[base], VERTICES[first]
    east = ref - v * (ref @ v)
    north = np.cross(v, east)
    angle = np.mod(np.arctan2(VERTICES[others] @ north, VERTICES[others] @ east) + 1e-6, 2 * np.pi)
    return others[np.argsort(angle)].tolist()


def _frame(corners: np.ndarray):
    """Centre of spherical triangles (n, 3, 3), direction of the first corner, and the one a quarter turn on."""
    c = corners.sum(-2)
    c = c / np.linalg.norm(c, axis=-1, keepdims=True)
    a = corners[..., 0, :]
    u = a - c * (a * c).sum(-1, keepdims=True)
    u = u / np.linalg.norm(u, axis=-1, keepdims=True)
    return c, u, np.cross(c, u)


def _angle_of_arc(azimuth):
    """The third angle H of the triangle centre - corner - foot, for an azimuth within a sector."""
    return np.arccos(np.clip(np.sin(azimuth) * SIN_CORNER * COS_ARC - np.cos(azimuth) * COS_CORNER, -1, 1))


def _half_sine(azimuth):
    """sin(q / 2) for the arc q from the centre to the edge along an azimuth."""
    q = np.arctan(TAN_ARC / (np.cos(azimuth) + np.sin(azimuth) * COT_HALF))
    return np.sin(q / 2)


def to_sphere(corners: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Points of barycentric weights (n, 3) in triangles (n, 3, 3)."""
    centre, u, w = _frame(corners)
    turns = np.exp(1j * SECTOR * np.arange(3))
    plane = RADIUS * (weights * turns).sum(-1)
    rho, angle = np.abs(plane), np.mod(np.angle(plane), 2 * np.pi)
    k = np.minimum(2, np.floor(angle / SECTOR))
    flat = np.maximum(angle - k * SECTOR, 1e-15)
    area = RADIUS**2 / (2 * (1 / np.tan(flat) + COT_HALF))
    azimuth = flat.copy()
    for _ in range(12):
        h = _angle_of_arc(azimuth)
        slope = (np.cos(azimuth) * SIN_CORNER * COS_ARC + np.sin(azimuth) * COS_CORNER) / np.maximum(np.sin(h), 1e-300) - 1
        step = (area - np.radians(36) - h - azimuth + np.pi) / slope
        azimuth = np.clip(azimuth - step, 0, SECTOR)
    edge = RADIUS / (np.cos(flat) + np.sin(flat) * COT_HALF)
    z = 2 * np.arcsin(np.minimum(1.0, rho * _half_sine(azimuth) / edge))
    azimuth = azimuth + k * SECTOR
    out = np.cos(z)[..., None] * centre + np.sin(z)[..., None] * (np.cos(azimuth)[..., None] * u + np.sin(azimuth)[..., None] * w)
    return np.where((rho < 1e-15)[..., None], centre, out)


def to_weights(corners: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Barycentric weights of points in triangles; outside a triangle they are of its extended third."""
    centre, u, w = _frame(corners)
    half = np.linalg.norm(points - centre, axis=-1) / 2
    azimuth = np.mod(np.arctan2((points * w).sum(-1), (points * u).sum(-1)), 2 * np.pi)
    k = np.minimum(2, np.floor(azimuth / SECTOR))
    azimuth = azimuth - k * SECTOR
    area = np.maximum(azimuth + np.radians(36) + _angle_of_arc(azimuth) - np.pi, 0)
    flat = np.arctan2(2 * area, RADIUS**2 - 2 * area * COT_HALF)
    edge = RADIUS / (np.cos(flat) + np.sin(flat) * COT_HALF)
    plane = edge * half / _half_sine(azimuth) * np.exp(1j * (flat + k * SECTOR))
    turns = np.exp(-1j * SECTOR * np.arange(3))
    return 1 / 3 + 2 / 3 * (plane[..., None] * turns).real / RADIUS


def nearest_face(points: np.ndarray) -> np.ndarray:
    return np.argmax(points @ CENTRES.T, -1)


def nearest_vertex(points: np.ndarray) -> np.ndarray:
    return np.argmax(points @ VERTICES.T, -1)


def rotate(points: np.ndarray, matrix) -> np.ndarray:
    """Into a grid frame turned by a 3 x 3 rotation; its transpose turns back."""
    return points @ np.asarray(matrix, float).T

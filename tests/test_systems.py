"""Laws that hold for every system, and recorded centres."""

import numpy as np
import pytest

from tessellon.functions import sphere
from tessellon.systems import system
from tessellon.systems.authalic import WGS84, AuthalicSystem, authalic_q, authalic_radius, authalic_to_geodetic, geodetic_to_authalic
from tessellon.systems.dem import ElevationLattice, band_factor2

GEOMETRIC = ["HEALPix", "S2", "ISEA4R", "IGeo7"]


@pytest.mark.parametrize("name", GEOMETRIC)
@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_round_trips_areas_and_rings(name, level):
    s = system(name)
    pos = np.arange(1, s.ncells(level) + 1)
    centre = s.centroid(pos, level)
    assert (s.cellat(centre, level) == pos).all()
    assert (s.id_to_pos(s.pos_to_id(pos, level), level) == pos).all()
    area = sphere.ring_area(s.boundary(pos, level))
    assert (area > 0).all() and abs(area.sum() - 4 * np.pi) < 1e-9
    assert abs(s.area(pos, level).sum() - 4 * np.pi) < 1e-9
    for connectivity in ("vertex", "edge"):
        ring = s.one_ring(pos, level, connectivity)
        links = {(p, q) for p, r in zip(pos.tolist(), ring.tolist(), strict=True) for q in r if q}
        assert all((q, p) in links and p != q for p, q in links)
        if level >= 2:
            for p in pos[:: max(1, len(pos) // 40)]:
                near = ring[p - 1][ring[p - 1] > 0]
                turn = np.diff(np.unwrap(sphere.azimuth(centre[p - 1], centre[near - 1])))
                assert (turn > 0).all() and turn.sum() < 2 * np.pi


@pytest.mark.parametrize("name", ["HEALPix", "S2", "ISEA4R", "IGeo7", "H3"])
def test_subtrees_are_contiguous(name):
    s = system(name)
    for level in (0, 1, 2):
        n = s.ncells(level)
        lo, hi = s.descendant_range(np.arange(1, n + 1), level, level + 1)
        assert lo[0] == 1 and hi[-1] == s.ncells(level + 1) and (lo[1:] == hi[:-1] + 1).all()
        assert (s.parent_pos(hi, level + 1) == np.arange(1, n + 1)).all()


def test_covering_law():
    rng = np.random.default_rng(1)
    for name in GEOMETRIC:
        s = system(name)
        for p in rng.integers(1, s.ncells(1) + 1, 5):
            centre, radius = s.node_cap(np.array([p]), 1)
            lo, hi = s.descendant_range(np.array([p]), 1, 3)
            b = s.boundary(np.arange(lo[0], hi[0] + 1), 3).reshape(-1, 3)
            assert np.nanmax(sphere.distance(b, centre)) <= radius[0] + 1e-12


def test_z7_codec_and_recorded_centres():
    g = system("IGeo7")
    for text, lon, lat in (("000", 11.250000000628733, 58.282525589545045), ("010", -168.749999995427913, 58.282525583136824), ("005", -33.161068390564644, 76.901356492319934), ("016", -118.309392782240792, 66.533246367956679)):
        z = g.from_string(text)
        assert g.to_string(z) == text and g.from_hex(g.to_hex(z)) == z
        c = g.centroid(g.id_to_pos(np.array([z]), 1), 1)
        assert sphere.distance(c, sphere.unit_point(np.array([lon]), np.array([lat])))[0] < 1e-8
    with pytest.raises(ValueError):
        g.from_string("0002")  # the pentagon's missing digit
    assert not g.is_valid(np.array([-1]))[0]
    assert [g.ncells(r) for r in range(3)] == [12, 72, 492]


def test_deep_levels():
    g = system("IGeo7")
    for level in (7, 12, 19):
        pos = np.random.default_rng(level).integers(1, g.ncells(level) + 1, 50)
        assert (g.cellat(g.centroid(pos, level), level) == pos).all()
    h = system("HEALPix")
    pos = np.random.default_rng(0).integers(1, h.ncells(29) + 1, 50)
    assert (h.id_to_pos(h.pos_to_id(pos, 29), 29) == pos).all()


def test_healpix_ring_is_a_permutation():
    h = system("HEALPix")
    for level in range(4):
        nested = np.arange(h.ncells(level))
        ring = h.nested_to_ring(nested, level)
        assert sorted(ring) == list(range(1, len(nested) + 1))
        assert (h.ring_to_nested(ring, level) == nested).all()
        z = h.centroid(nested[np.argsort(ring)] + 1, level)[:, 2]
        assert (np.diff(z) <= 1e-12).all()


def test_h3_and_a5_hierarchy():
    h = system("H3")
    assert h.ncells(0) == 122 and len(h.get_pentagons(2)) == 12 and h.is_pentagon(h.get_pentagons(2)).all()
    for name in ("H3", "A5"):
        s = system(name)
        for level in range(3):
            pos = np.arange(1, s.ncells(level) + 1)
            ids = s.pos_to_id(pos, level)
            assert len(set(ids.tolist())) == len(pos) and (s.id_to_pos(ids, level) == pos).all()
            kids = s.children_pos(pos, level)
            assert all((s.parent_pos(k, level + 1) == p).all() for p, k in zip(pos, kids, strict=True))
        with pytest.raises(NotImplementedError):
            s.cellat(np.array([[1.0, 0, 0]]), 2)
    with pytest.raises(ValueError):
        system("A5").descendant_range(np.array([1]), 0, 2)


def test_authalic():
    lat = np.linspace(-1.5, 1.5, 61)
    assert abs(authalic_radius() - 6371007.180918) < 1e-5
    assert np.abs(authalic_to_geodetic(geodetic_to_authalic(lat)) - lat).max() < 1e-14
    assert np.abs(geodetic_to_authalic(lat) - np.arcsin(authalic_q(lat, WGS84[1]) / authalic_q(np.pi / 2, WGS84[1]))).max() < 1e-11
    s = AuthalicSystem("IGeo7")
    pos = np.arange(1, s.ncells(2) + 1)
    assert (s.cellat(s.centroid(pos, 2), 2) == pos).all()
    with pytest.raises(ValueError):
        AuthalicSystem(s)


def test_elevation_lattice():
    assert [band_factor2(lat) for lat in (0, 49, 50, 60, 70, 80, 85, -50, -51, -86)] == [2, 2, 3, 4, 6, 10, 20, 2, 3, 20]
    d, fine = ElevationLattice(30), ElevationLattice(60)
    pos = np.random.default_rng(0).integers(1, d.ncells(1) + 1, 500)
    assert (d.cellat(d.centroid(pos, 1), 1) == pos).all()
    assert abs(d.area(np.arange(1, 64801), 0).sum() - 4 * np.pi) < 1e-9
    kids = d.refine(fine, int(pos[0]))
    assert len(kids) == 4 and (fine.coarsen(d, kids) == pos[0]).all()
    ring = d.one_ring(pos[:20], 1)
    for p, r in zip(pos[:20], ring, strict=True):
        for q in r[r > 0]:
            assert p in d.one_ring(np.array([q]), 1)[0]


def test_shells_wind_about_the_cell():
    s = system("HEALPix")
    near = s.neighbors(np.array([100]), 4, 2)[0]
    assert len(near) == len(set(near.tolist())) == 24
    assert (s.ring(np.array([100]), 4, 2)[0] == near[8:]).all() and s.ring(np.array([100]), 4, 0)[0].tolist() == [100]

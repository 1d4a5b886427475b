"""Queries over the whole orders table at a level with gaps, against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessellon.functions import sphere
from tessellon.plans import registry
from tessellon.operators import regions
from tessellon.plans.points import located, orders
from tessellon.plans.topology import DENSE, RADIUS, WHOLE, whole_region
from tessellon.systems import system

H = system("HEALPix")


def near(a, b):
    return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 2e-6 * max(1, abs(b))


def test_whole_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.range(1, 12001).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 1009).cast("double").alias("o_totalprice")).write.parquet(f"{sf}/orders.parquet")
    held = {}
    for r in located(orders(spark, sf), WHOLE).select("pos", "value").collect():
        held.setdefault(r.pos, []).append(r.value)
    z = {p: float(max(v)) for p, v in held.items()}
    cells = sorted(z)
    # Whole: the left-out multiples of 3 and 5 and the cells from 40 on are there, with neighbours and without.
    ring = dict(zip(cells, ([q for q in r if q] for r in H.one_ring(np.array(cells), WHOLE).tolist()), strict=True))
    inside = {p: [q for q in ring[p] if q in z] for p in cells}
    assert {p % 15 for p in cells} == set(range(15)) and {len(n) for n in inside.values()} >= {0, 1, 2, 3}
    get = lambda name: registry.queries()[name](spark, sf).collect()
    only = lambda name: sorted(r.pos for r in get(name))
    outside = {q for p in cells for q in ring[p]} - set(z)
    edge = {p for p in cells if len(inside[p]) < len(ring[p])}
    assert only("halo") == sorted(outside)
    assert only("border") == sorted(edge)
    whole = sorted(r.pos for r in whole_region(spark, sf, DENSE).collect())
    assert only("interior") == [p for p, r in zip(whole, H.one_ring(np.array(whole), DENSE).tolist(), strict=True) if {q for q in r if q} <= set(whole)]
    once = set(z) | outside
    rings = H.one_ring(np.array(sorted(once)), WHOLE)
    assert sorted(r.pos for r in regions.grow(whole_region(spark, sf), H, WHOLE, 2).collect()) == sorted(once | set(rings[rings > 0].tolist()))
    at = {p: k for k, p in enumerate(cells, 1)}
    behind = at | {p: k for k, p in enumerate(sorted(outside), len(cells) + 1)}
    slots = [(at[p], k, int(q)) for p, r in zip(cells, H.one_ring(np.array(cells), WHOLE), strict=True) for k, q in enumerate(r[r > 0])]
    for name, want in (("mark", [(r, k, at.get(q, 0)) for r, k, q in slots]), ("clipped", [(r, k, at[q]) for r, k, q in slots if q in at]), ("halo", [(r, k, behind[q]) for r, k, q in slots])):
        assert sorted((r.row, r["index"]) for r in get(f"adjacency_{name}")) == sorted((r, i) for r, _, i in want)
        halo = {"mark": "mark", "clipped": 0, "halo": 1}[name]
        assert sorted((r.row, r.slot, r["index"]) for r in regions.adjacency(whole_region(spark, sf), H, WHOLE, halo).collect()) == sorted(want)
    two = {p: {q for x in H.one_ring(np.array([p, *ring[p]]), WHOLE).tolist() for q in x if q} - {p} for p in cells[::50]}
    got = {}
    for r in registry.queries()["neighbors_k2"](spark, sf).collect():
        got.setdefault(r.pos, set()).add(r.nbr)
    assert sorted(got) == cells and all(got[p] == n for p, n in two.items())

    def mean(p):
        return sum(z[q] for q in inside[p]) / len(inside[p]) if inside[p] else math.nan

    def folded(p):
        out = math.nan
        for k, q in enumerate(inside[p]):
            out = out * 0.5 + z[q] if k else z[q]
        return out

    for name, column, f in (
        ("smooth", "z", lambda p: (z[p] + sum(z[q] for q in inside[p])) / (1 + len(inside[p]))),
        ("laplacian", "z", lambda p: mean(p) - z[p]),
        ("terrain_tpi", "tpi", lambda p: z[p] - mean(p)),
        ("terrain_tri", "tri", lambda p: math.sqrt(sum((z[p] - z[q]) ** 2 for q in inside[p]))),
        ("terrain_roughness", "roughness", lambda p: max((abs(z[p] - z[q]) for q in inside[p]), default=0)),
        ("terrain_prominence", "prominence", lambda p: sum(z[q] <= z[p] for q in inside[p])),
        ("lowest_neighbor", "downhill", lambda p: min(((z[q], q) for q in inside[p] if z[q] < z[p]), default=(0, 0))[1]),
        ("map_neighbors_callback", "result", folded),
    ):
        rows = {r.pos: math.nan if r[column] is None else r[column] for r in get(name)}
        assert sorted(rows) == cells and all(near(rows[p], f(p)) for p in cells), name

    centre = dict(zip(cells, H.centroid(np.array(cells), WHOLE), strict=True))
    far = {(p, q): RADIUS * float(sphere.distance(centre[p][None], centre[q][None])[0]) for p in cells for q in inside[p]}
    slope, curved, plane = ({r.pos: r for r in get(f"terrain_{name}")} for name in ("slope", "curvature", "plane_fit"))
    assert sorted(slope) == sorted(curved) == sorted(plane) == cells
    for p in cells:
        n = inside[p]
        assert near(slope[p].slope, math.degrees(math.atan(max((abs(z[p] - z[q]) / far[p, q] for q in n), default=0))))
        if n:
            assert abs(curved[p].curvature - 4 * sum((z[q] - z[p]) / far[p, q] ** 2 for q in n) / len(n)) < 1e-8
        else:
            assert curved[p].curvature is None
        assert math.isnan(plane[p].slope) or len(n) > 1
        assert not math.isnan(plane[p].slope) or len(n) < 3
    rows = {r.pos: r for r in get("flow_accumulation")}
    assert sorted(rows) == cells
    total = dict.fromkeys(cells, 0)
    for p in cells:
        best = max(((z[p] - z[q]) / far[p, q] for q in inside[p]), default=0)
        d = rows[p].dir
        assert d == p if best <= 0 else near((z[p] - z[d]) / far[p, d], best)
        while True:
            total[p] += 1
            if rows[p].dir == p:
                break
            p = rows[p].dir
    assert {p: r.accumulation for p, r in rows.items()} == total

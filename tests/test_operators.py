"""Region algebra, coverage, regridding, stores: against brute force on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellon.functions import sphere
from tessellon.operators import regions as R
from tessellon.operators import regrid as G
from tessellon.operators import spatial as Q
from tessellon.operators import stencils as S
from tessellon.sources import conventions as C
from tessellon.sources import encodings as E
from tessellon.sources import store
from tessellon.sources.errors import DGGSFormatError
from tessellon.systems import system

H = system("HEALPix")


def positions(df):
    return sorted(r[0] for r in df.collect())


def test_forms_and_ranks(spark):
    pos = [1, 2, 3, 65535, 65536, 65537, 131071, 131072, 200000, (1 << 32) - 1, 1 << 32, (1 << 32) + 1]
    df = spark.createDataFrame([(p,) for p in pos + [2, 3]], "pos long")
    runs = sorted((r.lo, r.hi, r.offset) for r in R.compress(df).collect())
    assert runs == [(1, 3, 0), (65535, 65537, 3), (131071, 131072, 6), (200000, 200000, 8), ((1 << 32) - 1, (1 << 32) + 1, 9)]
    assert sorted((r.rank, r.pos) for r in R.ranked(df).collect()) == list(enumerate(pos, 1))
    assert R.compress(df.limit(0)).count() == 0


def test_regions_against_sets(spark):
    level = 2
    member = set(range(10, 60)) - {30}
    df = spark.createDataFrame([(p,) for p in sorted(member)], "pos long")
    ring = {p: [q for q in H.one_ring(np.array([p]), level)[0].tolist() if q] for p in range(1, 193)}
    assert positions(R.halo(df, "HEALPix", level)) == sorted({q for p in member for q in ring[p]} - member)
    edge = {p for p in member if set(ring[p]) - member}
    assert positions(R.border(df, H, level)) == sorted(edge)
    assert positions(R.interior(df, H, level)) == sorted(member - edge)
    got = {(r.level, r.pos) for r in R.compact(df, H, level).collect()}
    cells = {p for lv, q in got for p in range(*(lambda r: (int(r[0][0]), int(r[1][0]) + 1))(H.descendant_range(np.array([q]), lv, level)))}
    assert cells == member and any(lv < level for lv, _ in got)


def test_polygon_query_against_every_cell(spark):
    target = Q.polygon([(-10, -10), (25, -5), (20, 30), (-5, 20)])
    found = set(positions(Q.query(spark, "IGeo7", target, "intersects", 3)))
    g = system("IGeo7")
    every = np.arange(1, g.ncells(3) + 1)
    assert found == set(every[Q.matches(g, every, 3, target, "intersects")].tolist())
    within = set(positions(Q.query(spark, "IGeo7", target, "within", 3)))
    assert within < found
    out = set(positions(Q.query(spark, "IGeo7", target, "disjoint", 3)))
    assert out == set(every.tolist()) - found
    for p in every[:: 37]:
        state = target.holds(g.centroid(np.array([p]), 3))[0]
        assert not (state == 1 and p not in found)
    with pytest.raises(NotImplementedError):
        Q.query(spark, "IGeo7", target, "crosses", 3)


def test_wide_boxes_hold_the_cells_whose_centres_they_hold():
    for name, level in (("HEALPix", 3), ("S2", 3), ("IGeo7", 2)):
        s = system(name)
        every = np.arange(1, s.ncells(level) + 1)
        centre = s.centroid(every, level)
        lon, lat = sphere.lonlat(centre)
        reach = np.degrees(np.nanmax(sphere.distance(s.boundary(every, level), centre[:, None]), 1).max())
        for x0, x1, y0, y1 in ((-170, 170, -60, 60), (-179, 179, -89, 89), (10, 200, -30, 30), (-100, 20, 10, 80), (-60, 40, -20, 50)):
            along = np.mod(lon - x0, 360)
            inside = (along < x1 - x0) & (lat > y0) & (lat < y1)
            target = Q.box(x0, x1, y0, y1)
            found = Q.matches(s, every, level, target, "intersects")
            # Arcs between the points of a parallel run off it by less than this.
            off = 0.05
            sure = inside & (lat > y0 + off) & (lat < y1 - off)
            assert found[sure].all()
            far = (lat > y1 + reach + off) | (lat < y0 - reach - off) | ((np.abs(lat) < 60) & (along > x1 - x0 + 2.2 * reach) & (along < 360 - 2.2 * reach))
            assert not found[far].any()
            within = Q.matches(s, every, level, target, "within")
            assert not (within & ~inside).any() and (within <= found).all()


def test_offsets_of_scattered_ranges(spark):
    """Runs in many blocks of all sizes."""
    rng = np.random.default_rng(7)
    lo = np.unique(np.concatenate([rng.integers(0, 1 << 62, 200), rng.integers(0, 1 << 34, 200), rng.integers(0, 1 << 17, 50)])) & ~np.int64(7)
    lo = np.unique(lo)
    hi = lo + rng.integers(0, 6, len(lo))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(lo, hi)], "lo long, hi long").repartition(5)
    got = sorted((r.lo, r.hi, r.offset) for r in R.with_offsets(df).collect())
    before = np.cumsum(hi - lo + 1) - (hi - lo + 1)
    assert got == list(zip(lo.tolist(), hi.tolist(), before.tolist()))


def test_coverage_modes(spark):
    target = Q.cap(10, 40, 9)
    c = Q.coverage("HEALPix", target, level=6)
    assert positions(Q.cellindices(spark, c, 6)) == positions(Q.query(spark, "HEALPix", target, "intersects", 6))
    assert c.cells["key"].is_monotonic_increasing and Q.coarsest_contained(c) is not None
    budget = Q.coverage("HEALPix", target, maxcells=40)
    assert len(budget.cells) <= 40
    for bad in ({}, {"level": 3, "maxcells": 4}, {"level": 3, "maxlevel": 4}, {"maxcells": 0}):
        with pytest.raises(ValueError):
            Q.coverage("HEALPix", target, **bad)


def test_conservative_weights_keep_areas(spark):
    raster = G.RasterGrid(np.linspace(-180, 180, 19), np.linspace(-90, 90, 10))
    for name, level in (("S2", 1), ("IGeo7", 1), ("HEALPix", 1)):
        w = G.plan_regrid(spark, raster, name, "conservative", level).weights.toPandas()
        assert abs(w["w"].sum() - 4 * np.pi) < 1e-8
        s = system(name)
        own = sphere.ring_area(s.boundary(np.arange(1, s.ncells(level) + 1), level))
        assert np.abs(w.groupby("dst")["w"].sum().to_numpy() - own).max() < 1e-8


def test_policies(spark):
    raster = G.RasterGrid([0, 10, 20], [0, 10])
    plan = G.plan_regrid(spark, raster, G.RasterGrid([0, 20], [0, 10]), "conservative")
    data = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "pos long, value double")
    assert G.regrid(data, plan, G.weighted(0.4)).first()["value"] == pytest.approx(2.0)
    assert G.regrid(data, plan, G.weighted(0.6)).first()["value"] is None
    assert np.isnan(G.regrid(data, plan, G.weighted(0.6), blank="nan").first()["value"])
    assert G.regrid(data, plan, G.extensive()).first()["value"] > 0
    with pytest.raises(ValueError):
        G.RasterGrid([0, 1, 1], [0, 1])


def test_plans_store_their_denominators(spark, tmp_path):
    plan = G.plan_regrid(spark, G.RasterGrid([0, 10, 20], [0, 10]), G.RasterGrid([0, 20], [0, 10]), "conservative")
    data = spark.createDataFrame([(1, 2.0), (2, None)], "pos long, value double")
    before = G.regrid(data, plan, G.weighted(0.4)).collect()
    total = {r.dst: r.total for r in plan.denominators.collect()}
    plan.spill(str(tmp_path / "plan"))
    assert {r.dst: r.total for r in plan.denominators.collect()} == total and G.regrid(data, plan, G.weighted(0.4)).collect() == before
    assert total[1] == pytest.approx(sum(r.w for r in plan.weights.collect()))


def test_regrid_keeps_every_slice(spark):
    """More slices than the 1 << 20 that the frame once held, and the NULL slice; slices without a value get their blank rows."""
    plan = G.plan_regrid(spark, G.RasterGrid([0, 10, 20], [0, 10]), G.RasterGrid([0, 20], [0, 10]), "conservative")
    n = (1 << 20) + 5
    data = spark.range(n).select(F.lit(1).cast("long").alias("pos"), F.when(F.col("id") > 0, F.col("id")).alias("t"), F.col("id").cast("double").alias("value"))
    out = G.regrid(data, plan, G.weighted(0.4), dims=("t",))
    assert out.columns == ["pos", "t", "value"]
    assert out.agg(F.count("*"), F.countDistinct("t"), F.sum("value")).first() == (n, n - 1, n * (n - 1) / 2)
    plan = G.plan_regrid(spark, G.DGGSpace("HEALPix", 1), "HEALPix", "nearest", 2)
    some = spark.createDataFrame([(p, b, t, 1.0 * p) for p in (1, 7, 40) for b in ("r", None) for t in (1, 2)], "pos long, b string, t int, value double")
    rows = G.regrid(some, plan, dims=("b", "t")).collect()
    assert len(rows) == 192 * 4 == len({(r.pos, r.b, r.t) for r in rows})
    assert all(r.value == ((r.pos + 3) // 4 if (r.pos + 3) // 4 in (1, 7, 40) else None) for r in rows)


def test_flow_accumulates_everything(spark):
    f = H.levelgrid(spark, 2).select("pos", ((F.col("pos") * 7919) % 101).cast("double").alias("z"))
    d = S.flow_direction(f, H, 2).toPandas()
    got = S.flow_accumulation(spark.createDataFrame(d)).toPandas().set_index("pos")["accumulation"]
    nxt, want = dict(zip(d["pos"], d["dir"], strict=True)), dict.fromkeys(d["pos"], 0)
    for p in d["pos"]:
        while True:
            want[p] += 1
            if nxt[p] == p:
                break
            p = nxt[p]
    assert got.to_dict() == want


def test_encodings(spark):
    g = system("IGeo7")
    df = spark.createDataFrame([(p,) for p in [*range(100, 200), *range(500, 520)]], "pos long")
    for merge in ("rank", "step"):
        r = E.idranges(df, g, 4, merge)
        assert positions(E.RangesEncoding().decode(r, g, 4)) == positions(df)
        assert E.validate_ranges(r, 120, g, 4) == 120
    with pytest.raises(DGGSFormatError):
        E.validate_ranges(E.idranges(df, g, 4), 119, g, 4)
    ids = g.pos_to_id(np.array([5, 6]), 4)
    assert E.idrank(g, ids, 4).tolist() == [5, 6] and E.idrank(g, ids + 1, 4).tolist() == [6, 7]
    assert not E.write_eligible("implicit", df, g, 4) and E.write_eligible("none", df, g, 4)
    assert E.chunkbounds(2, 120, 50) == (51, 100) and E.nchunks(120, 50) == 3


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(p, p * 0.5) for p in [*range(100, 200), *range(500, 520)]], "pos long, v double")
    store.write(df, str(tmp_path / "a"), "IGeo7", 4, "ranges")
    assert store.read(spark, str(tmp_path / "a"), ["v"], "scan").count() == 120
    with pytest.raises(Exception, match="exist"):
        store.write(df, str(tmp_path / "a"), "IGeo7", 4, "ranges")
    for axis in ("none", "ranges"):
        path = str(tmp_path / axis)
        store.write_zarr(df, path, "IGeo7", 4, ["v"], 50, axis)
        back, d = store.read_zarr(spark, path)
        assert d.encoding == axis and {tuple(r) for r in back.select("pos", "v").collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(store.SelectorError):
        store.at(df, 7)
    with pytest.raises(store.SelectorError):
        store.near(df)


def test_conventions():
    a = C.ArrayEntry("cell_ids", (10,), ("cells",), {"grid_name": "healpix", "nside": 4, "nest": True})
    v = C.ArrayEntry("t", (10,), ("cells",))
    d = C.describe_store(C.StoreSnapshot("x", {}, [a, v]))
    assert (d.gridname, d.level, d.scheme, d.variables) == ("healpix", 2, "nested", ("t",)) and set(d.provenance) == {"xdggs", "legacy-healpix"}
    crs = C.ArrayEntry("crs", (), (), {"grid_mapping_name": "healpix", "healpix_nside": 2, "healpix_order": "nest"})
    d = C.describe_store(C.StoreSnapshot("x", {}, [crs, C.ArrayEntry("t", (48,), ("cell",))]))
    assert (d.level, d.encoding, d.spatial_dimension) == (1, "implicit", "cell")
    for attrs, check in (({"grid_name": "nope"}, "unknown_grid_name"), ({"grid_name": "healpix", "level": 1, "nside": 2}, "duplicate_level_alias"), ({"grid_name": "healpix", "nside": 3}, "invalid_nside")):
        with pytest.raises(DGGSFormatError) as e:
            C.describe_store(C.StoreSnapshot("x", {}, [C.ArrayEntry("c", (1,), ("cells",), attrs)]))
        assert e.value.check == check


def test_streaming_cells(spark, tmp_path):
    from tessellon.streaming.enrich import windowed_counts

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 7.0 % 360 - 180).alias("lon"), (F.col("id") % 80 * 1.0).alias("lat"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_counts(rows, "HEALPix", 1).collect()}
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "HEALPix", 1)
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("cells").collect()} == batch

"""Many rows in few cells: results against brute force, and how many rows a single task reads."""

import contextlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellon.operators import regions, spatial
from tessellon.plans import registry
from tessellon.plans.points import located, orders
from tessellon.systems import system

H = system("HEALPix")


@contextlib.contextmanager
def plain(spark):
    """Plans as they are written: no broadcasts, no partitions put together or split."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def most_read(spark, group, run):
    """The result, and the most shuffled rows that one task read."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc._jsc.clearJobGroup()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store, most = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1000)
            for k in range(tasks.size()):
                m = tasks.apply(k).taskMetrics()
                most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    return out, most


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """40 000 orders and 4 000 customers in 3 072 cells of HEALPix level 4, which lie in one block of positions."""
    path = str(tmp_path_factory.mktemp("many"))
    key = F.col("id")
    spark.range(40_000).repartition(3).select(key.alias("o_orderkey"), (key * 7919 % 1009).cast("double").alias("o_totalprice")).write.parquet(f"{path}/orders.parquet")
    spark.range(4_000).select(key.alias("c_custkey"), F.lit(1.5).alias("c_acctbal")).write.parquet(f"{path}/customer.parquet")
    return path


def test_range_join_deals_out_the_rows(spark, many):
    with plain(spark):
        got, most = most_read(spark, "range_join", lambda: registry.queries()["range_join"](spark, many).collect())
    own = {r.pos for r in located(spark.read.parquet(f"{many}/customer.parquet").select(((F.col("c_custkey") * 7919 % 36000) / 100.0 - 180 + 0.005).alias("lon"), ((F.col("c_custkey") * 104729 % 20000) / 10000.0 - 1 + 0.00005).alias("z")), 4).collect()}
    assert sorted((r.key, r.pos) for r in got) == sorted((r.key, r.pos) for r in located(orders(spark, many), 4).collect() if r.pos in own)
    assert most < 20_000


def test_zones_meet_cells(spark, many):
    with plain(spark):
        got, most = most_read(spark, "zonal_mean", lambda: registry.queries()["zonal_mean"](spark, many).collect())
    rows = located(orders(spark, many), 5).select("pos", "value").collect()
    zones = {"cap": spatial.cap(10, 40, 12), "box": spatial.box(-30.0, 40.0, -20.0, 35.0)}
    assert {r.zone for r in got} == set(zones)
    for r in got:
        cells = {p.pos for p in spatial.cellindices(spark, spatial.coverage(H, zones[r.zone], level=5), 5).collect()}
        held = [x.value for x in rows if x.pos in cells]
        assert r.n == len(held) and math.isclose(r["mean"], math.fsum(held) / len(held), rel_tol=1e-12)
    # At most a row of every cell (12 288 of the level) from each of the three files, over four tasks.
    assert most < 20_000


def test_zonal_skips_missing_values_and_weighs_by_area(spark):
    pos = np.arange(1, S2_CELLS + 1)
    rows = [(int(p), None if p % 7 == 0 else math.nan if p % 5 == 0 else float(p * k % 13)) for p in pos for k in range(1, 4)]
    data = spark.createDataFrame([*rows, (None, 3.0)], "pos long, value double")
    zone = spatial.box(-30.0, 40.0, -20.0, 35.0)
    got = spatial.zonal(data, "S2", 4, {"box": zone, "nowhere": spatial.cap(0, 0, 1)}).collect()
    cells = {p.pos for p in spatial.cellindices(spark, spatial.coverage("S2", zone, level=4), 4).collect()}
    held = [(p, v) for p, v in rows if p in cells and v is not None and not math.isnan(v)]
    a = dict(zip(pos.tolist(), system("S2").area(pos, 4), strict=True))
    box = next(r for r in got if r.zone == "box")
    assert box.n == len(held) and math.isclose(box["mean"], sum(v * a[p] for p, v in held) / sum(a[p] for p, _ in held), rel_tol=1e-12)


S2_CELLS = 6 * 4**4


@pytest.mark.parametrize("bits", [3, 16])
def test_in_ranges_against_brute_force(spark, bits):
    """Repeated, missing and unheld positions; ranges that overlap, repeat and run over many blocks."""
    rows = [(k, k * k % 200) for k in range(600)] + [(600, None), (601, None)]
    ranges = [(3, 5, "a"), (4, 90, "b"), (4, 90, "c"), (150, 150, "d"), (120, 118, "e"), (1000, 2000, "f")]
    data, r = spark.createDataFrame(rows, "key long, pos long"), spark.createDataFrame(ranges, "lo long, hi long, name string")
    pairs = sorted((k, p, n) for k, p in rows for lo, hi, n in ranges if p is not None and lo <= p <= hi)
    held = {k for k, _, _ in pairs}
    out = regions.in_ranges(data, r, how="inner", bits=bits)
    assert out.columns == ["key", "pos", "name"] and sorted(map(tuple, out.collect())) == pairs
    bare = r.select("lo", "hi")
    assert sorted(x.key for x in regions.in_ranges(data, bare, bits=bits).collect()) == sorted(held)
    assert sorted(x.key for x in regions.in_ranges(data, bare, how="left_anti", bits=bits).collect()) == sorted({k for k, _ in rows} - held)
    once = data.dropDuplicates(["pos"])
    assert sorted(x.pos for x in regions.in_ranges(once, bare, bits=bits, unique=True).collect()) == sorted({p for _, p, _ in pairs})

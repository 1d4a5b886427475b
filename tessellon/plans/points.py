"""Points derived from the driver tables, whose tables have no coordinates, and grid queries over them with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import sphere
from tessellon.plans.registry import query
from tessellon.systems import system
from tessellon.systems.authalic import WGS84, geodetic_to_authalic_col, series
from tessellon.systems.base import GridSystem

HEALPIX = "HEALPix"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lon in degrees, z = sin latitude, value): exact arithmetic on the key."""
    k = F.col(key)
    return df.select(k.alias("key"), ((k * 7919 % 36000) / 100.0 - 180 + 0.005).alias("lon"), ((k * 104729 % 20000) / 10000.0 - 1 + 0.00005).alias("z"), F.col(value).alias("value"))


def points_sql(name: str, key: str, value: str) -> str:
    return f"SELECT {key} AS key, ({key} * 7919 % 36000) / 100.0::DOUBLE - 180 + 0.005::DOUBLE AS lon, ({key} * 104729 % 20000) / 10000.0::DOUBLE - 1 + 0.00005::DOUBLE AS z, {value} AS value FROM {name}"


def morton_sql(ix: str, iy: str, level: int) -> str:
    return " + ".join([f"((({ix}) >> {b}) & 1) * {4**b} + ((({iy}) >> {b}) & 1) * {2 * 4**b}" for b in range(level)]) or "0"


def healpix_sql(points: str, level: int) -> str:
    """A SELECT of (key, value, pos) over a SELECT of points: belt and caps of the published inverse."""
    n = 1 << level
    return f"""
SELECT key, value, (face * {n * n} + {morton_sql("ix", "iy", level)} + 1)::BIGINT AS pos FROM (
  SELECT key, value,
    CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN CASE WHEN up // {n} = down // {n} THEN (up // {n}) % 4 + 4 WHEN up // {n} < down // {n} THEN up // {n} ELSE down // {n} + 8 END
         WHEN z >= 0 THEN sector ELSE sector + 8 END AS face,
    CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN down % {n} WHEN z >= 0 THEN {n - 1} - l ELSE r END AS ix,
    CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN {n - 1} - up % {n} WHEN z >= 0 THEN {n - 1} - r ELSE l END AS iy
  FROM (
    SELECT *, floor({n}::DOUBLE * (0.5::DOUBLE + t) - {n}::DOUBLE * (z * 0.75::DOUBLE))::BIGINT AS up, floor({n}::DOUBLE * (0.5::DOUBLE + t) + {n}::DOUBLE * (z * 0.75::DOUBLE))::BIGINT AS down,
      least({n - 1}, floor((t - sector) * w))::BIGINT AS r, least({n - 1}, floor((1 - (t - sector)) * w))::BIGINT AS l
    FROM (SELECT *, least(3, floor(t))::BIGINT AS sector, {n}::DOUBLE * sqrt(greatest(0, 3 * (1 - abs(z)))) AS w
          FROM (SELECT *, (lon - floor(lon / 360) * 360) / 90 AS t FROM ({points})))))
"""


def located(df: DataFrame, level: int) -> DataFrame:
    return system(HEALPIX).with_cell_z(df, "lon", "z", level)


ORDERS = points_sql("orders", "o_orderkey", "o_totalprice")
CUSTOMERS = points_sql("customer", "c_custkey", "c_acctbal")
SUPPLIERS = points_sql("supplier", "s_suppkey", "s_acctbal")


def orders(spark, sf_dir):
    return points(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


def customers(spark, sf_dir):
    return points(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


def suppliers(spark, sf_dir):
    return points(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")


@query("healpix_cellat", f"SELECT key, pos FROM ({healpix_sql(ORDERS, 8)})")
def healpix_cellat(spark, sf_dir):
    return located(orders(spark, sf_dir), 8).select("key", "pos")


@query("healpix_rollup", f"SELECT ((pos - 1) >> 4) + 1 AS pos, sum(n)::BIGINT AS n, round(sum(total) / sum(n), 4) AS mean_price, count(*) AS cells FROM (SELECT pos, count(*) AS n, sum(value) AS total FROM ({healpix_sql(ORDERS, 3)}) GROUP BY pos) GROUP BY 1")
def healpix_rollup(spark, sf_dir):
    """Orders per level-3 cell, rolled up two levels on the ancestor key."""
    fine = located(orders(spark, sf_dir), 3).groupBy("pos").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    coarse = fine.withColumn("pos", system(HEALPIX).ancestor_col(F.col("pos"), 3, 1))
    return coarse.groupBy("pos").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean_price"), F.count("*").alias("cells"))


@query("healpix_rollup_levels", f"SELECT coalesce(level1, 0) AS level1, coalesce(level0, 0) AS level0, count(*) AS n FROM (SELECT ((pos - 1) >> 2) + 1 AS level1, ((pos - 1) >> 4) + 1 AS level0 FROM ({healpix_sql(ORDERS, 2)})) GROUP BY ROLLUP (level0, level1)")
def healpix_rollup_levels(spark, sf_dir):
    h = system(HEALPIX)
    at = located(orders(spark, sf_dir), 2).select(h.ancestor_col(F.col("pos"), 2, 1).alias("level1"), h.ancestor_col(F.col("pos"), 2, 0).alias("level0"))
    return at.rollup("level0", "level1").agg(F.count("*").alias("n")).select(F.coalesce("level1", F.lit(0)).alias("level1"), F.coalesce("level0", F.lit(0)).alias("level0"), "n")


@query("healpix_hierarchy", "SELECT pos, ((pos - 1) >> 2) + 1 AS parent, ((pos - 1) << 4) + 1 AS lo, pos << 4 AS hi, k::BIGINT AS child FROM (SELECT unnest(range(1, 193)) AS pos), LATERAL (SELECT unnest(range(((pos - 1) << 2) + 1, (pos << 2) + 1)) AS k)")
def healpix_hierarchy(spark, sf_dir):
    """Parent, children and descendant ranges of the level-2 cells."""
    h, pos = system(HEALPIX), F.col("pos")
    r = h.descendant_range_col(pos, 2, 4)
    return h.levelgrid(spark, 2).select("pos", h.parent_col(pos, 2).alias("parent"), r["lo"].alias("lo"), r["hi"].alias("hi"), F.explode(h.children_col(pos, 2)).alias("child"))


def _xyf_sql(level: int) -> str:
    n = 1 << level
    ix = " + ".join(f"((code >> {2 * b}) & 1) * {1 << b}" for b in range(level))
    iy = " + ".join(f"((code >> {2 * b + 1}) & 1) * {1 << b}" for b in range(level))
    return f"SELECT pos, face, ring, col, ix, iy, least({n}, least(ring, {4 * n} - ring)) AS width FROM (SELECT *, (face // 4 + 2) * {n} - ix - iy - 1 AS ring, CASE WHEN face // 4 = 1 THEN 2 * (face - 4) ELSE 2 * (face % 4) + 1 END AS col FROM (SELECT pos, (pos - 1) // {n * n} AS face, {ix} AS ix, {iy} AS iy FROM (SELECT pos, (pos - 1) % {n * n} AS code FROM (SELECT unnest(range(1, {12 * n * n + 1})) AS pos))))"


def _ring_sql(level: int) -> str:
    n = 1 << level
    first = f"CASE WHEN ring <= {n} THEN 2 * ring * (ring - 1) WHEN ring <= {3 * n} THEN {2 * n * (n - 1)} + (ring - {n}) * {4 * n} ELSE {12 * n * n} - 2 * ({4 * n} - ring) * ({4 * n} - ring + 1) END"
    at = f"(col * width + ix - iy + 1 + CASE WHEN ring < {n} OR ring > {3 * n} THEN 0 ELSE (ring - {n}) % 2 END) // 2"
    return f"SELECT pos, ({first} + CASE WHEN k > 4 * width THEN k - 4 * width WHEN k < 1 THEN k + 4 * width ELSE k END)::BIGINT AS ring_id FROM (SELECT *, {at} AS k FROM ({_xyf_sql(level)}))"


@query("healpix_ring", _ring_sql(4))
def healpix_ring(spark, sf_dir):
    h = system(HEALPIX)
    return h.with_ring_id(h.levelgrid(spark, 4), 4)


def _centroid_sql(level: int) -> str:
    n = float(1 << level)
    z = f"CASE WHEN ring < {n} THEN 1 - (width / {n}::DOUBLE) * (width / {n}::DOUBLE) / 3 WHEN ring > {3 * n} THEN (width / {n}::DOUBLE) * (width / {n}::DOUBLE) / 3 - 1 ELSE ({2 * n}::DOUBLE - ring) * 2 / {3 * n}::DOUBLE END"
    return f"SELECT pos, round(sqrt(1 - z * z) * cos(phi), 9) AS x, round(sqrt(1 - z * z) * sin(phi), 9) AS y, round(z, 9) AS z FROM (SELECT pos, {z} AS z, pi() / 4 * (col * width + ix - iy) / width AS phi FROM ({_xyf_sql(level)}))"


@query("healpix_centroid", f"SELECT pos, x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z FROM ({_centroid_sql(3)})")
def healpix_centroid(spark, sf_dir):
    h = system(HEALPIX)
    c = h.with_centroid(h.levelgrid(spark, 3), 3, "c")
    return c.select("pos", *((F.round(F.col(f"c.{k}"), 9) + 0.0).alias(k) for k in "xyz"))


@query("cone_mean", f"SELECT count(*) AS n, round(avg(value), 4) AS mean_price FROM (SELECT value, pos FROM ({healpix_sql(ORDERS, 3)})) JOIN ({_centroid_sql(3)}) c USING (pos) WHERE acos(greatest(-1, least(1, x * 0.6 + y * 0.0 + z * 0.8))) <= radians(25)")
def cone_mean(spark, sf_dir):
    """Mean over the cells whose centre lies in a cap."""
    import numpy as np

    h = system(HEALPIX)
    data = located(orders(spark, sf_dir), 3)
    c = data.select("value", h.centroid_col(F.col("pos"), 3).alias("c"))
    inside = sphere.cap_contains_col(F.col("c"), 0.6, 0.0, 0.8, float(np.radians(25)))
    return c.filter(inside).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_price"))


# S2: faces by the largest component, quadratic coordinates, and the curve as a walk over the bits.
_S2_LEVEL = 6


def _s2_sql() -> str:
    n = 1 << _S2_LEVEL

    def lattice(u: str) -> str:
        return f"least({n - 1}, greatest(0, floor((CASE WHEN {u} >= 0 THEN 0.5::DOUBLE * sqrt(1 + 3 * {u}) ELSE 1 - 0.5::DOUBLE * sqrt(1 - 3 * {u}) END) * {n})))::BIGINT"

    return f"""
WITH RECURSIVE p AS (SELECT key, sqrt(1 - z * z) * cos(radians(lon)) AS x, sqrt(1 - z * z) * sin(radians(lon)) AS y, z FROM ({CUSTOMERS})),
f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x >= 0 THEN 0 ELSE 3 END WHEN abs(y) >= abs(z) THEN CASE WHEN y >= 0 THEN 1 ELSE 4 END ELSE CASE WHEN z >= 0 THEN 2 ELSE 5 END END AS face FROM p),
u AS (SELECT key, face, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u, CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM f),
g AS (SELECT key, face, {lattice("u")} AS ix, {lattice("v")} AS iy FROM u),
walk AS (
  SELECT key, face, ix, iy, {_S2_LEVEL} AS b, 0::BIGINT AS code, (face % 2)::INTEGER AS turn FROM g
  UNION ALL
  SELECT key, face, ix, iy, b - 1, code * 4 + place, xor(turn, [1, 0, 0, 3][place + 1]) FROM (
    SELECT *, [[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]][turn + 1][(2 * ((ix >> (b - 1)) & 1) + ((iy >> (b - 1)) & 1) + 1)::INTEGER] AS place FROM walk WHERE b > 0)
)
SELECT key, (face * {n * n} + code + 1)::BIGINT AS pos FROM walk WHERE b = 0
"""


@query("s2_cellat", _s2_sql())
def s2_cellat(spark, sf_dir):
    r = F.sqrt(1 - F.col("z") * F.col("z"))
    p = customers(spark, sf_dir).select("key", (r * F.cos(F.radians("lon"))).alias("x"), (r * F.sin(F.radians("lon"))).alias("y"), "z")
    return system("S2").with_cell_xyz(p, "x", "y", "z", _S2_LEVEL).select("key", "pos")


@query("great_circle", f"SELECT a.key, round(2 * asin(least(1, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2)), 9) AS radians FROM (SELECT key, sqrt(1 - z * z) * cos(radians(lon)) AS x, sqrt(1 - z * z) * sin(radians(lon)) AS y, z FROM ({CUSTOMERS})) a, (SELECT 0.6::DOUBLE AS x, 0.0::DOUBLE AS y, 0.8::DOUBLE AS z) b")
def great_circle(spark, sf_dir):
    r = F.sqrt(1 - F.col("z") * F.col("z"))
    a = F.struct((r * F.cos(F.radians("lon"))).alias("x"), (r * F.sin(F.radians("lon"))).alias("y"), F.col("z").alias("z"))
    b = F.struct(F.lit(0.6).alias("x"), F.lit(0.0).alias("y"), F.lit(0.8).alias("z"))
    return customers(spark, sf_dir).select("key", F.round(sphere.distance_col(a, b), 9).alias("radians"))


def _series_sql(lat: str) -> str:
    return f"degrees(radians({lat})" + "".join(f" + ({c!r})::DOUBLE * sin({2.0 * k}::DOUBLE * radians({lat}))" for k, c in enumerate(series(WGS84[1])[0], 1)) + ")"


@query("authalic_latitude", f"SELECT key, round({_series_sql('lat')}, 9) AS lat FROM (SELECT key, degrees(asin(z)) AS lat FROM ({CUSTOMERS}))")
def authalic_latitude(spark, sf_dir):
    return customers(spark, sf_dir).select("key", F.round(geodetic_to_authalic_col(F.degrees(F.asin("z"))), 9).alias("lat"))


def _dem_sql() -> str:
    n = 30
    edge = "least(abs(lat_s), abs(lat_s + 1))"
    nc = f"(60 // CASE WHEN {edge} >= 85 THEN 20 WHEN {edge} >= 80 THEN 10 WHEN {edge} >= 70 THEN 6 WHEN {edge} >= 60 THEN 4 WHEN {edge} >= 50 THEN 3 ELSE 2 END)"
    return f"""
WITH rows AS (SELECT 89 - r AS lat_s, r FROM (SELECT unnest(range(0, 180)) AS r)), cols AS (SELECT r, {nc} AS nc FROM rows),
base AS (SELECT r, nc, coalesce(sum(360 * nc * {n}) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM cols),
p AS (SELECT key, lon + 180 AS x, z * 90 AS lat FROM ({CUSTOMERS}))
SELECT key, (base + floor(x) * nc * {n} + least({n - 1}, greatest(0, {n - 1} - floor((lat - (89 - r)) * {n}))) * nc + least(nc - 1, floor((x - floor(x)) * nc)) + 1)::BIGINT AS pos
FROM p JOIN base ON r = 89 - floor(lat)
"""


@query("dem_cellat", _dem_sql())
def dem_cellat(spark, sf_dir):
    """Pixels of a scaled elevation lattice; latitudes are z * 90 here, exact in both engines."""
    return customers(spark, sf_dir).select("key", system("DEM30").cellat_col(F.col("lon"), F.col("z") * 90, 1).alias("pos"))


@query("raster_cellat", f"SELECT pos, count(*) AS n FROM (SELECT floor((lon + 180) / 7.5::DOUBLE) + floor((z * 90 + 90) / 5::DOUBLE) * 48 + 1 AS p, p::BIGINT AS pos FROM ({ORDERS})) GROUP BY pos")
def raster_cellat(spark, sf_dir):
    import numpy as np

    from tessellon.operators.regrid import RasterGrid

    grid = RasterGrid(np.linspace(-180, 180, 49), np.linspace(-90, 90, 37))
    return orders(spark, sf_dir).groupBy(grid.locate_col(F.col("lon"), F.col("z") * 90).alias("pos")).agg(F.count("*").alias("n"))


def _cells(spark, sf_dir, level: int, which=customers) -> DataFrame:
    return located(which(spark, sf_dir), level).select("pos").distinct()


def _cells_sql(source: str, level: int) -> str:
    return f"SELECT DISTINCT pos FROM ({healpix_sql(source, level)})"


def igeo7_of(spark, sf_dir, level: int, sys: str | GridSystem = "IGeo7") -> DataFrame:
    lat = F.degrees(F.asin("z"))
    return customers(spark, sf_dir).select("key", "value", system(sys).cellat_col(F.col("lon"), lat, level).alias("pos"))


@query("igeo7_cellat")
def igeo7_cellat(spark, sf_dir):
    g = system("IGeo7")
    at = igeo7_of(spark, sf_dir, 7)
    z = g.id_col(F.col("pos"), 7)
    return at.select("key", "pos", g.string_col(z).alias("z7"), g.hex_col(z).alias("z7_hex"), g.resolution_col(z).alias("resolution"))


@query("isea4r_cellat")
def isea4r_cellat(spark, sf_dir):
    return igeo7_of(spark, sf_dir, 6, "ISEA4R").select("key", "pos")


@query("authalic_cellat")
def authalic_cellat(spark, sf_dir):
    from tessellon.systems.authalic import AuthalicSystem

    return igeo7_of(spark, sf_dir, 5, AuthalicSystem("IGeo7")).select("key", "pos")


@query("h3_hierarchy", "SELECT n::BIGINT AS n FROM (SELECT 120 * 7 * 7 * 7 + 2 AS n)")
def h3_hierarchy(spark, sf_dir):
    h = system("H3")
    ids = h.levelgrid(spark, 3).select("pos", h.id_col(F.col("pos"), 3).alias("id"))
    return ids.select(h.pos_col(F.col("id"), 3).alias("back"), "pos").filter("back = pos").agg(F.count("*").alias("n"))


@query("a5_hierarchy", "SELECT ((pos - 1) >> 2) + 1 AS parent, count(*) AS n FROM (SELECT unnest(range(1, 961)) AS pos) GROUP BY 1")
def a5_hierarchy(spark, sf_dir):
    a = system("A5")
    return a.levelgrid(spark, 3).groupBy(a.ancestor_col(F.col("pos"), 3, 2).alias("parent")).agg(F.count("*").alias("n"))


@query("events_by_cell", "SELECT window_start, pos, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, pos, h.value FROM events JOIN (" + healpix_sql(points_sql("events", "event_id", "value"), 1) + ") h ON h.key = event_id) GROUP BY ALL")
def events_by_cell(spark, sf_dir):
    """The windowed aggregation that also runs on a stream."""
    from tessellon.streaming.enrich import windowed_counts

    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("ts", "value", ((k * 7919 % 36000) / 100.0 - 180 + 0.005).alias("lon"), F.degrees(F.asin((k * 104729 % 20000) / 10000.0 - 1 + 0.00005)).alias("lat"))
    return windowed_counts(e, HEALPIX, 1, window="1 day").withColumn("mean", F.round("mean", 6))



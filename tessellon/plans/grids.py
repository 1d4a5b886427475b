"""Region, stencil, coverage, regridding and encoding queries over the derived points, with their SQL where it exists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessellon.functions import sphere
from tessellon.operators import regions, regrid, spatial
from tessellon.plans.points import CUSTOMERS, HEALPIX, ORDERS, SUPPLIERS, _cells, _cells_sql, customers, healpix_sql, igeo7_of, located, orders, suppliers
from tessellon.plans.registry import query
from tessellon.sources import encodings
from tessellon.systems import system

A, B = _cells_sql(CUSTOMERS, 4), _cells_sql(SUPPLIERS, 4)
_RUNS = f"SELECT min(pos) AS lo, max(pos) AS hi FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM ({A})) GROUP BY g"


@query("region_compress", f"SELECT lo, hi, (sum(hi - lo + 1) OVER (ORDER BY lo) - (hi - lo + 1))::BIGINT AS \"offset\" FROM ({_RUNS})")
def region_compress(spark, sf_dir):
    return regions.compress(_cells(spark, sf_dir, 4)).select("lo", "hi", F.col("offset").cast("long").alias("offset"))


@query("region_rank", f"SELECT pos, row_number() OVER (ORDER BY pos) AS rank FROM ({A})")
def region_rank(spark, sf_dir):
    return regions.ranked(_cells(spark, sf_dir, 4))


@query("region_union", f"SELECT pos FROM ({A}) UNION SELECT pos FROM ({B})")
def region_union(spark, sf_dir):
    return regions.union(_cells(spark, sf_dir, 4), _cells(spark, sf_dir, 4, suppliers))


@query("region_intersect", f"SELECT pos FROM ({A}) INTERSECT SELECT pos FROM ({B})")
def region_intersect(spark, sf_dir):
    return regions.intersect(_cells(spark, sf_dir, 4), _cells(spark, sf_dir, 4, suppliers))


@query("region_difference", f"SELECT pos FROM ({A}) EXCEPT SELECT pos FROM ({B})")
def region_difference(spark, sf_dir):
    return regions.difference(_cells(spark, sf_dir, 4), _cells(spark, sf_dir, 4, suppliers))


@query("region_union_levels", f"SELECT 2 AS level, pos FROM ({_cells_sql(SUPPLIERS, 2)}) UNION ALL SELECT 4 AS level, pos FROM ({A}) WHERE ((pos - 1) >> 4) + 1 NOT IN (SELECT pos FROM ({_cells_sql(SUPPLIERS, 2)}))")
def region_union_levels(spark, sf_dir):
    return regions.union_levels(HEALPIX, [(4, _cells(spark, sf_dir, 4)), (2, _cells(spark, sf_dir, 2, suppliers))])


@query("region_expand", f"SELECT ((lo - 1) << 4) + 1 AS lo, hi << 4 AS hi FROM ({_RUNS})")
def region_expand(spark, sf_dir):
    return regions.expand(regions.compress(_cells(spark, sf_dir, 4)), HEALPIX, 4, 6)


def _compact_sql(level: int) -> str:
    out = f"WITH l{level} AS ({_cells_sql(ORDERS, level)})"
    for k in range(level, 0, -1):
        out += f", l{k - 1} AS (SELECT ((pos - 1) >> 2) + 1 AS pos FROM l{k} GROUP BY 1 HAVING count(*) = 4)"
    parts = [f"SELECT {k} AS level, pos FROM l{k}" + (f" WHERE ((pos - 1) >> 2) + 1 NOT IN (SELECT pos FROM l{k - 1})" if k else "") for k in range(level, -1, -1)]
    return out + " " + " UNION ALL ".join(parts)


@query("region_compact", _compact_sql(5))
def region_compact(spark, sf_dir):
    return regions.compact(_cells(spark, sf_dir, 5, orders), HEALPIX, 5)


@query("range_join", f"SELECT key, pos FROM ({healpix_sql(ORDERS, 4)}) o WHERE EXISTS (SELECT 1 FROM ({_RUNS}) r WHERE o.pos BETWEEN r.lo AND r.hi)")
def range_join(spark, sf_dir):
    return regions.in_ranges(located(orders(spark, sf_dir), 4).select("key", "pos"), regions.compress(_cells(spark, sf_dir, 4)).select("lo", "hi"))


@query("range_overlap", f"SELECT greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ({_RUNS}) a JOIN (SELECT min(pos) AS lo, max(pos) AS hi FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM ({B})) GROUP BY g) b ON a.lo <= b.hi AND b.lo <= a.hi")
def range_overlap(spark, sf_dir):
    return regions.intersect_ranges(regions.compress(_cells(spark, sf_dir, 4)), regions.compress(_cells(spark, sf_dir, 4, suppliers)))


# --- coverage and predicates --------------------------------------------------------------------------------------

BOX = (-30.0, 40.0, -20.0, 35.0)


@query("moc_level")
def moc_level(spark, sf_dir):
    return spatial.coverage("IGeo7", spatial.box(*BOX), level=4).df(spark)


@query("moc_budget")
def moc_budget(spark, sf_dir):
    return spatial.coverage(HEALPIX, spatial.box(*BOX), maxcells=120).df(spark)


@query("query_intersects")
def query_intersects(spark, sf_dir):
    return spatial.query(spark, HEALPIX, spatial.box(*BOX), "intersects", 4)


@query("query_within_polygon")
def query_within_polygon(spark, sf_dir):
    ring, hole = [(-20, -15), (30, -10), (25, 30), (-10, 25)], [(0, 0), (0, 8), (8, 8), (8, 0)]
    return spatial.query(spark, "S2", spatial.polygon(ring, hole), "within", 5)


@query("zonal_mean")
def zonal_mean(spark, sf_dir):
    data = located(orders(spark, sf_dir), 5).select("pos", "value")
    return spatial.zonal(data, HEALPIX, 5, {"cap": spatial.cap(10, 40, 12), "box": spatial.box(*BOX)})


@query("covering_orders")
def covering_orders(spark, sf_dir):
    return spatial.covering(igeo7_of(spark, sf_dir, 5), "IGeo7", 5, spatial.box(*BOX))


# --- regridding -------------------------------------------------------------------------------------------------


def _raster() -> regrid.RasterGrid:
    return regrid.RasterGrid(np.linspace(-180, 180, 25), np.linspace(-90, 90, 13))


def _on_raster(spark, sf_dir):
    g = _raster()
    return orders(spark, sf_dir).groupBy(g.locate_col(F.col("lon"), F.col("z") * 90).alias("pos")).agg(F.avg("value").alias("value"))


@query("regrid_conservative")
def regrid_conservative(spark, sf_dir):
    plan = regrid.plan_regrid(spark, _raster(), "IGeo7", "conservative", 2)
    return regrid.regrid(_on_raster(spark, sf_dir), plan)


def _fine() -> regrid.RasterGrid:
    """Every cell of _raster() in four."""
    return regrid.RasterGrid(np.linspace(-180, 180, 49), np.linspace(-90, 90, 25))


def _whole_on_raster(spark, sf_dir, *dims):
    """Whole numbers, so that sums do not depend on their order."""
    at = _raster().locate_col(F.col("lon"), F.col("z") * 90).alias("pos")
    return orders(spark, sf_dir).withColumn("part", F.col("key") % 3).groupBy(at, *dims).agg(F.floor(F.max("value")).cast("double").alias("value"))


_AT = "(floor((lon + 180) / 15::DOUBLE) + floor((z * 90 + 90) / 15::DOUBLE) * 24)::BIGINT"
_FINE_SQL = "SELECT p + 1 AS pos, p % 48 AS i, p // 48 AS j FROM (SELECT unnest(range(0, 1152)) AS p)"
_SRC_SQL = f"SELECT {_AT} % 24 AS x, {_AT} // 24 AS y, floor(max(value)) AS value FROM ({ORDERS}) GROUP BY 1, 2"
# A fine centre lies a quarter of a cell from its own source cell's centre, towards the neighbour on its side.
_TAPS_SQL = "SELECT pos, ((i // 2 + CASE WHEN a = 0 THEN 0 WHEN i % 2 = 0 THEN -1 ELSE 1 END) % 24 + 24) % 24 AS x, least(11, greatest(0, j // 2 + CASE WHEN b = 0 THEN 0 WHEN j % 2 = 0 THEN -1 ELSE 1 END)) AS y, CASE WHEN a = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * CASE WHEN b = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS w FROM fine, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b)"


@query("regrid_bilinear", f"WITH fine AS ({_FINE_SQL}), src AS ({_SRC_SQL}), taps AS ({_TAPS_SQL}), s AS (SELECT pos, sum(w * value) AS num, sum(w) AS cover FROM taps JOIN src USING (x, y) GROUP BY pos) SELECT pos, CASE WHEN cover >= 0.5 THEN round(num / cover, 6) END AS value FROM fine LEFT JOIN s USING (pos)")
def regrid_bilinear(spark, sf_dir):
    plan = regrid.plan_regrid(spark, _raster(), _fine(), "bilinear")
    return regrid.regrid(_whole_on_raster(spark, sf_dir), plan).withColumn("value", F.round("value", 6))


@query("regrid_bilinear_sphere")
def regrid_bilinear_sphere(spark, sf_dir):
    return regrid.regrid(_on_raster(spark, sf_dir), regrid.plan_regrid(spark, _raster(), HEALPIX, "bilinear", 3))


@query("regrid_extensive", f"WITH fine AS ({_FINE_SQL}), src AS ({_SRC_SQL}) SELECT f.pos, coalesce(s.value, 0)::DOUBLE AS value FROM fine f LEFT JOIN src s ON s.x = f.i // 2 AND s.y = f.j // 2")
def regrid_extensive(spark, sf_dir):
    return regrid.regrid(_whole_on_raster(spark, sf_dir), regrid.plan_regrid(spark, _raster(), _fine(), "nearest"), regrid.extensive())


@query("regrid_slices", f"WITH fine AS ({_FINE_SQL}), src AS (SELECT {_AT} % 24 AS x, {_AT} // 24 AS y, key % 3 AS part, floor(max(value)) AS value FROM ({ORDERS}) GROUP BY 1, 2, 3) SELECT f.pos, p.part, s.value FROM fine f CROSS JOIN (SELECT DISTINCT part FROM src) p LEFT JOIN src s ON s.x = f.i // 2 AND s.y = f.j // 2 AND s.part = p.part")
def regrid_slices(spark, sf_dir):
    return regrid.regrid(_whole_on_raster(spark, sf_dir, "part"), regrid.plan_regrid(spark, _raster(), _fine(), "nearest"), dims=("part",))


@query("regrid_nearest", """
WITH src AS (SELECT floor((lon + 180) / 15::DOUBLE) + floor((z * 90 + 90) / 15::DOUBLE) * 24 + 1 AS pos, avg(value) AS value FROM (""" + ORDERS + """) GROUP BY 1),
dst AS (SELECT unnest(range(1, 1153)) AS pos)
SELECT d.pos, round(s.value, 6) AS value FROM dst d LEFT JOIN src s ON s.pos = ((d.pos - 1) % 48) // 2 + (((d.pos - 1) // 48) // 2) * 24 + 1
""")
def regrid_nearest(spark, sf_dir):
    return regrid.regrid(_on_raster(spark, sf_dir), regrid.plan_regrid(spark, _raster(), _fine(), "nearest")).withColumn("value", F.round("value", 6))


@query("sampling_pyramid")
def sampling_pyramid(spark, sf_dir):
    data = located(orders(spark, sf_dir), 3).groupBy("pos").agg(F.avg("value").alias("value"))
    return regrid.pyramid(data, HEALPIX, 3, 1)


# --- stored axes --------------------------------------------------------------------------------------------------


@query("idranges", f"SELECT lo - 1 AS first, hi - 1 AS last FROM ({_RUNS})")
def idranges(spark, sf_dir):
    return encodings.idranges(_cells(spark, sf_dir, 4), HEALPIX, 4)


@query("idranges_igeo7")
def idranges_igeo7(spark, sf_dir):
    return encodings.idranges(igeo7_of(spark, sf_dir, 4).select("pos"), "IGeo7", 4)


@query("chunk_manifest", f"SELECT (k - 1) // 100 + 1 AS chunk, min(pos) - 1 AS first_id, max(pos) - 1 AS last_id, count(*) AS length, ((k - 1) // 100) * 100 AS \"offset\" FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM ({A})) GROUP BY (k - 1) // 100")
def chunk_manifest(spark, sf_dir):
    return encodings.chunk_manifest(_cells(spark, sf_dir, 4), HEALPIX, 4, 100)


@query("dense_axis", f"SELECT pos - 1 AS cell FROM ({A})")
def dense_axis(spark, sf_dir):
    return encodings.DenseEncoding().encode(_cells(spark, sf_dir, 4), system(HEALPIX), 4)


@query("cellsize")
def cellsize(spark, sf_dir):
    rows = [(n, level, spatial.cellsize(n, level)) for n in ("HEALPix", "S2", "IGeo7", "ISEA4R") for level in (2, 5)]
    return spark.createDataFrame(rows, "system string, level int, metres double")


@query("bearing", f"SELECT key, round(mod(degrees(atan2(sin(radians(10 - lon)) * cos(radians(50)), sqrt(1 - z * z) * sin(radians(50)) - z * cos(radians(50)) * cos(radians(10 - lon)))) + 360, 360), 6) AS bearing FROM ({CUSTOMERS})")
def bearing(spark, sf_dir):
    lat = F.degrees(F.asin("z"))
    return customers(spark, sf_dir).select("key", F.round(sphere.bearing_col(F.col("lon"), lat, F.lit(10.0), F.lit(50.0)), 6).alias("bearing"))

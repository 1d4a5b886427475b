"""Neighbour, region and terrain queries over whole tables, with SQL that finds neighbours by itself.

The SQL derives adjacency from geometry: the corners of a cell lie on the lattice of the published projection, so that a
corner is a pair of whole numbers (its lattice row and its place in that row), and cells are neighbours where they
share one; they share an edge where they share two. Points repeat after 180 000 order keys, so that the level has gaps
at small scales and fills up at large ones. Field values are whole numbers, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellon.operators import regions, stencils
from tessellon.plans.points import CUSTOMERS, HEALPIX, ORDERS, _cells, _cells_sql, _xyf_sql, customers, healpix_sql, located, orders
from tessellon.plans.registry import query
from tessellon.systems import system

#: Level of fields and most regions (49 152 cells), level of the region whose interior is asked for, radius for slopes.
WHOLE, DENSE, RADIUS = 6, 4, 1e6


def _corners_sql(level: int) -> str:
    """(pos, a, b): a cell's corners, named by lattice row and place in the row."""
    n = 1 << level
    at = f"SELECT pos, (face // 4 + 2) * {n} - x - y AS a, col, x - y AS s FROM (SELECT pos, face, col, ix + dx AS x, iy + dy AS y FROM ({_xyf_sql(level)}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy))"
    return f"SELECT pos, a, CASE WHEN w = 0 THEN 0 ELSE (col * w + s + 8 * w) % (8 * w) END AS b FROM (SELECT *, least({n}, least(a, {4 * n} - a)) AS w FROM ({at}))"


def _near_sql(level: int, edge: bool = False) -> str:
    """(pos, nbr) of all neighbours of the level."""
    return f"(WITH c AS ({_corners_sql(level)}) SELECT c.pos, d.pos AS nbr FROM c JOIN c d USING (a, b) WHERE c.pos <> d.pos GROUP BY 1, 2{' HAVING count(*) = 2' if edge else ''})"


NEAR = _near_sql(WHOLE)
REGION = f"({_cells_sql(ORDERS, WHOLE)})"
FIELD = f"(SELECT pos, floor(max(value)) AS z FROM ({healpix_sql(ORDERS, WHOLE)}) GROUP BY pos)"
_WITH = f"WITH n AS {NEAR}, r AS {REGION}"
_PAIRS = f"WITH n AS MATERIALIZED {NEAR}, f AS MATERIALIZED {FIELD}, p AS (SELECT f.pos, f.z, n.nbr, g.z AS zn FROM f JOIN n USING (pos) JOIN f g ON g.pos = n.nbr)"


def whole_field(spark, sf_dir):
    return located(orders(spark, sf_dir), WHOLE).groupBy("pos").agg(F.floor(F.max("value")).cast("double").alias("z"))


def whole_region(spark, sf_dir, level: int = WHOLE):
    return _cells(spark, sf_dir, level, orders)


def _rounded(df, column: str, digits: int = 6):
    return df.select("pos", F.round(F.nanvl(column, F.lit(None).cast("double")), digits).alias(column))


# --- neighbours ---------------------------------------------------------------------------------------------------


@query("one_ring", f"SELECT pos::BIGINT AS pos, nbr::BIGINT AS nbr FROM {NEAR}")
def one_ring(spark, sf_dir):
    return regions.neighbour_relation(system(HEALPIX).levelgrid(spark, WHOLE), HEALPIX, WHOLE).select("pos", "nbr")


@query("one_ring_edge", f"SELECT pos::BIGINT AS pos, nbr::BIGINT AS nbr FROM {_near_sql(WHOLE, True)} JOIN {REGION} USING (pos)")
def one_ring_edge(spark, sf_dir):
    return regions.neighbour_relation(whole_region(spark, sf_dir), HEALPIX, WHOLE, "edge").select("pos", "nbr")


@query("neighbor_count", f"SELECT pos, count(*) AS n FROM {NEAR} JOIN {REGION} USING (pos) GROUP BY pos")
def neighbor_count(spark, sf_dir):
    return whole_region(spark, sf_dir).select("pos", system(HEALPIX).neighborcount_col(F.col("pos"), WHOLE).cast("long").alias("n"))


_TWO = f"{_WITH}, two AS (SELECT pos, nbr FROM n JOIN r USING (pos) UNION SELECT n.pos, m.nbr FROM n JOIN r USING (pos) JOIN n m ON m.pos = n.nbr WHERE m.nbr <> n.pos)"


@query("neighbors_k2", f"{_TWO} SELECT pos, nbr::BIGINT AS nbr FROM two")
def neighbors_k2(spark, sf_dir):
    return regions.neighbors(whole_region(spark, sf_dir), HEALPIX, WHOLE, 2).select("pos", "nbr")


@query("ring_k2", f"{_TWO} SELECT pos, nbr::BIGINT AS nbr FROM two ANTI JOIN n USING (pos, nbr)")
def ring_k2(spark, sf_dir):
    return regions.ring(whole_region(spark, sf_dir), HEALPIX, WHOLE, 2).select("pos", "nbr")


@query("neighbors_clipped", f"{_WITH} SELECT n.pos, n.nbr::BIGINT AS nbr FROM n JOIN r USING (pos) JOIN r q ON q.pos = n.nbr")
def neighbors_clipped(spark, sf_dir):
    own = whole_region(spark, sf_dir)
    return regions.neighbors(own, HEALPIX, WHOLE, 1, clip=own).select("pos", "nbr")


def _corner_points_sql(level: int) -> str:
    n = 1 << level
    z = f"CASE WHEN a < {n} THEN 1 - (w / {n}::DOUBLE) * (w / {n}::DOUBLE) / 3 WHEN a > {3 * n} THEN (w / {n}::DOUBLE) * (w / {n}::DOUBLE) / 3 - 1 ELSE ({2 * n}::DOUBLE - a) * 2 / {3 * n}::DOUBLE END"
    return f"SELECT pos, round(sqrt(greatest(0, 1 - z * z)) * cos(phi), 7) + 0.0 AS x, round(sqrt(greatest(0, 1 - z * z)) * sin(phi), 7) + 0.0 AS y, round(z, 7) + 0.0 AS z FROM (SELECT pos, {z} AS z, CASE WHEN w = 0 THEN 0 ELSE pi() / 4 * b / w END AS phi FROM (SELECT *, least({n}, least(a, {4 * n} - a)) AS w FROM ({_corners_sql(level)})))"


@query("cell_boundary", _corner_points_sql(4))
def cell_boundary(spark, sf_dir):
    """The corners of every cell of a level."""
    h = system(HEALPIX)
    line = h.levelgrid(spark, 4).withColumn("line", h.boundary_col(F.col("pos"), 4))
    # Corners are every fourth part of the points of the line.
    corner = line.select("pos", F.size("line").alias("n"), F.posexplode("line").alias("k", "c")).filter("k * 4 % n = 0")
    return corner.select("pos", *((F.round(F.col("c")[v], 7) + 0.0).alias(v) for v in "xyz"))


# --- regions ------------------------------------------------------------------------------------------------------


@query("halo", f"{_WITH} SELECT DISTINCT nbr::BIGINT AS pos FROM n JOIN r USING (pos) WHERE nbr NOT IN (SELECT pos FROM r)")
def halo(spark, sf_dir):
    return regions.halo(whole_region(spark, sf_dir), HEALPIX, WHOLE)


@query("border", f"{_WITH} SELECT DISTINCT r.pos FROM n JOIN r USING (pos) WHERE nbr NOT IN (SELECT pos FROM r)")
def border(spark, sf_dir):
    return regions.border(whole_region(spark, sf_dir), HEALPIX, WHOLE)


@query("interior", f"WITH n AS {_near_sql(DENSE)}, r AS ({_cells_sql(ORDERS, DENSE)}) SELECT pos FROM r WHERE pos NOT IN (SELECT pos FROM n WHERE nbr NOT IN (SELECT pos FROM r))")
def interior(spark, sf_dir):
    return regions.interior(whole_region(spark, sf_dir, DENSE), HEALPIX, DENSE)


@query("grow", f"WITH n AS {NEAR}, r AS ({_cells_sql(CUSTOMERS, WHOLE)}), g AS (SELECT pos FROM r UNION SELECT nbr FROM n JOIN r USING (pos)) SELECT pos::BIGINT AS pos FROM g UNION SELECT nbr::BIGINT FROM n JOIN g USING (pos)")
def grow(spark, sf_dir):
    return regions.grow(_cells(spark, sf_dir, WHOLE, customers), HEALPIX, WHOLE, 2)


_RANKED = f"WITH n AS {NEAR}, r AS (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM {REGION})"


@query("adjacency_mark", f"{_RANKED} SELECT r.k AS row, coalesce(q.k, 0) AS index FROM n JOIN r USING (pos) LEFT JOIN r q ON q.pos = n.nbr")
def adjacency_mark(spark, sf_dir):
    return regions.adjacency(whole_region(spark, sf_dir), HEALPIX, WHOLE, "mark").select("row", "index")


@query("adjacency_clipped", f"{_RANKED} SELECT r.k AS row, q.k AS index FROM n JOIN r USING (pos) JOIN r q ON q.pos = n.nbr")
def adjacency_clipped(spark, sf_dir):
    return regions.adjacency(whole_region(spark, sf_dir), HEALPIX, WHOLE, 0).select("row", "index")


@query("adjacency_halo", f"{_RANKED}, h AS (SELECT DISTINCT nbr AS pos FROM n JOIN r USING (pos) WHERE nbr NOT IN (SELECT pos FROM r)), e AS (SELECT pos, k FROM r UNION ALL SELECT pos, row_number() OVER (ORDER BY pos) + (SELECT count(*) FROM r) FROM h) SELECT r.k AS row, e.k::BIGINT AS index FROM n JOIN r USING (pos) JOIN e ON e.pos = n.nbr")
def adjacency_halo(spark, sf_dir):
    return regions.adjacency(whole_region(spark, sf_dir), HEALPIX, WHOLE, 1).select("row", "index")


@query("rootcells", "SELECT unnest(range(1, 13)) AS pos")
def rootcells(spark, sf_dir):
    return regions.rootcells(spark, HEALPIX).select("pos")


@query("descendants", f"SELECT DISTINCT (pos - 1) * 16 + 1 + k AS pos FROM ({_cells_sql(CUSTOMERS, 3)}), (SELECT unnest(range(0, 16)) AS k)")
def descendants(spark, sf_dir):
    return regions.descendants(_cells(spark, sf_dir, 3, customers), HEALPIX, 3, 5).select("pos")


@query("subtree", "SELECT 6 * 256 + unnest(range(1, 257)) AS pos")
def subtree(spark, sf_dir):
    return regions.dense(regions.subtree(spark, HEALPIX, 7, 0, 4))


@query("region_concatenate", f"SELECT pos FROM ({_cells_sql(CUSTOMERS, 3)}) UNION SELECT pos FROM ({_cells_sql(ORDERS, 3)})")
def region_concatenate(spark, sf_dir):
    return regions.concatenate(_cells(spark, sf_dir, 3, customers), _cells(spark, sf_dir, 3, orders)).select("pos").distinct()


@query("region_select_rank", f"SELECT k AS rank, pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM {REGION}) WHERE k IN (SELECT c_custkey FROM customer)")
def region_select_rank(spark, sf_dir):
    ranks = customers(spark, sf_dir).select(F.col("key").alias("rank")).distinct()
    return regions.select_rank(whole_region(spark, sf_dir), ranks)


@query("cell_ids", f"SELECT pos, pos - 1 AS id, pos AS back FROM {REGION}")
def cell_ids(spark, sf_dir):
    h = system(HEALPIX)
    named = whole_region(spark, sf_dir).select("pos", h.id_col(F.col("pos"), WHOLE).alias("id"))
    return named.select("pos", "id", h.pos_col(F.col("id"), WHOLE).alias("back"))


@query("cell_area", f"SELECT pos, round(4 * pi() / {12 * 4**WHOLE}, 12) AS area FROM {REGION}")
def cell_area(spark, sf_dir):
    return whole_region(spark, sf_dir).select("pos", F.round(system(HEALPIX).area_col(F.col("pos"), WHOLE), 12).alias("area"))


# --- stencils -----------------------------------------------------------------------------------------------------


@query("smooth", f"{_PAIRS} SELECT pos, round((first(f.z) + coalesce(sum(zn), 0)) / (1 + count(zn)), 6) AS z FROM f LEFT JOIN p USING (pos) GROUP BY pos")
def smooth(spark, sf_dir):
    return _rounded(stencils.smooth(whole_field(spark, sf_dir), HEALPIX, WHOLE, "z"), "z")


@query("laplacian", f"{_PAIRS} SELECT pos, round(avg(zn) - first(f.z), 6) AS z FROM f LEFT JOIN p USING (pos) GROUP BY pos")
def laplacian(spark, sf_dir):
    return _rounded(stencils.laplacian(whole_field(spark, sf_dir), HEALPIX, WHOLE, "z"), "z")


@query("terrain_tpi", f"{_PAIRS} SELECT pos, round(first(f.z) - avg(zn), 6) AS tpi FROM f LEFT JOIN p USING (pos) GROUP BY pos")
def terrain_tpi(spark, sf_dir):
    return _rounded(stencils.topographic_position(whole_field(spark, sf_dir), HEALPIX, WHOLE), "tpi")


@query("terrain_tri", f"{_PAIRS} SELECT pos, round(sqrt(coalesce(sum((f.z - zn) * (f.z - zn)), 0)), 6) AS tri FROM f LEFT JOIN p USING (pos) GROUP BY pos")
def terrain_tri(spark, sf_dir):
    return _rounded(stencils.ruggedness(whole_field(spark, sf_dir), HEALPIX, WHOLE), "tri")


@query("terrain_roughness", f"{_PAIRS} SELECT pos, round(coalesce(max(abs(f.z - zn)), 0), 6) AS roughness FROM f LEFT JOIN p USING (pos) GROUP BY pos")
def terrain_roughness(spark, sf_dir):
    return _rounded(stencils.roughness(whole_field(spark, sf_dir), HEALPIX, WHOLE), "roughness")


@query("terrain_prominence", f"{_PAIRS} SELECT pos, count(*) FILTER (WHERE zn <= f.z) AS prominence FROM f LEFT JOIN p USING (pos) GROUP BY pos")
def terrain_prominence(spark, sf_dir):
    return stencils.prominence(whole_field(spark, sf_dir), HEALPIX, WHOLE)


def _centres_sql(level: int) -> str:
    n = float(1 << level)
    z = f"CASE WHEN ring < {n} THEN 1 - (width / {n}::DOUBLE) * (width / {n}::DOUBLE) / 3 WHEN ring > {3 * n} THEN (width / {n}::DOUBLE) * (width / {n}::DOUBLE) / 3 - 1 ELSE ({2 * n}::DOUBLE - ring) * 2 / {3 * n}::DOUBLE END"
    return f"SELECT pos, sqrt(1 - z * z) * cos(phi) AS cx, sqrt(1 - z * z) * sin(phi) AS cy, z AS cz FROM (SELECT pos, {z} AS z, pi() / 4 * (col * width + ix - iy) / width AS phi FROM ({_xyf_sql(level)}))"


_APART = "2 * asin(sqrt(power(u.cx - v.cx, 2) + power(u.cy - v.cy, 2) + power(u.cz - v.cz, 2)) / 2)"
_FAR = f"{_PAIRS}, c AS MATERIALIZED ({_centres_sql(WHOLE)}), d AS (SELECT p.*, {RADIUS}::DOUBLE * {_APART} AS d FROM p JOIN c u ON u.pos = p.pos JOIN c v ON v.pos = p.nbr)"


@query("terrain_slope", f"{_FAR} SELECT pos, round(degrees(atan(coalesce(max(abs(f.z - zn) / d), 0))), 6) AS slope FROM f LEFT JOIN d USING (pos) GROUP BY pos")
def terrain_slope(spark, sf_dir):
    return _rounded(stencils.slope_mdg(whole_field(spark, sf_dir), HEALPIX, WHOLE, radius=RADIUS), "slope")


@query("terrain_curvature", f"{_FAR} SELECT pos, round(4 * avg((zn - f.z) / (d * d)), 9) AS curvature FROM f LEFT JOIN d USING (pos) GROUP BY pos")
def terrain_curvature(spark, sf_dir):
    return _rounded(stencils.curvature(whole_field(spark, sf_dir), HEALPIX, WHOLE, radius=RADIUS), "curvature", 9)


@query("terrain_plane_fit")
def terrain_plane_fit(spark, sf_dir):
    """Slope and aspect of the least squares plane."""
    return stencils.plane_fit(whole_field(spark, sf_dir), HEALPIX, WHOLE)


_DIRECTION = "SELECT f.pos, coalesce(b.nbr, f.pos)::BIGINT AS dir FROM f LEFT JOIN (SELECT pos, arg_max(nbr, ((z - zn) / d, -nbr)) AS nbr FROM d WHERE zn < z GROUP BY pos) b USING (pos)"


@query("flow_direction", f"{_FAR} {_DIRECTION}")
def flow_direction(spark, sf_dir):
    return stencils.flow_direction(whole_field(spark, sf_dir), HEALPIX, WHOLE)


@query("flow_accumulation", f"{_FAR.replace('WITH ', 'WITH RECURSIVE ', 1)}, g AS MATERIALIZED ({_DIRECTION}), w AS (SELECT pos AS begun, pos FROM g UNION ALL SELECT w.begun, g.dir FROM w JOIN g USING (pos) WHERE g.dir <> g.pos) SELECT pos, dir, k::DOUBLE AS accumulation FROM g JOIN (SELECT pos, count(*) AS k FROM w GROUP BY pos) USING (pos)")
def flow_accumulation(spark, sf_dir):
    d = stencils.flow_direction(whole_field(spark, sf_dir), HEALPIX, WHOLE)
    return stencils.flow_accumulation(d).join(d, "pos")


@query("lowest_neighbor", f"{_PAIRS} SELECT f.pos, coalesce(b.nbr, 0)::BIGINT AS downhill FROM f LEFT JOIN (SELECT pos, arg_min(nbr, (zn, nbr)) AS nbr FROM p WHERE zn < z GROUP BY pos) b USING (pos)")
def lowest_neighbor(spark, sf_dir):
    return stencils.lowest_neighbor(whole_field(spark, sf_dir), HEALPIX, WHOLE).select("pos", F.coalesce("downhill", F.lit(0)).alias("downhill"))


def _fold():
    def fold(_pos, _own, near):
        if not near:
            return float("nan")
        out = near[0]
        for v in near[1:]:
            out = out * 0.5 + v
        return out

    return fold


@query("map_neighbors_callback")
def map_neighbors_callback(spark, sf_dir):
    """An arbitrary callback that depends on the ring's order."""
    return _rounded(stencils.map_neighbors_pandas(whole_field(spark, sf_dir), HEALPIX, WHOLE, _fold(), "z"), "result")


def _middle():
    def middle(_pos, own, near):
        held = sorted([own, *near])
        return held[len(held) // 2]

    return middle


@query("map_neighbors_middle", f"{_PAIRS} SELECT pos, list_sort(list(z))[count(*) // 2 + 1] AS result FROM (SELECT pos, z FROM f UNION ALL SELECT pos, zn FROM p) GROUP BY pos")
def map_neighbors_middle(spark, sf_dir):
    """An arbitrary callback that does not: the upper median of a cell and its neighbours."""
    return stencils.map_neighbors_pandas(whole_field(spark, sf_dir), HEALPIX, WHOLE, _middle(), "z")

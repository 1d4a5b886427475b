"""S2 positions as expressions: against numpy, the SQL on odd rows, and the plan's size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellon.plans import registry
from tessellon.systems import system

S2 = system("S2")


def directions(n):
    """Points all over the sphere, with corners, edges and middles of the faces."""
    p = np.random.default_rng(5).normal(size=(n, 3))
    axes = np.array([[x, y, z] for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)], float)
    return np.concatenate([p / np.linalg.norm(p, axis=1, keepdims=True), axes])


@pytest.mark.parametrize("level", [0, 1, 2, 3, 6, 7, 30])
def test_positions_same_as_numpy(spark, level):
    p = directions(400)
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "k long, x double, y double, z double")
    want = S2.cellat(p, level).tolist()
    assert [r.pos for r in S2.with_cell_xyz(df, "x", "y", "z", level).orderBy("k").collect()] == want
    assert [r.pos for r in df.select("k", S2.cellat_xyz_col(F.col("x"), F.col("y"), F.col("z"), level).alias("pos")).orderBy("k").collect()] == want
    ix, iy, face = S2.decode(np.array(want) - 1, level)
    rows = spark.createDataFrame([(k, int(a), int(b), int(f)) for k, (a, b, f) in enumerate(zip(ix, iy, face, strict=True))], "k long, ix long, iy long, face long")
    assert [r.id + 1 for r in rows.select("k", S2.encode_col(F.col("ix"), F.col("iy"), F.col("face"), level).alias("id")).orderBy("k").collect()] == want


def test_query_same_as_sql_on_missing_keys(spark, tmp_path):
    rows = [(None, 1.0), *((k * 37, float(k)) for k in range(3000))]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = registry.queries()["s2_cellat"](spark, str(tmp_path)).collect()
    order = lambda r: (r[0] is not None, r)
    assert sorted(((r.key, r.pos) for r in got), key=order) == sorted(con.execute(registry.oracle_sql()["s2_cellat"]).fetchall(), key=order)


def test_query_stays_in_generated_code(spark, sf):
    """A lambda is interpreted, and reckons what it refers to anew at every bit."""
    plan = registry.queries()["s2_cellat"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan

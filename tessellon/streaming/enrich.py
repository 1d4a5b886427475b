"""Grid cells on streams: location is stateless, so a stream of points is keyed by cell and aggregated in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.systems.base import GridSystem, system


def with_cell(points: DataFrame, sys: str | GridSystem, level: int, lon: str = "lon", lat: str = "lat", out: str = "pos") -> DataFrame:
    """The points with their cell's position; works alike on batches and streams."""
    s = system(sys)
    if hasattr(s, "with_cell_z"):
        return s.with_cell_z(points.withColumn("_z", F.sin(F.radians(lat))), lon, "_z", level, out).drop("_z")
    return points.withColumn(out, s.cellat_col(F.col(lon), F.col(lat), level))


def windowed_counts(points: DataFrame, sys: str | GridSystem, level: int, time: str = "ts", value: str = "value", window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(window_start, pos, n, mean) per tumbling (or sliding) window and cell; rows later than `late` are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    keyed = with_cell(points, sys, level).withWatermark(time, late)
    return keyed.groupBy(w, "pos").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("window_start"), "pos", "n", "mean")

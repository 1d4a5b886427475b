"""Stores of gridded fields.

The native store is Parquet in position order with a JSON sidecar: a region's axis in one of the encodings, values
range-partitioned by position, so that a selection prunes files by their footers. Zarr v2 directories are read through
Spark's binary reader (chunks are decoded on the executors, raw or zlib) and written chunk by chunk.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.operators import regions
from tessellon.sources import conventions as C
from tessellon.sources.encodings import chunk_plan, encoding, write_eligible
from tessellon.sources.errors import DGGSFormatError, store_context
from tessellon.systems.base import system

FORMAT = {"writer": "tessellon", "format": 1}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, through Spark's file systems (whose readers skip names that begin with a dot)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def normalize_url(url: str) -> str:
    """gs:// becomes its public https address; s3:// and paths stay."""
    m = re.match(r"gs://([^/]+)/(.*)", url)
    return f"https://storage.googleapis.com/{m[1]}/{m[2]}" if m else url


def write(data: DataFrame, path: str, sys: str, level: int, axis: str = "none", pos: str = "pos", target: int = 1_000_000) -> None:
    """Values with their axis and metadata; never over an existing store. Whole coarse subtrees stay together in files."""
    spark, s = data.sparkSession, system(sys)
    region = data.select(F.col(pos).alias("pos")).distinct()
    if not write_eligible(axis, region, s, level):
        raise DGGSFormatError("encoding", declared=axis, observed="cells that it cannot hold", store=path)
    ancestor = chunk_plan(s, level, target)
    files = max(1, -(-s.ncells(ancestor) // 64))
    data.withColumnRenamed(pos, "pos").repartitionByRange(min(files, 10_000), "pos").sortWithinPartitions("pos").write.mode("errorifexists").parquet(f"{path}/values")
    encoding(axis).encode(region, s, level).write.mode("errorifexists").parquet(f"{path}/axis")
    n = region.count()
    _put_text(spark, f"{path}/store.json", json.dumps(FORMAT | {"system": s.name, "level": level, "encoding": axis, "cells": n, "chunk_level": ancestor, "validated": True}))


def describe(spark: SparkSession, path: str) -> dict:
    text = _text(spark, f"{path}/store.json")
    if text is None:
        raise DGGSFormatError("store", declared="store.json", observed=None, store=path)
    return json.loads(text)


def read(spark: SparkSession, path: str, variables: list[str] | None = None, validate: str = "trust") -> DataFrame:
    """(pos, variables...). "trust" believes this writer's marker; "scan" decodes the axis and compares it."""
    d = describe(spark, path)
    data = spark.read.parquet(f"{path}/values")
    trusted = all(d.get(k) == v for k, v in FORMAT.items()) and d.get("validated")
    if validate == "scan" or not trusted:
        with store_context(path):
            axis = encoding(d["encoding"]).decode(spark.read.parquet(f"{path}/axis"), system(d["system"]), d["level"])
            if not regions.is_subset(data.select("pos"), axis) or not regions.is_subset(axis, data.select("pos")):
                raise DGGSFormatError("axis", declared=d["encoding"], observed="positions of the values differ")
    return data if variables is None else data.select("pos", *variables)


def read_variable(spark: SparkSession, path: str, variable: str) -> DataFrame:
    return read(spark, path, [variable])


# --- selection ----------------------------------------------------------------------------------------------------


class SelectorError(KeyError):
    """A selector found no cell, or cannot be answered."""


def at(data: DataFrame, pos: int) -> DataFrame:
    """The rows of one cell; none is an error."""
    out = data.filter(F.col("pos") == int(pos))
    if out.isEmpty():
        raise SelectorError(f"no cell at position {pos}")
    return out


def containing(data: DataFrame, sys: str, level: int, lon: float, lat: float) -> DataFrame:
    from tessellon.functions.sphere import unit_point

    return at(data, int(system(sys).cellat(unit_point(np.array([lon]), np.array([lat])), level)[0]))


def near(*_):
    raise SelectorError("curve order is no distance: there is no nearest cell along an axis")


# --- Zarr v2 ------------------------------------------------------------------------------------------------------


def snapshot(spark: SparkSession, path: str) -> C.StoreSnapshot:
    """Metadata only: the group's attributes and each array's shape, dims and attributes."""
    fs, p = _fs(spark, path)
    attrs = _text(spark, f"{path}/.zattrs")
    arrays = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        meta = _text(spark, f"{path}/{name}/.zarray") if status.isDirectory() else None
        if meta:
            z, own = json.loads(meta), json.loads(_text(spark, f"{path}/{name}/.zattrs") or "{}")
            dims = tuple(own.pop("_ARRAY_DIMENSIONS", ()))
            arrays.append(C.ArrayEntry(name, tuple(z["shape"]), dims, own, tuple(z["chunks"]), z["dtype"]))
    return C.StoreSnapshot(path, json.loads(attrs or "{}"), sorted(arrays, key=lambda a: a.name))


def _decoder(entry: C.ArrayEntry, compressor: dict | None, fill, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                key = [int(k) for k in path.rsplit("/", 1)[1].split(".")]
                raw = zlib.decompress(content) if compressor else content
                block = np.frombuffer(raw, entry.dtype).reshape(entry.chunks)
                begin = [k * c for k, c in zip(key, entry.chunks, strict=True)]
                size = [min(c, n - s) for c, n, s in zip(entry.chunks, entry.shape, begin, strict=True)]
                block = block[tuple(slice(0, n) for n in size)]
                grid = np.indices(block.shape).reshape(block.ndim, -1)
                out = {f"i{d}": grid[d] + begin[d] for d in range(block.ndim)}
                v = block.ravel()
                out[names[-1]] = v.astype(np.int64) if v.dtype.kind in "iu" else v.astype(float)
                yield pd.DataFrame(out)

    return run


def read_array(spark: SparkSession, path: str, entry: C.ArrayEntry) -> DataFrame:
    """(i0, i1..., value) of an array, 0-based indices; chunks that are not stored give no rows."""
    meta = json.loads(_text(spark, f"{path}/{entry.name}/.zarray"))
    if meta.get("filters") or (meta.get("compressor") or {}).get("id", "zlib") != "zlib" or meta.get("order", "C") != "C":
        raise DGGSFormatError("codec", declared=meta.get("compressor"), observed="raw or zlib in C order", store=path)
    kind = "long" if np.dtype(entry.dtype).kind in "iu" else "double"
    schema = ", ".join([*(f"i{d} long" for d in range(len(entry.shape))), f"value {kind}"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{path}/{entry.name}").select("path", "content")
    return files.mapInPandas(_decoder(entry, meta.get("compressor"), meta.get("fill_value"), ["value"]), schema)


def read_zarr(spark: SparkSession, path: str, variables: list[str] | None = None) -> tuple[DataFrame, C.StoreDescription]:
    """(pos, other dims..., variables...) and the description of the store's axis."""
    with store_context(path):
        snap = snapshot(spark, path)
        d = C.describe_store(snap)
        s = d.system
        if d.encoding == "implicit":
            n = next(a.shape[a.dims.index(d.spatial_dimension)] for a in snap.arrays if d.spatial_dimension in a.dims)
            axis = spark.range(n).select(F.col("id").alias("k"), (F.col("id") + 1).alias("pos"))
        elif d.encoding == "ranges":
            ids = read_array(spark, path, snap.array(d.coordinate)).groupBy("i0").pivot("i1", [0, 1]).agg(F.first("value"))
            axis = regions.ranked(encoding("ranges").decode(ids.select(F.col("0").alias("first"), F.col("1").alias("last")), s, d.level)).select((F.col("rank") - 1).alias("k"), "pos")
        else:
            ids = read_array(spark, path, snap.array(d.coordinate)).select(F.col("i0").alias("k"), F.col("value").alias("cell"))
            pos = s.pos_col(F.col("cell"), d.level) if d.scheme != "ring" else None
            if pos is None:
                ring = F.pandas_udf(lambda r: pd.Series(s.ring_to_nested(r.to_numpy(np.int64) + 1, d.level) + 1), "long")
                pos = ring("cell")
            axis = ids.select("k", pos.alias("pos"))
            if not axis.filter("pos is null").isEmpty():
                raise DGGSFormatError("axis", declared=f"cells of level {d.level}", observed="an id that is none")
        out = None
        for name in variables or d.variables:
            a = snap.array(name)
            at_dim = a.dims.index(d.spatial_dimension)
            rest = [x for k, x in enumerate(a.dims) if k != at_dim]
            v = read_array(spark, path, a).select(F.col(f"i{at_dim}").alias("k"), *(F.col(f"i{k}").alias(x) for k, x in enumerate(a.dims) if k != at_dim), F.col("value").alias(name))
            out = v if out is None else out.join(v, ["k", *[x for x in rest if x in out.columns]], "full")
        return out.join(axis, "k").drop("k"), d


def write_zarr(data: DataFrame, path: str, sys: str, level: int, variables: list[str], chunk: int = 65536, axis: str = "none") -> None:
    """A Zarr v2 group (little-endian doubles, zlib) on a path that all workers share; never over an existing one."""
    if os.path.exists(path):
        raise FileExistsError(path)
    spark, s = data.sparkSession, system(sys)
    name = {v.system: k for k, v in C.GRIDS.items()}.get(s.name)
    if name is None:
        raise DGGSFormatError("unknown_grid_name", declared=s.name)
    if not write_eligible(axis, data.select("pos"), s, level):
        raise DGGSFormatError("encoding", declared=axis, observed="cells that it cannot hold", store=path)
    placed = data.join(regions.ranked(data.select("pos")), "pos").withColumn("k", F.col("rank") - 1).withColumn("cell", s.id_col(F.col("pos"), level))
    n = placed.count()
    coordinate = "cell_ids" if axis != "implicit" else None
    arrays = [C.ArrayEntry(v, (n,), ("cells",), {}, (min(chunk, max(n, 1)),), "<f8") for v in variables]
    if axis == "none":
        arrays.append(C.ArrayEntry("cell_ids", (n,), ("cells",), {}, (min(chunk, max(n, 1)),), "<i8"))
    if axis == "ranges":
        r = np.array([tuple(x) for x in encoding("ranges").encode(data.select("pos"), s, level).toLocalIterator()], "<i8").reshape(-1, 2)
        arrays.append(C.ArrayEntry("cell_ids", r.shape, ("ranges", "bounds"), {}, (max(len(r), 1), 2), "<i8"))
    snap = C.StoreSnapshot(path, {}, arrays)
    d = C.StoreDescription(name, C.GRIDS[name].scheme, level, axis, coordinate, "cells", tuple(variables))
    C.ZarrDGGSConvention().encode(snap, d)
    if axis == "none":
        C.XdggsConvention().encode(snap, d)
    os.makedirs(path)
    for a in arrays:
        os.makedirs(f"{path}/{a.name}")
        meta = {"zarr_format": 2, "shape": a.shape, "chunks": a.chunks, "dtype": a.dtype, "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "C", "filters": None}
        for file, content in ((".zarray", meta), (".zattrs", a.attrs | {"_ARRAY_DIMENSIONS": a.dims})):
            with open(f"{path}/{a.name}/{file}", "w") as f:
                json.dump(content, f)
    for file, content in ((".zgroup", {"zarr_format": 2}), (".zattrs", snap.attrs)):
        with open(f"{path}/{file}", "w") as f:
            json.dump(content, f)
    if axis == "ranges":
        with open(f"{path}/cell_ids/0.0", "wb") as f:
            f.write(zlib.compress(r.tobytes(), 1))
    columns = [*variables, *(["cell"] if axis == "none" else [])]

    def put(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0]) // chunk
        order = np.argsort(group["k"].to_numpy())
        for c in columns:
            folder, kind = ("cell_ids", "<i8") if c == "cell" else (c, "<f8")
            block = np.zeros(min(chunk, max(n, 1)), kind)
            block[: len(group)] = group[c].to_numpy()[order].astype(kind)
            temporary = f"{path}/{folder}/.{k}.{os.getpid()}"
            with open(temporary, "wb") as f:
                f.write(zlib.compress(block.tobytes(), 1))
            os.replace(temporary, f"{path}/{folder}/{k}")
        return pd.DataFrame({"chunk": [k]})

    placed.select("k", *columns).withColumn("c", F.floor(F.col("k") / chunk)).groupBy("c").applyInPandas(put, "chunk long").count()

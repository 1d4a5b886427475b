"""Connected components by minimum labels with pointer jumping, and small fixed-size aggregates over a DataFrame."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> None:
    """Use the folder that the cluster names; set one only where none is, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder, so that nothing above is computed again; see drop()."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(df.table_path)
        target.getFileSystem(conf).delete(target, True)


def release(spark) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that are no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the smallest node that it reaches.

    A round jumps every node to the label of its label node, takes the smallest such label among its neighbours', and
    shares it with all nodes of the same label; a path of d links takes about log2(d) rounds. Rounds go on until
    nothing changes: labels only fall, so that they end. Everything stays distributed; each round is cut to storage.
    """
    last = None
    edges = cut(links.select("a", "b").filter("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        # A label is a node itself: its own label is the jump.
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        far = labels.join(root, "label").select("node", "label", "jump")
        near = edges.join(far.select(F.col("node").alias("b"), "jump"), "b").groupBy("a").agg(F.min("jump").alias("m"))
        own = far.join(near, far["node"] == near["a"]).select("node", "label", F.least("jump", "m").alias("low"))
        told = own.groupBy("label").agg(F.min("low").alias("least"))
        state = cut(own.join(told, "label").select("node", "label", F.least("low", "least").alias("next")))
        drop(last or labels)
        last = state
        labels = state.select("node", F.col("next").alias("label"))
        if state.filter(F.col("next") < F.col("label")).isEmpty():
            drop(edges)
            return labels


def combine_slices(parts: DataFrame, dtype: str, how: str) -> np.ndarray:
    """Add ("sum") or merge ("or") the arrays of a fixed size that partitions give as (slice int, data binary)."""

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in group["data"]:
            one = np.frombuffer(data, dtype)
            total = one.copy() if total is None else np.minimum(total.astype(np.uint64) + one, np.iinfo(dtype).max).astype(dtype) if how == "sum" else total | one
        return pd.DataFrame({"slice": [key[0]], "data": [total.tobytes()]})

    rows = parts.select("slice", "data").groupBy("slice").applyInPandas(fold, "slice int, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], dtype) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(0, dtype)


#: Bits of the membership filter; its size is fixed, so that it may be broadcast whatever it stands for.
FILTER_BITS = 1 << 23
_SLICES = 8


def _spots(ids: np.ndarray) -> np.ndarray:
    from tessellon.llm.textbytes import mix

    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitset with the hashed spots of all ids (one long column); others may share spots, so it only prunes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        some = False
        for b in batches:
            if b.num_rows:
                some = True
                bits[_spots(b.column(0).to_numpy(zero_copy_only=False))] = True
        if some:
            packed = np.packbits(bits).reshape(_SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["slice", "data"])

    packed = combine_slices(ids.mapInArrow(run, "slice int, data binary"), "uint8", "or")
    return packed if len(packed) else np.zeros(FILTER_BITS // 8, np.uint8)


def maybe_in(packed: np.ndarray, batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """The rows of a batch whose id, in column `at`, may be in the filter; null ids go."""
    batch = batch.filter(batch.column(at).is_valid())
    spots = _spots(batch.column(at).to_numpy(zero_copy_only=False))
    return batch.filter(pa.array((packed[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1).astype(bool)))

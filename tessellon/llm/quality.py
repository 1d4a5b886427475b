"""Quality classifier: a factorisation machine over hashed words and structure statistics; no metadata is read.

score = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], through a logistic link; the square
identity makes it linear in the features present. Words are hashed into DIMS slots with damped, normalised counts; each
structure statistic falls into one of BINS slots of its own, so that the machine also learns how they go together.

The model is fitted on a sample of at most `sample` labelled rows (a documented parameter, chosen by hash of the id);
its size is fixed by DIMS, BINS and RANK, so it may be broadcast. Scoring is one narrow pass over the whole texts.

Defined cases: a null or empty text is scored on its (empty) statistics; an id labelled twice counts by its highest
label; rows without labels are only scored; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellon.llm.textbytes import ALNUM, LINE, chunks, column_bytes, distinct, trim, words

DIMS, BINS, RANK = 1 << 14, 12, 6


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.float64)


#: Byte classes whose shares in a text are statistics.
CLASSES = np.stack(
    [
        _class(lambda b: 0x41 <= b <= 0x5A),
        _class(lambda b: 0x61 <= b <= 0x7A),
        _class(lambda b: 0x30 <= b <= 0x39),
        _class(lambda b: b in b" \t\r\n"),
        _class(lambda b: b in b"!?"),
        _class(lambda b: b in b".,;:"),
        _class(lambda b: b in b"#$%&*|<>{}[]()=+/\\^~_@"),
        _class(lambda b: b >= 0x80),
        _class(lambda b: b == 0x0A),
    ],
    1,
)
STATS = CLASSES.shape[1] + 8


def statistics(buf: np.ndarray, off: np.ndarray, row: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of STATS numbers per text."""
    n, size = len(off) - 1, np.diff(off).astype(np.float64)
    per = np.repeat(np.arange(n, dtype=np.int64), np.diff(off)) * 256
    histogram = np.bincount(per + buf, minlength=256 * n).reshape(n, 256).astype(np.float64)
    share = histogram @ CLASSES / np.maximum(size, 1)[:, None]
    count = np.bincount(row, minlength=n).astype(np.float64)
    length = np.bincount(row, end - start, n) / np.maximum(count, 1)
    drow, _ = distinct(row, value)
    kinds = np.bincount(drow, minlength=n) / np.maximum(count, 1)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], runs)
    same = np.bincount(row[1:], (row[1:] == row[:-1]) & (value[1:] == value[:-1]), n) if len(row) > 1 else np.zeros(n)
    lvalue, _, _, lrow = words(buf, off, LINE)
    lines = np.bincount(lrow, minlength=n).astype(np.float64)
    lkinds = np.bincount(distinct(lrow, lvalue)[0], minlength=n)
    p = histogram / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    return np.column_stack([share, np.log1p(size), length, kinds, top / np.maximum(count, 1), same / np.maximum(count, 1), 1 - lkinds / np.maximum(lines, 1), size / np.maximum(lines, 1), entropy])


def word_features(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, weight): log-damped counts with unit length per text."""
    key = np.sort(row.astype(np.int64) * DIMS + (value % np.uint64(DIMS)).astype(np.int64))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.append(at, len(key))))
    row, slot = key[at] // DIMS, key[at] % DIMS
    norm = np.sqrt(np.bincount(row, weight**2, n))
    return row, slot, weight / norm[row]


def featurise(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Chunks of (first row, end row, statistics, word features); every chunk's rows count from 0."""
    buf, off = column_bytes(column)
    for lo, hi, b, o in chunks(buf, off):
        value, start, end, row = words(b, o, ALNUM)
        yield lo, hi, statistics(b, o, row, value, start, end), word_features(row, value, hi - lo)


class FactorisationMachine:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = DIMS + STATS * BINS
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = rng.normal(0, 0.05, (self.size, RANK))
        self.edges = np.zeros((STATS, BINS - 1))

    def rows(self, stats: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word features and one slot per statistic, sorted by row."""
        n = len(stats)
        slot = np.stack([DIMS + j * BINS + np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(STATS)], 1)
        row = np.concatenate([found[0], np.repeat(np.arange(n), STATS)])
        order = np.argsort(row, kind="stable")
        return row[order], np.concatenate([found[1], slot.ravel()])[order], np.concatenate([found[2], np.full(n * STATS, STATS**-0.5)])[order]

    def raw(self, row: np.ndarray, slot: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score before the link, sums of v x per text); every text has features."""
        at = np.searchsorted(row, np.arange(n))
        vx = self.v[slot] * x[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        return self.w0 + np.add.reduceat(self.w[slot] * x, at) + 0.5 * (sums**2 - np.add.reduceat(vx**2, at, axis=0)).sum(1), sums

    def score(self, stats: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(stats, found), len(stats))[0], -30, 30)))

    def fit(self, stats: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, l2: float = 1e-4, seed: int = 5) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        self.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
        row, slot, x = self.rows(stats, found)
        at = np.searchsorted(row, np.arange(len(y) + 1))
        gw, gv, g0 = np.full(self.size, 1e-8), np.full(self.v.shape, 1e-8), 1e-8
        # Rarer labels weigh more, up to a factor of 4, so that few bad texts still shape the machine.
        share = np.clip(y.mean(), 0.2, 0.8)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows = order[lo : lo + batch]
                size = at[rows + 1] - at[rows]
                take = np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
                r, s, z = np.repeat(np.arange(len(rows)), size), slot[take], x[take]
                raw, sums = self.raw(r, s, z, len(rows))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * weight[rows] / len(rows) * batch
                # Gradients of the same slot are added before the step.
                used, inv = np.unique(s, return_inverse=True)
                e = err[r] * z
                dw = np.bincount(inv, e, len(used)) / batch + l2 * self.w[used]
                dv = np.stack([np.bincount(inv, e * (sums[r, f] - self.v[s, f] * z), len(used)) for f in range(RANK)], 1) / batch + l2 * self.v[used]
                d0 = err.mean()
                gw[used] += dw**2
                gv[used] += dv**2
                g0 += d0**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self


def sample_labels(labels: DataFrame, sample: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most `sample` ids with a label, whose crc32 modulo 4 is not 2, chosen by hash."""
    return (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fit on the features (not the texts) of at most `sample` labelled rows, which are all that reaches the driver."""
    chosen = sample_labels(labels, sample, id_col)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, stats, (row, slot, x) in featurise(b.column(2)):
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        b.column(1).slice(lo, hi - lo),
                        pa.array([s.tobytes() for s in stats], pa.binary()),
                        pa.array([slot[s:e].astype("<i4").tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()),
                        pa.array([x[s:e].astype("<f4").tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()),
                    ],
                    names=["id", "y", "stats", "slot", "x"],
                )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.DoubleType()), *(T.StructField(c, T.BinaryType()) for c in ("stats", "slot", "x"))])
    # A sampled id may stand in many rows of docs: its first row by content is the example.
    made = joined.mapInArrow(run, schema).groupBy("id").agg(F.min(F.struct("stats", "slot", "x", "y")).alias("r")).select("id", "r.*").toArrow()
    machine = FactorisationMachine()
    if made.num_rows == 0:
        return machine
    made = made.take(pa.array(np.argsort(np.array([hash(str(i)) % (1 << 31) if not isinstance(i, int) else i for i in made["id"].to_pylist()]), kind="stable")))
    y = made["y"].to_numpy()
    stats = np.stack([np.frombuffer(s, np.float64) for s in made["stats"].to_pylist()])
    slots = [np.frombuffer(s, "<i4") for s in made["slot"].to_pylist()]
    row = np.repeat(np.arange(len(y)), [len(s) for s in slots])
    x = np.concatenate([np.frombuffer(s, "<f4") for s in made["x"].to_pylist()]).astype(np.float64)
    return machine.fit(stats, (row, np.concatenate(slots).astype(np.int64), x), y)


def score_documents(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [shared.value.score(stats, found) for _, _, stats, found in featurise(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else [], pa.float64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, machine: FactorisationMachine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least threshold, all columns as they were; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 2000) for whole in batches for lo in range(0, whole.num_rows, 2000)):
            score = [shared.value.score(stats, found) for _, _, stats, found in featurise(b.column(at))]
            if score:
                yield b.filter(pa.array(np.concatenate(score) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return score_documents(docs, machine).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))

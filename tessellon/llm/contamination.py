"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is some MB of whole documents. Its text is a string of word symbols (the benchmark's vocabulary; every other
word is a boundary), kept only where a run of known words is long enough to hold the shortest phrase, which loses no
occurrence. Over it stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and suffix positions
sampled at every SAMPLE-th place and behind every boundary. All phrases are searched backwards together through
wavelet ranks; occurrences are located by walking to a sampled position; hit words of a document are merged to spans.

Phrases are each item's windows of `width` words, or the whole item where it has fewer. They reach the executors in
blocks of at most BLOCK_BYTES of item texts, one broadcast a block; where there are several, a task holds one at a time
and reads the others again from Spark's store for each of its batches. Word hashes propose a symbol, the words' bytes
decide it.

Defined cases: null or empty texts have no words; an item without words has no phrase; documents are judged row by
row, so repeated rows give repeated results; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellon.llm.textbytes import ALNUM, chunks, column_bytes, heads, same_stretches, trim, words

WIDTH, SAMPLE = 8, 8
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20


class Phrases:
    """A block of items: vocabulary (sorted word hashes; symbol = place + 1), phrases as symbol rows, owners."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        found: dict[bytes, set] = {}
        self.bytes = np.zeros(0, np.uint8)
        self.start = self.size = np.zeros(0, np.int64)
        self.vocabulary = self.head = np.zeros(0, np.uint64)
        if items:
            buf, off = column_bytes(pa.array([t or "" for _, t in items], pa.string()))
            value, start, end, row = words(buf, off, ALNUM)
            self.bytes = ALNUM[buf]
            self.vocabulary, first, same = np.unique(value, return_index=True, return_inverse=True)
            self.start, self.size = start[first], (end - start)[first]
            self.head = heads(self.bytes, start[first], end[first])
            if len(value) and not self._is(same, self.bytes, start, end).all():
                raise ValueError("two words of the benchmark share a 64-bit hash")
            at = np.searchsorted(row, np.arange(len(items) + 1))
            for k, (item, _) in enumerate(items):
                own = value[at[k] : at[k + 1]]
                for i in range(max(1, len(own) - width + 1) if len(own) else 0):
                    found.setdefault(own[i : i + width].tobytes(), set()).add(item)
        self.length = np.array([len(p) // 8 for p in found], np.int64)
        self.symbols = np.zeros((len(found), width), np.int64)
        for k, p in enumerate(found):
            own = np.searchsorted(self.vocabulary, np.frombuffer(p, np.uint64)) + 1
            self.symbols[k, : len(own)] = own
        self.owners = [sorted(o) for o in found.values()]
        self.shortest = int(self.length.min(initial=width))

    def _is(self, at: np.ndarray, mapped: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the words start..end of mapped bytes are the vocabulary's words at those places, byte for byte."""
        size = end - start
        out = (self.size[at] == size) & (self.head[at] == heads(mapped, start, end))
        long = np.flatnonzero(out & (size > 8))
        out[long] = same_stretches(mapped, start[long] + 8, self.bytes, self.start[at[long]] + 8, size[long] - 8)
        return out

    def symbols_of(self, value: np.ndarray, mapped: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The symbol of every word, 0 for words that are not in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(value), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
        maybe = np.flatnonzero(self.vocabulary[at] == value)
        out = np.zeros(len(value), np.int64)
        out[maybe] = (at[maybe] + 1) * self._is(at[maybe], mapped, start[maybe], end[maybe])
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of a symbol string in order, by prefix doubling over the groups still tied; boundaries (0) differ from
    one another by place, so no comparison passes a boundary."""
    n = len(s)
    zeros = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 1
    while True:
        # Rows of order whose rank is shared; a rank is the first row of its group.
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        rows = np.flatnonzero(tied)
        at = order[rows]
        second = rank[np.minimum(at + h, n - 1)]
        sub = np.lexsort((second, rank[at]))
        at, second, first = at[sub], second[sub], rank[at][sub]
        order[rows] = at
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[rows] |= fresh
        rank[at] = rows[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before place i, for arrays of both."""
        start = np.zeros(len(i), np.int64)
        for k, level in enumerate(reversed(range(self.bits))):
            one = ((symbol >> level) & 1) == 1
            a, b = self.ones[k][start], self.ones[k][i]
            start = np.where(one, self.zeros[k] + a, start - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - start


class FMIndex:
    def __init__(self, s: np.ndarray, largest: int):
        """s: symbols, ending with a boundary."""
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, largest)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=largest + 1))])
        marked = (order % SAMPLE == 0) | (self.bwt == 0)
        self.marked = marked
        self.sampled = order[marked]
        self.sample_at = np.cumsum(marked) - 1

    def count(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each phrase."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((step < length) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, length[live] - 1 - step]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        out, at, live = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(live):
            done = self.marked[at]
            out[live[done]] = self.sampled[self.sample_at[at[done]]] + steps
            live, at = live[~done], at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


def occurrences(symbol: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position, phrase) of every occurrence in a shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(symbol) or not len(phrases.owners):
        return none
    known = symbol > 0
    first, last = known.copy(), known.copy()
    first[1:] &= ~known[:-1] | (row[1:] != row[:-1])
    last[:-1] &= ~known[1:] | (row[1:] != row[:-1])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - begin >= phrases.shortest
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return none
    # The kept runs, each closed by a boundary, and the word that every symbol stands for.
    offset = np.cumsum(size + 1) - size - 1
    place = np.repeat(begin - offset, size + 1) + np.arange(int((size + 1).sum()))
    s = symbol[np.minimum(place, len(symbol) - 1)]
    s[offset + size] = 0
    index = FMIndex(s, len(phrases.vocabulary))
    lo, hi = index.count(phrases.symbols, phrases.length)
    which = np.repeat(np.arange(len(lo)), np.maximum(hi - lo, 0))
    if not len(which):
        return none
    found = np.maximum(hi - lo, 0)
    rows = np.repeat(lo - np.cumsum(found) + found, found) + np.arange(int(found.sum()))
    return place[index.locate(rows)], which


def _loaded(blocks: list) -> Iterator[Phrases]:
    """The phrases of every broadcast block, one after the other; of several only one is held."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def _shard(buf: np.ndarray, off: np.ndarray, blocks: list) -> tuple[np.ndarray, np.ndarray, list[set], np.ndarray, np.ndarray, np.ndarray]:
    n = len(off) - 1
    parts, mapped = [], []
    for lo, _, b, o in chunks(buf, off):
        value, start, end, row = words(b, o, ALNUM)
        parts.append((value, start + off[lo], end + off[lo], row + lo))
        mapped.append(ALNUM[b])
    value, start, end, row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    mapped = np.concatenate(mapped) if mapped else np.zeros(0, np.uint8)
    change = np.zeros(len(value) + 1, np.int64)
    items: list[set] = [set() for _ in range(n)]
    for phrases in _loaded(blocks):
        place, which = occurrences(phrases.symbols_of(value, mapped, start, end), row, phrases)
        np.add.at(change, place, 1)
        np.add.at(change, place + phrases.length[which], -1)
        for r, p in {(r, p) for r, p in zip(row[place].tolist(), which.tolist(), strict=True)}:
            items[r].update(phrases.owners[p])
    hit = np.cumsum(change)[:-1] > 0
    return np.bincount(row, minlength=n), np.bincount(row[hit], minlength=n), items, hit, start, end


def _blocks(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> list:
    """Broadcast phrase blocks, each of bounded size."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    part = rows if n == 1 else rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    out = []
    for k in range(n):
        own = part if n == 1 else part.filter(F.col("b") == k)
        out.append(sc.broadcast(Phrases([(r["i"], r["t"]) for r in own.toLocalIterator()], width)))
        if n > 1:
            # The driver holds one block at a time; executors read it from the file.
            out[-1].__dict__.pop("_value", None)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (sorted array) and hit byte spans (array of start, end)."""
    blocks = _blocks(benchmark, width, item_id, item_text)
    item_type = benchmark.schema[item_id].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrow_item = pa.list_(pa.int64() if item_type == T.LongType() else pa.int32() if item_type == T.IntegerType() else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, n_words, n_hit, items, spans in shards(batch.column(1), blocks):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(i) for i in items], arrow_item), pa.array(spans, arrow_span)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def shards(column: pa.Array, blocks: list) -> Iterator[tuple]:
    """(first row, end row, n_words, n_hit, item sets, span lists) for shards of a column; spans in bytes of the text."""
    buf, off = column_bytes(column)
    for lo, hi, b, o in chunks(buf, off, SHARD_BYTES):
        n_words, n_hit, items, hit, start, end = _shard(b, o, blocks)
        spans: list[list] = [[] for _ in range(hi - lo)]
        row = np.repeat(np.arange(hi - lo), n_words)
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        for s, e, r in zip(start[first].tolist(), end[last].tolist(), row[first].tolist(), strict=True):
            spans[r].append({"start": s - int(o[r]), "end": e - int(o[r])})
        yield lo, hi, n_words, n_hit, items, spans


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", chars_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with every hit span cut out of the text, and chars_col set to the new length; the columns stay as they are."""
    blocks = _blocks(benchmark, width, item_id, item_text)
    at = docs.columns.index(text_col)

    def cut(text: str, spans: list) -> str:
        raw, out, done = text.encode(), [], 0
        for s in spans:
            out.append(raw[done : s["start"]])
            done = s["end"]
        return b"".join([*out, raw[done:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _, _, spans in shards(batch.column(at), blocks):
                # A shard leaves as soon as it is done; one without hits as it came.
                part = batch.slice(lo, hi - lo)
                if any(spans):
                    columns = list(part.columns)
                    columns[at] = pa.array([cut(t.as_py(), s) if s else t.as_py() for t, s in zip(columns[at], spans, strict=True)], columns[at].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part
        trim()

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.char_length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))

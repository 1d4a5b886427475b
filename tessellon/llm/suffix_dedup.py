"""Suffix-array dedup: hash-compared suffix sort over shards of suffixes.

A byte goes when a string of `length` bytes covers it that also starts in a document with a smaller id. Every string of
that length is dealt to a bucket by the least hash among its K-byte windows, so equal strings meet. Neighbouring
strings mostly share that least hash and travel together as one fragment of text. In a batch of documents equal
fragments are sent once, for the smallest id; the other ids' strings are known to go at once, so that a passage in a
third of all documents is one fragment a batch.

In a bucket, fragments that only one document has are set aside, equal ones are merged, and the suffixes of the rest
are sorted: grouped by the hash of their first bytes (two thirds of the length), then merge sorted in lock step over all groups. Two suffixes are
compared by their longest common extension, found by binary search on prefix polynomial hashes, and by the byte
behind it. Neighbours that agree in `length` bytes are one string, which is verified byte by byte; its smallest id
decides for every fragment that holds it.

Defined cases: a null or empty text has no bytes; a text shorter than `length` loses none; a null id neither removes
nor loses; repeated ids are one document for the comparison of ids, each row judged by its own text; ties (equal ids)
remove nothing; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellon.llm.textbytes import BASE_INVERSE, chunks, column_bytes, merge_intervals, mix, powers, prefix_hash, stretch_hash, trim

LENGTH, K = 50, 12
#: Bytes of text whose fragments one bucket should hold, and bytes of text that one batch gathers before it sends.
BUCKET_BYTES, BATCH_BYTES = 4 << 20, 16 << 20
#: Bytes of fragments whose suffixes are hashed and sorted at a time; one least hash with more is handled alone.
SLICE_BYTES = 1 << 18
#: Bytes of packed fragments that a task hands to Spark at a time.
HANDED_BYTES = 1 << 20


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The mixed hash of every k bytes, from prefix hashes."""
    n = len(h) - k
    with np.errstate(over="ignore"):
        return mix((h[k:] - h[:n]) * powers(BASE_INVERSE, max(1, n))[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


def fragments(prefix: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, least hash, row) of the runs of up to length - k + 1 strings that share their least hash."""
    none = np.zeros(0, np.int64)
    if len(prefix) <= length:
        return none, none, none.astype(np.uint64), none
    least = sliding_min(window_hashes(prefix, k), length - k + 1)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)[: len(least)]
    valid = np.arange(len(least)) + length <= off[1:][row]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    count = np.bincount(run[valid], minlength=len(begin)) if len(begin) else none
    # A run longer than a fragment may be is dealt out in pieces.
    most = length - k + 1
    pieces = -(-count // most)
    at = np.repeat(np.cumsum(pieces) - pieces, pieces)
    inner = np.arange(int(pieces.sum())) - at
    begin, count = np.repeat(begin, pieces) + inner * most, np.minimum(most, np.repeat(count, pieces) - inner * most)
    return begin, count, least[begin], row[begin]


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.cumsum(size) - size
    return buf[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a : a + size] == buf[b : b + size], for arrays of places."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 16384):
        s = size[lo : lo + 16384]
        differ = gather(buf, a[lo : lo + 16384], s) != gather(buf, b[lo : lo + 16384], s)
        out[lo : lo + 16384] = np.add.reduceat(differ, np.cumsum(s) - s) == 0 if len(s) else True
    return out


def leaders(value: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every stretch the first one that equals it; hashes propose, bytes decide."""
    with np.errstate(over="ignore"):
        value = value ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value, kind="stable")
    new = np.append(True, value[order][1:] != value[order][:-1]) if len(order) else np.zeros(0, bool)
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(lead != np.arange(len(lead)))
    even = size[other] == size[lead[other]]
    wrong = np.concatenate([other[~even], other[even][~same_bytes(buf, start[other[even]], start[lead[other[even]]], size[other[even]])]])
    lead[wrong] = wrong
    return lead


class _Suffixes:
    """Suffixes as places in buf, compared on their first `length` bytes (all there)."""

    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = buf, length
        self.prefix = prefix_hash(buf)
        self.inverse = powers(BASE_INVERSE, len(self.prefix))
        self.whole = window_hashes(self.prefix, length)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extension up to length, by binary search on prefix hashes; most pairs share it all."""
        out = np.full(len(a), self.length)
        apart = np.flatnonzero(self.whole[a] != self.whole[b])
        if not len(apart):
            return out
        a, b = a[apart], b[apart]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        with np.errstate(over="ignore"):
            ha, ia, hb, ib = self.prefix[a], self.inverse[a], self.prefix[b], self.inverse[b]
            for _ in range(int(self.length - 1).bit_length()):
                mid = (lo + hi + 1) >> 1
                same = (self.prefix[a + mid] - ha) * ia == (self.prefix[b + mid] - hb) * ib
                lo = np.where(same, mid, lo)
                hi = np.where(same, hi, mid - 1)
        out[apart] = lo
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix a sorts before b; equal ones do if ties."""
        e = self.extension(a, b)
        full = e >= self.length
        e = np.where(full, 0, e)
        return np.where(full, ties, self.buf[a + e] < self.buf[b + e])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """at sorted within each group (groups contiguous): bottom-up mergesort of all groups in lock step."""
        n = len(at)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, n))
        base, total = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(n) - base
        width = 1
        while width < size.max(initial=0):
            pair = place // (2 * width) * (2 * width)
            split = np.minimum(pair + width, total)
            live = np.flatnonzero(split < total)
            left = place[live] < split[live]
            # Each element's rank in the run that it merges with: left elements come before equal right ones.
            lo = np.where(left, split[live], pair[live])
            hi = np.where(left, np.minimum(split[live] + width, total[live]), split[live])
            start = lo.copy()
            own = at[live]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                other, mine, is_left = at[base[live[open_]] + mid], own[open_], left[open_]
                # The other run's element counts if it stands before mine; on ties only for a right element.
                counts = np.where(is_left, ~self.before(mine, other, True), self.before(other, mine, True))
                lo[open_] = np.where(counts, mid + 1, lo[open_])
                hi[open_] = np.where(counts, hi[open_], mid)
            rank = lo - start
            home = np.where(left, place[live], place[live] - width)
            at = at.copy()
            at[base[live] + home + rank] = own
            width *= 2
        return at


def removed_in_bucket(lens: np.ndarray, data: np.ndarray, frag: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the stretches that go, from fragments (lens, data) and their occurrences (frag, doc, start)."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(frag):
        return none
    begin = np.cumsum(lens) - lens
    value, anchor = np.empty(len(lens), np.uint64), np.empty(len(lens), np.uint64)
    for lo, hi in _slices(lens):
        # The least hash of a fragment's first string names the group that its strings can meet.
        piece, at = data[begin[lo] : begin[hi - 1] + lens[hi - 1]], begin[lo:hi] - begin[lo]
        prefix = prefix_hash(piece)
        value[lo:hi] = stretch_hash(prefix, at, at + lens[lo:hi])
        anchor[lo:hi] = sliding_min(window_hashes(prefix, k), length - k + 1)[at]
    frag = leaders(value, data, begin, lens)[frag]
    order = np.argsort(anchor[frag], kind="stable")
    key = anchor[frag[order]]
    new = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(new)
    several = np.minimum.reduceat(doc[order], at) != np.maximum.reduceat(doc[order], at)
    order = order[several[np.cumsum(new) - 1]]
    if not len(order):
        return none
    frag, doc, start = frag[order], doc[order], start[order]
    # Distinct fragments in the order of their groups, and slices of whole groups.
    used, frag = np.unique(frag, return_inverse=True)
    by_anchor = np.argsort(anchor[used], kind="stable")
    back = np.empty(len(used), np.int64)
    back[by_anchor] = np.arange(len(used))
    used, frag = used[by_anchor], back[frag]
    smallest = np.full(len(used), np.iinfo(np.int64).max)
    np.minimum.at(smallest, frag, doc)
    order = np.argsort(frag, kind="stable")
    frag, doc, start = frag[order], doc[order], start[order]
    out = []
    for lo, hi in _slices(lens[used], anchor[used]):
        size = lens[used[lo:hi]]
        first, decides = _decide(gather(data, begin[used[lo:hi]], size), size, anchor[used[lo:hi]], smallest[lo:hi], length, k)
        a, b = np.searchsorted(frag, [lo, hi])
        for c in range(a, b, 16384):
            f, d = frag[c : min(b, c + 16384)] - lo, doc[c : min(b, c + 16384)]
            count = size[f] - length + 1
            occ = np.repeat(np.arange(len(f)), count)
            inner = np.arange(len(occ)) - np.repeat(np.cumsum(count) - count, count)
            gone = np.flatnonzero(decides[first[f[occ]] + inner] < d[occ])
            if len(gone):
                s, e = start[c:b][occ[gone]] + inner[gone], d[occ[gone]]
                at = np.flatnonzero(np.append(True, (s[1:] != s[:-1] + 1) | (e[1:] != e[:-1])))
                out.append((e[at], s[at], s[np.append(at[1:] - 1, len(s) - 1)] + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def _slices(size: np.ndarray, key: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with up to SLICE_BYTES in all, or one longer (or one key's run)."""
    end, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        if key is not None and hi < len(size) and key[hi] == key[hi - 1]:
            run = int(np.searchsorted(key, key[hi], "left"))
            hi = run if run > lo else int(np.searchsorted(key, key[hi], "right"))
        yield lo, hi
        lo = hi


def _decide(data: np.ndarray, lens: np.ndarray, anchor: np.ndarray, smallest: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first string of each fragment, smallest document that has each string), from sorting all strings as suffixes."""
    begin, strings = np.cumsum(lens) - lens, lens - length + 1
    first = np.cumsum(strings) - strings
    owner = np.repeat(np.arange(len(lens)), strings)
    place = begin[owner] + np.arange(len(owner)) - first[owner]
    suffixes = _Suffixes(data, length)
    with np.errstate(over="ignore"):
        # Strings that are equal begin alike; the longer the beginning, the smaller the groups to be sorted.
        group = mix(window_hashes(suffixes.prefix, max(k, 2 * length // 3))[place] ^ (anchor[owner] * np.uint64(3)))
    order = np.argsort(group, kind="stable")
    group = group[order]
    sa = suffixes.sort(place[order], group)
    equal = np.zeros(len(sa), bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    near = near[suffixes.extension(sa[near - 1], sa[near]) >= length]
    equal[near[same_bytes(data, sa[near - 1], sa[near], np.full(len(near), length))]] = True
    # Places are unique, so the string is found again from its place.
    slot = np.empty(len(data), np.int64)
    slot[place] = np.arange(len(place))
    index = slot[sa]
    decides = np.empty(len(place), np.int64)
    decides[index] = np.minimum.reduceat(smallest[owner[index]], np.flatnonzero(~equal))[np.cumsum(~equal) - 1]
    return first, decides


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 3)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of each document's [start, end) as maximal spans, by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.append(True, doc[1:] != doc[:-1])
    own = doc[new]
    # Every document on its own stretch of one line, so that all are merged at once; as many at a time as the line holds.
    low, width = int(start.min()), int(end.max()) - int(start.min()) + 2
    step = max(1, (1 << 62) // width)
    which, out = np.cumsum(new) - 1, []
    for lo in range(0, len(own), step):
        a, b = np.searchsorted(which, [lo, lo + step])
        shift = (which[a:b] - lo) * width - low
        first, last = merge_intervals(start[a:b] + shift, end[a:b] + shift)
        at = first // width
        out.append((own[lo + at], first - at * width + low, last - at * width + low))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pack_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return _pack(np.diff(doc, prepend=0), np.diff(start, prepend=0), end - start)


def _unpack_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, start, size = pickle.loads(zstandard.decompress(data))
    start = np.cumsum(start)
    return np.cumsum(doc), start, start + size


def _send(docs: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    """docs (id, base, text) as rows (bucket, batch, known, data): packed fragments for a bucket, or spans that are known
    already to go (they travel by any bucket). A batch is some MB of documents, named by a hash of its ids."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, bases = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[3]) for h in held]))])
        buf = np.concatenate([h[2] for h in held])
        held.clear()
        parts = []
        for lo, _, b, o in chunks(buf, off):
            prefix = prefix_hash(b)
            begin, count, least, row = fragments(prefix, o, length, k)
            if len(begin):
                parts.append((begin + off[lo], count + length - 1, least, row + lo, stretch_hash(prefix, begin, begin + count + length - 1)))
        if not parts:
            return
        begin, size, least, row, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        lead = leaders(value, buf, begin, size)
        del value
        smallest = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(smallest, lead, ids[row])
        local = ids[row] == smallest[lead]
        start = begin - off[row] + bases[row]
        with np.errstate(over="ignore"):
            batch = int(mix(np.add.reduce(mix(ids.view(np.uint64)), keepdims=True)).view(np.int64)[0])
        out = []
        if not local.all():
            out.append((batch % buckets, batch, True, _pack_spans(*_merged(ids[row][~local], start[~local], (start + size)[~local]))))
        bucket = (least % np.uint64(buckets)).astype(np.int64)
        order = np.flatnonzero(local)
        order = order[np.lexsort((start[order], ids[row[order]], bucket[order]))]
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for q in range(buckets):
            own = order[at[q] : at[q + 1]]
            if not len(own):
                continue
            # The leader of equal fragments may belong to another id; the first of ours stands for it here.
            _, which, frag = np.unique(lead[own], return_index=True, return_inverse=True)
            kept = own[which]
            # A fragment has less than twice the length.
            blob = _pack(size[kept].astype(np.min_scalar_type(2 * length)), gather(buf, begin[kept], size[kept]), np.diff(frag, prepend=0).astype(np.int32), np.diff(ids[row[own]], prepend=0), np.diff(start[own], prepend=0))
            out.append((q, batch, False, blob))
        lo, end = 0, np.cumsum([len(x[3]) for x in out])
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + HANDED_BYTES, "right")))
            c = list(zip(*out[lo:hi], strict=True))
            lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.binary())], names=["bucket", "batch", "known", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            buf, off = column_bytes(whole.column(2))
            ids, bases = whole.column(0).to_numpy(zero_copy_only=False), whole.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, b, o in chunks(buf, off, BATCH_BYTES // 4):
                if size and size + len(b) > BATCH_BYTES:
                    yield from flush(held)
                    held, size = [], 0
                    trim()
                held.append((ids[lo:hi], bases[lo:hi], b.copy(), o))
                size += len(b)
        if held:
            yield from flush(held)
        trim()

    return docs.mapInArrow(run, "bucket int, batch long, known boolean, data binary")


def _bucket(length: int, k: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """(batch, data): the spans that go, packed for each batch."""
        parts, of, have = [], [], 0
        known = group["known"]
        for batch, blob in zip(group["batch"][~known], group["data"][~known], strict=True):
            lens, data, frag, doc, start = pickle.loads(zstandard.decompress(blob))
            doc = np.cumsum(doc)
            parts.append((lens.astype(np.int64), data, np.cumsum(frag, dtype=np.int64) + have, doc, np.cumsum(start)))
            of.append(np.full(len(doc), batch))
            have += len(lens)
        out = list(zip(group["batch"][known], group["data"][known], strict=True))
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            ids, first = np.unique(columns[3], return_index=True)
            home = np.concatenate(of)[first]
            doc, start, end = _merged(*removed_in_bucket(*columns, length, k))
            # An id that stands in several batches goes by the first of them.
            batch = home[np.searchsorted(ids, doc)]
            order = np.argsort(batch, kind="stable")
            at = np.flatnonzero(np.append(True, batch[order][1:] != batch[order][:-1])) if len(order) else order
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=False):
                some = order[s:e]
                out.append((int(batch[some[0]]), _pack_spans(doc[some], start[some], end[some])))
            del parts, of, columns
            trim()
        return pd.DataFrame({"batch": np.array([x for x, _ in out], np.int64), "data": pd.Series([x for _, x in out], dtype=object)})

    return run


def _by_document(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """(id, data): a batch's spans, merged over all buckets, as packed (start, end) of each document."""
    doc, start, end = _merged(*(np.concatenate(x) for x in zip(*map(_unpack_spans, group["data"]), strict=True)))
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    whole = np.stack([start, end], 1).astype("<i8").tobytes()
    blobs = [whole[16 * s : 16 * e] for s, e in zip(at.tolist(), [*at[1:].tolist(), len(doc)], strict=False)]
    return pd.DataFrame({"id": doc[at], "data": pd.Series(blobs, dtype=object)})


def removed_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(id, blobs) for docs (id, base, text): arrays of packed (start, end) in bytes, counted from base."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(total) // BUCKET_BYTES))
    sent = _send(docs.filter("id is not null"), buckets, length, k)
    found = sent.groupBy("bucket").applyInPandas(_bucket(length, k), "batch long, data binary")
    found = found.groupBy("batch").applyInPandas(_by_document, "id long, data binary")
    return found.groupBy("id").agg(F.collect_list("data").alias("blobs"))


def _packed_texts(rows: DataFrame) -> DataFrame:
    """(id, base, packed) with the texts compressed, as they are to be shuffled whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for b in batches:
            packed = [pack(t.as_buffer()) if t.is_valid else None for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["id"], b["base"], pa.array(packed, pa.binary())], names=["id", "base", "packed"])

    return rows.select("id", "base", "text").mapInArrow(run, "id long, base long, packed binary")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, text): rows that share an id but not their text get bases apart, so that their spans don't mix."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.select("id", F.xxhash64("text").alias("name"))
    twice = named.filter("id is not null").groupBy("id").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b").select("id")
    if twice.isEmpty():
        return rows.withColumn("base", F.lit(0).cast("long")).select("id", "base", "text")
    order = Window.partitionBy("id").orderBy("name")
    rank = named.join(twice, "id", "left_semi").distinct().select("id", "name", (F.row_number().over(order) - 1).alias("rank"))
    joined = rows.withColumn("name", F.xxhash64("text")).join(rank, ["id", "name"], "left")
    return joined.select("id", F.shiftleft(F.coalesce("rank", F.lit(0)).cast("long"), 32).alias("base"), "text")


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    rows = _identified(docs, id_col, text_col)
    spans = removed_spans(rows, length)
    joined = _packed_texts(rows).join(spans, "id", "left").select("id", "base", "packed", "blobs")
    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5 if kept_text else 4)]
            for base, text, blobs in zip(b["base"].to_pylist(), b["packed"], b["blobs"], strict=True):
                raw = zstandard.decompress(text.as_buffer()) if text.is_valid else b""
                n, removed, count = len(raw), 0, 0
                if blobs.is_valid:
                    all_ = np.frombuffer(b"".join(blobs.as_py()), "<i8").reshape(-1, 2)
                    all_ = all_[(all_[:, 0] >= base) & (all_[:, 0] < base + (1 << 32))] - base
                    start, end = merge_intervals(all_[:, 0], all_[:, 1])
                    removed, count = int((end - start).sum()), len(start)
                    ends = [0, *end.tolist()]
                    raw = b"".join(raw[e:s] for e, s in zip(ends, [*start.tolist(), n], strict=True))
                for column, v in zip(out, (n, removed, count, hashlib.sha256(raw).hexdigest(), raw), strict=False):
                    column.append(v)
            arrays = [b["id"], *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())] + ([pa.array(out[4], pa.binary())] if kept_text else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    return joined.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Documents whose shingle sets are equal form a class; only classes are joined. A class is named by a 64-bit sum of its
hashes; a second sum shows when two sets share a name, and all is then named anew with another seed.

* Every set is put in one global order of shingles, frequent ones last (by name: shingles that repeat among neighbouring
  documents are counted and the counts added up; the order costs time, never a link). Two sets that reach the threshold
  share a shingle among the first n - ceil(t n) + 1 of each, and their sizes lie in the same or in neighbouring bands
  of ratio t. A tile is a shingle and a band: the classes with that shingle up front whose size lies in the band, and as
  visitors those of the next.
* A tile gives its pairs, as far as sizes and places in the order leave room, when they are few for every member. Larger
  tiles that share members are laid together and cut into blocks of bounded size, within which all is settled; then,
  only where there are several blocks, members outside the main component meet the other blocks: first by bitmaps
  alone, then with their arrays those that may have a partner there. A shingle so frequent that its tile would not fit
  a task (hashed counters of fixed size tell) skips the tiles' task and goes to the blocks directly.
* Bitmaps bound the overlap of a pair from above (bits of one signature that the other lacks); what they let pass is
  decided by intersecting the sorted hash arrays, which are computed once for the classes that need them. A block gives
  at most one link for each component that it joins, not its pairs.

Defined cases: null or empty texts, or texts without words, have the empty set and link with nothing; a text of fewer
words than a shingle is one shingle; repeated rows share a class, and rows of one id count as linked; rows
with a null id take no part in links and their component is null; an empty table gives none; other columns of any name
are left alone. Words are told apart by 64-bit hashes (textbytes.block_hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm.components import combine_slices, components, cut, drop, id_filter, maybe_in, release
from tessellon.llm.textbytes import NONSPACE, chunks, column_bytes, distinct, mix, shingles, trim, words

#: Counters of the frequency table, least and most bits of a signature, members of a tile that gives its pairs itself.
COUNTERS, LEAST_BITS, MOST_BITS, SMALL_TILE = 1 << 18, 2048, 1 << 16, 12
#: Shingles that a task counts at a time, counts of repeated ones sent of them, and entries of the table of frequent ones.
COUNTED, COUNTS_SENT, FREQUENT = 2 << 20, 1 << 15, 1 << 20
#: Members of a block, and hashes of a block; blocks without arrays hold so many times as much.
BLOCK, BLOCK_HASHES, LIGHT = 2048, 2 << 20, 4
#: Bytes of text whose prefixes one bucket of postings should hold, and postings that a task gathers before it sends.
BUCKET_BYTES, HELD = 48 << 20, 3 << 20
#: A shingle whose counter is above both this and 8 times the mean skips the tiles' task.
HOT = 1 << 16
_SLICES = 4
_SEEDS = (0xA5A5A5A5A5A5A5A5, 0xC3A5C85C97CB3127)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles sorted by row and hash, and the set size of every row."""
    value, _, _, row = words(buf, off, NONSPACE)
    value, row = shingles(value, row, len(off) - 1, width)
    row, value = distinct(row, value)
    return row, value, np.bincount(row, minlength=len(off) - 1)


def class_ids(value: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name of every row's set."""
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size > 0)
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(value ^ np.uint64(seed)), np.cumsum(size)[some] - size[some]) + size[some].astype(np.uint64))
    return out.view(np.int64)


def signatures(value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Bitmaps of as many bits as the set has shingles, rounded up to a power of two."""
    bits = np.minimum(np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)), MOST_BITS)
    end = np.cumsum(bits)
    flags = np.zeros(int(bits.sum()), bool)
    flags[np.repeat(end - bits, size) + ((value >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, size))] = True
    whole = np.packbits(flags).tobytes()
    return [whole[(e - n) // 8 : e // 8] for e, n in zip(end.tolist(), bits.tolist(), strict=True)]


def folded(data: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, all brought to the given number of bytes by laying parts upon another."""
    out = np.empty((len(data), size), np.uint8)
    wide = np.array([len(d) for d in data])
    for w in np.unique(wide):
        at = np.flatnonzero(wide == w)
        out[at] = np.bitwise_or.reduce(np.frombuffer(b"".join(data[k] for k in at), np.uint8).reshape(len(at), -1, size), axis=1)
    return out.view(np.uint64)


def required(a, b, percent: int):
    """The least overlap with which sets of sizes a and b link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -((-percent * n) // 100) + 1


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that can link are at most one band apart: the bands' edges are e, floor(100 e / percent) + 1, ..."""
    edges = [1]
    while edges[-1] <= n.max(initial=0):
        edges.append(edges[-1] * 100 // percent + 1)
    return np.searchsorted(edges, n, "right") - 1


def repeated(values: list[np.ndarray]) -> bytes:
    """The shingles that occur several times, the most frequent ones if they are many, and behind them their counts."""
    value = np.concatenate(values)
    values.clear()
    value.sort()
    same = np.concatenate([[False], value[1:] == value[:-1], [False]])
    first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    count = last - first + 1
    if len(first) > COUNTS_SENT:
        at = np.argpartition(count, -COUNTS_SENT)[-COUNTS_SENT:]
        first, count = first[at], count[at]
    return value[first].tobytes() + count.astype("<u4").tobytes()


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, level) of the most frequent shingles, sorted; a level is half a power of two."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["data"]:
                raw = data.as_buffer()
                k = len(raw) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64, k)), pa.array(np.frombuffer(raw, "<u4", k, 8 * k).astype(np.int64))], names=["key", "k"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], names=["keys", "levels"])

    counts = described.filter("kind = 2").select("data").mapInArrow(unpack, "key long, k long").groupBy("key").agg(F.sum("k").alias("k"))
    counts = cut(counts.filter("k > 3").select("key", F.floor(2 * F.log2("k")).cast("byte").alias("level")))
    least, room = 127, FREQUENT
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    rows = counts.filter(F.col("level") >= least).mapInArrow(pack, "keys binary, levels binary").collect()
    drop(counts)
    key, level = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("keys", np.uint64), ("levels", np.int8)))
    order = np.argsort(key)
    return key[order], level[order]


def levels_of(value: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles' levels, 0 for those that are not in the table."""
    key, level = frequent
    if not len(key):
        return np.zeros(len(value), np.int8)
    at = np.minimum(np.searchsorted(key, value), len(key) - 1)
    return np.where(key[at] == value, level[at], 0)


def _describe(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """kind 0: a row (id, class, second name, n, bytes, signature) for every row; kind 1: shingle counters by slice;
    kind 2: counts of shingles that repeat among some MB of documents, copies of a set left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint32)
        names = ["kind", "id", "cls", "other", "n", "bytes", "data"]
        held, have, seen = [], 0, np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            zero = pa.array([0], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([None], pa.int64()), zero, zero, zero, zero, pa.array([repeated(held)], pa.binary())], names=names)

        for b in batches:
            buf, off = column_bytes(b.column(1))
            for lo, hi, cb, co in chunks(buf, off):
                row, value, size = shingle_sets(cb, co, width)
                counters += np.bincount((value >> np.uint64(40)).astype(np.int64) % COUNTERS, minlength=COUNTERS).astype(np.uint32)
                k = hi - lo
                one, two = (class_ids(value, size, s ^ seed) for s in _SEEDS)
                data = pa.array(signatures(value, size), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), b.column(0).slice(lo, k), pa.array(one), pa.array(two), pa.array(size, pa.int64()), pa.array(np.diff(co), pa.int64()), data], names=names)
                _, first = np.unique(one, return_index=True)
                first = first[~np.isin(one[first], seen)]
                fresh = np.zeros(k, bool)
                fresh[first] = True
                held.append(value[fresh[row]])
                have, seen = have + len(held[-1]), np.concatenate([seen, one[first]])
                if have > COUNTED:
                    yield counted()
                    held, have, seen = [], 0, np.zeros(0, np.int64)
                    trim()
        if have:
            yield counted()
        held.clear()
        trim()
        if counters.any():
            parts = counters.reshape(_SLICES, -1)
            zero = pa.array([0] * _SLICES, pa.int64())
            data = pa.array([p.tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(_SLICES, np.int32)), pa.array([None] * _SLICES, pa.int64()), pa.array(range(_SLICES), pa.int64()), zero, zero, zero, data], names=names)

    return docs.mapInArrow(run, "kind int, id long, cls long, other long, n long, bytes long, data binary")


def _postings(docs: DataFrame, width: int, percent: int, seed: int, shared, buckets: int) -> DataFrame:
    """(bucket, keys, members, classes, sizes): prefix shingles with their places, packed by bucket of the shingle's hash.

    Hot shingles go to buckets from `buckets` on, dealt by class.
    """

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        begun = np.cumsum([0] + [len(h[3]) for h in held])
        key, place, hot = (np.concatenate([h[k] for h in held]) for k in (0, 2, 5))
        member = np.concatenate([h[1] + b for h, b in zip(held, begun, strict=False)])
        cls, n = (np.concatenate([h[k] for h in held]) for k in (3, 4))
        pack_ = zstandard.ZstdCompressor(1).compress
        # Copies of a set are told apart by nothing that matters here: the first of them stands for all.
        _, first, same = np.unique(cls, return_index=True, return_inverse=True)
        keep = first[same][member] == member
        key, member, place, hot = key[keep], member[keep], place[keep], hot[keep]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        bucket[hot] = buckets + (cls[member[hot]].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        # Members keep their order in a bucket, and their shingles the order of places: small differences pack well.
        order = np.argsort(bucket, kind="stable")
        key, member, place, bucket = key[order], member[order], np.minimum(place[order], 65535), bucket[order]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        for lo in range(0, len(at), 512):
            out = []
            for s, e in zip(at[lo : lo + 512].tolist(), [*at[lo + 1 : lo + 513].tolist(), len(key)], strict=False):
                used, count = np.unique(member[s:e], return_counts=True)
                low = (key[s:e] >> np.uint64(24)).astype("<u4").tobytes() + (key[s:e] >> np.uint64(56)).astype("u1").tobytes()
                places = pack_(count.astype("<u4").tobytes() + np.diff(place[s:e], prepend=0).astype("<i4").tobytes())
                out.append((int(bucket[s]), low, places, cls[used].tobytes(), pack_(n[used].astype("<u4").tobytes())))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "keys", "members", "classes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = shared.value
        held, count = [], 0
        for b in batches:
            buf, off = column_bytes(b.column(0))
            for _, _, cb, co in chunks(buf, off):
                row, value, size = shingle_sets(cb, co, width)
                slot = (value >> np.uint64(40)).astype(np.int64) % COUNTERS
                order = np.lexsort((value, levels_of(value, frequent), row))
                value, row, slot = value[order], row[order], slot[order]
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                keep = place < prefix_length(size, percent)[row]
                held.append((value[keep], row[keep], place[keep], class_ids(value, size, _SEEDS[0] ^ seed), size, often[slot[keep]]))
                count += int(keep.sum())
                if count > HELD:
                    yield from pack(held)
                    held, count = [], 0
        if count:
            yield from pack(held)
        held.clear()
        trim()

    return docs.mapInArrow(run, "bucket int, keys binary, members binary, classes binary, sizes binary")


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, n, place) of every posting of a bucket."""
    out = []
    unpack = zstandard.ZstdDecompressor().decompress
    for k, m, c, z in zip(group["keys"], group["members"], group["classes"], group["sizes"], strict=True):
        size, own = len(k) // 5, np.frombuffer(c, np.int64)
        key = np.frombuffer(k, "<u4", size).astype(np.uint64) | np.frombuffer(k, "u1", size, 4 * size).astype(np.uint64) << np.uint64(32)
        m = unpack(m)
        at = np.repeat(np.arange(len(own)), np.frombuffer(m, "<u4", len(own)))
        place = np.cumsum(np.frombuffer(m, "<i4", size, 4 * len(own)))
        out.append((key, own[at], np.frombuffer(unpack(z), "<u4").astype(np.int32)[at], place.astype(np.int32)))
    key, cls, n, place = (np.concatenate(x) for x in zip(*out, strict=True))
    return key, cls, n.astype(np.int64), place.astype(np.int64)


def _tile_bucket(percent: int, buckets: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """kind 0: candidate pairs a < b; kind 1: (tile, class) of large tiles."""
        keys, cls, n, place = _unpacked(group)
        order = np.lexsort((cls, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (cls[order][1:] != cls[order][:-1])
        order = order[new]
        keys, cls, n, place = keys[order], cls[order], n[order], place[order]
        if key[0] >= buckets:
            return pd.DataFrame({"kind": np.ones(len(keys), np.int32), "a": mix(keys).view(np.int64), "b": cls})
        # Keys of a single class need no tile.
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        several = np.repeat(np.diff(np.append(at, len(keys))) > 1, np.diff(np.append(at, len(keys))))
        keys, cls, n, place = keys[several], cls[several], n[several], place[several]
        empty = np.zeros(0, np.int64)
        if not len(keys):
            return pd.DataFrame({"kind": empty.astype(np.int32), "a": empty, "b": empty})
        # Tiles: a class is at home in its own band's and a visitor (listed behind) in that of the band below.
        own = band(n, percent)
        tile, home = np.concatenate([own, own - 1]), np.repeat([True, False], len(own))
        keys, cls, n, place = (np.tile(x, 2) for x in (keys, cls, n, place))
        order = np.lexsort((cls, ~home, tile, keys))
        keys, cls, n, place, tile, home = (x[order] for x in (keys, cls, n, place, tile, home))
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (tile[1:] != tile[:-1])))
        size = np.diff(np.append(at, len(keys)))
        at, size = at[home[at] & (size > 1)], size[home[at] & (size > 1)]
        a, b, tiles, members = [], [], [], []
        for g in np.unique(size[size <= SMALL_TILE]):
            x = at[size == g][:, None] + np.arange(g)
            i, j = np.triu_indices(g, 1)
            x, y = x[:, i].ravel(), x[:, j].ravel()
            # In the tile of the first shingle that both share, the rest of the shorter remainder bounds the overlap.
            ok = home[x] & (np.minimum(n[x] - place[x], n[y] - place[y]) >= required(n[x], n[y], percent))
            a.append(np.minimum(cls[x], cls[y])[ok])
            b.append(np.maximum(cls[x], cls[y])[ok])
        large = size > SMALL_TILE
        if large.any():
            which = np.repeat(np.arange(int(large.sum())), size[large])
            spot = np.arange(len(which)) - np.repeat(np.cumsum(size[large]) - size[large], size[large]) + np.repeat(at[large], size[large])
            # Tiles of equal members count once.
            named = np.add.reduceat(mix(cls[spot].view(np.uint64)), np.flatnonzero(np.append(True, which[1:] != which[:-1])))
            tiles.append(mix(named)[which].view(np.int64))
            members.append(cls[spot])
        a, b = distinct(*(np.concatenate(x) if x else empty for x in (a, b)))
        tiles, members = distinct(*(np.concatenate(x) if x else empty for x in (tiles, members)))
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), [len(a), len(tiles)]), "a": np.concatenate([a, tiles]), "b": np.concatenate([b, members])})

    return run


def bitmap_room(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, percent: int) -> np.ndarray:
    """By how much the overlap that sizes and signatures (rows of 64-bit words) leave room for exceeds what is required."""
    need = required(na, nb, percent)
    room = np.minimum(na, nb) - need
    at = np.flatnonzero(room >= 0)
    for lo in range(0, len(at), 4096):
        i = at[lo : lo + 4096]
        most = np.minimum(na[i] - np.bitwise_count(sa[i] & ~sb[i]).sum(1, dtype=np.int64), nb[i] - np.bitwise_count(sb[i] & ~sa[i]).sum(1, dtype=np.int64))
        room[i] = most - need[i]
    return room


def _by_signature(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that band and bitmaps allow, with the ids that stand for their classes."""
    one = classes.select(F.col("cls").alias("a"), F.col("id").alias("ia"), F.col("n").alias("na"), F.col("data").alias("sa"))
    two = classes.select(F.col("cls").alias("b"), F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("data").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ia", "ib", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                x = whole.slice(lo, 2048)
                na, nb, sa, sb = x["na"].to_numpy(), x["nb"].to_numpy(), x["sa"].to_pylist(), x["sb"].to_pylist()
                least = np.array([min(len(p), len(q)) for p, q in zip(sa, sb, strict=True)])
                ok = np.zeros(len(na), bool)
                for w in np.unique(least):
                    at = np.flatnonzero(least == w)
                    ok[at] = bitmap_room(na[at], nb[at], *(folded([d[k] for k in at], w) for d in (sa, sb)), percent) >= 0
                yield x.select(["a", "b", "ia", "ib"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long, ia long, ib long")


def _arrays(docs: DataFrame, needed: DataFrame, width: int, seed: int, unique: bool) -> DataFrame:
    """(cls, id, hashes): the sorted hash array of the needed rows, and perhaps of a few more."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            b = maybe_in(shared.value, whole, 0)
            buf, off = column_bytes(b.column(1))
            for lo, hi, cb, co in chunks(buf, off):
                row, value, size = shingle_sets(cb, co, width)
                end = np.cumsum(size)
                data = [value[e - n : e].tobytes() for e, n in zip(end.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(value, size, _SEEDS[0] ^ seed)), b.column(0).slice(lo, hi - lo), pa.array(data, pa.binary())], names=["cls", "id", "hashes"])

    out = docs.select("id", "text").mapInArrow(run, "cls long, id long, hashes binary")
    return out if unique else out.groupBy("cls", "id").agg(F.first("hashes").alias("hashes"))


def _exact(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by intersecting their sorted hash arrays; one array travels to the other's place."""
    one = arrays.select(F.col("cls").alias("a"), F.col("id").alias("ia"), F.col("hashes").alias("ha"))
    two = arrays.select(F.col("cls").alias("b"), F.col("id").alias("ib"), F.col("hashes").alias("hb"))
    joined = pairs.join(one, ["a", "ia"]).join(two, ["b", "ib"]).select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for ha, hb in zip(x["ha"], x["hb"], strict=True):
                p, q = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                ok.append(int((q[at] == p).sum()) >= required(len(p), len(q), percent))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def partners(n: np.ndarray, bits: np.ndarray, root: np.ndarray, lead: np.ndarray, home: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every lead with the members (ordered by size n) that it may link to by size and bitmap, while their roots differ."""
    for r in np.flatnonzero(lead).tolist():
        lo, hi = np.searchsorted(n, [-(-n[r] * percent // 100), n[r] * 100 // percent + 1])
        ok = root[lo:hi] != root[r]
        if not home[r]:
            ok &= home[lo:hi]
        # Two leads meet once.
        ok[: max(0, r - lo)] &= ~lead[lo:r]
        at = lo + np.flatnonzero(ok)
        if len(at):
            at = at[bitmap_room(np.full(len(at), n[r]), n[at], np.broadcast_to(bits[r], (len(at), bits.shape[1])), bits[at], percent) >= 0]
        if len(at):
            yield r, at


def settle(cls: np.ndarray, n: np.ndarray, bits: np.ndarray, hashes: list[np.ndarray], comp: np.ndarray, lead: np.ndarray, home: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of a block's members: every lead meets all others (not visitor and visitor).

    Sizes, then bitmaps, then exact intersection decide; a pair whose components are joined already is left out.
    """
    order = np.argsort(n, kind="stable")
    cls, n, bits, comp, lead, home = cls[order], n[order], bits[order], comp[order], lead[order], home[order]
    hashes = [hashes[k] for k in order]
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)
    begin = np.cumsum(n) - n
    mark = np.zeros(int(code.max()) + 1, np.int32)
    _, root = np.unique(comp, return_inverse=True)
    a, b = [], []
    for r, at in partners(n, bits, root, lead, home, percent):
        own = code[begin[r] : begin[r] + n[r]]
        mark[own] = 1
        overlap = np.empty(len(at), np.int64)
        for s in range(0, len(at), 256):
            part = at[s : s + 256]
            before = np.cumsum(n[part]) - n[part]
            spot = np.arange(int(n[part].sum())) + np.repeat(begin[part] - before, n[part])
            overlap[s : s + 256] = np.add.reduceat(mark[code[spot]], before)
        mark[own] = 0
        at = at[overlap >= required(n[r], n[at], percent)]
        _, one = np.unique(root[at], return_index=True)
        for other in at[one].tolist():
            a.append(cls[r])
            b.append(cls[other])
            root[root == root[other]] = root[r]
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return np.minimum(a, b), np.maximum(a, b)


def _settled(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    # A member may have come twice, as lead and as one of the others, or by its own block and as the pivot.
    group = group.sort_values("lead", ascending=False, kind="stable").drop_duplicates("cls")
    if len(group) < 2:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    bits = folded(group["data"].tolist(), min(map(len, group["data"])))
    hashes = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    a, b = settle(*(group[c].to_numpy() for c in ("cls", "n")), bits, hashes, *(group[c].to_numpy() for c in ("comp", "lead", "home")), percent)
    return pd.DataFrame({"a": a, "b": b})


def _crowds(tiles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(crowd, band, cls, id, n, data, home, blocks): tiles that share members laid together, and cut into bands anew."""
    labels = components(tiles.select(F.col("a"), F.col("b")))
    joined = labels.select(F.col("node").alias("cls"), F.col("label").alias("crowd")).join(classes.select("cls", "id", "n", "data"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                own = band(x["n"].to_numpy(), percent)
                for step in (0, 1):
                    yield pa.RecordBatch.from_arrays([x["crowd"], pa.array((own - step).astype(np.int32)), x["cls"], x["id"], x["n"], x["data"], pa.array(np.full(len(own), step == 0))], names=["crowd", "band", "cls", "id", "n", "data", "home"])

    laid = cut(joined.select("crowd", "cls", "id", "n", "data").mapInArrow(run, "crowd long, band int, cls long, id long, n long, data binary, home boolean"))
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    # A band without members at home has nothing to meet.
    size = laid.groupBy("crowd", "band").agg(many.alias("blocks"), F.max("home").alias("some"), F.count("*").alias("k")).filter("some and k > 1").select("crowd", "band", "blocks")
    out = cut(laid.join(size, ["crowd", "band"]))
    drop(laid)
    return out


_MEMBER = ("cls", "n", "data", "hashes", "comp", "lead", "home")


def _within(members: DataFrame, percent: int) -> DataFrame:
    """Links within each block, which also holds the crowd's pivot, so that a crowd's blocks hang together."""
    alone = members.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("comp", F.col("cls")).withColumn("lead", F.lit(True))
    pivot = members.filter("blocks > 1").groupBy("crowd", "band").agg(F.min_by(F.struct("cls", "n", "data", "hashes", "home", "blocks"), F.struct(~F.col("home"), F.xxhash64("cls", F.lit(7)))).alias("p"))
    pivot = pivot.select("crowd", "band", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("i")).withColumn("comp", F.col("cls")).withColumn("lead", F.lit(True))
    columns = ["crowd", "band", "i", *_MEMBER]
    return alone.select(*columns).union(pivot.select(*columns)).groupBy("crowd", "band", "i").applyInPandas(lambda group: _settled(group, percent), "a long, b long")


def _may_link(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(crowd, band, cls) of the members that may link to one of another component, by size and bitmap."""
    group = group.sort_values("lead", ascending=False, kind="stable").drop_duplicates("cls").sort_values("n", kind="stable")
    hit = np.zeros(len(group), bool)
    bits = folded(group["data"].tolist(), min(map(len, group["data"])))
    _, root = np.unique(group["comp"].to_numpy(), return_inverse=True)
    for r, at in partners(group["n"].to_numpy(), bits, root, *(group[c].to_numpy() for c in ("lead", "home")), percent):
        hit[r] = True
        hit[at] = True
    return group.loc[hit, ["crowd", "band", "cls"]]


def _dealt(named: DataFrame, member: tuple[str, ...], times: int):
    """Cells (crowd, band, i, j) in which members outside a crowd's main component meet, block by block, all others."""
    count = named.groupBy("crowd", "band", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    main = count.groupBy("crowd", "band").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("g"), F.sum("w").alias("w")).filter(F.col("m.k") < F.col("g"))
    blocks = F.greatest(F.ceil(F.col("g") / (BLOCK * times)), F.ceil(F.col("w") / (BLOCK_HASHES * times))).cast("int")
    main = main.select("crowd", "band", F.col("m.comp").alias("main"), ((F.col("g") - F.col("m.k")) / F.col("g")).alias("share"), blocks.alias("blocks"))
    dealt = named.join(main, ["crowd", "band"]).withColumn("outer", F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("share"))).cast("int"))
    home = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    away = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("outer")).cast("int")
    rest = dealt.withColumn("i", home).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("lead", F.lit(False))
    lead = dealt.filter("comp <> main").withColumn("j", away).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lead", F.lit(True))
    columns = ["crowd", "band", "i", "j", *member]
    return lead.select(*columns).union(rest.select(*columns)).groupBy("crowd", "band", "i", "j")


def _across(crowds: DataFrame, arrays: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between blocks: members outside a crowd's main component meet all of other components.

    They meet without their arrays at first; only members that may then have a partner bring them along.
    """
    named = crowds.filter("blocks > 1").drop("blocks").join(labels, F.col("cls") == labels["node"], "left").withColumn("comp", F.coalesce("label", "cls"))
    light = tuple(c for c in _MEMBER if c != "hashes")
    hit = cut(_dealt(named, light, LIGHT).applyInPandas(lambda group: _may_link(group, percent), "crowd long, band int, cls long").distinct())
    whole = named.join(hit, ["crowd", "band", "cls"], "left_semi").join(arrays, ["cls", "id"])
    out = cut(_dealt(whole, _MEMBER, 1).applyInPandas(lambda group: _settled(group, percent), "a long, b long"))
    drop(hit)
    return out


def _described(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """What _describe gives, the classes (cls, id, n, data), and the seed with which no two sets share a name."""
    seed = 0
    while True:
        described = cut(_describe(rows, width, seed))
        members = described.filter("kind = 0 and n > 0 and id is not null")
        classes = cut(members.groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("data").alias("data"), F.min("other").alias("least"), F.max("other").alias("most")))
        if classes.filter("least <> most").isEmpty():
            return described, classes, seed
        drop(described, classes)
        seed += 1


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs; component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described, classes, seed = _described(rows, width)
    table = cut(described.filter("kind = 0").select("id", "cls", "n", "bytes"))
    counts = combine_slices(described.filter("kind = 1").select(F.col("cls").cast("int").alias("slice"), "data"), "uint32", "sum").astype(np.float64)
    if not len(counts):
        counts = np.zeros(COUNTERS)
    # Only the order of magnitude counts, so that rare shingles stay in hash order.
    frequent = _frequent(described)
    drop(described)
    release(spark)
    often = (counts > HOT) & (counts > 8 * counts.mean())
    buckets = max(8, -(-int(table.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast((frequent, often))
    found = cut(_postings(rows.filter("id is not null").select("text"), width, percent, seed, shared, buckets).groupBy("bucket").applyInPandas(_tile_bucket(percent, buckets), "kind int, a long, b long"))
    release(spark)
    pairs = cut(_by_signature(found.filter("kind = 0").select("a", "b").distinct(), classes, percent))
    crowds = _crowds(found.filter("kind = 1"), classes, percent)
    names = cut(classes.select("cls", "id"))
    drop(found, classes)
    # Ids that stand in several rows: their classes count as linked.
    own = table.filter("n > 0 and id is not null")
    several = cut(own.groupBy("id").agg(F.min("cls").alias("a"), F.count("*").alias("k")).filter("k > 1").select("id", "a"))
    needed = pairs.select(F.explode(F.array("ia", "ib")).alias("id")).union(crowds.select("id"))
    arrays = cut(_arrays(rows, needed, width, seed, several.isEmpty()))
    release(spark)
    members = crowds.join(arrays, ["cls", "id"])
    same = own.join(several, "id").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    links = cut(_exact(pairs, arrays, percent).union(_within(members, percent)).union(same))
    drop(pairs, several)
    release(spark)
    labels = components(links)
    if not crowds.filter("blocks > 1").isEmpty():
        further = _across(crowds, arrays, labels, percent)
        if not further.isEmpty():
            labels = components(links.union(further))
        drop(further)
    drop(links, crowds, arrays)
    named = names.join(labels, F.col("cls") == labels["node"], "left").select("cls", "id", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    named = named.join(least, "label").select("cls", "component")
    out = table.select("id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id")).cast("long").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)

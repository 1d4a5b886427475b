"""Vectorised text primitives on the UTF-8 bytes of an Arrow string column.

Word classes here are decided byte by byte: every delimiter is ASCII, so a byte of 0x80 or more always belongs to a
word and no code point is ever cut. Polynomial hashes are taken modulo 2**64 from prefix sums, so that the hash of any
stretch costs two lookups; strings of a certain build (Thue-Morse) share them, so bytes must decide where they are used.
Words are named by block_hash, which has no such build.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at a time by the vectorised passes; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64; kept for the next call, up to 4 M entries."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = have[filled - 1] * base
                take = min(filled, size - filled)
                have[filled : filled + take] = have[:take] * step
                filled += take
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """h[i] covers buf[:i]; stretch [s, e) hashes to (h[e] - h[s]) * BASE ** -s."""
    out = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, max(1, len(buf)))[: len(buf)], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start]


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def block_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each stretch: the sum of its 8-byte blocks, each mixed with its place, mixed with the length.

    Stretches of up to 8 bytes and equal length have equal names only if they are equal.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray((len(buf),), "<u8", buffer=padded, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        out = mix((at[start] & _LOW_BYTES[np.minimum(size, 8)]) ^ BASE)
        long = np.flatnonzero(size > 8)
        if len(long):
            count = (size[long] - 1) // 8
            before = np.cumsum(count) - count
            inner = np.arange(int(count.sum())) - np.repeat(before, count) + 1
            left = np.repeat(size[long], count) - 8 * inner
            block = at[np.repeat(start[long], count) + 8 * inner] & _LOW_BYTES[np.minimum(left, 8)]
            out[long] += np.add.reduceat(mix(block ^ mix(inner.astype(np.uint64) * BASE_INVERSE + BASE)), before)
        return mix(out + size.astype(np.uint64) * BASE)


def heads(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each stretch, zeros behind its end."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.ndarray((len(buf),), "<u8", buffer=np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    return at[start] & _LOW_BYTES[np.minimum(end - start, 8)]


def same_stretches(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start : start + size] == b[start : start + size], for arrays of places; every size is above 0."""
    out = np.ones(len(size), bool)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        n = size[lo:hi]
        before = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(before, n)
        differ = a[np.repeat(a_start[lo:hi], n) + inner] != b[np.repeat(b_start[lo:hi], n) + inner]
        out[lo:hi] = np.add.reduceat(differ, before, dtype=np.int64) == 0
        lo = hi
    return out


def table(is_word, lower: bool = True) -> np.ndarray:
    """256 entries: 0 for a delimiter, else the byte that stands for it (A-Z become a-z if lower)."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        if is_word(c):
            out[b] = c
    return out


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
#: `[^\x20\x09-\x0D]+` after lower-casing. NUL is a word byte, so it is shifted to a byte that UTF-8 never uses.
NONSPACE = table(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D))
NONSPACE[0] = 0xFF
#: Lines.
LINE = table(lambda c: c != 0x0A, lower=False)
LINE[0] = 0xFF


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and len + 1 offsets into them; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with up to limit bytes, or of one longer row."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, mapping: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of every word of rows laid end to end; words never cross rows."""
    mapped = mapping[buf]
    if not len(mapped):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    value = block_hash(mapped, start, end)
    row = np.searchsorted(off, start, "right") - 1
    return value, start, end, row


def shingles(value: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of width words in a row; a row of fewer words, but not none, gives its whole sequence."""
    count = np.bincount(row, minlength=rows)
    n = len(value)
    if not n:
        return value, row
    keep = np.zeros(0, np.int64)
    out = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n >= width:
            keep = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
            out = np.full(len(keep), np.uint64(width))
            for k in range(width):
                out = mix(out * BASE + value[keep + k])
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            begin = (np.cumsum(count) - count)[short]
            whole = count[short].astype(np.uint64)
            for k in range(width - 1):
                more = count[short] > k
                whole[more] = mix(whole[more] * BASE + value[begin[more] + k])
            out = np.concatenate([out, whole])
            keep = np.concatenate([row[keep], short])
            return out, keep
    return out, row[keep]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, sorted by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def trim() -> None:
    """Gives freed memory back: a worker that waits for its next task would hold it otherwise."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give(0)


def merge_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, end) as maximal intervals, ascending."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:] - 1, len(end) - 1)]

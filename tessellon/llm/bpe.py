"""Byte-pair encoding by a tokenization automaton.

Arcs are tokens, a state is what may follow the token just read. The automaton starts as one state with a loop for each
byte; every merge (u, v) -> w is a gadget applied in rank order: wherever arcs u and v could follow one another a new
arc w is added, the state behind w is a copy of the state behind v, and the state behind u loses its arc v. The copies
are kept as (copied state, time of the copy, cuts), so compiling costs a few table entries per merge; the arc table of
a state is filled in as its arcs are first asked for, and kept. A string is encoded by the one path of arcs that spells
it: the longest arc first, falling back to shorter ones where the state has no such arc, never trying a position twice.
Decoding emits the labels of the arcs.

Special strings of the vocabulary file are split off before, as the reference library does.
Defined cases: a null text counts as empty; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessellon.llm.textbytes import BASE, BASE_INVERSE, mix, powers, prefix_hash, stretch_hash, trim

#: Fixed value: the byte-level pre-tokenizer's pattern.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same pattern spelt out for texts of these code points alone (Latin up to U+024F, general punctuation, pictographs):
#: within them the letters, numbers and white space are the listed ones, and the plain engine is many times faster.
FAST_ONLY = re.compile("[\x00-\u024F\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\U0001F300-\U0001F64F]*+")
_L, _N, _S = "a-zA-Z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", "0-9\u00B2\u00B3\u00B9\u00BC-\u00BE", "\t-\r \u0085\u00A0"
FAST_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]++| ?[{_N}]++| ?[^{_L}{_N}{_S}]++|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Distinct pre-split words whose encodings a worker keeps; beyond it the table starts anew.
CACHE_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable char: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split(text: str) -> list[str]:
    """The pre-split words of a text."""
    return FAST_SPLIT.findall(text) if FAST_ONLY.fullmatch(text) else SPLIT.findall(text)


class _Words(dict):
    """Encodings of the words met; long ones are not kept."""

    def __init__(self, machine: MergeAutomaton):
        self.machine = machine

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.machine.path(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out


class _Table:
    """64-bit keys to numbers, looked up for whole arrays: keys sorted, and where each leading-bits bucket begins."""

    BITS = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.zeros(1, np.uint64))
        self.values = np.append(values[order], -1).astype(np.int64)
        top = (keys[order] >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.begin = np.searchsorted(top, np.arange(1 << self.BITS))
        self.most = int(np.bincount(top, minlength=1).max(initial=0))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys not held."""
        at = self.begin[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)]
        out = np.full(len(keys), -1, np.int64)
        left = None
        last = len(self.keys) - 1
        for _ in range(self.most):
            if left is None:
                hit = self.keys[at] == keys
                out[hit] = self.values[at[hit]]
                left = np.flatnonzero(~hit & (self.keys[at] < keys))
            else:
                at_left = np.minimum(at[left] + 1, last)
                at[left] = at_left
                hit = self.keys[at_left] == keys[left]
                out[left[hit]] = self.values[at_left[hit]]
                left = left[~hit & (self.keys[at_left] < keys[left])]
            if not len(left):
                break
        return out


class MergeAutomaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.vocab, self.special = vocab, special or {}
        self.labels: dict[int, bytes] = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        #: By the first three bytes of what is left, the length of the longest token that begins so; 2 where none is longer.
        self.farthest: dict[bytes, int] = {}
        for t in vocab:
            if len(t) > 2:
                self.farthest[t[:3]] = max(self.farthest.get(t[:3], 0), len(t))
        self.left: dict[int, int] = {}
        self.copied: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for time, (u, v) in enumerate(merges):
            self._gadget(time, vocab[u], vocab[v], vocab[u + v])
        self._arcs: dict[int, bool] = {}
        labels = [self.labels.get(i, b"") for i in range(max(self.labels, default=-1) + 1)]
        self.label_size = np.array([len(x) for x in labels], np.int64)
        self.label_begin = np.cumsum(self.label_size) - self.label_size
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo = _Words(self)
        buf = np.frombuffer(b"".join(vocab), np.uint8)
        end = np.cumsum([len(t) for t in vocab])
        begin = end - np.array([len(t) for t in vocab])
        if len(end):
            self.tokens = _Table(mix(stretch_hash(prefix_hash(buf), begin, end)), np.array(list(vocab.values())))
        self.known = _Table(np.zeros(0, np.uint64), np.zeros(0))
        self.longest = max(map(len, vocab), default=1)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault((u, v), time)
        if w not in self.born:
            self.born[w], self.left[w], self.copied[w] = time, u, v

    def arc(self, p: int, t: int) -> bool:
        """May token t follow token p?"""
        found = self._arcs.get(p << 20 | t)
        if found is None:
            if len(self._arcs) > 1_000_000:
                self._arcs.clear()
            found = self._arcs[p << 20 | t] = self._at(p, t, 1 << 30)
        return found

    def _at(self, p: int, t: int, time: int) -> bool:
        """Whether state p had arc t before the gadget of that time."""
        while True:
            if self.cut.get((p, t), 1 << 30) < time:
                return False
            bp, bt = self.born.get(p, -1), self.born.get(t, -1)
            if bp < 0 and bt < 0:
                return True
            if bt >= bp:  # the arc came later: it stands where its left part stood then
                t, time = self.left[t], bt + 1
            else:  # the state came later: it began as a copy
                p, time = self.copied[p], bp

    def path(self, word: bytes) -> list[int]:
        """The tokens that spell word."""
        get, arcs, farthest = self.vocab.get, self._arcs, self.farthest.get
        whole = get(word)
        if whole is not None and (len(word) == 1 or whole in self.born):
            return [whole]
        n, at, last, size, dead = len(word), 0, -1, 0, set()
        ids, ends = [], []
        while at < n:
            if not size:
                size = farthest(word[at : at + 3], 2)
            if size > n - at:
                size = n - at
            while size:
                t = get(word[at : at + size])
                if t is not None and at + size not in dead:
                    if last < 0:
                        break
                    ok = arcs.get(last << 20 | t)
                    if ok or ok is None and self.arc(last, t):
                        break
                size -= 1
            if size:
                at += size
                ids.append(t)
                ends.append(at)
                last, size = t, 0
                continue
            # No arc leads on from here: take the last arc back and try shorter ones.
            if not ids:
                raise ValueError("the vocabulary has no token for a byte of the word")
            dead.add(at)
            ids.pop()
            ends.pop()
            begin = ends[-1] if ends else 0
            size, at, last = at - begin - 1, begin, ids[-1] if ids else -1
            if not size:
                # Even the shortest arc failed; go back further.
                while not size:
                    if not ids:
                        raise ValueError("no path of arcs spells the word")
                    dead.add(at)
                    ids.pop()
                    ends.pop()
                    begin = ends[-1] if ends else 0
                    size, at, last = at - begin - 1, begin, ids[-1] if ids else -1
        return ids

    def _follows(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """arc() for arrays, from the table of the arcs asked for so far."""
        key = p << 20 | t
        found = self.known.get(mix(key.astype(np.uint64)))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            unique, at = np.unique(key[missing], return_inverse=True)
            found[missing] = np.array([self.arc(k >> 20, k & 0xFFFFF) for k in unique.tolist()], np.int64)[at]
        return found > 0

    def paths(self, words: list[bytes]) -> list[bytes]:
        """path() of many words as little-endian uint32, in lock step over words of one length.

        Every prefix of a word has one path; its last arc is the token that ends there, begins where a path ends, and
        that the state there has an arc for.
        """
        if len(self._arcs) > 1.25 * (len(self.known.keys) + 1000):
            self.known = _Table(mix(np.array(list(self._arcs), np.uint64)), np.fromiter(self._arcs.values(), np.int64, len(self._arcs)))
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, which in by_length.items():
            if n > 40:
                for i in which:
                    out[i] = np.array(self.path(words[i]), "<u4").tobytes()
                continue
            rows = len(which)
            m = np.frombuffer(b"".join([words[i] for i in which]), np.uint8).reshape(rows, n)
            with np.errstate(over="ignore"):
                h = np.zeros((n + 1, rows), np.uint64)
                np.cumsum((m.T.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:, None], axis=0, out=h[1:])
                inverse = powers(BASE_INVERSE, n + 1)
                last = np.full((n + 1, rows), -1, np.int64)
                for end in range(1, n + 1):
                    for size in range(1, min(end, self.longest) + 1):
                        begin = end - size
                        live = np.flatnonzero((last[begin] >= 0) & (last[end] < 0)) if begin else np.flatnonzero(last[end] < 0)
                        if not len(live):
                            continue
                        t = self.tokens.get(mix((h[end, live] - h[begin, live]) * inverse[begin]))
                        has = t >= 0
                        live, t = live[has], t[has]
                        if begin and len(live):
                            ok = self._follows(last[begin, live], t)
                            live, t = live[ok], t[ok]
                        last[end, live] = t
            # Read the arcs back from the end.
            steps = np.zeros((rows, n), "<u4")
            at, count = np.full(rows, n), np.zeros(rows, np.int64)
            live = np.arange(rows)
            while len(live):
                t = last[at[live], live]
                if (t < 0).any():
                    raise ValueError("no path of arcs spells the word")
                count[live] += 1
                steps[live, n - count[live]] = t
                at[live] -= self.label_size[t]
                live = live[at[live] > 0]
            for i, row, c in zip(which, steps, count.tolist(), strict=True):
                out[i] = row[n - c :].tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """encode() of many texts; words not met before take one lock-step pass together."""
        if any(s in t for s in self.special for t in texts):
            return [self.encode(t) for t in texts]
        parts = [split(t) for t in texts]
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
        new = [w for w in set().union(*parts) if w not in self.memo]
        self.memo.update(zip(new, self.paths([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        return [b"".join(map(self.memo.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self._special is None or not any(x in text for x in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if len(self.memo) > CACHE_WORDS:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, split(text)))

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The labels of the arcs, end to end."""
        begin, size = self.label_begin[ids], self.label_size[ids]
        before = np.cumsum(size) - size
        return self.label_bytes[np.repeat(begin - before, size) + np.arange(int(size.sum()))]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, as text; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.frombuffer(ids, "<u4")).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    """Compiled once in each worker process."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    chars = byte_chars()

    def raw(token: str) -> bytes:
        return bytes(chars[c] for c in token)

    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    vocab = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in data["model"]["merges"]]
    return MergeAutomaton(vocab, merges, special)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (binary, little-endian uint32), decoded text; digests instead if asked for.

    Narrow: one pass over the texts. path is the vocabulary file, present on every worker.
    """
    path = path or default_path()
    tail = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.BinaryType()), ("decoded", T.StringType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(*x) for x in tail)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                n, first, second = [], [], []
                for ids in machine.encode_batch(b.column(1).fill_null("").to_pylist()):
                    text = machine.decode(ids)
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                    second.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.binary()), pa.array(second, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def append_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (binary, little-endian uint32) appended; columns of those names are replaced."""
    path = path or default_path()
    docs = docs.drop("n_tokens", "ids")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        machine = automaton(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                ids = machine.encode_batch(b.column(at).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)
                del b, ids
                trim()

    return docs.mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)

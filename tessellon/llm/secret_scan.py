"""Secret scans with structural confirmation.

Three base patterns are always reported. Beyond them, long base64 and hex candidates are decoded, and a candidate is
reported only when what it decodes to has the structure of a secret: a DER key whose nested lengths close exactly, an
OpenSSH key blob whose length-prefixed fields fill it, or a signed token whose header is JSON naming an algorithm.

Defined cases: a null or empty text has no spans; repeated rows give repeated results; the work is linear in the text.
Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessellon.llm.textbytes import chunks, column_bytes

#: The base kinds, in the order in which ties are listed, then the kinds that the method adds.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "pem", "der", "openssh")
RANK = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

#: The assignment is found from its sign: the name must end before it, the value begin after it.
SIGN = re.compile(r"[:=]")
NAME = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\Z")
VALUE = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]++)")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"[0-9a-f]{24,}+")
#: Keys in hex, in either case or both.
HEX_KEY = [re.compile(r) for r in (r"[0-9a-f]{48,}+", r"[0-9A-F]{48,}+", r"[0-9A-Fa-f]{48,}+")]
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{40,}+={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*+)-----END \1-----")


def _assigned(text: str) -> list[tuple[str, int, int]]:
    out, done = [], 0
    for m in SIGN.finditer(text):
        at = m.start()
        if at < done:
            continue
        e = at
        while e > done and text[e - 1] == " ":
            e -= 1
        begin = max(done, e - 9)
        if (name := NAME.search(text[begin:e])) and (value := VALUE.match(text, m.end())):
            done = value.end()
            if value.end() - value.start(1) >= 6:
                out.append(("assign", begin + name.start(), done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = _assigned(text)
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill data exactly, or None where a nested length does not close."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, size = data[i], data[i + 1]
        i += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or i + n > len(data):
                return None
            size = int.from_bytes(data[i : i + n], "big")
            i += n
            if size < 0x80:
                return None
        if i + size > len(data):
            return None
        content = data[i : i + size]
        if tag & 0x20 and depth < 8 and der_items(content, depth + 1) is None:
            return None
        out.append((tag, content))
        i += size
    return out


#: Object identifiers 1.2.840.113549.1.5 (PKCS #5) and 1.2.840.113549.1.12.1 (PKCS #12).
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that opens with an integer (a private key), with an algorithm SEQUENCE and a BIT STRING (a public key), or
    with a password-based algorithm and an OCTET STRING (an encrypted private key; other algorithms make a digest)."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_items(data)
    if not top or len(top) != 1:
        return False
    inner = der_items(top[0][1]) or []
    tags = [t for t, _ in inner]
    private = len(tags) >= 2 and tags[0] == 0x02 and (tags.count(0x02) >= 6 or 0x04 in tags[1:3])
    public = tags[:2] == [0x30, 0x03] and any(t == 0x06 for t, _ in der_items(inner[0][1]) or [])
    encrypted = tags == [0x30, 0x04] and any(t == 0x06 and c.startswith(PASSWORD_BASED) for t, c in (der_items(inner[0][1]) or [])[:1])
    return private or public or encrypted


def is_openssh(data: bytes) -> bool:
    """A private key container, or a public blob: length-prefixed fields that fill it, the first naming the key type."""
    if data.startswith(b"openssh-key-v1\x00"):
        return True
    fields, i = [], 0
    while i < len(data):
        if i + 4 > len(data):
            return False
        size = int.from_bytes(data[i : i + 4], "big")
        i += 4
        if i + size > len(data):
            return False
        fields.append(data[i : i + size])
        i += size
    return len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-"))


def is_signed_token(text: str) -> bool:
    parts = text.split(".")
    head, body = _unbase64(parts[0]), _unbase64(parts[1])
    try:
        header, claims = json.loads(head or b""), json.loads(body or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that the method adds."""
    out = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            data = _unbase64("".join(m[2].split()))
            if data and (is_der_key(data) or is_openssh(data)):
                out.append(("pem", m.start(), m.end()))
    for m in BASE64.finditer(text):
        if (data := _unbase64(m[0])) is not None:
            kind = "der" if is_der_key(data) else "openssh" if is_openssh(data) else None
            if kind:
                out.append((kind, m.start(), m.end()))
    runs = {m.span() for r in HEX_KEY for m in r.finditer(text)}
    out += [("der", s, e) for s, e in sorted(runs) if (e - s) % 2 == 0 and is_der_key(bytes.fromhex(text[s:e]))]
    return out


def by_start(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], RANK[x[0]], x[2])))


#: Bytes of base64 in both alphabets; hex is among them.
_RUN = np.zeros(256, bool)
_RUN[[b for b in range(128) if chr(b).isalnum() or chr(b) in "+/_-="]] = True
SHORTEST = 20
#: What opens a token or a PEM block, whose runs may be shorter.
OPENING = re.compile(rb"eyJ|-----BEGIN")


def worth_a_look(column: pa.Array) -> np.ndarray:
    """Which rows have a sign of assignment, the opening of a token or PEM block, or a run long enough for any other kind;
    the rest have no span."""
    buf, off = column_bytes(column)
    out = np.zeros(len(off) - 1, bool)
    for lo, hi, b, o in chunks(buf, off):
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = _RUN[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hit = np.concatenate([start[end - start >= SHORTEST], np.flatnonzero((b == 0x3A) | (b == 0x3D))])
        # A run may span rows that touch; then every row it reaches is looked at.
        hit = np.concatenate([hit, end[end - start >= SHORTEST] - 1])
        hit = np.concatenate([hit, np.array([m.start() for m in OPENING.finditer(b)], np.int64)])
        out[lo + np.unique(np.searchsorted(o, hit, "right") - 1)] = True
        for s, e in zip(start[end - start >= SHORTEST], end[end - start >= SHORTEST], strict=True):
            out[lo + np.searchsorted(o, s, "right") - 1 : lo + np.searchsorted(o, e - 1, "right")] = True
    return out


NOTHING = (0, 0, 0, "", "")


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base span list, list of all spans) of a text."""
    base = base_spans(text or "")
    kinds = [k for k, _, _ in base]
    added = confirmed_spans(text or "")
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), by_start(base), by_start(base + added)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts of the base kinds, their spans, and all spans with the confirmed ones.

    Narrow: one pass over the texts, no shuffle; only the id and the text are read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, k, h, base, spans = (list(x) for x in zip(*(scan(t.as_py()) if look else NOTHING for t, look in zip(b.column(1), worth_a_look(b.column(1)), strict=True)), strict=True)) if b.num_rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()

"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Base spans (email, ip, card, phone) are exact patterns and always stay. The generators also propose overlapping spans
that the base patterns miss (written-out addresses, national phone numbers, bank accounts, social security numbers,
IPv6 addresses, shorter card numbers); boosted trees score each by its format and the words around it, a threshold
calibrated per kind on held-out examples selects, and of overlapping selected spans the longest one is kept.
The trees learn from examples that are composed here with a fixed seed; nothing is read for it.

Defined cases: a null or empty text has no spans; repeated rows give repeated results. Spans are in code points.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellon.llm.boosting import BoostedTrees, threshold_for
from tessellon.llm.textbytes import merge_intervals, trim

#: The base kinds in listing order, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("intl_phone", "card_run", "written_email", "national_phone", "iban", "ssn", "ipv6", "short_card")
RANK = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

GENERATORS = {
    "intl_phone": re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])", re.A),
    "card_run": re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])", re.A),
    "national_phone": re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,4}){2,4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![\w:])", re.A),
    "short_card": re.compile(r"(?<![\w-])[0-9]{4}(?:[ -]?[0-9]{4,6}){2}(?:[ -]?[0-9]{1,3})?(?![\w-])", re.A),
}
HEX_PAIR = re.compile(r"[0-9a-fA-F]:[0-9a-fA-F]")
#: A written-out address is found from its middle: the word for the sign, what may precede it, what must follow.
AT_WORD = re.compile(r"at(?![A-Za-z0-9_])")
AT_LEFT = re.compile(r"(?<![\w.])[A-Za-z][A-Za-z0-9._-]{0,63} ?[(\[]?\Z", re.A)
AT_RIGHT = re.compile(r"[)\]]? ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[a-z]{2,12}){1,3}\b", re.A)


#: Context words by what they speak of.
CONTEXT = {
    "mail": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "whatsapp", "anrufen"),
    "bank": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "person": ("ssn", "social", "security", "my", "name", "born", "patient"),
    "host": ("ip", "host", "server", "address", "ping"),
    "other": ("version", "isbn", "order", "invoice", "page", "pages", "figure", "date", "serial", "section", "meeting", "score"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # Chars left of the sign that may belong to the name, no further than the end of the last match.
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", s, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans of different kinds may overlap."""
    out = []
    if DIGIT.search(text):
        for kind, pattern in GENERATORS.items():
            if kind != "ipv6" or HEX_PAIR.search(text):
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    for m in AT_WORD.finditer(text):
        s = m.start()
        if s and text[s - 1] in " ([" and (right := AT_RIGHT.match(text, m.end())) and (left := AT_LEFT.search(text[max(0, s - 66) : s])):
            out.append(("written_email", max(0, s - 66) + left.start(), right.end()))
    return out


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    span = text[s:e]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = re.findall(r"[a-z-]+", text[max(0, s - 40) : s].lower())[-5:]
    after = re.findall(r"[a-z-]+", text[e : e + 24].lower())[:2]
    near = set(before) | set(after)
    groups = re.findall(r"[0-9A-Za-z]+", span)
    iban = 0.0
    if kind == "iban":
        flat = re.sub(r"[^0-9A-Z]", "", span)
        iban = float(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
    return [
        *(float(kind == k) for k in ADDED_KINDS),
        float(e - s), float(len(digits)), len(digits) / (e - s), float(len(groups)), float(len({len(g) for g in groups})),
        float(len(set(span) & set(" -./()[]"))), float(luhn(digits)) if digits else 0.0, iban,
        float("(at)" in span or "[at]" in span), float(" at " in span), float(" dot " in span or "(dot)" in span or "[dot]" in span),
        float(span.endswith((" com", " org", " net", ".com", ".org", ".net", " de", " fr", " es", ")com", "]com"))),
        float(kind == "ssn" and not span.startswith(("000", "666", "9"))),
        *(float(bool(near & set(group))) for group in CONTEXT.values()),
        float(s > 0 and text[s - 1] in ":=\"'<("), float(span.startswith(("0", "(0", "(")) and kind == "national_phone"),
    ]


def _examples(n: int, rng: random.Random) -> tuple[list[list[float]], list[int], list[str]]:
    """Composed sentences with one labelled candidate each; negatives share the format but not the context."""
    x, y, kinds = [], [], []
    words = "the report was sent and people of this town in an old house with many new things to do when rain comes".split()

    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def valid_card(k):
        body = digits(k - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def valid_iban():
        country, body = rng.choice(["DE", "FR", "ES", "GB"]), digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    def make(kind, good):
        name, host = rng.choice(["john.doe", "anna", "m.weber", "luis_p"]), rng.choice(["example", "mailbox", "corp"])
        if kind == "written_email":
            if good:
                a, d = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot ")])
                return f"{name}{a}{host}{d}{rng.choice(['com', 'org', 'net', 'de'])}"
            return rng.choice(["look at this.then", "stood at home.she", "arrived at noon.they", "was at work.and", "look at page.html"])
        if kind == "intl_phone":
            return f"+{rng.randint(1, 49)} ({digits(3)}) {digits(3)}-{digits(4)}" if good else f"+{digits(2)} {digits(2)} {digits(2)}"
        if kind == "card_run":
            flat = valid_card(16) if good else digits(16)
            sep = rng.choice(["", " ", "-"])
            return sep.join(flat[i : i + 4] for i in range(0, 16, 4)) + rng.choice(["", "", f" {digits(5)}"])
        if kind == "national_phone":
            if good:
                return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(3)} {digits(3)}"])
            return rng.choice([f"{rng.randint(10, 31)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{digits(2)} {digits(2)} {digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"])
        if kind == "iban":
            flat = valid_iban() if good else rng.choice(["AB", "XK", "DE"]) + digits(18 + 2)
            return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if rng.random() < 0.5 else flat
        if kind == "ssn":
            return f"{rng.choice('12345')}{digits(2)}-{digits(2)}-{digits(4)}"
        if kind == "ipv6":
            return ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)) if good else f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}"
        k = rng.choice([13, 14, 15])
        flat = valid_card(k) if good else digits(k)
        return flat if rng.random() < 0.4 else f"{flat[:4]} {flat[4:10]} {flat[10:]}"

    topic = {"intl_phone": "phone", "card_run": "card", "written_email": "mail", "national_phone": "phone", "iban": "bank", "ssn": "person", "ipv6": "host", "short_card": "card"}
    while len(x) < n:
        kind, good = rng.choice(ADDED_KINDS), rng.random() < 0.5
        cue = rng.choice(CONTEXT[topic[kind]]) if good and rng.random() < (0.4 if kind in ("intl_phone", "card_run") else 0.85) else rng.choice(CONTEXT["other"]) if not good and rng.random() < 0.5 else rng.choice(words)
        lead = " ".join(rng.choices(words, k=rng.randint(2, 6)))
        text = f"{lead} {cue}{rng.choice([' ', ': ', ' '])}{make(kind, good)} {' '.join(rng.choices(words, k=3))}"
        for k, s, e in candidates(text):
            x.append(features(text, k, s, e))
            y.append(int(good and k == kind))
            kinds.append(k)
    return x, y, kinds


@lru_cache(maxsize=2)
def train(examples: int = 4000, precision: float = 0.97, seed: int = 7) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and a threshold per kind; half of the examples fit, the other half calibrate."""
    x, y, kinds = _examples(examples, random.Random(seed))
    x, y, kinds = np.array(x), np.array(y), np.array(kinds)
    half = np.arange(len(x)) % 2 == 0
    trees = BoostedTrees().fit(x[half], y[half].astype(float))
    p = trees.predict(x[~half])
    return trees, {k: max(0.5, threshold_for(p[kinds[~half] == k], y[~half][kinds[~half] == k], precision)) for k in ADDED_KINDS}


def select(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]], p: np.ndarray, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """The proposed spans that score enough, free of overlaps with base spans and with longer ones."""
    kept: list[tuple[str, int, int]] = []
    s, e = merge_intervals(*(np.array([x[i] for x in base], np.int64) for i in (1, 2)))
    starts, ends = s.tolist(), e.tolist()
    for i in sorted((i for i in range(len(found)) if p[i] >= thresholds[found[i][0]]), key=lambda i: (found[i][1] - found[i][2], -p[i], RANK[found[i][0]], found[i][1])):
        _, s, e = found[i]
        at = bisect_right(starts, s)
        if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or starts[at] >= e):
            kept.append(found[i])
            starts.insert(at, s)
            ends.insert(at, e)
    return kept


def spans_of(texts: list[str], trees: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; all candidates of the batch are scored together."""
    base = [base_spans(t) for t in texts]
    found = [candidates(t) for t in texts]
    x = [features(t, *c) for t, cs in zip(texts, found, strict=True) for c in cs]
    p = trees.predict(np.array(x)) if x else np.zeros(0)
    at = np.cumsum([0, *(len(c) for c in found)])
    return [(b, select(b, c, p[at[i] : at[i + 1]], thresholds) if c else []) for i, (b, c) in enumerate(zip(base, found, strict=True))]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (RANK[x[0]], x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every maximal covered stretch replaced by the bracketed kind of its first span."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], RANK[x[0]])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per row of docs: counts and list of base spans, list of all spans, and the redacted text if asked for.

    Narrow: one pass, no shuffle; the model is some tens of KB whatever the input.
    """
    trees, thresholds = train()
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]
    schema = T.StructType(fields + [T.StructField("redacted", T.StringType())] * redacted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            texts = b.column(1).fill_null("").to_pylist()
            for text, valid, (base, added) in zip(texts, b.column(1).is_valid(), spans_of(texts, trees, thresholds), strict=True):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), listed(base), listed(base + added), *([redact(text, base + added) if valid.as_py() else None] if redacted else [])))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * (len(schema) - 1)
            types = [pa.int64()] * 4 + [pa.string()] * (len(schema) - 5)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced by its kind, and chars_col set to the new length; same columns."""
    trees, thresholds = train()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 2000) for whole in batches for lo in range(0, whole.num_rows, 2000)):
            texts = b.column(at).to_pylist()
            found = spans_of([t or "" for t in texts], trees, thresholds)
            columns = list(b.columns)
            columns[at] = pa.array([t if t is None or not base and not added else redact(t, base + added) for t, (base, added) in zip(texts, found, strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        trim()

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.char_length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")

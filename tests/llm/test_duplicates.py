"""Suffix dedup, Jaccard join and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessellon.llm import components, contamination, jaccard_join, pii, quality, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_dedup(rows):
    first = {}
    for i, x in rows:
        if i is not None:
            for p in range(len(x) - 49):
                s = x[p : p + 50]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, x in rows:
        gone = bytearray(len(x))
        for p in range(len(x) - 49 if i is not None else 0):
            if first[x[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(rng, n):
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choices(words, k=40))
    base = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(n)]
    for k in range(0, n, 3):
        base[k] = f"{base[k][: rng.randint(0, 99)]}{passage[rng.randint(0, 30) :]}{base[k]}"
    base[1], base[2], base[4] = base[7], "a" * 700, "a" * 120
    return base


def test_suffix_dedup(spark):
    rng = random.Random(5)
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts(rng, 60))] + [(5, None), (5, "x" * 60), (5, "y" * 60), (None, "a" * 99), (200, "x" * 60), (201, "y" * 60 + "z"), (201, "y" * 60 + "z")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.deduplicate(df).collect()), key=str)
    assert got == brute_dedup([(i, (t or "").encode()) for i, t in rows])
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def test_suffix_dedup_hands_on_small_batches():
    """A task that has gathered some MB of text hands their fragments to Spark bit by bit, and whole."""

    class Tasks:
        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(6)
    text = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(1500)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array([0] * 1500, pa.int64()), pa.array(text)], names=["id", "base", "text"])
    out = list(suffix_dedup._send(Tasks(), 40, 50, 12)(iter([rows])))
    assert sum(b.num_rows for b in out) == 40 and all(b.nbytes < 1.1 * suffix_dedup.HANDED_BYTES for b in out)


def test_op7_on_tables(spark, sf):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in suffix_dedup.op7_suffix_dedup(spark, sf).collect()), key=str) == brute_dedup(rows)


def brute_groups(rows, width, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            o = len(s & t)
            if None not in (i, j) and s and t and 100 * o >= percent * (len(s) + len(t) - o):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def crowded(rng):
    """A large group of near copies, which all share tiles, and a passage in many texts that don't link."""
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=90)
    out = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(90)] = rng.choice(words)
        out.append(" ".join(copy))
    passage = rng.choices(words, k=30)
    out += [" ".join(rng.choices(words, k=rng.randint(4, 40)) + passage) for _ in range(60)]
    out += ["", None, "Hi", "hi", "a b", "A  b", " \t\n"]
    return out


def test_jaccard_join(spark):
    rng = random.Random(2)
    rows = [(1000 - i, t) for i, t in enumerate(crowded(rng))] + [(1000, "other words than before"), (None, "hi")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, percent in ((4, 85), (5, 80)):
        got = sorted((tuple(r) for r in jaccard_join.near_duplicates(df, width, percent).collect()), key=str)
        assert got == brute_groups(rows, width, percent)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_join_in_many_blocks(spark, monkeypatch):
    """Crowds cut into blocks of a few members, and hot shingles that go to the blocks directly."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=60)
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(copy[: rng.randint(40, 60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_groups(rows, 4, 85)
    assert 3 < len({r[2] for r in want}) < 150
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", 3)
    for hot in (1 << 16, 8):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        assert sorted((tuple(r) for r in jaccard_join.near_duplicates(df, 4, 85).collect()), key=str) == want


def test_jaccard_join_of_common_shingles(spark, monkeypatch):
    """Texts that share only common shingles make few candidates, however many shingles share a counter, and bring no arrays."""
    rng = random.Random(3)
    phrases = [" ".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(phrases) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    rows += [(1000 + i, f"{t} more") for i, t in rows[:9]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_groups(rows, 4, 85)
    monkeypatch.setattr(jaccard_join, "COUNTERS", 64)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", 3)
    counts, arrays = [], jaccard_join._arrays
    monkeypatch.setattr(jaccard_join, "_arrays", lambda docs, needed, *a: counts.append(needed.distinct().count()) or arrays(docs, needed, *a))
    assert sorted((tuple(r) for r in jaccard_join.near_duplicates(df, 4, 85).collect()), key=str) == want
    assert counts[0] < 200


def test_counts_of_repeated_shingles(monkeypatch):
    """Only what repeats is sent, with its count, and the most frequent if there is too much."""
    want = np.array([3, 9], np.uint64).tobytes() + np.array([2, 3], "<u4").tobytes()
    assert jaccard_join.repeated([np.array(x, np.uint64) for x in ([9, 3, 5], [9, 3, 9, 7])]) == want
    monkeypatch.setattr(jaccard_join, "COUNTS_SENT", 1)
    assert jaccard_join.repeated([np.array([9, 3, 5, 9, 3, 9], np.uint64)]) == np.array([9], np.uint64).tobytes() + np.array([3], "<u4").tobytes()


def test_op8_on_tables(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in jaccard_join.op8_jaccard_join(spark, sf).collect()), key=str) == brute_groups(rows, 4, 85)


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words of 1024 letters."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, other + "  "), (4, f"{one} x y z u v w"), (5, f"{other} x y z u v w")]
    got = jaccard_join.near_duplicates(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, cls int, n int"), 4, 85)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 4, 4), (5, 4, 5)]


def test_components_of_long_paths(spark, monkeypatch):
    """Paths in id order, against it and shuffled settle in logarithmic rounds."""
    calls, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: calls.append(1) or cut(df))
    n, order = 300, random.Random(4).sample(range(600, 900), 300)
    rows = [(i, i + 1) for i in range(n - 1)] + [(300 + i + 1, 300 + i) for i in range(n - 1)] + list(zip(order, order[1:]))
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {i: i // n * n for i in range(3 * n)} and len(calls) <= 14


def test_jaccard_join_of_an_ordered_chain(spark):
    """Each text links to its neighbours only."""
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 20))) for i in range(300)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(tuple(r) for r in got) == [(i, 17, 0) for i in range(300)]


def test_pipeline(spark, sf):
    """Each stage on its own input, then the whole run."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, machine).collect()}
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == {i for i, s in score.items() if s >= corpus_pipeline.QUALITY_THRESHOLD} and kept.columns == docs.columns
    single = corpus_pipeline.near_duplicate_filter(spark, kept, sf)
    groups = defaultdict(list)
    for i, _, g in brute_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80):
        groups[g].append(i)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(groups) and single.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, single, sf)
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r["doc_id"] for r in contamination.find_contamination(single, benchmark).filter("n_hit > 0").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (single, clean))
    assert {i for i in before if before[i] != after[i]} == hit
    private = corpus_pipeline.redact_pii(spark, clean, sf)
    assert all(not pii.base_spans(r["text"] or "") or "[" in r["text"] for r in private.collect())
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == single.count() and {"n_tokens", "ids"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_unlike_texts_of_an_id(spark):
    a, b, x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "abxy")
    rows = [(3, a), (5, a), (5, b), (7, x), (8, x + " more"), (7, y), (9, y + " more"), (11, b + " on"), (12, ""), (12, None), (13, ""), (14, x + " z"), (14, x + " z"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert out.columns == docs.columns
    want = [(3, a), (5, b), (7, x), (7, y), (12, ""), (12, None), (13, ""), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_suffix_dedup_of_long_strings(spark):
    """Fragments of more than 255 bytes."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(500)]
    passage = " ".join(rng.choices(words, k=90))
    rows = [(i, f"{' '.join(rng.choices(words, k=20))} {passage[rng.randint(0, 150) :]} {i}") for i in range(12)] + [(20, "z" * 900), (21, "z" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length in (140, 200):
        first = {}
        for i, t in rows:
            for p in range(len(t) - length + 1):
                first.setdefault(t[p : p + length], i)
        want = {}
        for i, t in rows:
            gone = {q for p in range(len(t) - length + 1) if first[t[p : p + length]] < i for q in range(p, p + length)}
            want[i] = (len(gone), hashlib.sha256("".join(c for q, c in enumerate(t) if q not in gone).encode()).hexdigest())
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicate(df, length).collect()} == want

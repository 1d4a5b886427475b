import random

import pytest

from tessellon.llm import bpe, token_counts


@pytest.fixture(scope="module")
def machine():
    return bpe.automaton(bpe.default_path())


def test_edits_count_as_if_encoded_anew(machine):
    rng = random.Random(3)
    pieces = [" it's", "'ll", "  ", "\n\n", " the", "12", "é", "日本", "!?", "\t", "x", " we've"]
    for _ in range(150):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 300)))
        tree = token_counts.TokenTree(text, machine)
        for _ in range(6):
            s = rng.randint(0, len(text) + 3)
            e = s + rng.choice([0, 1, 2, 5, 60])
            new = "".join(rng.choices(pieces, k=rng.choice([0, 1, 2, 200])))
            tree.edit(s, e, new)
            s = min(s, len(text))
            text = text[:s] + new + text[min(max(e, s), len(text)) :]
            assert tree.text == text
            assert tree.count == sum(len(machine.memo[w]) // 4 for w in bpe.split(text))
            assert tree.words == len(bpe.split(text))
            assert tree.root.chars == len(text)


def test_an_edit_encodes_few_words(machine):
    text = " word" * 20_000
    tree = token_counts.TokenTree(text, machine)
    tree.edit(50_000, 50_003, "zz")
    assert tree.encoded < 10 and tree.words == len(bpe.split(tree.text))


def test_many_edits_of_a_long_text(machine, monkeypatch):
    """Leaves come and go under small nodes; the sums stay those of the text, and few words are encoded anew."""
    monkeypatch.setattr(token_counts, "FAN", 3)
    monkeypatch.setattr(token_counts, "AHEAD", 4)
    rng = random.Random(9)
    text = "".join(rng.choices([" word", " it's", "\n\n", "  x", "ab", " 12", "é"], k=6000))
    tree = token_counts.TokenTree(text, machine)
    for k in range(120):
        s = rng.randint(0, len(text))
        e = s + rng.choice([0, 3, 40, 900])
        new = "".join(rng.choices(["'", " re", "\t\t", "zz", " 日本"], k=rng.choice([0, 1, 9, 400])))
        tree.edit(s, e, new)
        text = text[:s] + new + text[e:]
        assert tree.root.chars == len(text) and (k % 10 or tree.text == text)
        want = bpe.split(text)
        assert tree.words == len(want) and tree.count == sum(len(machine.memo[w]) // 4 for w in want)
    tree.edit(0, len(text), "")
    assert (tree.count, tree.words, tree.text) == (0, 0, "")
    tree.edit(0, 0, "a b")
    assert (tree.words, tree.text) == (2, "a b")


def test_cases(spark):
    rows = [(1, None, None), (2, "", []), (3, "a b", [{"start": 1, "end": 9, "text": "cc"}]), (3, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start long, end long, text string>>")
    got = {tuple(r) for r in token_counts.count_tokens(docs).collect()}
    assert (1, 0, 0, 0, 0, 0) in got and (2, 0, 0, 0, 0, 0) in got and (3, 2, 2, 2, 2, 0) in got
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    edits = spark.createDataFrame([(3, 1, 0, 1, "x"), (3, 2, 0, 1, "yy")], "doc_id long, seq int, start long, end long, text string")
    assert token_counts.attach_edits(docs, edits).filter("doc_id = 3").first()["edits"][1]["text"] == "yy"


def test_query(spark, sf):
    got = token_counts.op6_token_counts(spark, sf).toPandas().set_index("doc_id")
    machine = bpe.automaton(bpe.default_path())
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = r["text"] or ""
        n = len(t)
        assert got.loc[r["doc_id"], "n_tokens"] == sum(len(machine.memo[w]) // 4 for w in bpe.split(t))
        for s, size, new in ((n // 4, 40, ""), (n // 2, 0, token_counts.INSERTED), (3 * n // 4, 20, token_counts.REPLACED)):
            s = min(s, len(t))
            t = t[:s] + new + t[s + size :]
        assert got.loc[r["doc_id"], "n_tokens_after"] == sum(len(machine.memo[w]) // 4 for w in bpe.split(t))

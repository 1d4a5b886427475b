"""Edit-aware token counts.

A document's pre-split words stand, with their text, in the leaves of a segment tree whose nodes sum chars, tokens and
words; nodes have up to 2 * FAN children, so that leaves may come and go. An edit descends by char sums to the first
word that it may touch (words end at a place only after seeing up to CONTEXT chars beyond it), splits the changed text
anew from there until a boundary falls on an old one behind the edit, encodes just those words, puts leaves for them in
place of the leaves it went through and updates the sums above. From such a boundary on the old split holds, as the
pattern never looks back. Text away from the edit is neither read nor copied. Counts follow the byte-level vocabulary with special strings taken as ordinary text.

Defined cases: a null text counts as empty; null or empty edits change nothing; edits apply in the order listed, each
to the text as it then is, and places beyond the text are taken as its end (an end before its start as the start);
repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellon.llm.bpe import CACHE_WORDS, FAST_ONLY, FAST_SPLIT, SPLIT, MergeAutomaton, automaton, default_path, split

#: Words of a leaf when built, and the most before it is split; children of a node when built; chars beyond its end that
#: may decide a word; chars behind an edit that are looked at first.
LEAF, MOST, FAN, CONTEXT, AHEAD = 32, 96, 32, 2, 64


class Node:
    """kids: nodes, or the (chars, tokens) of a leaf's words; with the sums over them."""

    __slots__ = ("kids", "text", "chars", "tokens", "words", "leaves")

    def __init__(self, kids: list, text: str | None = None):
        self.kids, self.text = kids, text
        self.sum_up()

    def sum_up(self) -> None:
        kids = self.kids
        if self.text is not None:
            self.chars, self.tokens, self.words, self.leaves = len(self.text), sum([t for _, t in kids]), len(kids), 1
        else:
            self.chars, self.tokens = sum([k.chars for k in kids]), sum([k.tokens for k in kids])
            self.words, self.leaves = sum([k.words for k in kids]), sum([k.leaves for k in kids])

    def replace(self, lo: int, hi: int, new: list[Node]) -> None:
        """Puts new leaves in place of the leaves lo..hi under this inner node, and sums up along the way."""
        kids = self.kids
        if kids[0].text is not None:
            kids[lo:hi] = new
        else:
            i = before = 0
            while lo >= before + kids[i].leaves:
                before += kids[i].leaves
                i += 1
            j, behind = i, before
            while hi > behind + kids[j].leaves:
                behind += kids[j].leaves
                j += 1
            if i == j:
                kids[i].replace(lo - before, hi - before, new)
            else:
                kids[i].replace(lo - before, kids[i].leaves, new)
                kids[j].replace(0, hi - behind, [])
            touched = [kids[i]] if i == j else [kids[i], kids[j]]
            kids[i : j + 1] = [part for k in touched if k.kids for part in (parted(k.kids) if len(k.kids) > 2 * FAN else [k])]
        self.sum_up()


def parted(nodes: list[Node]) -> list[Node]:
    return [Node(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]


def tree_of(nodes: list[Node]) -> Node:
    while len(nodes) > 1:
        nodes = parted(nodes)
    return nodes[0] if nodes else Node([], "")


def leaves_of(words: list[tuple[int, int]], text: str) -> list[Node]:
    if not words:
        return []
    if len(words) <= MOST:
        return [Node(words, text)]
    out, at = [], 0
    for i in range(0, len(words), LEAF):
        part = words[i : i + LEAF]
        end = at + sum([c for c, _ in part])
        out.append(Node(part, text[at:end]))
        at = end
    return out


class TokenTree:
    def __init__(self, text: str, machine: MergeAutomaton):
        self.machine, self.encoded = machine, 0
        memo = machine.memo
        self.root = tree_of(leaves_of([(len(w), len(memo[w]) >> 2) for w in split(text)], text))

    @property
    def count(self) -> int:
        return self.root.tokens

    @property
    def words(self) -> int:
        return self.root.words

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self._from(0))

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf number, chars before it) of the leaf that holds the char at place, or the last one."""
        node, number, before = self.root, 0, 0
        while node.text is None:
            for k in node.kids[:-1]:
                if before + k.chars > place:
                    node = k
                    break
                before += k.chars
                number += k.leaves
            else:
                node = node.kids[-1]
        return number, before

    def _from(self, number: int, node: Node | None = None) -> Iterator[Node]:
        """The leaves from a number on."""
        node = node or self.root
        if node.text is not None:
            yield node
            return
        for k in node.kids:
            if number < k.leaves:
                yield from self._from(max(0, number), k)
            number -= k.leaves

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new."""
        n = self.root.chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if start == end and not new:
            return
        first, before = self._find(max(0, start - CONTEXT))
        more, held, old = self._from(first), [], ""

        def take(chars: int) -> str:
            """The text of further leaves with so many chars, or of all."""
            out = ""
            while len(out) < chars and (leaf := next(more, None)) is not None:
                held.append(leaf)
                out += leaf.text
            return out

        old = take(end - before + AHEAD)
        ended = len(old) < end - before + AHEAD
        start, end = start - before, end - before
        # From here on places count from the first leaf held; `window` is its text and what follows, after the edit.
        window = old[:start] + new + old[end:]
        delta, clean = len(new) - (end - start), start + len(new)
        leaf = word = at = 0
        while held[0].kids and word < len(held[0].kids) and at + held[0].kids[word][0] + CONTEXT <= start:
            at += held[0].kids[word][0]
            word += 1
        head = held[0].kids[:word]
        made, memo, behind, ahead = [], self.machine.memo, at, AHEAD
        pattern = FAST_SPLIT if FAST_ONLY.fullmatch(window, at) else SPLIT
        joined = False
        while not joined:
            m = pattern.match(window, at) if at < len(window) else None
            if m is None and ended:
                break
            if m is None or (m.end() + CONTEXT > len(window) and not ended):
                # What follows may decide where this word ends.
                ahead *= 2
                piece = take(ahead)
                ended = len(piece) < ahead
                window += piece
                pattern = FAST_SPLIT if FAST_ONLY.fullmatch(window, at) else SPLIT
                continue
            at = m.end()
            made.append((at - m.start(), len(memo[m[0]]) >> 2))
            while behind < at - delta and leaf < len(held):
                if word == len(held[leaf].kids):
                    leaf, word = leaf + 1, 0
                    continue
                behind += held[leaf].kids[word][0]
                word += 1
            joined = behind == at - delta and at >= clean
        self.encoded += len(made)
        if joined and leaf < len(held):
            tail, through = held[leaf].kids[word:], leaf + 1
            text = window[: sum([x.chars for x in held[:through]]) + delta]
        else:
            tail, through, text = [], len(held), window
        fresh = leaves_of(head + made + tail, text)
        if self.root.text is not None:
            self.root = tree_of(fresh)
            return
        self.root.replace(first, first + through, fresh)
        if len(self.root.kids) > 2 * FAN:
            self.root = tree_of(parted(self.root.kids))
        while self.root.text is None and len(self.root.kids) <= 1:
            self.root = self.root.kids[0] if self.root.kids else Node([], "")


EDIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())]))


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column `edits` from a table (id, seq, start, end, text), in the order of seq."""
    listed = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("e"))
    listed = listed.select(id_col, F.transform("e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["text"].alias("text"))).alias("edits"))
    return docs.drop("edits").join(listed, id_col, "left")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", path: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_tokens before the edits, n_words_after, n_tokens_after, n_reencoded words."""
    path = path or default_path()
    names = ["n_words", "n_tokens", "n_words_after", "n_tokens_after", "n_reencoded"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                texts = b.column(1).fill_null("").to_pylist()
                if len(machine.memo) > CACHE_WORDS:
                    machine.memo.clear()
                new = [w for w in set().union(*map(split, texts)) if w not in machine.memo]
                machine.memo.update(zip(new, machine.paths([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
                rows = []
                for text, edits in zip(texts, b.column(2).to_pylist(), strict=True):
                    tree = TokenTree(text, machine)
                    n, words = tree.count, tree.words
                    for e in edits or []:
                        if e:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    rows.append((words, n, tree.words, tree.count, tree.encoded))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return docs.select(id_col, text_col, edits_col).mapInArrow(run, schema)


#: Fixed values of the query's edit script: what it puts in.
INSERTED, REPLACED = " it's edited, 2 times.", "ÄB \n\n  c"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents counted, then counted again after three edits each: a cut at a quarter, words put in at the half,
    a stretch replaced at three quarters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))

    def one(start, size, text):
        return F.struct(F.floor(start).cast("long").alias("start"), (F.floor(start) + size).cast("long").alias("end"), F.lit(text).alias("text"))

    script = F.array(one(n / 4, 40, ""), one(n / 2, 0, INSERTED), one(n * 3 / 4, 20, REPLACED))
    return count_tokens(docs.withColumn("edits", script))

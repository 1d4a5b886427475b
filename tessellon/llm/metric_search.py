"""Exact top-k inner-product search with an M-tree.

Vectors of whole numbers are lifted into a metric space: with M the largest squared norm, x' = (x, sqrt(M - |x|^2)) and
q' = (q, 0) give |q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest lifted vectors are those of largest inner product. The
index is a forest: rows are dealt by hash into shards of bounded size (no key can be hot), and every shard is an M-tree
whose nodes are pages: a routing vector, its covering radius, its distance to the parent's routing vector, and in a
leaf the entries with their distances to the leaf's routing vector.

A query goes best first: nodes wait in order of their least possible distance; a child is skipped without a distance
computation when |d(q, parent) - d(child, parent)| already exceeds the k-th distance plus its radius, and a leaf's
entries likewise by their stored distances. Distances prune with a slack above rounding; scores are exact.

Blocks of queries meet shards (never rows all rows), each giving at most k per query, and the best k of all shards stay.
A shard's pages travel once to each block of queries; for the 8 MB of pages of 64 dimensions that a block receives it
searches QUERY_BLOCK queries. Where vectors have no clusters the bounds can prune little (README has the figures).

Defined cases: a vector that is null or has null or non-finite components takes no part; only vectors of equal length
are compared; ties go to the smaller id; fewer candidates than k give fewer rows; rows sharing an id are all
candidates, and k rows are given for the id; an empty table gives none. Scores beyond 64 bits saturate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a shard, entries of a leaf page, children of an inner page, queries of a block.
SHARD_ROWS, LEAF, FANOUT, QUERY_BLOCK = 16384, 32, 16, 8192
#: Most nodes that a search takes from its queue at a time.
AT_ONCE = 32
#: Inner products below this are exact in double precision.
EXACT = 2.0**53
PAGE_SCHEMA = "shard int, dims int, node int, parent int, leaf boolean, pivot binary, radius double, to_parent double, ids binary, vectors binary, to_pivot binary"


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))])


def _distances(points: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = points - p
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build_pages(ids: np.ndarray, x: np.ndarray, top: float) -> Iterator[dict]:
    """Bulk load: split by the nearest of some routing vectors until a page holds the rest; parents first."""
    points, count, rng = lift(x, top), 0, np.random.default_rng(len(ids))
    todo = [(np.arange(len(ids)), -1, None)]
    while todo:
        rows, parent, above = todo.pop()
        own = points[rows]
        centre = own[int(np.argmin(_distances(own, own.mean(0))))]
        far = _distances(own, centre)
        page = {"node": count, "parent": parent, "pivot": centre.tobytes(), "radius": float(far.max()), "to_parent": float(np.linalg.norm(centre - above)) if above is not None else 0.0}
        count += 1
        if len(rows) <= LEAF or far.max() == 0:
            yield page | {"leaf": True, "ids": ids[rows].tobytes(), "vectors": x[rows].tobytes(), "to_pivot": far.tobytes()}
            continue
        yield page | {"leaf": False, "ids": None, "vectors": None, "to_pivot": None}
        # Routing vectors drawn from the rows: clusters get theirs by their size, on this level or a lower one.
        fanout = min(FANOUT, max(2, -(-len(rows) // LEAF)))
        drawn = np.unique(own[rng.choice(len(rows), fanout, replace=False)], axis=0)
        if len(drawn) == 1:
            drawn = np.stack([centre, own[int(np.argmax(far))]])
        nearest = np.argmin(np.stack([_distances(own, r) for r in drawn]), axis=0)
        todo += [(rows[nearest == k], page["node"], centre) for k in np.unique(nearest)]


class Forest:
    """The pages of one shard, ready for search: the entries of all leaf pages lie in one array, page by page."""

    def __init__(self, pages: pd.DataFrame, dims: int):
        pages = pages.sort_values("node")
        self.pivot = np.stack([np.frombuffer(p, np.float64) for p in pages["pivot"]])
        self.radius, self.to_parent = pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
        parent = pages["parent"].to_numpy()
        self.children = {int(n): np.flatnonzero(parent == n) for n in np.unique(parent[parent >= 0])}
        leaves = pages[pages["leaf"]]
        self.ids = np.frombuffer(b"".join(leaves["ids"]), np.int64)
        self.vectors = np.frombuffer(b"".join(leaves["vectors"]), np.float64).reshape(len(self.ids), dims)
        self.to_pivot = np.frombuffer(b"".join(leaves["to_pivot"]), np.float64)
        end = np.cumsum([len(i) // 8 for i in leaves["ids"]]).tolist()
        self.leaf = dict(zip(leaves["node"].tolist(), zip([0, *end], end, strict=False), strict=True))
        #: Entries scored and routing vectors measured by all searches so far.
        self.scored = self.measured = 0
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def _scores(self, at: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.vectors[at] @ q).astype(np.int64)
        whole = [int(v) for v in q]
        return np.array([sum(a * int(b) for a, b in zip(whole, self.vectors[i].tolist(), strict=True)) for i in at], object)

    def search(self, own: int, q: np.ndarray, k: int, top: float) -> list[tuple[int, int]]:
        """The best (score, id) pairs, best first; the query's own id takes no part.

        Nodes are taken nearest first, one, then two, four, up to AT_ONCE at a time.
        """
        lifted, norm = np.append(q, 0.0), float(q @ q)
        slack = 1e-7 * (np.sqrt(norm + top) + 1.0)
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT
        best_score, best_id = np.zeros(0, np.int64 if exact else object), np.zeros(0, np.int64)
        reach, width = np.inf, 1
        d0 = float(np.linalg.norm(lifted - self.pivot[0]))
        queue = [(max(0.0, d0 - self.radius[0]), 0, d0)]
        while queue and queue[0][0] <= reach + slack:
            inner, leaves = [], []
            while queue and len(inner) + len(leaves) < width and queue[0][0] <= reach + slack:
                _, node, d = heapq.heappop(queue)
                (leaves if node in self.leaf else inner).append((node, d))
            width = min(AT_ONCE, 2 * width)
            if inner:
                kids = [self.children[n] for n, _ in inner]
                above = np.repeat([d for _, d in inner], [len(x) for x in kids])
                kids = np.concatenate(kids)
                kids = kids[np.abs(above - self.to_parent[kids]) - self.radius[kids] <= reach + slack]
                self.measured += len(kids)
                dist = _distances(self.pivot[kids], lifted)
                least = np.maximum(0.0, dist - self.radius[kids])
                near = least <= reach + slack
                for item in zip(least[near].tolist(), kids[near].tolist(), dist[near].tolist(), strict=True):
                    heapq.heappush(queue, item)
            if not leaves:
                continue
            spans = [self.leaf[n] for n, _ in leaves]
            at = np.concatenate([np.arange(s, e) for s, e in spans])
            d = np.repeat([d for _, d in leaves], [e - s for s, e in spans])
            at = at[(np.abs(d - self.to_pivot[at]) <= reach + slack) & (self.ids[at] != own)]
            self.scored += len(at)
            scores = self._scores(at, q, exact)
            if len(best_id) == k:
                keep = scores >= best_score[-1]
                at, scores = at[keep], scores[keep]
            best_score, best_id = np.concatenate([best_score, scores]), np.concatenate([best_id, self.ids[at]])
            order = np.lexsort((best_id, -best_score)) if exact else np.array(sorted(range(len(best_id)), key=lambda i: (-best_score[i], best_id[i])), np.int64)
            best_score, best_id = best_score[order[:k]], best_id[order[:k]]
            if len(best_id) == k:
                reach = float(np.sqrt(max(0.0, norm + top - 2 * float(best_score[-1]))))
        return list(zip(best_score.tolist(), best_id.tolist(), strict=True))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: v = floor(256 x)."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # rint of a floor stays in double: whole numbers beyond 64 bits keep their value.
    return vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.when(F.abs(c) < 1e15, F.floor(c * 256).cast("double")).otherwise(c * 256)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products among the other rows."""
    rows = whole_numbers(vectors, id_col, vector_col).withColumn("dims", F.size("v"))
    asked = whole_numbers(queries, id_col, vector_col).withColumn("dims", F.size("v"))
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("top")).first()
    n, top = int(stats["n"]), float(stats["top"] or 0.0)
    shards = max(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["v"].to_numpy()).astype(np.float64) if key[1] else np.zeros((len(group), 0))
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        pages = pd.DataFrame(build_pages(group["id"].to_numpy(np.int64)[order], x[order], top))
        return pages.assign(shard=np.int32(key[0]), dims=np.int32(key[1]))[["shard", "dims", "node", "parent", "leaf", "pivot", "radius", "to_parent", "ids", "vectors", "to_pivot"]]

    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")
    # Rows of one id are told apart by content, so that a repeated id is dealt out too.
    salt = F.when(F.lit(shards) == 1, F.lit(0)).otherwise(F.pmod(salt + F.pmod(F.xxhash64("v"), F.lit(shards)), F.lit(shards)).cast("int"))
    pages = rows.withColumn("shard", salt).groupBy("shard", "dims").applyInPandas(build, PAGE_SCHEMA)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    paged = pages.select("*", every)
    dealt = asked.select("id", "v", "dims", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(key: tuple, qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(ps):
            forest = Forest(ps, int(key[2]))
            for own, v in zip(qs["id"], qs["v"], strict=True):
                q = np.asarray(v, np.float64)
                out += [(own, i, min(max(s, -(2**63)), 2**63 - 1)) for s, i in forest.search(int(own), q, k, top)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ["shard", "block", "dims"]
    found = dealt.groupBy(*key).cogroup(paged.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

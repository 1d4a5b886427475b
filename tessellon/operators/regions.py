"""Regions: sets of cells of one level, as DataFrames.

A region is `pos` (dense form) or `lo, hi` (ranges form) of one system and level. Every verb is relational: equi-joins on
position, left_semi and left_anti, explodes of neighbour arrays and of ranges. Neighbour relations carry `slot`, the
counter-clockwise order of the ring.

At scale: no verb gathers rows in one task. Windows are partitioned by blocks of positions, with offsets of the blocks
added afterwards; a range join is turned into an equi-join of distinct positions on the block that holds both ends, and
one of the rows on the positions found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellon.systems.base import GridSystem, system

#: Positions of a block, in bits: windows and range joins work block by block.
BLOCK_BITS = 16


def _block(pos: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(pos, bits)


# --- scans ------------------------------------------------------------------------------------------------------


def level_region(spark: SparkSession, sys: str | GridSystem, level: int) -> DataFrame:
    return system(sys).levelgrid(spark, level)


def rootcells(spark: SparkSession, sys: str | GridSystem) -> DataFrame:
    """(pos, id) of the coarsest level, ascending."""
    s = system(sys)
    level = s.levels[0]
    grid = s.levelgrid(spark, level)
    return grid.select("pos", s.id_col(F.col("pos"), level).alias("id"))


def subtree(spark: SparkSession, sys: str | GridSystem, pos: int, level: int, to: int) -> DataFrame:
    """The descendants of one cell, as a single range (or, without ranges, as positions)."""
    import numpy as np

    s = system(sys)
    if s.has_sorted_subtrees:
        lo, hi = s.descendant_range(np.array([pos]), level, to)
        return spark.createDataFrame([(int(lo[0]), int(hi[0]))], "lo long, hi long")
    return descendants(spark.createDataFrame([(pos,)], "pos long"), s, level, to)


def partial(ids: DataFrame, sys: str | GridSystem, level: int, id_col: str = "id") -> DataFrame:
    """The region of a column of ids; an id that is no cell of the level raises."""
    s = system(sys)
    pos = s.pos_col(F.col(id_col), level)
    checked = F.when(pos.isNull(), F.raise_error(F.concat(F.lit(f"no {s.name} cell of level {level}: "), F.coalesce(F.col(id_col).cast("string"), F.lit("NULL"))))).otherwise(pos)
    return ids.select(checked.cast("long").alias("pos")).distinct()


# --- forms ------------------------------------------------------------------------------------------------------


def dense(region: DataFrame) -> DataFrame:
    """(pos) from either form."""
    if "pos" in region.columns:
        return region.select("pos")
    return region.select(F.explode(F.sequence("lo", "hi")).alias("pos"))


def compress(region: DataFrame, pos: str = "pos") -> DataFrame:
    """(lo, hi) of the maximal runs of consecutive positions, and `offset`, the cells before each.

    Gaps and islands within blocks, then runs that meet at block borders are joined: the window over the (few) runs of a
    block never holds more than the block, and the window over block borders sees two rows a block.
    """
    p = region.select(F.col(pos).cast("long").alias("pos")).distinct().withColumn("b", _block(F.col("pos")))
    w = Window.partitionBy("b").orderBy("pos")
    runs = p.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("b", "g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # A run continues the block before if that block ends in a run up to the border.
    ends = runs.select((F.col("b") + 1).alias("nb"), (F.col("hi") + 1).alias("nlo"))
    opened = runs.join(ends, (runs["b"] == ends["nb"]) & (runs["lo"] == ends["nlo"]), "left").select("b", "lo", "hi", F.col("nb").isNotNull().alias("continued"))
    # Blocks covered whole and continued chain runs over many blocks; only border runs take part in the chain.
    first = F.shiftleft(F.col("b"), BLOCK_BITS)
    last = F.shiftleft(F.col("b") + 1, BLOCK_BITS) - 1
    chained = opened.filter(F.col("continued") | (F.col("hi") == last))
    alone = opened.filter(~(F.col("continued") | (F.col("hi") == last))).select("lo", "hi")
    super_ = Window.partitionBy(F.shiftright("b", BLOCK_BITS)).orderBy("lo")
    chain = chained.withColumn("n", F.sum(F.when(F.col("continued") & (F.lag("hi").over(super_) + 1 == F.col("lo")), 0).otherwise(1)).over(super_))
    merged = chain.groupBy(F.shiftright("b", BLOCK_BITS).alias("s"), "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")
    # What still meets at a border of super-blocks (2^32 positions apart) is joined by a last small window.
    edge = (F.col("hi") + 1) % (1 << (2 * BLOCK_BITS)) == 0
    at_edge = merged.filter(edge | (F.col("lo") % (1 << (2 * BLOCK_BITS)) == 0))
    rest = merged.filter(~(edge | (F.col("lo") % (1 << (2 * BLOCK_BITS)) == 0)))
    few = Window.orderBy("lo")
    joined = at_edge.withColumn("n", F.sum(F.when(F.lag("hi").over(few) + 1 == F.col("lo"), 0).otherwise(1)).over(few)).groupBy("n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")
    del first
    return with_offsets(alone.unionByName(rest).unionByName(joined))


def with_offsets(ranges: DataFrame) -> DataFrame:
    """(lo, hi, offset): the number of cells in the ranges before.

    Counts are summed up in blocks of 2^16 positions, these in blocks of blocks, and so once more, so that no window holds
    more than 2^16 rows, whatever the number of ranges.
    """
    cells = F.col("hi") - F.col("lo") + 1
    names = [f"b{k}" for k in (1, 2, 3)]
    r = ranges.select("lo", "hi", *(F.shiftright("lo", k * BLOCK_BITS).alias(n) for k, n in enumerate(names, 1)))
    counts = r.groupBy(*names).agg(F.sum(cells).alias("n"))
    start = None
    for k, name in enumerate(names):
        # Within a block of the next size, the cells before each block of this one.
        above = names[k + 1 :]
        rows = counts.groupBy(name, *above).agg(F.sum("n").alias("n")) if k else counts
        w = (Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))).orderBy(name)
        before = rows.select(name, *above, (F.sum("n").over(w) - F.col("n")).alias(f"s{k}"))
        start = before if start is None else start.join(before.select(name, f"s{k}"), name)
    starts = start.select("b1", (F.col("s0") + F.col("s1") + F.col("s2")).alias("start"))
    w = Window.partitionBy("b1").orderBy("lo")
    within = r.withColumn("before", F.sum(cells).over(w) - cells)
    return within.join(starts, "b1").select("lo", "hi", (F.col("before") + F.col("start")).alias("offset"))


def prefers_ranges(region: DataFrame) -> bool:
    """Whether the ranges form is the smaller one: three times the runs are no more than the cells."""
    r = compress(dense(region)).agg(F.count("*").alias("runs"), F.sum(F.col("hi") - F.col("lo") + 1).alias("cells")).first()
    return 3 * r["runs"] <= (r["cells"] or 0)


def ranked(region: DataFrame) -> DataFrame:
    """(pos, rank): the 1-based place of every cell in the region."""
    runs = compress(dense(region))
    return runs.select(F.posexplode(F.sequence("lo", "hi")).alias("k", "pos"), "offset").select("pos", (F.col("offset") + F.col("k") + 1).alias("rank"))


def select_rank(region: DataFrame, ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """(rank, pos) of 1-based places in the region; places beyond it give no row."""
    return ranks.select(F.col(rank).alias("rank")).join(ranked(region), "rank").select("rank", "pos")


# --- hierarchy --------------------------------------------------------------------------------------------------


def children(region: DataFrame, sys: str | GridSystem, level: int) -> DataFrame:
    """(parent, pos) one level down."""
    s = system(sys)
    return region.select(F.col("pos").alias("parent"), F.explode(s.children_col(F.col("pos"), level)).alias("pos"))


def ancestors(region: DataFrame, sys: str | GridSystem, level: int, to: int) -> DataFrame:
    """(pos, ancestor): the universal roll-up key."""
    return region.select("pos", system(sys).ancestor_col(F.col("pos"), level, to).alias("ancestor"))


def descendants(region: DataFrame, sys: str | GridSystem, level: int, to: int) -> DataFrame:
    """(pos) of all descendants, ascending within each cell."""
    s = system(sys)
    if s.has_sorted_subtrees:
        r = s.descendant_range_col(F.col("pos"), level, to)
        return region.select(r.alias("r")).select(F.explode(F.sequence("r.lo", "r.hi")).alias("pos"))
    out = region.select("pos")
    for at in range(level, to):
        out = children(out, s, at).select("pos")
    return out


def expand(region: DataFrame, sys: str | GridSystem, level: int, to: int) -> DataFrame:
    """The region at a finer level; ranges stay ranges where subtrees are contiguous."""
    s = system(sys)
    if to < level:
        raise ValueError("a region expands to a finer level")
    if s.has_sorted_subtrees and "lo" in region.columns:
        a, b = (s.descendant_range_col(F.col(c), level, to) for c in ("lo", "hi"))
        return region.select(a["lo"].alias("lo"), b["hi"].alias("hi"))
    return descendants(dense(region), s, level, to)


def compact(region: DataFrame, sys: str | GridSystem, level: int) -> DataFrame:
    """(level, pos) with complete sibling groups replaced by their parent, over and over.

    One grouped count a level; what is promoted shrinks by the fan-out each time.
    """
    s = system(sys)
    at, out = dense(region).distinct(), []
    for k in range(level, s.levels[0], -1):
        groups = at.select("pos", s.ancestor_col(F.col("pos"), k, k - 1).alias("parent"))
        full = groups.groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") == F.size(s.children_col(F.col("parent"), k - 1))).select("parent")
        out.append(groups.join(full, "parent", "left_anti").select(F.lit(k).alias("level"), "pos"))
        at = full.select(F.col("parent").alias("pos"))
    out.append(at.select(F.lit(s.levels[0]).alias("level"), "pos"))
    return reduce(DataFrame.unionByName, out)


# --- set algebra ------------------------------------------------------------------------------------------------


def union(*regions: DataFrame) -> DataFrame:
    """Cells of any region of one level."""
    return reduce(DataFrame.unionByName, [dense(r) for r in regions]).distinct()


def union_levels(sys: str | GridSystem, sets: list[tuple[int, DataFrame]]) -> DataFrame:
    """(level, pos) of regions of several levels; cells that a coarser operand covers go."""
    s = system(sys)
    out = []
    ordered = sorted(sets, key=lambda x: x[0])
    for k, (level, region) in enumerate(ordered):
        own = dense(region).distinct()
        for coarse, other in ordered[:k]:
            if coarse < level:
                covered = dense(other).distinct().select(F.col("pos").alias("a"))
                own = own.withColumn("a", s.ancestor_col(F.col("pos"), level, coarse)).join(covered, "a", "left_anti").select("pos")
        out.append(own.select(F.lit(level).alias("level"), "pos"))
    return reduce(DataFrame.unionByName, out).distinct()


def concatenate(*regions: DataFrame) -> DataFrame:
    """(ordinal, pos) with repeats, in the order given: (region, place within it by position)."""
    parts = [r.select(F.struct(F.lit(k).alias("part"), F.col("pos").alias("at")).alias("ordinal"), "pos") for k, r in enumerate(map(dense, regions))]
    return reduce(DataFrame.unionByName, parts)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return dense(a).distinct().join(dense(b).distinct(), "pos", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return dense(a).distinct().join(dense(b), "pos", "left_anti")


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return dense(a).join(dense(b), "pos", "left_anti").isEmpty()


def split_ranges(ranges: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(block, lo, hi): ranges cut at block borders, so that ranges that meet share a block."""
    cutted = ranges.withColumn("block", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))))
    return cutted.select("block", F.greatest("lo", F.shiftleft("block", bits)).alias("lo"), F.least("hi", F.shiftleft(F.col("block") + 1, bits) - 1).alias("hi"))


def intersect_ranges(a: DataFrame, b: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(lo, hi) of the overlaps of two ranges forms: an equi-join on blocks with an overlap condition."""
    x = split_ranges(a, bits)
    y = split_ranges(b, bits).select("block", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return x.join(y, "block").filter("lo <= hi2 and lo2 <= hi").select(F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))


def in_ranges(data: DataFrame, ranges: DataFrame, pos: str = "pos", how: str = "left_semi", bits: int = BLOCK_BITS, unique: bool = False) -> DataFrame:
    """Rows of data whose position lies in a range: equi-joins, never a nested loop.

    how: left_semi, left_anti, or inner (then the ranges' other columns come along, a row for each range that holds it).
    A block may hold all rows, but no more than 2^bits positions: only distinct positions meet the ranges by block, and the
    rows meet these by position. unique: data has each position once, so that its rows can meet the ranges themselves.
    """
    extra = [c for c in ranges.columns if c not in ("lo", "hi")]
    cutted = ranges.withColumn("_b", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits)))).select("_b", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *extra)
    left = data if unique else data.select(F.col(pos).alias("_p")).distinct()
    at = F.col(pos if unique else "_p")
    on = (F.shiftright(at, bits) == F.col("_b")) & at.between(F.col("_lo"), F.col("_hi"))
    if unique:
        return left.join(cutted, on, how).drop("_b", "_lo", "_hi")
    held = left.join(cutted, on, "inner" if how == "inner" else "left_semi").drop("_b", "_lo", "_hi")
    return data.join(held, F.col(pos) == F.col("_p"), how).drop("_p")


# --- topology ---------------------------------------------------------------------------------------------------


def neighbour_relation(region: DataFrame, sys: str | GridSystem, level: int, connectivity: str = "vertex") -> DataFrame:
    """(pos, slot, nbr): one-rings exploded, slot counting counter-clockwise from 0."""
    return region.select("pos", F.posexplode(system(sys).one_ring_col(F.col("pos"), level, connectivity)).alias("slot", "nbr"))


def neighbors(region: DataFrame, sys: str | GridSystem, level: int, k: int = 1, connectivity: str = "vertex", clip: DataFrame | None = None) -> DataFrame:
    """(pos, slot, nbr) of rings 1..k, outward; clip keeps only members of a region (distance is the full level's)."""
    out = region.select("pos", F.posexplode(system(sys).neighbors_col(F.col("pos"), level, k, connectivity)).alias("slot", "nbr"))
    return out if clip is None else out.join(dense(clip).distinct().select(F.col("pos").alias("nbr")), "nbr", "left_semi").select("pos", "slot", "nbr")


def ring(region: DataFrame, sys: str | GridSystem, level: int, k: int, connectivity: str = "vertex", clip: DataFrame | None = None) -> DataFrame:
    """(pos, slot, nbr) of the cells at distance exactly k."""
    out = region.select("pos", F.posexplode(system(sys).ring_col(F.col("pos"), level, k, connectivity)).alias("slot", "nbr"))
    return out if clip is None else out.join(dense(clip).distinct().select(F.col("pos").alias("nbr")), "nbr", "left_semi").select("pos", "slot", "nbr")


def halo(region: DataFrame, sys: str | GridSystem, level: int, connectivity: str = "vertex") -> DataFrame:
    """(pos) of the cells outside that touch a member, each once; holes count."""
    own = dense(region).distinct()
    near = own.select(F.explode(system(sys).one_ring_col(F.col("pos"), level, connectivity)).alias("pos")).distinct()
    return near.join(own, "pos", "left_anti")


def _degrees(region: DataFrame, sys: str | GridSystem, level: int, connectivity: str) -> DataFrame:
    own = dense(region).distinct()
    members = own.select(F.col("pos").alias("nbr"), F.lit(1).alias("one"))
    return neighbour_relation(own, sys, level, connectivity).join(members, "nbr", "left").groupBy("pos").agg(F.count("*").alias("degree"), F.count("one").alias("inside"))


def border(region: DataFrame, sys: str | GridSystem, level: int, connectivity: str = "vertex") -> DataFrame:
    """(pos) of the members with a neighbour outside."""
    return _degrees(region, sys, level, connectivity).filter("inside < degree").select("pos")


def interior(region: DataFrame, sys: str | GridSystem, level: int, connectivity: str = "vertex") -> DataFrame:
    """(pos) of the members whose neighbours are all members."""
    return _degrees(region, sys, level, connectivity).filter("inside = degree").select("pos")


def grow(region: DataFrame, sys: str | GridSystem, level: int, n: int = 1, connectivity: str = "vertex") -> DataFrame:
    """The region and n rings about it."""
    if n < 0:
        raise ValueError("a region grows by a number of rings that is not negative")
    s, out = system(sys), dense(region).distinct()
    for _ in range(n):
        out = out.select(F.explode(F.concat(F.array("pos"), s.one_ring_col(F.col("pos"), level, connectivity))).alias("pos")).distinct()
    return out


def adjacency(region: DataFrame, sys: str | GridSystem, level: int, halo: int | str | DataFrame = 0, connectivity: str = "vertex") -> DataFrame:
    """(row, slot, index): the region's one-rings by 1-based places in the region.

    halo 0 drops neighbours outside; "mark" keeps them as index 0; 1 numbers the halo cells on behind the region; a
    region given as halo must be complete (its cells are numbered behind the region's, ascending).
    """
    own = ranked(region)
    rel = neighbour_relation(own.select("pos"), sys, level, connectivity).join(own.select("pos", F.col("rank").alias("row")), "pos")
    index = own.select(F.col("pos").alias("nbr"), F.col("rank").alias("index"))
    if isinstance(halo, int) and halo == 0:
        return rel.join(index, "nbr").select("row", "slot", "index")
    if isinstance(halo, str) and halo == "mark":
        return rel.join(index, "nbr", "left").select("row", "slot", F.coalesce("index", F.lit(0)).alias("index"))
    if isinstance(halo, int) and halo != 1:
        raise ValueError("halo is 0, 1, 'mark' or the region of halo cells")
    outside = _halo_of(region, sys, level, connectivity) if isinstance(halo, int) else dense(halo)
    n = own.agg(F.count("*")).first()[0]
    behind = ranked(outside).select(F.col("pos").alias("nbr"), (F.col("rank") + n).alias("index"))
    joined = rel.join(index.unionByName(behind), "nbr", "left")
    checked = F.when(F.col("index").isNull(), F.raise_error(F.lit("the halo given lacks a neighbour of the region"))).otherwise(F.col("index"))
    return joined.select("row", "slot", checked.cast("long").alias("index"))


_halo_of = halo


def csr(adjacency_rows: DataFrame) -> DataFrame:
    """(row, indices): each row's neighbours as an array in ring order."""
    return adjacency_rows.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "index"))), lambda x: x["index"]).alias("indices"))


def subtree_border_count(fan: str, depth: int) -> int:
    """Closed-form border sizes: a square subtree, a hexagon's, a pentagon's."""
    if depth == 0:
        return 1
    return {"square": 4 * 2**depth - 4, "hexagon": 3 ** (depth + 1) - 3, "pentagon": 5 * (3**depth - 1) // 2}[fan]

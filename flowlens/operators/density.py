"""Density clusters of every scale at once: dense cells of nested grids, a tree of them, and its most stable parts.

Each grid halves the width of the one before. A cell of min_rows rows is dense and dense cells that touch are one
cluster; what is dense or touches on a grid is or does on the coarser one, so clusters of all grids form a tree. Only
cells meet cells: rows are counted once, in the finest cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.graph import components
from flowlens.session import written

ROOT = -1  # the level of what holds all rows


def _name(node: Column) -> Column:
    return F.array_join(node, ",")


def on_all_grids(base: DataFrame, levels: int) -> DataFrame:
    """base (cell, ...) with `node`, level and cell, of each grid; cell is that of the finest."""
    every = base.withColumn("level", F.explode(F.array(*[F.lit(k).cast("long") for k in range(levels)])))
    shift = F.transform("cell", lambda x: F.floor(x / F.pow(F.lit(2.0), F.lit(levels - 1) - F.col("level"))).cast("long"))
    return every.withColumn("node", F.concat(F.array("level"), shift)).drop("level")


def nested_cells(base: DataFrame, levels: int, min_rows: int) -> DataFrame:
    """(node, n): the dense cells of all grids, over those of the finest (cell, n)."""
    return on_all_grids(base, levels).groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)


def cluster_tree(dense: DataFrame, dims: int, min_cluster: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, root) of dense cells, and (root, level, size, parent) of their clusters of min_cluster rows or more."""
    shifts = [F.concat(F.array(F.col("node")[0]), F.array(*[F.col("node")[k + 1] + F.lit(step) for k, step in enumerate(way)])) for way in product((-1, 0, 1), repeat=dims)]
    touching = dense.select("node", F.explode(F.array(*shifts)).alias("other")).where("node < other")
    linked = touching.join(dense.select(F.col("node").alias("other")), "other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = components(linked).withColumnRenamed("node", "__node")
    placed = written(dense.join(roots, F.col("node") == F.col("__node"), "left").select("node", "n", F.coalesce("root", "node").alias("root")), "density-cells")
    sizes = placed.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster)
    above = F.concat(F.array(F.col("root")[0] - 1), F.transform(F.slice("root", 2, dims), lambda x: F.floor(x / 2).cast("long")))
    owner = placed.select(F.col("node").alias("above"), F.col("root").alias("parent"))
    tree = sizes.withColumn("above", above).join(owner, "above", "left")
    return placed, written(tree.select("root", F.col("root")[0].alias("level"), "size", F.coalesce("parent", F.array(F.lit(ROOT).cast("long"))).alias("parent")), "density-tree")


def condensed(tree: DataFrame, levels: int) -> DataFrame:
    """(root, level, size, id, over): a cluster that alone continues its parent keeps its id; else its root names a new
    one. over: the ids above it, the nearest last."""
    siblings = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings"))
    tree = written(tree.join(siblings, "parent"), "density-siblings")
    nobody = F.array().cast("array<array<bigint>>")
    above = tree.sparkSession.range(1).select(F.array(F.lit(ROOT).cast("long")).alias("parent"), F.array(F.lit(ROOT).cast("long")).alias("parent_id"), nobody.alias("parent_over"))
    found = []
    for level in range(levels):
        alone = F.col("siblings") == 1
        own = tree.where(F.col("level") == level).join(above, "parent")
        named = own.select("root", "level", "size", F.when(alone, F.col("parent_id")).otherwise(F.col("root")).alias("id"), F.when(alone, F.col("parent_over")).otherwise(F.concat("parent_over", F.array("parent_id"))).alias("over"))
        found.append(written(named, "density-level"))
        above = found[-1].select(F.col("root").alias("parent"), F.col("id").alias("parent_id"), F.col("over").alias("parent_over"))
    return reduce(DataFrame.unionByName, found)


def stable(chain: DataFrame, levels: int, single: bool = False) -> DataFrame:
    """(id, birth, stability): the clusters that are more stable than those within them, none within another.

    Density is one over the width, in units of the coarsest: a cluster gains its rows times what density grows by at
    each grid (excess of mass). Without `single`, what holds all rows isn't chosen.
    """
    gain = F.when(F.col("level") == 0, F.lit(1)).otherwise(F.expr("shiftleft(1L, cast(level - 1 as int))"))
    ids = written(chain.groupBy("id").agg(F.min("level").alias("birth"), F.sum(F.col("size") * gain).alias("stability"), F.first("over").alias("over")), "density-ids")
    scored = None
    for level in range(levels - 1, -1, -1):
        own = ids.where(F.col("birth") == level)
        if scored is None:
            now = own.withColumn("within", F.lit(0).cast("long"))
        else:
            within = scored.select(F.element_at("over", -1).alias("id"), "score").where("id is not null").groupBy("id").agg(F.sum("score").alias("within"))
            now = own.join(within, "id", "left").withColumn("within", F.coalesce("within", F.lit(0)))
        eligible = F.lit(True) if single else F.col("id")[0] != ROOT
        now = now.withColumn("chosen", eligible & (F.col("stability") >= F.col("within")))
        now = written(now.withColumn("score", F.when(F.col("chosen"), F.col("stability")).otherwise(F.col("within"))).drop("within"), "density-scores")
        scored = now if scored is None else scored.unionByName(now)
    chosen = scored.where("chosen")
    inside = chosen.select("id", F.explode("over").alias("outer")).join(chosen.select(F.col("id").alias("outer")), "outer", "left_semi").select("id").distinct()
    return chosen.join(inside, "id", "left_anti").select("id", "birth", "stability")


def hierarchical_clusters(rows: DataFrame, key: str, at: list[str], widest: float = 4.0, levels: int = 7, min_rows: int = 5, min_cluster: int = 25, single: bool = False) -> DataFrame:
    """(key, cluster, size, width, stability), a row per row: the most stable density cluster that a row is in, however
    dense others are; noise is '-1' with size 0 and nulls.

    at: the columns that span the space. widest, levels: the coarsest grid's width, and how many grids there are; min_rows:
    what makes a cell dense; min_cluster: smaller clusters are rows that fall out of theirs. A cluster's rows are those of
    its cells on the grid where it splits off, of that width. Rows with a null or NaN are noise; equal rows count each.
    single: a space of one cluster has that, instead of none.

    A crowded cell is one cell. Clusters are at most rows / min_cluster a grid; their tree is a table of `levels` steps.
    """
    finest = widest / 2 ** (levels - 1)
    whole = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in at]
    cell = F.array(*[F.floor(v / finest).cast("long") for v in whole])
    placed = written(rows.select(key, F.when(~F.exists(cell, lambda x: x.isNull()), cell).alias("cell")), "density-rows")
    base = written(placed.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "density-base")
    dense = written(nested_cells(base, levels, min_rows), "density-dense")
    cells, tree = cluster_tree(dense, len(at), min_cluster)
    chain = condensed(tree, levels)
    picked = chain.join(stable(chain, levels, single), "id").where("level = birth").select("root", "id", "birth", "size", "stability")
    inside = written(cells.join(picked, "root").select("node", _name(F.col("id")).alias("cluster"), "birth", "size", "stability"), "density-picked")
    known = on_all_grids(base.select("cell"), levels).join(inside, "node").drop("node")
    width = (F.lit(widest) / F.pow(F.lit(2.0), F.col("birth"))).alias("width")
    return placed.join(written(known, "density-known"), "cell", "left").select(key, F.coalesce("cluster", F.lit("-1")).alias("cluster"), F.coalesce("size", F.lit(0)).alias("size"), width, "stability")

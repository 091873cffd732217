"""Graphs as DataFrames: components, spread, neighbourhoods, centrality. Vertices are strings or numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.session import cut, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) with the least node it can reach.

    Nodes whose only neighbour is a lesser one have that one's root, so they are set aside, and each round works on what
    is left: small components go at once. Every round a node's larger neighbours, then its smaller ones, move to its least
    neighbour, so paths halve and rounds grow with the logarithm of the longest one. Minima combine before the shuffle, and
    are written before they meet the edges again: where they are few, Spark broadcasts them and a hub's edges stay where
    they are; else the edges go to a join whose large keys AQE splits.
    """

    def hang(directed: DataFrame, above: bool) -> DataFrame:
        least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = written(least, "least")
        met = directed.join(least, "u")
        if above:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    state, below = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "components"), []
    while True:
        # a node's lesser neighbours, the least and the largest, and whether it has larger ones
        sides = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.lit(None).cast(state.schema["v"].dataType).alias("v")))
        nodes = sides.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("most"), F.bool_or(F.col("v").isNull()).alias("above")).where("v is not null")
        nodes = written(nodes.select("u", "v", (~F.col("above") & (F.col("v") == F.col("most"))).alias("leaf")), "nodes")
        below.append(nodes.where("leaf").select("u", "v"))
        core = state.join(nodes.where("not leaf").select("u"), "u", "left_semi")
        core = written(core.distinct() if len(below) == 1 else core, "components")
        if core.isEmpty():
            break
        state = written(hang(hang(core.unionByName(core.select(F.col("v").alias("u"), F.col("u").alias("v"))), True), False), "components")
    found = None
    for leaves in reversed(below):
        tops = leaves.select("v").distinct()
        if found is None:
            found = leaves.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops.select(F.col("v").alias("node"), F.col("v").alias("root")))
            continue
        found = written(found, "roots")
        known = found.withColumnRenamed("node", "v")
        hung = leaves.join(known, "v", "left").select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root"))
        alone = tops.join(known, "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("root"))
        found = found.unionByName(hung).unionByName(alone)
    return found


def co_spend_edges(utxo: DataFrame, mixes: DataFrame | None = None, once: bool = True) -> DataFrame:
    """Each transaction's inputs as a star around its first one, so n addresses give n - 1 edges.

    Whoever spends from several addresses owns them all; what a transaction pays to tells nothing of that. mixes (txid):
    transactions of several owners, which are left out. once: each edge once, which components don't need.
    """
    alone = utxo if mixes is None else utxo.join(mixes.select("txid"), "txid", "left_anti")
    pairs = alone.select(F.get("inputs", F.lit(0)).alias("a"), F.explode("inputs").alias("b")).where("a <> b")
    return pairs.distinct() if once else pairs


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 3, hub: int = 200, decay: float = 0.5) -> DataFrame:
    """(entity, seed, hops, direction, parent, risk): what seeds (column entity) reach along edges, or against them.

    A walk keeps its direction and doesn't leave a hub. An entity goes to its nearest seed; of several, to the least
    by seed, direction and parent.
    """
    both = edges.select("src", "dst", F.lit("down").alias("direction")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("up").alias("direction")))
    degree = both.groupBy(F.col("src").alias("entity")).agg(F.count_distinct("dst").alias("n")).where(F.col("n") >= hub).select("entity")
    reached = seeds.select("entity", F.col("entity").alias("seed"), F.lit(0).alias("hops"), F.lit("seed").alias("direction"), F.lit(None).cast("string").alias("parent"))
    level = reached
    for hop in range(1, hops + 1):
        go = level.join(degree, "entity", "left_anti").withColumnRenamed("direction", "way")
        step = go.join(both, (F.col("entity") == F.col("src")) & ((F.col("way") == "seed") | (F.col("way") == F.col("direction"))))
        new = step.select(F.col("dst").alias("entity"), "seed", F.lit(hop).alias("hops"), "direction", F.col("src").alias("parent")).join(reached.select("entity"), "entity", "left_anti")
        best = W.partitionBy("entity").orderBy("seed", "direction", "parent")
        level = cut(new.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n"))
        reached = reached.unionByName(level)
    return reached.withColumn("risk", F.pow(F.lit(decay), F.col("hops")))


def khop(edges: DataFrame, seeds: DataFrame, hops: int = 2, cap: int = 1500) -> DataFrame:
    """(entity, hop, capped) within so many undirected steps, seeds counted, and whether the cap left any out.

    Where a step would pass the cap, the neighbours with most value stay; a top-k, so no task sorts them all.
    """
    both = edges.select("src", "dst", "value").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))
    reached = seeds.select("entity", F.lit(0).alias("hop"))
    level, n, capped = reached, seeds.count(), False
    for hop in range(1, hops + 1):
        new = level.join(both, F.col("entity") == F.col("src")).groupBy(F.col("dst").alias("entity")).agg(F.sum("value").alias("value"))
        room = max(0, cap - n)
        found = cut(new.join(reached.select("entity"), "entity", "left_anti").orderBy(F.col("value").desc(), "entity").limit(room + 1))
        size = found.count()
        capped |= size > room
        level = cut(found.orderBy(F.col("value").desc(), "entity").limit(room).select("entity", F.lit(hop).alias("hop")))
        n += min(size, room)
        reached = reached.unionByName(level)
    return reached.withColumn("capped", F.lit(capped))


def degrees(edges: DataFrame) -> DataFrame:
    """entity, degree_out, degree_in, wdegree_out, wdegree_in."""
    sides = edges.select(F.col("src").alias("entity"), "value", F.lit(True).alias("out")).unionByName(edges.select(F.col("dst").alias("entity"), "value", F.lit(False).alias("out")))
    out = F.col("out")
    return sides.groupBy("entity").agg(
        F.count_if(out).alias("degree_out"), F.count_if(~out).alias("degree_in"),
        F.coalesce(F.sum(F.when(out, F.col("value"))), F.lit(0)).alias("wdegree_out"), F.coalesce(F.sum(F.when(~out, F.col("value"))), F.lit(0)).alias("wdegree_in"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """entity, degree, triangles, coefficient.

    Edges point from the smaller degree to the larger, so a hub opens no wedges of its own: wedges grow with
    edges to the power 1.5 at most, whatever the largest degree.
    """
    pairs = cut(undirected(edges))
    ends = pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity")))
    degree = ends.groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))
    ranked = pairs.join(degree.select(F.col("entity").alias("a"), F.col("degree").alias("da")), "a").join(degree.select(F.col("entity").alias("b"), F.col("degree").alias("db")), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    way = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = way.alias("p").join(way.alias("q"), F.expr("p.x = q.x and p.y < q.y")).select("p.x", F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = wedges.join(pairs, ["a", "b"])
    hits = closed.select(F.explode(F.array("x", "a", "b")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("triangles"))
    joined = degree.join(hits, "entity", "left").na.fill(0, ["triangles"])
    possible = F.col("degree") * (F.col("degree") - 1)
    return joined.withColumn("coefficient", F.when(possible > 0, F.round(2 * F.col("triangles") / possible, 6)).otherwise(F.lit(0.0)))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(entity, rank) after so many rounds over edge values; a dead end spreads its rank evenly."""
    nodes = cut(edges.select(F.col("src").alias("entity")).unionByName(edges.select(F.col("dst").alias("entity"))).distinct())
    n = nodes.count()
    paid = cut(edges.groupBy("src").agg(F.sum("value").alias("paid")))  # combined before the shuffle, so a hub's edges stay apart
    share = cut(edges.join(paid, "src").select("src", "dst", (F.col("value") / F.col("paid")).alias("w")))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        got = share.join(rank, F.col("src") == F.col("entity")).groupBy(F.col("dst").alias("entity")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        flowing = got.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("all"))
        rank = nodes.join(got, "entity", "left").join(F.broadcast(flowing)).select("entity", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + (1 - F.col("all")) / n)).alias("rank"))
        rank = cut(rank)
    return rank


def core_numbers(edges: DataFrame) -> DataFrame:
    """(entity, core): the largest k such that the entity is in a part where all have k neighbours.

    Estimates fall from the degree to the h-index of the neighbours' estimates until none changes.
    """
    pairs = undirected(edges)
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    core = cut(both.groupBy(F.col("a").alias("entity")).agg(F.count(F.lit(1)).alias("core")))
    while True:
        seen = both.join(core.withColumnRenamed("entity", "b").withColumnRenamed("core", "nb"), "b").groupBy("a", "nb").agg(F.count(F.lit(1)).alias("n"))
        at_least = F.sum("n").over(W.partitionBy("a").orderBy(F.col("nb").desc()))
        h = seen.withColumn("h", F.least("nb", at_least)).groupBy(F.col("a").alias("entity")).agg(F.max("h").alias("h"))
        new = cut(core.join(h, "entity").select("entity", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("fell")))
        if new.where("fell").isEmpty():
            return new.drop("fell")
        core = new.drop("fell")


def pivots_of(edges: DataFrame, most: int = 400) -> DataFrame:
    """(entity): all vertices, or so many of them by a hash, a top-k."""
    ends = edges.select(F.col("src").alias("entity")).unionByName(edges.select(F.col("dst").alias("entity"))).distinct()
    return ends.orderBy(F.xxhash64("entity"), "entity").limit(most)


def betweenness(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """(entity, betweenness): how many shortest paths from the pivots (column entity, a bounded sample) pass through,
    scaled to all entities and rounded to four digits.

    All pivots walk at once, a level a round until none is left: forwards the numbers of shortest paths, backwards the
    shares that depend on an entity.
    """
    ways = cut(edges.where("src <> dst").select("src", "dst").distinct())
    n = ways.select(F.col("src").alias("v")).unionByName(ways.select(F.col("dst").alias("v"))).distinct().count()
    level = cut(pivots.select(F.col("entity").alias("pivot"), F.col("entity").alias("v"), F.lit(1.0).alias("paths")))
    levels, k = [level], level.count()
    seen = level.select("pivot", "v")
    while True:
        step = level.join(ways, F.col("v") == F.col("src")).groupBy("pivot", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = cut(step.join(seen, ["pivot", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("pivot", "v"))
    below, shares = None, []
    for level in reversed(levels[1:]):
        own = level.withColumn("share", F.lit(0.0)) if below is None else level.join(below, ["pivot", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        own = cut(own)
        shares.append(own.select("v", "share"))
        above = levels[levels.index(level) - 1]
        # along the ways that the walk took; all ways that come to an entity would be far more
        gone = above.join(ways, F.col("v") == F.col("src")).select("pivot", "src", "dst", "paths")
        met = gone.join(own.select("pivot", F.col("v").alias("dst"), F.col("paths").alias("q"), "share"), ["pivot", "dst"])
        below = met.groupBy("pivot", F.col("src").alias("v")).agg(F.sum(F.col("paths") / F.col("q") * (1 + F.col("share"))).alias("share"))
    nodes = ways.select(F.col("src").alias("v")).unionByName(ways.select(F.col("dst").alias("v"))).distinct()
    total = nodes.withColumn("share", F.lit(0.0))
    for part in shares:
        total = total.unionByName(part)
    return total.groupBy(F.col("v").alias("entity")).agg(F.round(F.sum("share") * n / k, 4).alias("betweenness"))

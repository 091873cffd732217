"""Near-dedup by the true Jaccard similarity of word shingles.

At a similarity of 0.8, fingerprints of 64 bits differ in some 9 bits, which deletion variants can't find. They are used
for what they do find: of the representatives of those that share a segment of its SimHash, or two of its least hashes,
each set is compared with the one whose SimHash is nearest, and verified links to them give groups of close copies.
Groups that share keys are then compared by one member each. What remains is found by a set-similarity join over
prefixes. If two sets have Jaccard j or more, then under any one order of all shingles they share one of their
first |x| - ceil(j |x|) + 1, and m of their first |x| - ceil(j |x|) + m. Only these are keys, and pairs of one group
don't meet; every pair that shares enough is verified on the whole sets, so no link between groups at j or more is
missed and none below it is made. Before a pair is told of, bitmaps of both sets' parities are compared: they differ in
no more bits than the sets in shingles, so a pair that differs in more than j allows is none. The order puts shingles that a sample finds common last: that spares crowded keys, and
doesn't bear on the result. Texts with one set are one class before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import simhash
from flowlens.llm.common import sieve, small_batches, written
from flowlens.llm.simhash import GONE, HOT, across, across_hot, least_of_each, segments, shingles
from flowlens.operators.graph import components
from flowlens.session import drop_scratch, laid_out, scratch_count

#: Words of a shingle, and the least Jaccard similarity of near copies as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Keys that a pair must share before its sets are compared: one for so many shingles.
EACH = 25
#: Pairs of least hashes under which a set meets representatives, and the differing bits from which on it doesn't.
BANDS, APART = 4, 17
#: Longs of a set's bitmap, and of the wider one that sets larger than LARGE have as well; a pair's keys tell it of sets larger than LARGER.
LONGS, WIDE, LARGE, LARGER = 16, 64, 400, 800
#: Pairs of members of two groups from which on one pair is tried first.
MANY = 16
#: Texts sampled for common shingles, and the most shingles that the order takes from them.
SAMPLE, COMMON = 5000, 50_000


def shingle_set(text: str | None, words: int = WORDS):
    """The distinct hashes of the text's word shingles, sorted, as signed longs."""
    import numpy as np

    parts = [np.unique(p) for p in shingles(text, words)[1]]
    return np.unique(np.concatenate(parts)).view("<i8") if parts else np.zeros(0, dtype="<i8")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield pd.Series([shingle_set(t) for t in text], dtype=object)


def common_shingles(docs: DataFrame, text_col: str) -> dict[int, int]:
    """Shingles of several sampled texts, with how many."""
    n = docs.count()
    some = docs.select(text_col) if n <= SAMPLE else docs.select(text_col).sample(SAMPLE / n, 42)
    each = some.distinct().select(F.explode(_sets(F.col(text_col))).alias("h")).groupBy("h").count().where("count > 2")
    return {r["h"]: r["count"] for r in each.orderBy(F.desc("count"), "h").limit(COMMON).collect()}


def parities(own, longs: int):
    """A bitmap of so many longs: for each remainder of the hashes, whether an odd number of them has it."""
    import numpy as np

    odd = np.bincount(own.view("<u8") & np.uint64(64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signatures(common: dict[int, int]):
    """What a text is indexed by: fp and size of its set, meet, the prefix, the SimHash of the set, its bands, its bitmap."""
    import numpy as np

    known = np.array(sorted(common), dtype="<i8")
    counts = np.array([common[h] for h in known.tolist()], dtype=np.int64)
    least, most = SIMILAR
    factors = np.random.default_rng(5).integers(1 << 62, size=2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def one(text):
        import xxhash

        own = shingle_set(text)
        if not len(own):
            return 0, 0, 0, [], 0, [0] * BANDS, [0] * LONGS, []
        rank = np.zeros(len(own), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            rank = np.where(known[at] == own, counts[at], 0)
        meet = max(1, len(own) // EACH)
        length = len(own) - -(-least * len(own) // most) + meet
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        sim = np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0]
        lows = np.array([(own.view("<u8") * f).min() for f in factors]).reshape(BANDS, 2)
        bands = (lows[:, 0] ^ (lows[:, 1] * np.uint64(0x9E3779B97F4A7C15))).view("<i8")
        fp = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).astype("<i8")
        wide = parities(own, WIDE) if len(own) > LARGE else []
        return fp, len(own), meet, own[np.lexsort((own, rank))[:length]], sim, bands, parities(own, LONGS), wide

    @F.pandas_udf("fp long, size int, meet int, prefix array<long>, sim long, bands array<long>, bits array<long>, wide array<long>")
    def signatures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            frame = pd.DataFrame([one(t) for t in text], columns=["fp", "size", "meet", "prefix", "sim", "bands", "bits", "wide"])
            yield frame.astype({"fp": "int64", "size": "int32", "meet": "int32", "sim": "int64"})

    return signatures


def nearest(classes: DataFrame) -> DataFrame:
    """(a, b): for each class b (fp, n, size, sim, bands) the representative a of its keys with the nearest SimHash, where
    it may be similar. A key's representative is the class that shares all its keys with most: the middle of a group."""
    least, most = SIMILAR
    keys = F.explode(F.concat(F.array(*segments(F.col("sim"))), "bands"))
    keyed = classes.where("size > 0").select(keys.alias("key"), "fp", "n", "size", "sim")
    crowd = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "similar-crowd")
    keyed = written(keyed.join(crowd, "key"), "similar-crowded")
    middle = keyed.join(written(keyed.groupBy("fp").agg(F.sum("rows").alias("others")), "similar-others"), "fp")
    heads = middle.groupBy("key").agg(F.max_by(F.struct("fp", "size", "sim"), F.struct("others", "n", "fp")).alias("head"))
    met = keyed.join(written(heads, "similar-heads"), "key").where("fp <> head.fp").withColumn("bits", F.bit_count(F.col("sim").bitwiseXOR(F.col("head.sim"))))
    fitting = (F.least("size", "head.size") * most >= F.greatest("size", "head.size") * least) & (F.col("bits") < APART)
    return met.where(fitting).groupBy(F.col("fp").alias("b")).agg(F.min_by("head.fp", F.struct("bits", "head.fp")).alias("a")).select("a", "b")


def within_bits(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the pairs of classes of different roots whose SimHashes differ in few bits, by op7's deletion variants."""
    sims = written(classes.where("size > 0").select("fp", "sim").join(roots, "fp"), "similar-sims")
    keys = sims.select(F.explode(F.array(*segments(F.col("sim")))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    return simhash.links(sims, hot=simhash.hot_variants(written(keys, "similar-segments")), sim="sim")


def shared_keys(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, fp, pos, weight, hot, root, size, meet): the prefix keys that several roots share, with all their classes.

    Keys that the same classes have, as those of a passage have, are told of as one: weight is their number, pos the least place.
    """
    keyed = classes.select(F.posexplode("prefix").alias("pos", "key"), "fp")
    ends = keyed.join(roots, "fp").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    shared = written(ends.where("low <> high").select("key"), "similar-keys")
    rows = written(keyed.join(shared, "key"), "similar-keyed")
    own = F.xxhash64(F.bit_xor("fp"), F.bit_xor(F.xxhash64("fp")), F.count(F.lit(1)))
    lists = rows.groupBy("key").agg(own.alias("list"), (F.count(F.lit(1)) >= HOT).alias("hot"))
    each = rows.join(lists, "key").groupBy(F.col("list").alias("key"), "fp").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("weight"), F.bool_or("hot").alias("hot"))
    return written(each.join(classes.select("fp", "size", "meet").join(roots, "fp"), "fp"), "similar-rows")


def group_pairs(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): of each two groups of several members that share keys, the pair of members that stand for them in most.

    In a key each root has one member, and they meet that of the key's largest root only.
    """
    sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "similar-groups")
    # of two sizes whose product is MANY, one is its root at least: other keys have no such pair
    large = written(rows.join(sizes.where(F.col("members") * F.col("members") >= MANY), "root").select("key").distinct(), "similar-large")
    heads = rows.join(large, "key", "left_semi").groupBy("key", "root").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).join(sizes, "root", "left").na.fill(1, ["members"])
    heads = written(heads, "similar-members")
    main = heads.groupBy("key").agg(F.max_by(F.struct("root", "head", "members"), F.struct("n", "head")).alias("main"))
    met = heads.join(main, "key").where((F.col("root") != F.col("main.root")) & (F.col("members") * F.col("main.members") >= MANY))
    pair = F.struct(F.least("head", "main.head").alias("a"), F.greatest("head", "main.head").alias("b")).alias("pair")
    per = met.groupBy(F.least("root", "main.root").alias("r"), F.greatest("root", "main.root").alias("t"), pair).agg(F.sum("weight").alias("count"))
    return per.groupBy("r", "t").agg(F.max_by("pair", F.struct("count", "pair")).alias("pair")).select("pair.a", "pair.b")


def candidates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of classes of different roots that share keys enough, at places that allow enough in
    common, and whose bitmaps allow it, from shared_keys."""
    least, most = SIMILAR
    bits = [F.col("bits")[k].alias(f"b{k}") for k in range(LONGS)]
    wide = F.when(F.col("size") > LARGER, F.col("wide")).otherwise(F.array().cast("array<bigint>")).alias("wide")
    rows = laid_out(rows.join(classes.select("fp", *bits, wide), "fp"), "similar-mapped", "key")
    due = F.least("a.meet", "b.meet")
    rest = F.least(F.expr("a.size - a.pos"), F.expr("b.size - b.pos"))
    enough = (rest + due - 1) * (least + most) >= (F.col("a.size") + F.col("b.size")) * least
    may = (F.col("a.size") + F.col("b.size")) * (most - least)
    enough &= reduce(add, (F.bit_count(F.col(f"a.b{k}").bitwiseXOR(F.col(f"b.b{k}"))) for k in range(LONGS))) * (least + most) <= may
    both = (F.size("a.wide") > 0) & (F.size("b.wide") > 0)
    enough &= ~both | (_differing("a.wide", "b.wide") * (least + most) <= may)
    more = (F.least("a.weight", "b.weight").alias("weight"), due.alias("due"))
    met = across(rows.where("not hot"), enough, *more).unionByName(across_hot(rows.where("hot"), enough, *more))
    return met.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("due").alias("due")).where("weight >= due").select("a", "b")

def _differing(x: str, y: str):
    """In how many bits two bitmaps differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes (fp, id, mark) whose whole shingle sets are similar."""
    least, most = SIMILAR
    for side, wide, size in (("a", "u", "m"), ("b", "v", "n")):
        pairs = pairs.join(classes.select(F.col("fp").alias(side), F.col("wide").alias(wide), F.col("size").alias(size)), side)
    small = (F.size("u") == 0) | (F.size("v") == 0)
    pairs = written(pairs.where(small | (_differing("u", "v") * (least + most) <= (F.col("m") + F.col("n")) * (most - least))).select("a", "b"), "similar-pairs")
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    spots = written(classes.select("fp", F.col("id").alias("own_id"), F.col("mark").alias("own_mark")).join(nodes, "fp", "left_semi"), "similar-nodes")
    # only texts that may be among them are laid out
    some, _ = sieve(docs, F.xxhash64(text_col), written(spots.select("own_mark").distinct(), "similar-marks"))
    texts = some.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    texts = texts.join(spots, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    sets = written(texts.select("fp", _sets(F.col("text")).alias("own")).dropDuplicates(["fp"]), "similar-sets")
    # sets that very many are compared with go by themselves: they are few, so most likely broadcast
    often = written(pairs.groupBy("a").count().where(F.col("count") >= HOT).select(F.col("a").alias("fp")), "similar-often")
    shared = F.size(F.array_intersect("x", "y")) * (least + most)
    b = sets.select(F.col("fp").alias("b"), F.col("own").alias("y"))

    def compared(some: DataFrame) -> DataFrame:
        return pairs.join(some.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(b, "b").where(shared >= (F.size("x") + F.size("y")) * least).select("a", "b")

    if often.isEmpty():
        return compared(sets)
    return compared(sets.join(often, "fp", "left_anti")).unionByName(compared(written(sets.join(often, "fp", "left_semi"), "similar-some")))


def _roots(nodes: DataFrame, linked: DataFrame, name: str) -> DataFrame:
    """(fp, root) of all nodes (fp), in components of the links (a, b)."""
    found = written(components(linked), f"{name}-found")
    return written(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), name)


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between classes (fp, id, mark, n, size, meet, prefix, sim, bands, bits, wide) that connect all that are similar,
    directly or through others."""

    def check(pairs: DataFrame, name: str) -> DataFrame:
        begun = scratch_count()
        found = written(verified(pairs, docs, classes, id_col, text_col), name)
        drop_scratch(docs.sparkSession, begun, keep=name)
        return found

    near = check(nearest(classes), "similar-near")
    close = check(within_bits(classes, _roots(classes.select("fp"), near, "similar-first")), "similar-close")
    near = near.unionByName(close)
    roots = _roots(classes.select("fp"), near, "similar-begun")
    rows = shared_keys(classes, roots)
    groups = check(group_pairs(rows, roots), "similar-joined")
    if not groups.isEmpty():
        near = near.unionByName(groups)
        rows = rows.drop("root").join(_roots(classes.select("fp"), near, "similar-grown"), "fp")
    return near.unionByName(check(candidates(rows, classes), "similar-rest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component of texts at Jaccard 0.8 or more, the row with the smallest id stays.

    Texts without words are one another's copies; shorter texts than a shingle are one shingle. Null ids come last; of
    different texts with one id, that with the smallest hash stays; of rows that are equal in both, one.
    """
    small_batches(docs.sparkSession)
    begun = scratch_count()
    found = _signatures(common_shingles(docs, text_col))(F.col(text_col))
    first = scratch_count()
    read = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), found.alias("s")).select("id", "mark", "s.*"), "similar")
    prints = written(read.groupBy("id", "mark", "fp").count(), "similar-prints")
    some = F.first(F.struct("id", "mark", "size", "meet", "prefix", "sim", "bands", "bits", "wide")).alias("some")
    classes = written(read.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), some).select("fp", "n", "some.*"), "similar-classes")
    drop_scratch(docs.sparkSession, first, keep="similar-prints", until=first + 2)
    rooted = _roots(classes.select("fp"), links(docs, classes, id_col, text_col), "similar-rooted")
    kept = least_of_each(docs, prints, rooted, id_col, text_col)
    drop_scratch(docs.sparkSession, begun, keep=GONE)
    return kept

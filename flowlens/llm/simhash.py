"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most one bit of some third of them. So each
distinct fingerprint is cut into 3 segments instead of 5, and indexed under every segment with one bit blanked: 64
variants. Fingerprints that share a variant meet in an equality join, which verifies the full distance and keeps each
link at its first shared variant only. Documents with one fingerprint are one class before any of this.

Dense groups would meet in all pairs, so every fingerprint is first compared with few representatives of those that
share a whole segment with it. Fingerprints linked to the same representative needn't meet again: only pairs beyond
that are joined, and a variant that very many fingerprints share is split into parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import ASCII_LOWER, fresh, sieve, small_batches, written
from flowlens.operators.graph import components
from flowlens.session import drop_scratch, scratch_count

WORDS, BITS = 4, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of a key from which on it is hot, and the parts that a hot key is split into.
HOT, PARTS = 2000, 16
#: Names of the tables that results read; all others are deleted before the result is returned.
LEAST, GONE = "root-least", "simhash-gone"
#: Shingles hashed at a time, so that a text of any length needs bounded memory.
CHUNK = 1 << 16


def shingles(text: str | None, words: int) -> tuple[int, Iterator]:
    """How many word shingles the text has, repeats included, and their 64-bit hashes in arrays of at most CHUNK."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not tokens:
        return 0, iter(())
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    starts = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=starts[1:])
    n = max(1, len(tokens) - words + 1)
    span = min(words, len(tokens))
    first, last = starts[:n].tolist(), (starts[span : span + n] - 1).tolist()
    parts = (np.array([digest(joined[a:b], 42) for a, b in zip(first[k : k + CHUNK], last[k : k + CHUNK])], dtype="<u8") for k in range(0, n, CHUNK))
    return n, parts


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of the text's word shingles, repeats included; 0 where there is no word."""
    import numpy as np

    n, parts = shingles(text, words)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(fingerprint, na_action=None).astype("int64") if len(text) else pd.Series([], dtype="int64")


def variants(fp: Column) -> Column:
    """64 longs: the number of the blanked bit above 22 bits of its segment."""
    out = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        out += [segment.bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1))).bitwiseOR(F.lit((first + bit) << 22)) for bit in range(width)]
    return F.array(*out)


def segments(fp: Column) -> list[Column]:
    """The number of each segment's first bit above the segment."""
    return [F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(first << 22)) for first, width in SEGMENTS]


def across(keyed: DataFrame, met: Column, *more: Column) -> DataFrame:
    """(a, b, *more) for the rows of keyed (key, fp, root, ...) that share a key and no root and are `met`, once for each key.

    met and more are expressions over rows a and b that are the same for both orders of them.
    """
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.fp") < F.col("b.fp")) & met
    return a.join(b.hint("merge"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), *more)


def across_hot(keyed: DataFrame, met: Column, *more: Column) -> DataFrame:
    """As across, for keys that many rows share.

    A key's largest root needn't meet itself, so the rows of its other roots go to all rows, in parts of the key.
    """
    rows = written(keyed, "hot-rows")
    homes = rows.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("home"))
    rows = rows.join(written(homes, "hot-homes"), "key")
    a = rows.where("root <> home").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).alias("a")
    b = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.root") != F.col("b.root"))
    once = (F.col("b.root") == F.col("b.home")) | (F.col("a.fp") < F.col("b.fp"))
    return a.join(b.hint("merge"), on & once & met).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"), *more)


def stars(keyed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """From keyed (key, fp, n): (a, b), each fp b with representatives a of its keys, and the keys that rows share.

    A key's representatives are the fp with most rows (n), and the least and the greatest one.
    """
    most = F.max_by("fp", F.struct("n", "fp")).alias("most")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), most, F.min("fp").alias("least"), F.max("fp").alias("greatest")).where("size > 1")
    shared = written(shared, f"{name}-keys")
    met = keyed.join(shared, "key").select(F.explode(F.array_distinct(F.array("most", "least", "greatest"))).alias("a"), F.col("fp").alias("b"))
    return met.where("a <> b").distinct(), shared


def with_roots(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """classes with a root: the least representative that fp is linked to, or itself. Equal roots are connected."""
    least = linked.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("least"))
    return classes.join(least, "fp", "left").withColumn("root", F.least("fp", "least")).drop("least")


def links(classes: DataFrame, bits: int = BITS, hot: DataFrame | None = None, sim: str = "fp") -> DataFrame:
    """(a, b), a < b: the pairs of distinct rows (fp) whose fingerprints (sim) have `bits` or fewer differing bits, each once.

    Where classes have a root, pairs with one root are left out. hot has the keys (key) that many rows share.
    """
    assert 1 <= bits < 2 * len(SEGMENTS), "more bits than the segments can find"
    root = F.col("root" if "root" in classes.columns else "fp").alias("root")
    keyed = classes.select(F.explode(variants(F.col(sim))).alias("key"), "fp", root, *[c for c in [sim] if c != "fp"])
    differ = F.col(f"a.{sim}").bitwiseXOR(F.col(f"b.{sim}"))
    bit = F.expr("cast(shiftright(a.key, 22) as int)")
    blanked = F.expr(f"(a.{sim} ^ b.{sim}) & shiftleft(1L, cast(shiftright(a.key, 22) as int))") != 0
    masks = [((1 << width) - 1) << first for first, width in SEGMENTS]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    firsts = []
    for k, (first, width) in enumerate(SEGMENTS):
        earlier = [F.bit_count(differ.bitwiseAND(F.lit(m))) > 1 for m in masks[:k]]
        here = [bit >= first, bit < first + width, blanked | (bit == first)]
        firsts.append(reduce(lambda x, y: x & y, earlier + here))
    once = reduce(lambda x, y: x | y, firsts)
    met = (F.bit_count(differ) <= bits) & once
    if hot is None:
        return across(keyed, met)
    return across(keyed.join(hot, "key", "left_anti"), met).unionByName(across_hot(keyed.join(hot, "key", "left_semi"), met))


def hot_variants(shared: DataFrame) -> DataFrame | None:
    """The variants that may have HOT fingerprints or more: those of segments that half as many share."""
    crowded = shared.where(F.col("size") >= HOT // 2)
    if crowded.isEmpty():
        return None
    keys = []
    for first, width in SEGMENTS:
        own = F.col("key").bitwiseAND(F.lit((1 << 22) - 1))
        each = F.array(*(own.bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1))).bitwiseOR(F.lit((first + bit) << 22)) for bit in range(width)))
        keys.append(crowded.where(F.shiftright("key", 22) == first).select(F.explode(each).alias("key")))
    return written(reduce(DataFrame.unionByName, keys).distinct(), "simhash-hot")


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, root): every distinct fingerprint of prints with the one that stands for its component."""
    classes = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "simhash-classes")
    near, shared = stars(classes.select(F.explode(F.array(*segments(F.col("fp")))).alias("key"), "fp", "n"), "simhash")
    near = written(near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits), "simhash-stars")
    rooted = written(with_roots(classes.select("fp"), near), "simhash-begun")
    roots = components(near.unionByName(links(rooted, bits, hot_variants(shared))))
    return classes.join(written(roots, "simhash-roots"), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def least_by_root(rooted: DataFrame) -> DataFrame:
    """(fp, least) from (fp, root, own): the least own of all that share the root.

    Minima combine before their shuffle; only roots of several classes are looked up, in a written table, so a root
    that very many classes have is split by AQE or has its minimum broadcast.
    """
    rooted = written(rooted, "rooted")
    several = rooted.groupBy("root").agg(F.min("own").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "all")
    return written(rooted.join(written(several, "root-minima"), "root", "left").select("fp", F.coalesce("all", "own").alias("least")), LEAST)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed 64 bits), component_id (the smallest doc_id reachable).

    Defined cases: null and empty texts have fingerprint 0 and link like any other; a null id takes part, and
    component_id is null only where no id of the component is given; repeated rows give repeated rows; an empty table
    gives none; other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    prints = written(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")), "simhash")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("own"))
    begun = scratch_count()
    named = least_by_root(_classes(prints, bits).join(own, "fp"))
    drop_scratch(docs.sparkSession, begun, keep=LEAST)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs without near-duplicates: of each component one row stays, that with the smallest id.

    Null ids come last; of different texts with one id, that with the smallest hash stays; of rows that are equal in
    both, one.
    """
    small_batches(docs.sparkSession)
    spot, mark = F.col(id_col), F.xxhash64(text_col)
    prints = docs.select(spot.alias("id"), mark.alias("mark"), _fingerprints(F.col(text_col)).alias("fp"))
    begun = scratch_count()
    prints = written(prints.groupBy("id", "mark", "fp").count(), "simhash")
    kept = least_of_each(docs, prints, _classes(prints, bits), id_col, text_col)
    drop_scratch(docs.sparkSession, begun, keep=GONE)
    return kept


def least_of_each(docs: DataFrame, prints: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs with the smallest id of each root: prints has (id, mark, fp, count), rooted (fp, root)."""
    spot, mark = F.col(id_col), F.xxhash64(text_col)
    order = F.struct(F.col("id").isNull().alias("unknown"), "id", "mark")
    best = least_by_root(prints.groupBy("fp").agg(F.min(order).alias("own")).join(rooted, "fp"))
    placed = written(prints.join(best, "fp").select("id", "mark", "count", (order == F.col("least")).alias("stays")), "simhash-placed")

    own_id, own_mark = fresh(docs, "__id"), fresh(docs, "__mark")

    def without(rows: DataFrame, gone: DataFrame, how: str) -> DataFrame:
        gone = written(gone.select(F.col("id").alias(own_id), F.col("mark").alias(own_mark)), GONE)
        return rows.join(gone, spot.eqNullSafe(F.col(own_id)) & (mark == F.col(own_mark)), how)

    gone = written(placed.where("not stays").select("id", "mark"), "simhash-left")
    some, rest = sieve(docs, mark, written(gone.select("mark").distinct(), "simhash-marks"), GONE)
    kept = without(some, gone, "left_anti").unionByName(rest)
    repeated = placed.where("stays and count > 1")
    if repeated.isEmpty():
        return kept
    once = without(kept, repeated, "left_semi").withColumn(own_mark, mark).dropDuplicates([id_col, own_mark]).drop(own_mark)
    return without(kept, repeated, "left_anti").unionByName(once)

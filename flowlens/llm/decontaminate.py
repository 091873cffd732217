"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are all runs of 10 words of every benchmark item (the whole item where it is shorter). Text and test
strings are bytes with one space around every word, so an occurrence of the bytes is one of whole words. Test strings
of similar length share tables: a block shift table tells how far to move on from the block that ends at the current
place; where it says 0, buckets by that block, then by leading bytes, give the few test strings to compare in full.

The benchmark goes to the executors in blocks of bounded size, each by its own pass over the documents; the usual
benchmark is one block. All passes but the last write what they find by the text's digest, and the last adds it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import fresh, small_batches, written

WINDOW = 10
#: Bytes of benchmark text that one pass searches for.
BLOCK_BYTES = 4 << 20

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).lower().encode() in _WORD else b if b in _WORD else 32 for b in range(256))
HITS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters (A-Z as a-z) and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(tokens: list[bytes], window: int = WINDOW) -> set[bytes]:
    n = max(1, len(tokens) - window + 1)
    return {b" " + b" ".join(tokens[i : i + window]) + b" " for i in range(n)} if tokens else set()


class WuManber:
    """Finds every occurrence of the patterns, which are of similar length."""

    def __init__(self, patterns: Iterable[bytes]) -> None:
        self.patterns = sorted(patterns)
        self.reach = min(map(len, self.patterns))
        # a longer block keeps shifts long where there are many patterns: natural text has some 2.5 bits a byte
        wanted = math.ceil(math.log2(2 * self.reach * len(self.patterns)) / 2.5)
        self.block = max(1, min(wanted, self.reach // 2))
        self.lead = min(8, self.reach)
        self.default = self.reach - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in self.patterns:
            for end in range(self.block, self.reach + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), self.reach - end)
            self.buckets.setdefault(p[self.reach - self.block : self.reach], {}).setdefault(p[: self.lead], []).append(p)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        end, n, block, reach, lead = self.reach, len(text), self.block, self.reach, self.lead
        shift, default, buckets = self.shift.get, self.default, self.buckets
        while end <= n:
            key = text[end - block : end]
            if move := shift(key, default):
                end += move
                continue
            start = end - reach
            for p in buckets[key].get(text[start : start + lead], ()):
                if text.startswith(p, start):
                    yield start, p
            end += 1


class Searcher:
    """The windows of some benchmark items, in tables by length, with the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.owners: dict[bytes, list[str]] = {}
        for item, text in items:
            for w in windows(words(text), window):
                self.owners.setdefault(w, []).append(item)
        tiers: list[list[bytes]] = []
        for w in sorted(self.owners, key=len):
            if not tiers or len(w) >= 2 * len(tiers[-1][0]):
                tiers.append([])
            tiers[-1].append(w)
        self.tables = [WuManber(t) for t in tiers]

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the word ranges hit, in order and merged, and the items found."""
        tokens = words(text)
        line = b" " + b" ".join(tokens) + b" "
        found = sorted((start, p) for t in self.tables for start, p in t.occurrences(line))
        spans: list[list[int]] = []
        items: set[str] = set()
        at = word = 0
        for start, p in found:
            word += line.count(b" ", at, start)
            at = start
            stop = word + p.count(b" ") - 1
            items.update(self.owners[p])
            if spans and word <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([word, stop])
        return len(tokens), [(a, b) for a, b in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_READY: dict[str, Searcher] = {}


def _hits(sent: Broadcast, window: int):
    """A UDF that adds what one block of the benchmark hits to what earlier blocks have hit."""

    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        if sent.value["key"] not in _READY:
            _READY.clear()  # one block at a time in a worker
            _READY[sent.value["key"]] = Searcher(sent.value["items"], window)
        searcher = _READY[sent.value["key"]]
        for texts, before in batches:
            rows = []
            for text, spans, items in zip(texts, before["spans"], before["items"]):
                n, new, names = searcher.search(text)
                flat = [int(x) for x in spans] if spans is not None else []
                if flat:
                    new = merged([*new, *zip(flat[::2], flat[1::2])])
                rows.append((n, [x for s in new for x in s], sorted({*names, *(items if items is not None else ())})))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return F.pandas_udf(search, HITS)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs, every row and column, with n_words, n_hit (words inside an occurrence), spans (pairs of word positions,
    first and past the last, flat and in order), items (ids found, sorted as strings) and contaminated.

    Defined cases: null and empty texts have no words and no hits; items without words are never found; a null item
    id counts as the empty string; items that share an id count once; an empty benchmark finds nothing; an empty
    table gives no rows; names that clash with the five get a leading underscore.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [fresh(docs, x) for x in ("n_words", "n_hit", "spans", "items", "contaminated")]
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / block_bytes))
    blocks = [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k) for k in range(n_blocks)]
    search = lambda k: _hits(spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "items": [tuple(r) for r in blocks[k].collect()]}), window)
    nothing = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    held, key = fresh(docs, "__hits"), fresh(docs, "__key")
    rows = docs.withColumn(held, nothing)
    if n_blocks > 1:
        digest = F.md5(F.col(text_col).cast("binary"))
        found = [
            written(docs.select(digest.alias(key), search(k)(F.col(text_col), nothing).alias("x")).where(F.size("x.spans") > 0).select(key, "x.spans", "x.items").distinct(), "hits")
            for k in range(n_blocks - 1)
        ]
        both = reduce(DataFrame.unionByName, found).groupBy(key)
        both = both.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row a block
        both = written(both.select(key, F.struct(F.lit(0).cast("long").alias("n_words"), "spans", "items").alias(held)), "hits")
        rows = docs.withColumn(key, digest).join(both, key, "left").withColumn(held, F.coalesce(held, nothing)).drop(key)
    rows = rows.withColumn(held, search(n_blocks - 1)(F.col(text_col), F.col(held)))
    spans = F.col(f"{held}.spans")
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*docs.columns, F.col(f"{held}.n_words").alias(names[0]), n_hit.alias(names[1]), spans.alias(names[2]), F.col(f"{held}.items").alias(names[3]), (n_hit > 0).alias(names[4]))

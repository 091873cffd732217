"""Line dedup by site-relative frequency, in DataFrame operations alone.

A line is boilerplate of a host when more than `ratio` of the host's pages contain it. Counting moves a digest for
each distinct line of a page, combined before the shuffle; the rewrite then joins pages with their host's list of
boilerplate digests. A host's list holds at most (mean distinct lines a page) / ratio digests, whatever the number
of its pages, and the lists reach the pages by a join that Spark broadcasts only when their table, as written, is
small; else it is a sort-merge join whose hot hosts AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, written

#: Share of a host's pages above which a line is boilerplate, and the least number of pages that must contain it.
RATIO, MIN_PAGES = 0.01, 5


def line_key(line: Column) -> Column:
    """16 bytes that stand for a trimmed line."""
    return F.unhex(F.md5(line.cast("binary")))


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\f")))


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, pages, host_pages): the lines that exceed the ratio. Empty lines never do; a null host is a host."""
    pages = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = F.transform(F.filter(F.array_distinct(_trimmed(F.col("text"))), lambda x: x != ""), line_key)
    counted = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    joined = counted.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host")))
    return joined.select("c.host", "key", "pages", "host_pages").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs, every row and column, with the text rewritten without boilerplate lines, and three columns more:
    n_lines, n_dropped (lines before, and lines dropped), text_before (null where nothing was dropped).

    Defined cases: null text stays null with no lines; empty text has none; kept lines stay as they are, in order,
    joined by line feeds; empty lines stay; repeats of a kept line in one page stay; a page may lose all lines and
    then has an empty text; an empty table gives no rows; names that clash with the three get a leading underscore.
    """
    lists = boilerplate_lines(docs, host_col, text_col, ratio, min_pages).groupBy("host").agg(F.collect_set("key").alias("keys"))
    host, keys, lines, kept = (fresh(docs, x) for x in ("__host", "__keys", "__lines", "__kept"))
    lists = written(lists, "line-lists").select(F.col("host").alias(host), F.col("keys").alias(keys))
    n_lines, n_dropped, before = fresh(docs, "n_lines"), fresh(docs, "n_dropped"), fresh(docs, "text_before")
    text = F.col(text_col)
    joined = docs.join(lists, F.col(host_col).eqNullSafe(F.col(host)), "left")
    split = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))
    stays = F.filter(lines, lambda x: ~F.array_contains(keys, line_key(F.btrim(x, F.lit(" \t\r\f")))))
    cut = joined.withColumn(lines, split).withColumn(kept, F.when(F.col(keys).isNull(), F.col(lines)).otherwise(stays))
    cut = cut.withColumn(n_lines, F.size(lines).cast("long")).withColumn(n_dropped, (F.size(lines) - F.size(kept)).cast("long"))
    dropped = F.col(n_dropped) > 0
    cut = cut.withColumn(before, F.when(dropped, text))
    return cut.withColumn(text_col, F.when(dropped, F.array_join(kept, "\n")).otherwise(text)).drop(host, keys, lines, kept)

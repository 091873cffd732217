"""Running sums and predecessors over long histories, so that no task needs all rows of a busy key.

Rows are taken in spans that rise with their order (days, weeks, ranges of numbers). A window runs within each span; of
each span one row meets those of the key's other spans, and what came before is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def week_of(ts: str | Column) -> Column:
    """A span of time: the number of the week."""
    return F.floor(micros(ts) / (7 * 86400 * 1_000_000))


def running_sum(rows: DataFrame, keys: list[str], span: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows of the keys up to each, itself counted."""
    local = W.partitionBy(*keys, span).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, span).agg(F.sum(value).alias("__sum"))
    ends = ends.select(*keys, span, F.coalesce(F.sum("__sum").over(W.partitionBy(*keys).orderBy(span).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn(name, F.sum(value).over(local)).join(ends, [*keys, span]).withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def previous(rows: DataFrame, keys: list[str], span: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the value of the row before in the order (columns, ascending), null for a key's first."""
    boxed = F.struct(value.alias("v"))
    local = F.lag(boxed).over(W.partitionBy(*keys, span).orderBy(*order))
    ends = rows.groupBy(*keys, span).agg(F.max_by(boxed, F.struct(*order)).alias("__last"))
    ends = ends.select(*keys, span, F.lag("__last").over(W.partitionBy(*keys).orderBy(span)).alias("__last"))
    found = rows.withColumn(name, local).join(ends, [*keys, span])
    return found.withColumn(name, F.coalesce(F.col(name), F.col("__last"))["v"]).drop("__last")

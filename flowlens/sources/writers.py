"""Writing results: tables, safe spreadsheets, graphs, versions. Spark writes and commits every file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.text import cell


def safe_csv(rows: DataFrame, path: str) -> None:
    """CSV with headers, in which no text can be taken for a formula."""
    text = {c for c, kind in rows.dtypes if kind == "string"}
    rows.select(*[cell(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def snapshot(rows: DataFrame, path: str, by: list[str], count: str) -> dict[str, int]:
    """Rows in order as CSV under path/rows, their counts as JSON under path/counts; and the counts."""
    rows.orderBy(*by).write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    counts = rows.groupBy(count).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").json(f"{path}/counts")
    return {r[count]: r["n"] for r in rows.sparkSession.read.json(f"{path}/counts").collect()}


def gzip_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def append_version(rows: DataFrame, path: str, run_id: str) -> None:
    """A run's rows in a partition of its own; writing a run again replaces that partition alone."""
    options = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    options.partitionBy("run_id").parquet(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): GraphML elements of nodes (id) and edges (src, dst, value), one a row, to write as text in order."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="v" for="edge" attr.name="value" attr.type="long"/><graph edgedefault="directed">'
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    points = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), safe("id"), F.lit('"/>')).alias("line"))
    lines = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('"><data key="v">'), F.col("value").cast("string"), F.lit("</data></edge>")).alias("line"))
    return ends.unionByName(points).unionByName(lines)

"""Lists that people send in: complaints as CSV, seizure orders, checks of tags, recorded cases, findings, datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.addresses import FORMS, detect_form
from flowlens.sources.readers import EVM, csv_text

# What columns of complaints are called.
NAMES = {
    "address": ("address", "wallet", "wallet address", "wallet_address"), "chain": ("chain", "network", "blockchain"),
    "case_ref": ("case_ref", "case ref", "case reference", "reference", "ref", "fir"),
}


def complaints(spark: SparkSession, path: str) -> DataFrame:
    """file, row, address, chain, case_ref of uploaded CSVs of any of three separators, with or without a header.

    A file is one row until its form is known, as an upload is small; row is the line in it, the header counted. A
    header is a first line that names an address column; without one the columns are in order. Empty lines are none.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))
    count = lambda sep: F.length("first") - F.length(F.replace("first", F.lit(sep), F.lit("")))
    lines = F.transform(F.split("text", "\r?\n"), lambda x, i: F.struct((i + 1).alias("row"), x.alias("line")))
    files = files.withColumn("lines", F.filter(lines, lambda x: F.btrim(F.translate(x.line, ",;\t", "   ")) != "")).where(F.size("lines") > 0)
    files = files.withColumn("first", F.col("lines")[0]["line"])
    sep = F.when((count(";") > count(",")) & (count(";") >= count("\t")), ";").when((count("\t") > count(",")) & (count("\t") > count(";")), "\t").otherwise(",")
    files = files.withColumn("sep", sep)
    cells = lambda line, sep: F.transform(F.split(line, F.concat(sep, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))), lambda c: F.btrim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    files = files.withColumn("head", F.transform(cells(F.col("first"), F.col("sep")), F.lower))
    place = lambda names: F.array_min(F.array(*[F.nullif(F.array_position("head", n), F.lit(0)) for n in names]))
    files = files.withColumn("has_head", place(NAMES["address"]).isNotNull())
    at = {name: F.when(F.col("has_head"), place(names)).otherwise(F.lit(k + 1)).alias(f"at_{name}") for k, (name, names) in enumerate(NAMES.items())}
    rows = files.select("file", "sep", "has_head", *at.values(), F.posexplode("lines").alias("n", "x")).where("n > 0 or not has_head")
    rows = rows.withColumn("cells", cells(F.col("x.line"), F.col("sep")))
    cell = lambda name: F.nullif(F.get("cells", F.col(f"at_{name}") - 1), F.lit(""))
    return rows.select("file", F.col("x.row").alias("row"), F.coalesce(cell("address"), F.lit("")).alias("address"), cell("chain").alias("chain"), cell("case_ref").alias("case_ref"))


def found_addresses(text: Column) -> Column:
    """All that has the form of an address in a text, each once, in order; forms are tried without their checksums."""
    inner = "|".join(p.strip("^$") for p in (FORMS["bitcoin"], FORMS["tron"], FORMS["evm"]))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![0-9A-Za-z])((?:{inner}))(?![0-9A-Za-z])"), F.lit(1)))


def seizure_orders(spark: SparkSession, path: str, today: str) -> DataFrame:
    """address, chain, threat, entity, evidence of orders' assets; cancelled orders don't count, lapsed ones say so."""
    rows = csv_text(spark, path, ["Is Canceled", "Assets", "Order Type", "Order Number", "Order Date", "Validity Date"])
    rows = rows.where(F.lower(F.btrim("Is Canceled")) != "true").withColumn("address", F.explode(found_addresses(F.col("Assets"))))
    rows = rows.withColumn("form", detect_form(F.col("address"))).where("form is not null")
    number, until = F.btrim("Order Number"), F.btrim("Validity Date")
    lapsed = F.when((until != "") & (until < today), " (lapsed)").otherwise("")
    evidence = F.concat(F.btrim("Order Type"), F.lit(" order "), number, F.lit(" of "), F.btrim("Order Date"), F.lit(", valid until "), until, lapsed)
    return rows.select("address", F.when(F.col("form") == "evm", "ethereum").otherwise(F.col("form")).alias("chain"), F.lit("terrorism_financing").alias("threat"), F.concat(F.lit("Seizure order "), number).alias("entity"), evidence.alias("evidence"))


def tag_checks(spark: SparkSession, path: str, columns: tuple[str, ...] = ("verdict", "owner")) -> DataFrame:
    """address, chain and the columns of a folder of check files; of an address in several files the last name wins."""
    rows = csv_text(spark, path, ["address", "chain", *columns]).withColumn("file", F.input_file_name())
    best = rows.groupBy("address", "chain").agg(F.max_by(F.struct(*columns), "file").alias("c"))
    return best.select("address", "chain", "c.*")


def recorded_cases(spark: SparkSession, path: str) -> DataFrame:
    """entity (small letters), case_id of a JSON object of cases by id, each with the service it named."""
    text = spark.read.text(path, wholetext=True)
    cases = F.from_json("value", "map<string, struct<top_vasp string>>")
    rows = text.select(F.explode(cases).alias("case_id", "c")).where("coalesce(c.top_vasp, '') <> ''")
    return rows.select(F.lower("c.top_vasp").alias("entity"), "case_id")


def refiled(labels: DataFrame) -> DataFrame:
    """labels (address, chain, ...) with the chain that an address's form belongs to; what fits none is dropped.

    Chains without a form of their own keep what they have; Solana's form says little, so it is only kept, never given.
    """
    form = detect_form(F.col("address"))
    rows = labels.withColumn("__form", form)
    own = F.when(F.col("chain").isin(EVM), "evm").when(F.col("chain").isin("tron", "bitcoin", "solana"), F.col("chain"))
    now = F.when(own.isNull() | (own == F.col("__form")), F.col("chain")).when(F.col("__form") == "evm", "ethereum").when(F.col("__form").isin("tron", "bitcoin"), F.col("__form"))
    return rows.withColumn("chain", now).where("chain is not null").drop("__form")


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Findings, claims, model scores, datasets: a CSV with a header and a schema; times are ISO 8601 in UTC."""
    return spark.read.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[XXX]").option("mode", "FAILFAST").schema(schema).csv(path)

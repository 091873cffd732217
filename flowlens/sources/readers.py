"""Reading labels, threats, findings, freezes and transfers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSFER = "chain string, tx_hash string, block_time timestamp, from_addr string, to_addr string, asset string, amount decimal(38,8), amount_usd decimal(38,8), fee_payer string, asset_contract string"
LABEL = ["address", "chain", "entity", "category", "tier", "kind", "source", "confidence"]
FINDING = "chain string, address string, entity string, confidence double, evidence string, status string"
TAG_FILE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("creator", T.StringType()), T.StructField("label", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("abuse", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("address", "currency", "label", "source", "abuse", "category")]))),
])

#: Spellings of chains that sources use.
CHAIN_ALIASES = {"btc": "bitcoin", "xbt": "bitcoin", "eth": "ethereum", "trx": "tron", "bnb": "bsc", "matic": "polygon", "sol": "solana"}
EVM = ["ethereum", "bsc", "polygon", "arbitrum", "base", "avalanche", "optimism"]


def chain_name(chain: Column) -> Column:
    low = F.lower(F.trim(chain))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CHAIN_ALIASES.items() for x in kv])[low], low)


def address_key(chain: Column, address: Column) -> Column:
    """An address as it is looked up: case counts but on EVM chains."""
    return F.when(chain.isin(EVM), F.lower(F.trim(address))).otherwise(F.trim(address))


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with all columns as text; missing columns and nulls are empty."""
    read = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return read.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in read.columns else F.lit("").alias(c) for c in columns])


def label_csv(spark: SparkSession, path: str, tier: str = "explorer_tag") -> DataFrame:
    """Labels of a folder of CSVs, one for each chain; files that start with `_` aren't labels."""
    rows = csv_text(spark, path, ["address", "network", "entity", "label", "category", "source", "confidence"])
    chain = chain_name(F.col("network"))
    kept = rows.select(
        address_key(chain, F.col("address")).alias("address"), chain.alias("chain"), F.when(F.col("entity") != "", F.col("entity")).otherwise(F.col("label")).alias("entity"),
        F.col("category"), F.lit(tier).alias("tier"), F.lit("unknown").alias("kind"), F.col("source"), F.expr("try_cast(confidence as double)").alias("confidence"),
    )
    return kept.where("address <> '' and address not like '%…%' and address not like '%...%'")


def tag_packs(spark: SparkSession, path: str) -> DataFrame:
    """Threat tags of JSON packs; what a tag leaves out is its pack's."""
    tag = F.explode("tags").alias("t")
    rows = spark.read.schema(TAG_FILE).option("multiLine", True).json(path).select("title", "creator", "label", "currency", "category", "abuse", tag)
    chain = chain_name(F.coalesce("t.currency", "currency"))
    return rows.select(
        address_key(chain, F.col("t.address")).alias("address"), chain.alias("chain"), F.coalesce("t.label", "label", "title").alias("entity"),
        F.coalesce("t.abuse", "t.category", "abuse", "category").alias("threat"), F.coalesce("t.source", "creator").alias("source"),
    )


def ransom_wallets(spark: SparkSession, path: str) -> DataFrame:
    """address, family, n_transactions, usd of a JSON export with a list `result`."""
    payment = T.ArrayType(T.StructType([T.StructField("hash", T.StringType()), T.StructField("time", T.LongType()), T.StructField("amount", T.LongType()), T.StructField("amountUSD", T.DoubleType())]))
    item = T.StructType([T.StructField("address", T.StringType()), T.StructField("blockchain", T.StringType()), T.StructField("family", T.StringType()), T.StructField("transactions", payment)])
    rows = spark.read.schema(T.StructType([T.StructField("result", T.ArrayType(item))])).option("multiLine", True).json(path).select(F.inline("result"))
    usd = F.aggregate(F.coalesce("transactions", F.array().cast(payment)), F.lit(0.0), lambda a, x: a + F.coalesce(x.amountUSD, F.lit(0.0)))
    return rows.where("lower(blockchain) = 'bitcoin'").select("address", "family", F.greatest(F.size("transactions"), F.lit(0)).alias("n_transactions"), usd.alias("usd"))


def sanctions_xml(spark: SparkSession, path: str, row_tag: str = "sdnEntry") -> DataFrame:
    """uid, name, chain, address of XML entries whose ids are digital currency addresses."""
    one = T.StructType([T.StructField("idType", T.StringType()), T.StructField("idNumber", T.StringType())])
    entry = T.StructType([
        T.StructField("uid", T.StringType()), T.StructField("lastName", T.StringType()), T.StructField("idList", T.StructType([T.StructField("id", T.ArrayType(one))])),
    ])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(entry).load(path).select("uid", F.col("lastName").alias("name"), F.explode("idList.id").alias("i"))
    code = F.regexp_extract("i.idType", r"^Digital Currency Address - (\w+)", 1)
    return rows.where(code != "").select("uid", "name", chain_name(code).alias("chain"), F.trim("i.idNumber").alias("address"))


def freeze_events(spark: SparkSession, path: str) -> DataFrame:
    """Freeze and release events, each (tx, log index) once."""
    rows = spark.read.schema("tx string, log_index int, block_ms long, event string, address string").json(path)
    return rows.dropDuplicates(["tx", "log_index"]).select("address", F.timestamp_millis("block_ms").alias("ts"), F.col("block_ms").alias("seq"), (F.col("event") == "Added").alias("added"))


def watchlist(spark: SparkSession, path: str, default: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of `address[,label]` lines; a rejected line isn't an address."""
    lines = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    parts = F.split("value", ",", 2)
    rows = lines.select("value", F.trim(parts[0]).alias("address"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.lit(default)).alias("label"))
    good = F.col("address").rlike("^[A-Za-z0-9]{4,}$")
    return rows.where(good).drop("value"), rows.where(~good).select("value")


def scan(transfers: DataFrame, address: str, direction: str = "both", since=None, asset: str | None = None, limit: int = 200) -> DataFrame:
    """Transfers that touch an address, oldest first; all conditions reach the files.

    One row more than the limit is read, and `complete` tells whether it was there.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(f"direction {direction!r} isn't in, out or both")
    out, into = F.col("from_addr") == address, F.col("to_addr") == address
    rows = transfers.where({"out": out, "in": into, "both": out | into}[direction])
    rows = rows.where(F.col("block_time") >= since) if since is not None else rows
    rows = rows.where(F.col("asset") == asset) if asset is not None else rows
    order = ["block_time", "tx_hash", "from_addr", "to_addr", "asset", "amount"]
    top = rows.orderBy(*order).limit(limit + 1)
    total = F.broadcast(top.agg(F.count(F.lit(1)).alias("__n")))
    return top.orderBy(*order).limit(limit).join(total).withColumn("complete", F.col("__n") <= limit).drop("__n")

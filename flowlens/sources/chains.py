"""Recorded responses of chains, as transfers.

Each function takes a table with a column of raw JSON, one item of a listing a row, and parses it with a schema: what
doesn't fit is null and dropped, and nothing leaves the JVM but Tron's hex addresses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions.addresses import tron_addresses

# Stablecoin contracts by chain, the coins of chains, chains by the numbers that bridges use.
TRON_STABLE = {"TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t": "USDT"}
ETHEREUM_STABLE = {"0xdac17f958d2ee523a2206206994597c13d831ec7": "USDT", "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48": "USDC"}
SOLANA_STABLE = {"EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v": "USDC", "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB": "USDT"}
NATIVE = {"ethereum": "ETH", "bsc": "BNB", "polygon": "POL", "arbitrum": "ETH", "base": "ETH", "optimism": "ETH", "avalanche": "AVAX"}
CHAIN_IDS = {1: "ethereum", 10: "optimism", 56: "bsc", 137: "polygon", 8453: "base", 42161: "arbitrum", 43114: "avalanche"}
ENDPOINTS = {30101: "ethereum", 30102: "bsc", 30106: "avalanche", 30109: "polygon", 30110: "arbitrum", 30111: "optimism", 30184: "base"}
WORMHOLE = {1: "solana", 2: "ethereum", 4: "bsc", 5: "polygon", 6: "avalanche", 23: "arbitrum", 24: "optimism", 30: "base"}

#: Coins that pay another's fees: fewer are dust, more are a deposit.
TOP_UP = (1, 100)
SECRETS = ("apikey", "api_key", "api-key", "key", "token")


def looked_up(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def scaled(units: Column, decimals: Column) -> Column:
    """Whole units, as digits, in coins: the point is set so many places from the right, and no digit is lost.
    What isn't a whole number, or has over 20 digits before the point, is null."""
    n = F.coalesce(decimals.cast("int"), F.lit(0))
    digits = F.lpad(units.cast("string"), 60, "0")
    point = F.concat(F.substring(digits, F.lit(1), 60 - n), F.lit("."), F.substring(digits, 61 - n, n))
    return F.when(units.cast("string").rlike("^[0-9]+$"), point).try_cast("decimal(38,18)")


def from_hex(text: Column) -> Column:
    """A 0x number of up to 30 digits, as decimal(38, 0)."""
    digits = F.lpad(F.regexp_replace(F.coalesce(text, F.lit("0x0")), "^0x", ""), 30, "0")
    half = lambda at: F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(16**15).cast("decimal(20,0)")).cast("decimal(38,0)") + half(16)


def _transfer(chain: Column, tx: Column, time: Column, sender: Column, receiver: Column, asset: Column, amount: Column, known: Column, payer: Column, contract: Column) -> list[Column]:
    return [
        chain.alias("chain"), tx.alias("tx_hash"), time.alias("block_time"), sender.alias("from_addr"), receiver.alias("to_addr"), asset.alias("asset"), amount.alias("amount"),
        F.when(known, amount).alias("amount_usd"), payer.alias("fee_payer"), contract.alias("asset_contract"),
    ]


def _named(symbol: Column, own: Column, contract: Column) -> Column:
    """A token that isn't known by its contract is named by its own symbol and that contract."""
    return F.coalesce(symbol, F.concat(F.coalesce(F.nullif(own, F.lit("")), F.lit("?")), F.lit("@"), contract))




def _none() -> Column:
    return F.lit(None).cast("string")


_TRON_CALL = "array<struct<type string, parameter struct<value struct<owner_address string, to_address string, receiver_address string, resource string, amount bigint>>>>"
TRON_TX = f"txID string, block_timestamp bigint, ret array<struct<contractRet string>>, raw_data struct<contract {_TRON_CALL}>"


def tron_tokens(rows: DataFrame, raw: str = "raw", stable: dict = TRON_STABLE) -> DataFrame:
    item = F.from_json(raw, "type string, value string, transaction_id string, block_timestamp bigint, `from` string, `to` string, token_info struct<address string, decimals int, symbol string>")
    r = rows.select(item.alias("i")).where("i.type = 'Transfer'")
    contract, symbol = F.col("i.token_info.address"), looked_up(stable, F.col("i.token_info.address"))
    amount = scaled(F.col("i.value"), F.col("i.token_info.decimals"))
    return r.select(*_transfer(F.lit("tron"), F.col("i.transaction_id"), F.timestamp_millis("i.block_timestamp"), F.col("i.from"), F.col("i.to"), _named(symbol, F.col("i.token_info.symbol"), contract), amount, symbol.isNotNull(), _none(), contract))


def _tron_calls(rows: DataFrame, raw: str, *also: str) -> DataFrame:
    """txID, at, done, type, v: the first contract call of each transaction."""
    call = F.get("i.raw_data.contract", F.lit(0))
    r = rows.select(*also, F.from_json(raw, TRON_TX).alias("i")).where("i.txID is not null")
    return r.select(*also, "i.txID", F.timestamp_millis("i.block_timestamp").alias("at"), (F.get("i.ret", F.lit(0))["contractRet"] == "SUCCESS").alias("done"), call["type"].alias("type"), call["parameter"]["value"].alias("v"))


def tron_coins(rows: DataFrame, raw: str = "raw", address=tron_addresses) -> DataFrame:
    r = _tron_calls(rows, raw).where("type = 'TransferContract' and done")
    owner = address(F.col("v.owner_address"))
    return r.select(*_transfer(F.lit("tron"), F.col("txID"), F.col("at"), owner, address(F.col("v.to_address")), F.lit("TRX"), scaled(F.col("v.amount"), F.lit(6)), F.lit(False), owner, _none()))


def tron_transfers(tokens: DataFrame, transactions: DataFrame, raw: str = "raw", address=tron_addresses) -> DataFrame:
    """Both listings as one; a token payment's fee payer is who signed its transaction."""
    calls = _tron_calls(transactions, raw).where("type = 'TriggerSmartContract' and v.owner_address is not null")
    signers = calls.groupBy(F.col("txID").alias("tx_hash")).agg(F.min(address(F.col("v.owner_address"))).alias("signer"))
    paid = tron_tokens(tokens, raw).join(signers, "tx_hash", "left").withColumn("fee_payer", F.col("signer")).drop("signer")
    return paid.unionByName(tron_coins(transactions, raw, address))


def tron_gas(rows: DataFrame, raw: str = "raw", own: str = "address", address=tron_addresses) -> DataFrame:
    """address, time, payer, kind, tx_hash, amount: who covered an account's fees, from its listing (address, raw)."""
    r = _tron_calls(rows, raw, own).where("done").withColumn("payer", address(F.col("v.owner_address"))).where(F.col("payer") != F.col(own))
    amount = scaled(F.col("v.amount"), F.lit(6))
    lent = (F.col("type") == "DelegateResourceContract") & (address(F.col("v.receiver_address")) == F.col(own))
    fed = (F.col("type") == "TransferContract") & (address(F.col("v.to_address")) == F.col(own)) & amount.between(*TOP_UP)
    kind = F.when(lent, F.lower(F.coalesce("v.resource", F.lit("BANDWIDTH")))).when(fed, "native").when(F.col("type") == "TriggerSmartContract", "signer")
    return r.select(F.col(own).alias("address"), F.col("at").alias("time"), "payer", kind.alias("kind"), F.col("txID").alias("tx_hash"), F.when(fed, amount).alias("amount")).where("kind is not null")


def top_ups(transfers: DataFrame, low, high) -> DataFrame:
    """address, time, payer, kind, tx_hash, amount: coins from others within the range of a top-up (a null end is open)."""
    inside = (F.col("amount") > 0) & F.coalesce(F.col("amount") >= low, F.lit(True)) & F.coalesce(F.col("amount") <= high, F.lit(True))
    rows = transfers.where(F.col("asset_contract").isNull() & inside & (F.col("from_addr") != F.col("to_addr")))
    return rows.select(F.col("to_addr").alias("address"), F.col("block_time").alias("time"), F.col("from_addr").alias("payer"), F.lit("native").alias("kind"), "tx_hash", "amount")


def evm_coins(rows: DataFrame, chain: str = "ethereum", raw: str = "raw") -> DataFrame:
    item = F.from_json(raw, "hash string, timeStamp string, `from` string, `to` string, value string, isError string")
    r = rows.select(item.alias("i")).where("coalesce(i.isError, '0') = '0' and coalesce(i.to, '') <> '' and i.value rlike '[1-9]'")
    sender = F.lower("i.from")
    return r.select(*_transfer(F.lit(chain), F.col("i.hash"), F.timestamp_seconds(F.col("i.timeStamp").cast("long")), sender, F.lower("i.to"), F.lit(NATIVE[chain]), scaled(F.col("i.value"), F.lit(18)), F.lit(False), sender, _none()))


def evm_tokens(rows: DataFrame, chain: str = "ethereum", raw: str = "raw", stable: dict = ETHEREUM_STABLE) -> DataFrame:
    item = F.from_json(raw, "hash string, timeStamp string, `from` string, `to` string, value string, contractAddress string, tokenDecimal string, tokenSymbol string, tokenID string")
    r = rows.select(item.alias("i")).where("coalesce(i.tokenID, '') = '' and i.hash is not null").withColumn("contract", F.lower(F.coalesce("i.contractAddress", F.lit(""))))
    symbol = looked_up(stable, F.col("contract"))
    amount = scaled(F.coalesce("i.value", F.lit("0")), F.col("i.tokenDecimal"))
    return r.select(*_transfer(F.lit(chain), F.col("i.hash"), F.timestamp_seconds(F.col("i.timeStamp").cast("long")), F.lower("i.from"), F.lower("i.to"), _named(symbol, F.col("i.tokenSymbol"), F.col("contract")), amount, symbol.isNotNull(), _none(), F.col("contract")))


def rpc_coins(rows: DataFrame, chain: str = "ethereum", raw: str = "raw") -> DataFrame:
    """As evm_coins, of a node's own answers: numbers are hex."""
    item = F.from_json(raw, "hash string, timestamp string, `from` string, `to` string, value string, status string")
    r = rows.select(item.alias("i")).where("i.status = '0x1' and coalesce(i.to, '') <> ''").withColumn("wei", from_hex(F.col("i.value"))).where("wei > 0")
    sender = F.lower("i.from")
    return r.select(*_transfer(F.lit(chain), F.col("i.hash"), F.timestamp_seconds(from_hex(F.col("i.timestamp")).cast("long")), sender, F.lower("i.to"), F.lit(NATIVE[chain]), scaled(F.col("wei"), F.lit(18)), F.lit(False), sender, _none()))


def rpc_tokens(rows: DataFrame, chain: str = "ethereum", raw: str = "raw", stable: dict = ETHEREUM_STABLE) -> DataFrame:
    item = F.from_json(raw, "transactionHash string, timestamp bigint, fromAddress string, toAddress string, valueRawInteger string, tokenDecimals int, tokenSymbol string, contractAddress string")
    r = rows.select(item.alias("i")).where("coalesce(i.contractAddress, '') <> '' and coalesce(i.fromAddress, '') <> '' and coalesce(i.toAddress, '') <> ''")
    contract = F.lower("i.contractAddress")
    symbol = looked_up(stable, contract)
    amount = scaled(F.coalesce("i.valueRawInteger", F.lit("0")), F.col("i.tokenDecimals"))
    return r.select(*_transfer(F.lit(chain), F.col("i.transactionHash"), F.timestamp_seconds("i.timestamp"), F.lower("i.fromAddress"), F.lower("i.toAddress"), _named(symbol, F.col("i.tokenSymbol"), contract), amount, symbol.isNotNull(), _none(), contract))


def block_at(times: DataFrame, blocks: DataFrame, first: bool = True) -> DataFrame:
    """times (ts) with block: the first of blocks (block, ts) at or after it, or the last at or before it.

    Both are put in one order and each time takes its neighbour, so no time meets all blocks; within a day, whose
    first and last block stand for it.
    """
    day = lambda df: df.withColumn("day", F.to_date("ts"))
    both = day(times.select("ts", F.lit(None).cast("long").alias("block")).distinct()).unionByName(day(blocks.select("ts", F.col("block").cast("long").alias("block"))))
    own = W.partitionBy("day").orderBy("ts")
    days = W.orderBy("day")  # a row a day
    if first:
        near = F.first("block", ignorenulls=True).over(own.rowsBetween(0, W.unboundedFollowing))
        per = both.groupBy("day").agg(F.min("block").alias("b")).withColumn("other", F.min("b").over(days.rowsBetween(1, W.unboundedFollowing)))
    else:
        near = F.last("block", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
        per = both.groupBy("day").agg(F.max("block").alias("b")).withColumn("other", F.max("b").over(days.rowsBetween(W.unboundedPreceding, -1)))
    same = blocks.groupBy("ts").agg((F.min if first else F.max)(F.col("block").cast("long")).alias("same"))
    found = both.withColumn("near", near).where("block is null").join(per.select("day", "other"), "day").join(same, "ts", "left")
    return found.select("ts", F.coalesce("same", "near", "other").alias("block"))


_SOL = "array<struct<fromUserAccount string, toUserAccount string, fromTokenAccount string, toTokenAccount string, mint string, amount bigint, tokenAmount double>>"


def solana_transfers(rows: DataFrame, raw: str = "raw", stable: dict = SOLANA_STABLE, digits: int = 6) -> DataFrame:
    """Coin and token payments of each transaction; rent of its token accounts and payments to oneself are none."""
    item = F.from_json(raw, f"signature string, timestamp bigint, feePayer string, transactionError string, nativeTransfers {_SOL}, tokenTransfers {_SOL}")
    r = rows.select(item.alias("i")).where("i.transactionError is null and i.signature is not null")
    accounts = F.array_compact(F.flatten(F.transform("i.tokenTransfers", lambda t: F.array(t.fromTokenAccount, t.toTokenAccount))))
    head = [F.col("i.signature").alias("tx"), F.timestamp_seconds("i.timestamp").alias("at"), F.col("i.feePayer").alias("payer"), F.coalesce(accounts, F.array().cast("array<string>")).alias("accounts")]
    real = "coalesce(t.fromUserAccount, '') <> '' and coalesce(t.toUserAccount, '') <> '' and t.fromUserAccount <> t.toUserAccount"
    coins = r.select(*head, F.explode("i.nativeTransfers").alias("t")).where(f"{real} and t.amount > 0").where(~F.array_contains("accounts", F.col("t.fromUserAccount")) & ~F.array_contains("accounts", F.col("t.toUserAccount")))
    coins = coins.select(*_transfer(F.lit("solana"), F.col("tx"), F.col("at"), F.col("t.fromUserAccount"), F.col("t.toUserAccount"), F.lit("SOL"), scaled(F.col("t.amount"), F.lit(9)), F.lit(False), F.col("payer"), _none()))
    symbol = looked_up(stable, F.col("t.mint"))
    amount = F.when(symbol.isNotNull(), F.bround("t.tokenAmount", digits)).otherwise(F.col("t.tokenAmount")).cast("decimal(38,18)")
    tokens = r.select(*head, F.explode("i.tokenTransfers").alias("t")).where(f"{real} and coalesce(t.mint, '') <> ''").withColumn("amount", amount).where("amount > 0")
    tokens = tokens.select(*_transfer(F.lit("solana"), F.col("tx"), F.col("at"), F.col("t.fromUserAccount"), F.col("t.toUserAccount"), _named(symbol, _none(), F.col("t.mint")), F.col("amount"), symbol.isNotNull(), F.col("payer"), F.col("t.mint")))
    return coins.unionByName(tokens)


ESPLORA = "txid string, status struct<block_time bigint>, vin array<struct<is_coinbase boolean, prevout struct<scriptpubkey_address string, value bigint>>>, vout array<struct<scriptpubkey_address string, value bigint>>"


def bitcoin_transactions(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """txid, ts, inputs and outputs (arrays of address, amount), coinbase, fee; a transaction once."""
    r = rows.select(F.from_json(raw, ESPLORA).alias("i")).where("i.txid is not null")
    side = lambda end: F.struct(end.scriptpubkey_address.alias("address"), F.coalesce(end.value, F.lit(0)).alias("amount"))
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x.amount)
    made = r.select(
        "i.txid", F.timestamp_seconds("i.status.block_time").alias("ts"), F.transform("i.vin", lambda v: side(v.prevout)).alias("inputs"), F.transform("i.vout", side).alias("outputs"),
        F.exists("i.vin", lambda v: F.coalesce(v.is_coinbase, F.lit(False))).alias("coinbase"),
    )
    fee = F.when(total("inputs") > 0, F.greatest(F.lit(0), total("inputs") - total("outputs"))).otherwise(F.lit(0))
    return made.withColumn("fee", fee).dropDuplicates(["txid"])


def transaction_table(transactions: DataFrame) -> DataFrame:
    """txid, ts, input_addresses, input_amounts, output_addresses, output_amounts, fee: ends with an address only."""
    known = lambda side: F.filter(side, lambda x: x.address.isNotNull())
    cols = [F.col("txid"), F.col("ts")]
    for side in ("input", "output"):
        cols += [F.transform(known(f"{side}s"), lambda x: x.address).alias(f"{side}_addresses"), F.transform(known(f"{side}s"), lambda x: x.amount).alias(f"{side}_amounts")]
    return transactions.select(*cols, "fee")


def mixes(table: DataFrame, min_equal: int = 5, min_share: float = 0.25, dust: int = 10_000) -> DataFrame:
    """txid of transactions that have a mix's shape and whose equal outputs aren't dust, of a transaction_table."""
    from flowlens.operators.utxo import coinjoins

    ends = F.transform(F.arrays_zip("output_addresses", "output_amounts"), lambda x: F.struct(x.output_addresses.alias("address"), x.output_amounts.alias("amount")))
    found = coinjoins(table.select("txid", F.col("input_addresses").alias("inputs"), ends.alias("outputs")), min_equal, min_share)
    return found.where(F.col("is_coinjoin") & (F.col("equal_value") >= dust)).select("txid")


def tron_freezes(rows: DataFrame, raw: str = "raw", address=tron_addresses) -> DataFrame:
    """event, address, ts, block, tx, log_index of a contract's event listing, each (tx, index) once."""
    item = F.from_json(raw, "event_name string, transaction_id string, event_index int, block_timestamp bigint, block_number bigint, result map<string, string>")
    r = rows.select(item.alias("i")).where("i.transaction_id is not null").withColumn("user", F.coalesce(F.col("i.result")["_user"], F.col("i.result")["0"]))
    out = r.select(F.col("i.event_name").alias("event"), address(F.concat(F.lit("41"), F.right("user", F.lit(40)))).alias("address"), F.timestamp_millis("i.block_timestamp").alias("ts"), F.col("i.block_number").alias("block"), F.col("i.transaction_id").alias("tx"), F.coalesce("i.event_index", F.lit(0)).alias("log_index"))
    return out.dropDuplicates(["tx", "log_index"])


def evm_freezes(rows: DataFrame, event: str, raw: str = "raw") -> DataFrame:
    item = F.from_json(raw, "transactionHash string, logIndex string, data string, timeStamp string, blockNumber string")
    r = rows.select(item.alias("i")).where("i.transactionHash is not null")
    number = lambda name: from_hex(F.nullif(F.col(f"i.{name}"), F.lit("0x"))).cast("long")
    out = r.select(F.lit(event).alias("event"), F.concat(F.lit("0x"), F.lower(F.right("i.data", F.lit(40)))).alias("address"), F.timestamp_seconds(number("timeStamp")).alias("ts"), number("blockNumber").alias("block"), F.col("i.transactionHash").alias("tx"), number("logIndex").cast("int").alias("log_index"))
    return out.dropDuplicates(["tx", "log_index"])


def stargate_recipient(payload: Column) -> Column:
    """Whom a message pays: type 1 (a byte), asset (2), receiver (32, an address behind zeros), amount (8); else null."""
    raw = F.lower(F.regexp_replace(payload, "^0x", ""))
    return F.when(raw.rlike("^01[0-9a-f]{4}0{24}[0-9a-f]{56}"), F.concat(F.lit("0x"), F.substring(raw, 31, 40)))


def _hop(rows: DataFrame, reason: Column, chain: Column, name: Column, recipient: Column, payout: Column) -> DataFrame:
    hit = reason.isNull()
    return rows.select("tx_hash", reason.alias("reason"), F.when(hit, chain).alias("to_chain"), F.when(hit, F.coalesce(chain, name)).alias("to_name"), F.when(hit, recipient).alias("recipient"), F.when(hit, payout).alias("payout_tx"))


def across_hops(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """tx_hash, reason (why it isn't matched), to_chain, to_name, recipient, payout_tx of answers (tx_hash, raw)."""
    item = F.from_json(raw, "error string, pagination struct<maxIndex int>, deposit struct<status string, fillTx string, destinationChainId int, recipient string>")
    r = rows.select("tx_hash", item.alias("i"))
    chain = looked_up(CHAIN_IDS, F.col("i.deposit.destinationChainId"))
    reason = F.when(F.col("i.error").isNotNull() | F.col("i.deposit").isNull(), "no_deposit").when(F.col("i.pagination.maxIndex") > 0, "several").when((F.col("i.deposit.status") != "filled") | F.col("i.deposit.fillTx").isNull(), "not_paid_out")
    to = F.when(chain.isNotNull(), F.lower("i.deposit.recipient")).otherwise(F.col("i.deposit.recipient"))
    return _hop(r, reason, chain, F.concat(F.lit("chain "), "i.deposit.destinationChainId"), to, F.lower("i.deposit.fillTx"))


def stargate_hops(rows: DataFrame, raw: str = "raw") -> DataFrame:
    message = "array<struct<status struct<name string>, source struct<tx struct<payload string>>, destination struct<tx struct<txHash string>>, pathway struct<dstEid int>>>"
    r = rows.select("tx_hash", F.from_json(raw, f"data {message}").alias("i")).withColumn("m", F.get("i.data", F.lit(0)))
    to = stargate_recipient(F.col("m.source.tx.payload"))
    chain = looked_up(ENDPOINTS, F.col("m.pathway.dstEid"))
    reason = F.when(F.col("m").isNull(), "no_message").when(F.size("i.data") > 1, "several").when((F.col("m.status.name") != "DELIVERED") | F.col("m.destination.tx.txHash").isNull(), "not_delivered").when(to.isNull(), "no_recipient")
    return _hop(r, reason, chain, F.concat(F.lit("endpoint "), "m.pathway.dstEid"), to, F.lower("m.destination.tx.txHash"))


def wormhole_hops(rows: DataFrame, raw: str = "raw") -> DataFrame:
    op = "array<struct<content struct<standarizedProperties struct<toAddress string, toChain int>>, targetChain struct<status string, transaction struct<txHash string>>>>"
    r = rows.select("tx_hash", F.from_json(raw, f"operations {op}").alias("i")).withColumn("o", F.get("i.operations", F.lit(0)))
    said, paid = F.col("o.content.standarizedProperties"), F.col("o.targetChain.transaction.txHash")
    chain = looked_up(WORMHOLE, said["toChain"])
    low = lambda c: F.when((chain.isNotNull() & (chain != "solana")) | c.startswith("0x"), F.lower(c)).otherwise(c)
    reason = F.when(F.col("o").isNull(), "no_transfer").when(F.size("i.operations") > 1, "several").when((F.coalesce(F.col("o.targetChain.status"), F.lit("")) != "completed") | paid.isNull(), "not_paid_out").when(said["toAddress"].isNull() | said["toChain"].isNull(), "no_recipient")
    return _hop(r, reason, chain, F.concat(F.lit("chain "), said["toChain"].cast("string")), low(said["toAddress"]), low(paid))


def request_key(url: Column, params: Column) -> Column:
    """A request in one form: parameters (a map of strings) sorted and encoded, secrets left out."""
    kept = F.array_sort(F.map_entries(F.map_filter(params, lambda k, v: ~F.lower(k).isin(*SECRETS))))
    query = F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e.key), F.lit("="), F.url_encode(e.value))), "&")
    return F.when(F.size(kept) > 0, F.concat(url, F.lit("?"), query)).otherwise(url)


CACHE_KEYS = ["chain", "address", "direction", "query"]


def cached(versions: DataFrame) -> DataFrame:
    """The newest whole answer of each request, over (chain, address, direction, query, raw, sha256, seq)."""
    whole = versions.where(F.sha2("raw", 256) == F.col("sha256"))
    best = whole.groupBy(*CACHE_KEYS).agg(F.max_by(F.struct("raw", "sha256"), "seq").alias("a"))
    return best.select(*CACHE_KEYS, "a.raw", "a.sha256")


def layered(caches: list[DataFrame]) -> DataFrame:
    """Of caches in order, the first that has a request answers it."""
    every = reduce(DataFrame.unionByName, (c.select(*CACHE_KEYS, "raw", F.lit(k).alias("layer")) for k, c in enumerate(caches)))
    return every.groupBy(*CACHE_KEYS).agg(F.min_by("raw", "layer").alias("raw"), F.min("layer").alias("layer"))

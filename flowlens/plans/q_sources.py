"""Queries that read recorded responses of chains, bridges and caches; the tables are put into their JSON first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ordered import micros
from flowlens.plans import binding as b
from flowlens.sources import chains

USDT, USDC = "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t", "0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48"
SOL_USDC = "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"


def _raw(rows: DataFrame, *also: str, **fields) -> DataFrame:
    return rows.select(*also, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("raw"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "chain", "tx_hash", F.col("block_time").cast("timestamp_ntz").alias("block_time"), "from_addr", "to_addr", "asset", F.col("amount").cast("double").alias("amount"),
        F.col("amount_usd").cast("double").alias("amount_usd"), "fee_payer", "asset_contract",
    )


def _seconds(ts):
    return F.floor(micros(ts) / 1_000_000).cast("long")


def _same(column):
    return column


def _lines(spark, sf_dir) -> DataFrame:
    t = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    tx = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return t.select(tx.alias("tx"), F.col("l_shipdate").alias("ts"), F.concat(F.lit("W"), "o_custkey").alias("src"), F.concat(F.lit("W"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("flag"), b.cents(F.col("l_extendedprice")).alias("cents"), F.col("l_linenumber").alias("line"))


def _tron_calls(spark, sf_dir) -> DataFrame:
    """Calls signed by another for first lines, coin payments for second ones, one in three of which failed."""
    rows = _lines(spark, sf_dir).where("line <= 2")
    value = F.struct(
        F.when(F.col("line") == 1, F.concat(F.lit("S"), F.col("dst"))).otherwise(F.col("src")).alias("owner_address"), F.when(F.col("line") == 2, F.col("dst")).alias("to_address"), F.when(F.col("line") == 2, F.col("cents") * 10).alias("amount")
    )
    call = F.array(F.struct(F.when(F.col("line") == 1, "TriggerSmartContract").otherwise("TransferContract").alias("type"), F.struct(value.alias("value")).alias("parameter")))
    ret = F.array(F.struct(F.when((F.col("line") == 2) & (F.col("cents") % 3 == 0), "REVERT").otherwise("SUCCESS").alias("contractRet")))
    return _raw(rows, F.col("dst").alias("address"), txID=F.col("tx"), block_timestamp=_seconds("ts") * 1000, ret=ret, raw_data=F.struct(call.alias("contract")))


def tron_rows(spark, sf_dir):
    """Token and coin payments, with the signers of their transactions as fee payers."""
    known = F.col("flag") == "A"
    token = F.struct(F.when(known, USDT).otherwise("C9").alias("address"), F.lit(6).alias("decimals"), F.when(F.col("flag") == "N", "XX").alias("symbol"))
    kind = F.when(F.col("cents") % 10 == 0, "Approval").otherwise("Transfer")
    tokens = _raw(_lines(spark, sf_dir), type=kind, value=(F.col("cents") * 10_000).cast("string"), transaction_id=F.col("tx"), block_timestamp=_seconds("ts") * 1000, **{"from": F.col("src"), "to": F.col("dst")}, token_info=token)
    return _shown(chains.tron_transfers(tokens, _tron_calls(spark, sf_dir), address=_same))


def tron_gas(spark, sf_dir):
    """Who covered the fees of receivers: signers of their calls, and coins of 1 to 100."""
    found = chains.tron_gas(_tron_calls(spark, sf_dir), address=_same)
    return found.select("address", F.col("time").cast("timestamp_ntz").alias("time"), "payer", "kind", "tx_hash", F.col("amount").cast("double").alias("amount"))


def evm_rows(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    ends = {"from": F.concat(F.lit("0xA"), "src"), "to": F.concat(F.lit("0xB"), "dst")}
    head = dict(hash=F.col("tx"), timeStamp=_seconds("ts").cast("string"), **ends)
    coins = _raw(rows.where("flag = 'R'"), **head, value=F.concat(F.col("cents").cast("string"), F.lit("0" * 16)), isError=F.when(F.col("cents") % 7 == 0, "1").otherwise("0"))
    contract = F.when(F.col("flag") == "A", F.upper(F.lit(USDC))).otherwise("0xC9")
    tokens = _raw(rows.where("flag <> 'R'"), **head, value=(F.col("cents") * 10_000).cast("string"), contractAddress=contract, tokenDecimal=F.lit("6"), tokenSymbol=F.lit("XX"), tokenID=F.when(F.col("cents") % 11 == 0, "5"))
    return _shown(chains.evm_coins(coins).unionByName(chains.evm_tokens(tokens)))


def rpc_rows(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    wei = F.concat(F.lit("0x"), F.lower(F.hex("cents")), F.lit("0000000000"))  # cents x 2^40
    coins = _raw(rows.where("flag = 'R'"), hash=F.col("tx"), timestamp=F.concat(F.lit("0x"), F.hex(_seconds("ts"))), **{"from": F.col("src"), "to": F.col("dst")}, value=wei, status=F.when(F.col("cents") % 7 == 0, "0x0").otherwise("0x1"))
    tokens = _raw(rows.where("flag <> 'R'"), transactionHash=F.col("tx"), timestamp=_seconds("ts"), fromAddress=F.col("src"), toAddress=F.col("dst"), valueRawInteger=F.col("cents").cast("string"), tokenDecimals=F.lit(2), tokenSymbol=F.lit("YY"), contractAddress=F.when(F.col("flag") == "A", USDC).otherwise(""))
    return _shown(chains.rpc_coins(coins).unionByName(chains.rpc_tokens(tokens)))


def solana_rows(spark, sf_dir):
    """An order as a transaction: coins of its first line, tokens of the others; a payment to a token account is rent."""
    t = _lines(spark, sf_dir).withColumn("key", F.substring_index("tx", "-", 1))
    one = F.struct(F.col("src").alias("fromUserAccount"), F.col("dst").alias("toUserAccount"), F.col("cents").alias("amount"), F.lit(None).cast("string").alias("mint"), F.lit(None).cast("string").alias("toTokenAccount"), F.lit(None).cast("double").alias("tokenAmount"))
    token = F.struct(F.col("src").alias("fromUserAccount"), F.col("dst").alias("toUserAccount"), F.lit(None).cast("long").alias("amount"), F.when(F.col("flag") == "A", SOL_USDC).otherwise("M1").alias("mint"), F.concat(F.lit("W"), F.col("cents") % 10).alias("toTokenAccount"), (F.col("cents") / 4).alias("tokenAmount"))
    first = F.col("line") == 1
    per = t.groupBy("key").agg(F.min("ts").alias("ts"), F.min("src").alias("payer"), F.collect_list(F.when(first, one)).alias("coins"), F.collect_list(F.when(~first, token)).alias("tokens"))
    raw = _raw(per, signature=F.col("key"), timestamp=_seconds("ts"), feePayer=F.col("payer"), nativeTransfers=F.col("coins"), tokenTransfers=F.col("tokens"))
    return _shown(chains.solana_transfers(raw))


def bitcoin_rows(spark, sf_dir):
    """Transactions from an explorer's JSON as a table, one of them listed twice, some ends without an address."""
    u = b.utxo(spark, sf_dir)
    ins = F.transform("inputs", lambda a: F.struct(F.lit(False).alias("is_coinbase"), F.struct(F.when(~a.endswith("7"), a).alias("scriptpubkey_address"), F.length(a).cast("long").alias("value")).alias("prevout")))
    outs = F.transform("outputs", lambda o: F.struct(F.when(~o.address.endswith("7"), o.address).alias("scriptpubkey_address"), (o.amount % 5).alias("value")))
    raw = _raw(u, txid=F.col("txid"), status=F.struct(_seconds("ts").alias("block_time")), vin=ins, vout=outs)
    table = chains.transaction_table(chains.bitcoin_transactions(raw.unionByName(raw)))
    return table.select("txid", F.col("ts").cast("timestamp_ntz").alias("ts"), F.array_join("input_addresses", ",").alias("inputs"), F.array_join("output_addresses", ",").alias("outputs"), F.array_join(F.col("output_amounts").cast("array<string>"), ",").alias("amounts"), "fee")


def mix_ids(spark, sf_dir):
    """Transactions with the shape of a mix, with amounts in steps so that some are equal."""
    u = b.utxo(spark, sf_dir)
    table = u.select("txid", F.col("inputs").alias("input_addresses"), F.transform("outputs", lambda o: o.address).alias("output_addresses"), F.transform("outputs", lambda o: F.floor(o.amount / 1_000_000).cast("long")).alias("output_amounts"))
    return chains.mixes(table, 2, 0.25, 3)


def freeze_logs(spark, sf_dir):
    """Events of two chains' logs, each once though pages overlap."""
    e = b.table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    user = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("user_id")), 40, "0"))
    name = F.when(F.col("event_type") == "signup", "Added").otherwise("Removed")
    tron = _raw(e, event_name=name, transaction_id=F.concat(F.lit("t"), "event_id"), event_index=F.lit(1), block_timestamp=_seconds("ts") * 1000, block_number=F.col("event_id"), result=F.create_map(F.lit("_user"), user))
    evm = _raw(e, transactionHash=F.concat(F.lit("e"), "event_id"), logIndex=F.lit("0x"), data=F.concat(F.lit("0x" + "0" * 24), F.substring(user, 3, 40)), timeStamp=F.concat(F.lit("0x"), F.hex(_seconds("ts"))), blockNumber=F.concat(F.lit("0x"), F.hex("event_id")))
    both = chains.tron_freezes(tron.unionByName(tron), address=_same).unionByName(chains.evm_freezes(evm.unionByName(evm), "Added"))
    return both.select("event", "address", F.col("ts").cast("timestamp_ntz").alias("ts"), "block", "tx", "log_index")


def bridge_hops(spark, sf_dir):
    """Three indexes' answers about deposits: whom they paid on which chain, or why that isn't known."""
    o = b.table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), "o_orderkey").alias("tx_hash"), F.col("o_orderkey").alias("k"), F.concat(F.lit("0xF"), "o_custkey").alias("who"))
    k = F.col("k")
    paid = F.when(k % 5 != 0, F.concat(F.lit("0xP"), k))
    across = _raw(o.where("k % 3 = 0"), "tx_hash", error=F.when(k % 7 == 0, "none"), pagination=F.struct(F.when(k % 11 == 0, 1).otherwise(0).alias("maxIndex")), deposit=F.struct(F.lit("filled").alias("status"), paid.alias("fillTx"), F.when(k % 2 == 0, 10).otherwise(777).alias("destinationChainId"), F.col("who").alias("recipient")))
    payload = F.concat(F.lit("0x01"), F.lit("0001"), F.lpad(F.lower(F.hex(k)), 64, "0"), F.lit("0" * 16))
    message = F.struct(F.struct(F.when(k % 5 != 0, "DELIVERED").otherwise("FAILED").alias("name")).alias("status"), F.struct(F.struct(F.when(k % 7 != 0, payload).otherwise("0x02").alias("payload")).alias("tx")).alias("source"), F.struct(F.struct(F.concat(F.lit("0xQ"), k).alias("txHash")).alias("tx")).alias("destination"), F.struct(F.when(k % 2 == 0, 30101).otherwise(9).alias("dstEid")).alias("pathway"))
    stargate = _raw(o.where("k % 3 = 1"), "tx_hash", data=F.when(k % 11 == 0, F.array(message, message)).otherwise(F.array(message)))
    op = F.struct(F.struct(F.struct(F.when(k % 7 != 0, F.col("who")).alias("toAddress"), F.when(k % 2 == 0, 1).otherwise(2).alias("toChain")).alias("standarizedProperties")).alias("content"), F.struct(F.when(k % 5 != 0, "completed").otherwise("waiting").alias("status"), F.struct(F.concat(F.lit("0xR"), k).alias("txHash")).alias("transaction")).alias("targetChain"))
    wormhole = _raw(o.where("k % 3 = 2"), "tx_hash", operations=F.array(op))
    parts = [chains.across_hops(across), chains.stargate_hops(stargate), chains.wormhole_hops(wormhole)]
    return reduce(DataFrame.unionByName, parts)


def block_lookup(spark, sf_dir):
    """The first block at or after each shipping date, and the last one before it."""
    dates = b.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts")).distinct()
    blocks = b.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.floor(micros("o_orderdate") / 12_000_000).cast("long").alias("block")).distinct()
    found = chains.block_at(dates, blocks).withColumnRenamed("block", "first_block").join(chains.block_at(dates, blocks, first=False).withColumnRenamed("block", "last_block"), "ts")
    return found.select("ts", "first_block", "last_block")


def request_keys(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    params = F.create_map(F.lit("page"), F.col("c_custkey").cast("string"), F.lit("apiKey"), F.lit("x"), F.lit("address"), F.concat(F.lit("W"), "c_custkey"))
    return c.select("c_custkey", chains.request_key(F.lit("https://h/a"), params).alias("key"))


def cache_layers(spark, sf_dir):
    """Answers from a cache of the newest versions and one below it; damaged versions don't count."""
    e = b.table(spark, sf_dir, "events")
    key = [F.lit("tron").alias("chain"), F.concat(F.lit("U"), "user_id").alias("address"), F.col("event_type").alias("direction"), F.lit("q").alias("query")]
    rows = e.select(*key, F.col("props").alias("raw"), F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.sha2("props", 256)).alias("sha256"), F.col("event_id").alias("seq"), F.col("event_type").isin("view", "click").alias("upper"))
    upper = chains.cached(rows.where("upper").drop("upper"))
    lower = chains.cached(rows.withColumn("raw", F.upper("raw")).withColumn("sha256", F.sha2("raw", 256)).drop("upper"))
    return chains.layered([upper, lower]).select("address", "direction", "raw", F.col("layer").cast("long").alias("layer"))


QUERIES = {f.__name__: f for f in (tron_rows, tron_gas, evm_rows, rpc_rows, solana_rows, bitcoin_rows, mix_ids, freeze_logs, bridge_hops, block_lookup, request_keys, cache_layers)}

_L = """l as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey as tx, l_orderkey::varchar as key, l_shipdate as ts, 'W' || o_custkey as src, 'W' || l_suppkey as dst, l_returnflag as flag,
    round(l_extendedprice * 100)::bigint as cents, l_linenumber as line from lineitem join orders on l_orderkey = o_orderkey)"""

ORACLES = {
    "tron_rows": f"""with {_L}, s as (select tx, min('S' || dst) as signer from l where line = 1 group by tx),
        t as (select 'tron' as chain, l.tx as tx_hash, ts as block_time, src as from_addr, dst as to_addr, case flag when 'A' then 'USDT' when 'N' then 'XX@C9' else '?@C9' end as asset, cents / 100 as amount,
            case when flag = 'A' then cents / 100 end as amount_usd, signer as fee_payer, case when flag = 'A' then '{USDT}' else 'C9' end as asset_contract from l left join s using (tx) where cents % 10 <> 0)
        select * from t union all select 'tron', tx, ts, src, dst, 'TRX', cents / 100000, null, src, null from l where line = 2 and cents % 3 <> 0""",
    "tron_gas": f"""with {_L} select dst as address, ts as time, 'S' || dst as payer, 'signer' as kind, tx as tx_hash, null::double as amount from l where line = 1
        union all select dst, ts, src, 'native', tx, cents / 100000 from l where line = 2 and cents % 3 <> 0 and cents between 100000 and 10000000 and src <> dst""",
    "evm_rows": f"""with {_L}, e as (select *, '0xa' || lower(src) as f, '0xb' || lower(dst) as t from l)
        select 'ethereum' as chain, tx as tx_hash, ts as block_time, f as from_addr, t as to_addr, 'ETH' as asset, cents / 100 as amount, null::double as amount_usd, f as fee_payer, null::varchar as asset_contract from e where flag = 'R' and cents % 7 <> 0
        union all select 'ethereum', tx, ts, f, t, case when flag = 'A' then 'USDC' else 'XX@0xc9' end, cents / 100, case when flag = 'A' then cents / 100 end, null, case when flag = 'A' then '{USDC}' else '0xc9' end
        from e where flag <> 'R' and cents % 11 <> 0""",
    "rpc_rows": f"""with {_L}, e as (select *, lower(src) as f, lower(dst) as t from l)
        select 'ethereum' as chain, tx as tx_hash, ts as block_time, f as from_addr, t as to_addr, 'ETH' as asset, ((cents::hugeint * 1099511627776)::decimal(38,0)::varchar::double) / 1e18 as amount, null::double as amount_usd, f as fee_payer, null::varchar as asset_contract
        from e where flag = 'R' and cents % 7 <> 0
        union all select 'ethereum', tx, ts, f, t, 'USDC', cents / 100, cents / 100, null, '{USDC}' from e where flag = 'A'""",
    "solana_rows": f"""with {_L}, k as (select key, min(ts) as moment, min(src) as payer, list('W' || (cents % 10)) filter (line <> 1) as acc from l group by key), j as (select l.*, moment, payer, coalesce(acc, []) as acc from l join k using (key))
        select 'solana' as chain, key as tx_hash, moment as block_time, src as from_addr, dst as to_addr, 'SOL' as asset, cents / 1e9 as amount, null::double as amount_usd, payer as fee_payer, null::varchar as asset_contract
        from j where line = 1 and src <> dst and cents > 0 and not list_contains(acc, src) and not list_contains(acc, dst)
        union all select 'solana', key, moment, src, dst, case when flag = 'A' then 'USDC' else '?@M1' end, cents / 4, case when flag = 'A' then cents / 4 end, payer, case when flag = 'A' then '{SOL_USDC}' else 'M1' end
        from j where line <> 1 and src <> dst and cents > 0""",
    "bitcoin_rows": b.sql("utxo", """select txid, ts, array_to_string(list_filter(inputs, lambda a: right(a, 1) <> '7'), ',') as inputs, array_to_string(list_filter(addresses, lambda a: right(a, 1) <> '7'), ',') as outputs,
        array_to_string(list_transform(list_filter(list_zip(addresses, amounts), lambda z: right(z[1], 1) <> '7'), lambda z: z[2] % 5), ',') as amounts,
        greatest(0, list_sum(list_transform(inputs, lambda a: length(a))) - list_sum(list_transform(amounts, lambda v: v % 5)))::bigint as fee from utxo"""),
    "mix_ids": b.sql("utxo", """with u as (select txid, inputs, unnest(list_transform(amounts, lambda x: x // 1000000)) as v, len(amounts) as n_out from utxo), k as (select txid, v, count(*) as n, any_value(n_out) as n_out, any_value(len(inputs)) as n_in from u group by all),
        best as (select * from k qualify row_number() over (partition by txid order by n desc, v desc) = 1) select txid from best where n >= 2 and n >= 0.25 * n_out and n_in >= n and v >= 3"""),
    "freeze_logs": """with e as (select *, lpad(lower(to_hex(user_id)), 40, '0') as u from events where event_type in ('signup', 'error'))
        select case when event_type = 'signup' then 'Added' else 'Removed' end as event, '41' || u as address, date_trunc('second', ts) as ts, event_id as block, 't' || event_id as tx, 1 as log_index from e
        union all select 'Added', '0x' || u, date_trunc('second', ts), event_id, 'e' || event_id, 0 from e""",
    "bridge_hops": """with o as (select 'd' || o_orderkey as tx_hash, o_orderkey as k, '0xF' || o_custkey as who from orders),
        x as (select *, case when k % 3 = 0 then case when k % 7 = 0 then 'no_deposit' when k % 11 = 0 then 'several' when k % 5 = 0 then 'not_paid_out' end
            when k % 3 = 1 then case when k % 11 = 0 then 'several' when k % 5 = 0 then 'not_delivered' when k % 7 = 0 then 'no_recipient' end
            else case when k % 5 = 0 then 'not_paid_out' when k % 7 = 0 then 'no_recipient' end end as reason,
            case k % 3 when 0 then case when k % 2 = 0 then 'optimism' end when 1 then case when k % 2 = 0 then 'ethereum' end else case when k % 2 = 0 then 'solana' else 'ethereum' end end as chain,
            case k % 3 when 0 then 'chain 777' when 1 then 'endpoint 9' end as other,
            case k % 3 when 0 then case when k % 2 = 0 then lower(who) else who end when 1 then '0x' || lpad(lower(to_hex(k)), 40, '0') else lower(who) end as recipient,
            case k % 3 when 0 then '0xp' when 1 then '0xq' else '0xr' end || k as payout from o)
        select tx_hash, reason, case when reason is null then chain end as to_chain, case when reason is null then coalesce(chain, other) end as to_name, case when reason is null then recipient end as recipient, case when reason is null then payout end as payout_tx from x""",
    "block_lookup": """with d as (select distinct l_shipdate as ts from lineitem), k as (select distinct o_orderdate as ts, floor(epoch_us(o_orderdate) / 12000000)::bigint as block from orders)
        select d.ts, (select min(block) from k where k.ts >= d.ts) as first_block, (select max(block) from k where k.ts <= d.ts) as last_block from d""",
    "request_keys": "select c_custkey, 'https://h/a?address=W' || c_custkey || '&page=' || c_custkey as key from customer",
    "cache_layers": """with a as (select 'U' || user_id as address, event_type as direction, arg_max(props, event_id) as raw, 0 as layer from events where event_type in ('view', 'click') and event_id % 10 <> 0 and props is not null group by 1, 2),
        w as (select 'U' || user_id as address, event_type as direction, arg_max(upper(props), event_id) as raw, 1 as layer from events where props is not null group by 1, 2)
        select address, direction, raw, layer::bigint as layer from (from a union all from w) qualify row_number() over (partition by address, direction order by layer) = 1""",
}

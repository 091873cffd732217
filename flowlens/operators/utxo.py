"""Transactions with several inputs and outputs: joins of many parties, shares, who paid whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coinjoins(utxo: DataFrame, min_equal: int = 3, min_share: float = 0.5) -> DataFrame:
    """txid, equal_value, n_equal, n_inputs, is_coinjoin: blocks of equal outputs that enough parties fund.

    Counted inside each transaction's arrays, without an explode; of equal counts the larger value.
    """
    best = utxo.select("txid", F.size(F.array_distinct("inputs")).cast("long").alias("n_inputs"), F.size("outputs").alias("n_outputs"), _largest_block().alias("b"))
    flag = (F.col("b.n") >= min_equal) & (F.col("b.n") >= min_share * F.col("n_outputs")) & (F.col("n_inputs") >= F.col("b.n"))
    return best.select("txid", F.col("b.value").alias("equal_value"), F.col("b.n").cast("long").alias("n_equal"), "n_inputs", flag.alias("is_coinjoin"))


def _largest_block() -> Column:
    amounts = F.col("outputs.amount")
    block = lambda v: F.struct(F.size(F.filter(amounts, lambda x: x == v)).alias("n"), v.alias("value"))
    return F.array_max(F.transform(F.array_distinct(amounts), block))


def is_coinjoin(min_equal: int = 3, min_share: float = 0.5) -> Column:
    """Of a transaction's own row whether it is one, for plans that needn't look it up by its id; not null."""
    n, amounts = _largest_block()["n"], F.col("outputs.amount")
    # few have as many equal amounts at all; only their blocks are counted
    flag = (F.size(amounts) - F.size(F.array_distinct(amounts)) >= min_equal - 1) & (n >= min_equal) & (n >= min_share * F.size("outputs")) & (F.size(F.array_distinct("inputs")) >= n)
    return F.coalesce(flag, F.lit(False))


def shares(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """txid, address, paid, fee_share: each input's part of every output, in whole units; the rest of it is its fee.

    inputs, outputs: txid, address, amount.
    """
    total = inputs.withColumn("total", F.sum("amount").over(W.partitionBy("txid")))
    met = total.withColumnRenamed("amount", "put").join(outputs.select("txid", F.col("amount").alias("out")), "txid")
    part = F.expr("cast((cast(out as decimal(38,0)) * put) div total as bigint)")
    return met.groupBy("txid", "address", "put").agg(F.sum(part).alias("paid")).select("txid", "address", "paid", (F.col("put") - F.col("paid")).alias("fee_share"))


def received(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """txid, sender, to_addr, amount: what each address got beyond its own inputs; the sender is the largest input."""
    sender = inputs.groupBy("txid").agg(F.max("amount").alias("most"))
    first = inputs.join(sender, "txid").where("amount = most").groupBy("txid").agg(F.min("address").alias("sender"))
    got = outputs.groupBy("txid", F.col("address").alias("to_addr")).agg(F.sum("amount").alias("got"))
    own = inputs.groupBy("txid", F.col("address").alias("to_addr")).agg(F.sum("amount").alias("put"))
    net = got.join(own, ["txid", "to_addr"], "left").withColumn("amount", F.col("got") - F.coalesce("put", F.lit(0))).where("amount > 0")
    return net.join(first, "txid").select("txid", "sender", "to_addr", "amount")


def payments(utxo: DataFrame, joined: DataFrame) -> DataFrame:
    """txid, funder, to_addr, certainty: who paid whom: certain with one funder and one destination, else pooled;
    nothing is told of coinjoins."""
    ends = F.array_except("outputs.address", "inputs")
    rows = utxo.join(joined.select("txid", "is_coinjoin"), "txid")
    kind = F.when(F.col("is_coinjoin"), "coinjoin").when(F.size(ends) == 0, "self").when((F.size("inputs") == 1) & (F.size(ends) == 1), "certain").when(F.size("inputs") == 1, "split").otherwise("pooled")
    one = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    return rows.select("txid", F.when(kind != "coinjoin", one(F.col("inputs"))).alias("funder"), F.when(kind != "coinjoin", one(ends)).alias("to_addr"), kind.alias("certainty"))


#: So many funding addresses aren't one person's ordinary payment.
POOL_INPUTS = 5
#: What stands for a wallet where money can't be followed on: `coinjoin:<txid>`, and so on.
SINKS = ("coinjoin", "pooled", "no-address", "fee")


def flows(inputs: DataFrame, outputs: DataFrame, mixes: DataFrame, own: bool = False) -> DataFrame:
    """tx_hash, from_addr, to_addr, amount: what each funder sent in each transaction, in whole units, and its fee.

    inputs, outputs: txid, address (may be null), amount, a row each. A funder's part of an output is by what it put in,
    rounded down, and its fee is the rest of that, so both add up to it. What comes back to it isn't sent. Its payments
    are told apart if it is the only funder or only one address is paid; else all go to one sink: `coinjoin:<txid>` for
    mixes (txid), `pooled:<txid>` for others. Outputs without an address go to `no-address:<txid>`, fees to
    `fee:<txid>`. own: for funders that are traced themselves, whose payments are told apart with fewer than POOL_INPUTS
    funders, unless equal outputs are as many as two and no more than the funders: the shape of a joint transaction.
    """
    return all_flows(inputs, outputs, mixes).where("mine" if own else "others").drop("mine", "others")


def all_flows(inputs: DataFrame, outputs: DataFrame, mixes: DataFrame) -> DataFrame:
    """The rows of flows for both uses, told apart by `mine` (with own) and `others` (without), for plans that need both."""
    # every step goes by txid, or by it and more, so inputs and outputs that are dealt by it are laid out once at most
    tx = W.partitionBy("txid")
    put = inputs.groupBy("txid", F.col("address").alias("from_addr")).agg(F.sum("amount").alias("put"))
    put = put.withColumns({"total": F.sum("put").over(tx), "funders": F.count("from_addr").over(tx)}).where("from_addr is not null and put > 0")
    put = put.join(mixes.select("txid", F.lit(True).alias("mix")).distinct(), "txid", "left")
    paid = outputs.groupBy("txid", F.col("address").alias("to"), "amount").agg(F.count(F.lit(1)).alias("n"))
    paid = paid.withColumn("equal", F.sum(F.when(F.col("to").isNotNull(), F.col("n"))).over(W.partitionBy("txid", "amount")))
    paid = paid.withColumn("equal", F.max("equal").over(tx)).groupBy("txid", "to").agg(F.sum(F.col("amount") * F.col("n")).alias("paid"), F.max("equal").alias("equal"))
    met = put.join(paid, "txid").withColumn("share", F.expr("cast((cast(paid as decimal(38,0)) * put) div total as bigint)"))
    sent = (F.col("share") > 0) & ~F.col("to").eqNullSafe(F.col("from_addr"))
    of = W.partitionBy("txid", "from_addr")
    met = met.withColumn("nth", F.row_number().over(of.orderBy("to")))
    met = met.withColumns({"n": F.count_if(sent).over(of), "amount": F.sum(F.when(sent, F.col("share"))).over(of), "fee": F.col("put") - F.sum("share").over(of)}).where("n > 0")
    certain = (F.col("funders") == 1) | (F.col("n") == 1)
    joint = (F.coalesce("equal", F.lit(0)) >= 2) & (F.col("funders") >= F.col("equal"))
    own = certain | ((F.col("funders") < POOL_INPUTS) & ~joint)
    sink = lambda told: F.when(F.col("mix"), "coinjoin").when(~told, "pooled")
    # what is told apart for others is so for one's own
    met = met.withColumns({"sink": sink(certain), "mine": sink(own).isNull(), "others": sink(certain).isNull()})
    at = lambda name: F.concat(name, F.lit(":"), F.col("txid"))
    row = lambda to, amount, mine, others: F.struct(to.alias("to_addr"), F.col(amount).alias("amount"), mine.alias("mine"), others.alias("others"))
    both, first = F.lit(True), F.col("nth") == 1
    rows = F.array(
        F.when(F.col("mine") & sent, row(F.coalesce("to", at(F.lit("no-address"))), "share", F.col("mine"), F.col("others"))),
        F.when(first & F.col("sink").isNotNull(), row(at(F.col("sink")), "amount", ~F.col("mine"), both)),
        F.when(first & (F.col("fee") > 0), row(at(F.lit("fee")), "fee", both, both)),
    )
    told = met.select("txid", "from_addr", F.explode(rows).alias("r")).where("r is not null").select("txid", "from_addr", "r.*")
    return told.withColumnRenamed("txid", "tx_hash")

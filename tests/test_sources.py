"""Readers and writers over small files."""

import gzip
import json
import re
from datetime import datetime

import pytest

from flowlens.operators import views
from flowlens.sources import readers, writers

T0 = datetime(2026, 1, 1)


def test_label_csv(spark, tmp_path):
    (tmp_path / "tron.csv").write_text("address,network,entity,label,category,source,confidence\nTabc,TRX,,Some Ex,exchange,site,0.9\nTx…yz,tron,A,b,exchange,site,1\n,tron,A,b,c,d,1\n")
    (tmp_path / "eth.csv").write_text("address,network,entity,label,category,source,confidence\n0xABCD,eth,Ex,l,exchange,site,high\n")
    (tmp_path / "_notes.csv").write_text("address,network,entity,label,category,source,confidence\nTn,tron,A,b,c,d,1\n")
    rows = {r.address: r for r in readers.label_csv(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"Tabc", "0xabcd"} and rows["Tabc"].entity == "Some Ex" and rows["Tabc"].confidence == 0.9
    assert rows["0xabcd"].chain == "ethereum" and rows["0xabcd"].confidence is None


def test_tag_packs_inherit(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"title": "T", "creator": "C", "currency": "BTC", "abuse": "scam", "tags": [{"address": " x1 "}, {"address": "y2", "currency": "ETH", "abuse": "ransomware", "label": "L"}]}))
    rows = {r.address: (r.chain, r.entity, r.threat, r.source) for r in readers.tag_packs(spark, str(tmp_path)).collect()}
    assert rows == {"x1": ("bitcoin", "T", "scam", "C"), "y2": ("ethereum", "L", "ransomware", "C")}


def test_ransom_wallets(spark, tmp_path):
    items = [{"address": "a", "blockchain": "bitcoin", "family": "F", "transactions": [{"hash": "h", "time": 1, "amount": 2, "amountUSD": 3.5}, {"hash": "i"}]}, {"address": "b", "blockchain": "other"}, {"address": "c", "blockchain": "Bitcoin"}]
    (tmp_path / "r.json").write_text(json.dumps({"result": items}))
    assert sorted((r.address, r.n_transactions, r.usd) for r in readers.ransom_wallets(spark, str(tmp_path)).collect()) == [("a", 2, 3.5), ("c", 0, 0.0)]


def test_sanctions_xml(spark, tmp_path):
    entry = lambda uid, *ids: f"<sdnEntry><uid>{uid}</uid><lastName>N{uid}</lastName><idList>{''.join(f'<id><idType>{t}</idType><idNumber>{n}</idNumber></id>' for t, n in ids)}</idList></sdnEntry>"
    (tmp_path / "s.xml").write_text("<list>" + entry(1, ("Passport", "P"), ("Digital Currency Address - XBT", "1abc")) + entry(2, ("Digital Currency Address - ETH", "0x1"), ("Digital Currency Address - TRX", "T1")) + "</list>")
    assert sorted(map(tuple, readers.sanctions_xml(spark, str(tmp_path / "s.xml")).collect())) == [("1", "N1", "bitcoin", "1abc"), ("2", "N2", "ethereum", "0x1"), ("2", "N2", "tron", "T1")]


def test_freezes_and_watchlist(spark, tmp_path):
    lines = [{"tx": "t", "log_index": 0, "block_ms": 1000, "event": "Added", "address": "a"}] * 2 + [{"tx": "t", "log_index": 1, "block_ms": 1000, "event": "Removed", "address": "b"}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, lines)))
    events = readers.freeze_events(spark, str(tmp_path / "f.json"))
    assert events.count() == 2 and [r.address for r in views.replay(events).collect()] == ["a"]
    (tmp_path / "w.txt").write_text("# note\nabcd1, Mine\n\n!!\nabcd2\n")
    kept, rejected = readers.watchlist(spark, str(tmp_path / "w.txt"), "watch")
    assert sorted(map(tuple, kept.collect())) == [("abcd1", "Mine"), ("abcd2", "watch")] and [r.value for r in rejected.collect()] == ["!!"]


def test_scan_knows_whether_it_is_complete(spark):
    rows = [(f"t{k}", T0, "a", "b" if k % 2 else "c", "USDT", k) for k in range(6)] + [("u", T0, "b", "a", "COIN", 9)]
    df = spark.createDataFrame(rows, "tx_hash string, block_time timestamp, from_addr string, to_addr string, asset string, amount long")
    assert [(r.tx_hash, r.complete) for r in readers.scan(df, "a", "out", limit=4).collect()] == [(f"t{k}", False) for k in range(4)]
    assert {r.complete for r in readers.scan(df, "a", limit=7).collect()} == {True}
    assert [r.tx_hash for r in readers.scan(df, "a", "in").collect()] == ["u"]
    with pytest.raises(ValueError):
        readers.scan(df, "a", "sideways")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("=cmd", 1, "x"), ("ok", 2, "y"), ("-1", 3, "x")], "name string, n int, chain string")
    writers.safe_csv(rows, str(tmp_path / "csv"))
    assert sorted(r.name for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["'-1", "'=cmd", "ok"]
    assert writers.snapshot(rows, str(tmp_path / "snap"), ["n"], "chain") == {"x": 2, "y": 1}
    writers.gzip_json(rows.coalesce(1), str(tmp_path / "gz"))
    assert len(gzip.open(next((tmp_path / "gz").glob("*.gz"))).read().splitlines()) == 3
    for n in (3, 1):
        writers.append_version(rows.limit(n), str(tmp_path / "runs"), "r1")
    writers.append_version(rows, str(tmp_path / "runs"), "r2")
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().collect()} == {("r1", 1), ("r2", 3)}


def test_graphml(spark):
    lines = writers.graphml(spark.createDataFrame([("a&b",), ("c",)], "id string"), spark.createDataFrame([("a&b", "c", 5)], "src string, dst string, value long"))
    text = "".join(r.line for r in lines.orderBy("part", "line").collect())
    import xml.etree.ElementTree as tree

    root = tree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text))
    assert [e.tag.rpartition("}")[2] for e in root.find("./{*}graph")] == ["node", "node", "edge"]


def test_tron_addresses_from_hex(spark):
    from flowlens.sources import chains

    row = '{"txID":"t","block_timestamp":1000,"ret":[{"contractRet":"SUCCESS"}],"raw_data":{"contract":[{"type":"TransferContract","parameter":{"value":{"owner_address":"41a614f803b6fd780986a42c78ec9c7f77e6ded13c","to_address":"410000000000000000000000000000000000000000","amount":1500000}}}]}}'
    got = chains.tron_coins(spark.createDataFrame([(row,), ("{}",), ("broken",), (None,)], "raw string")).collect()
    assert [(r.from_addr, r.to_addr, float(r.amount)) for r in got] == [("TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t", "T9yD14Nj9j7xAB4dbGeiX9h8unkKHxuWwb", 1.5)]


def test_amounts_lose_no_digit(spark):
    from pyspark.sql import functions as F

    from flowlens.sources import chains

    row = spark.createDataFrame([("123456789012345678901", 18, "0x21e19e0c9bab2400000")], "v string, d int, h string").select(chains.scaled(F.col("v"), F.col("d")).alias("a"), chains.scaled(F.col("v"), F.lit(0)).alias("b"), chains.from_hex(F.col("h")).alias("c")).first()
    assert (str(row.a), row.b, int(row.c)) == ("123.456789012345678901", None, 10**22)


def test_complaints_of_any_form(spark, tmp_path):
    from flowlens.sources import intake

    (tmp_path / "a.csv").write_text("﻿Case Ref;Wallet;Network\nF1;Taa;tron\n\n;Tbb;\n")
    (tmp_path / "b.csv").write_text('0xaa,ethereum,"F,2"\n,,\n0xbb\n')
    (tmp_path / "c.csv").write_text("address\tchain\nxx\tbtc\n")
    got = sorted((r.file[-5:], r.row, r.address, r.chain, r.case_ref) for r in intake.complaints(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 2, "Taa", "tron", "F1"), ("a.csv", 4, "Tbb", None, None), ("b.csv", 1, "0xaa", "ethereum", "F,2"), ("b.csv", 3, "0xbb", None, None), ("c.csv", 2, "xx", "btc", None)]


def test_seizures_checks_and_cases(spark, tmp_path):
    from flowlens.sources import intake

    tron = "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"
    (tmp_path / "o.csv").write_text(f"Order Type,Order Number,Order Date,Validity Date,Is Canceled,Assets\nASO,7,2024-01-01,2024-06-01,False,wallet {tron} and T1\nASO,8,2024-01-01,,TRUE,{tron}\n")
    rows = intake.seizure_orders(spark, str(tmp_path / "o.csv"), "2025-01-01").collect()
    assert [(r.address, r.chain, r.entity, r.evidence) for r in rows] == [(tron, "tron", "Seizure order 7", "ASO order 7 of 2024-01-01, valid until 2024-06-01 (lapsed)")]
    folder = tmp_path / "checks"
    folder.mkdir()
    for k, verdict in enumerate(("agrees", "differs")):
        (folder / f"{k}.csv").write_text(f"address,chain,verdict,owner\na,tron,{verdict},o{k}\n")
    assert [tuple(r) for r in intake.tag_checks(spark, str(folder)).collect()] == [("a", "tron", "differs", "o1")]
    (tmp_path / "r.json").write_text('{"c1": {"top_vasp": "Alpha"}, "c2": {"top_vasp": null}, "c3": {"top_vasp": "ALPHA"}}')
    assert sorted(map(tuple, intake.recorded_cases(spark, str(tmp_path / "r.json")).collect())) == [("alpha", "c1"), ("alpha", "c3")]
    labels = spark.createDataFrame([(tron, "bitcoin"), ("0x1985EA6E...2Fdb25c87", "base"), ("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed", "base"), ("x", "cosmos")], "address string, chain string")
    assert sorted((r.address[:3], r.chain) for r in intake.refiled(labels).collect()) == [("0x5", "base"), ("TR7", "tron"), ("x", "cosmos")]

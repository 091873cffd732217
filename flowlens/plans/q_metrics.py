"""Queries on scores: ranking, calibration, selection, splits, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import metrics, venn
from flowlens.plans import binding as b
from flowlens.session import cut

KS = [10, 25, 50]
EDGES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _scored(spark, sf_dir):
    return b.scored(spark, sf_dir)


def pr_auc(spark, sf_dir):
    return metrics.pr_auc(_scored(spark, sf_dir))


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir))


def precision_at_k(spark, sf_dir):
    return metrics.precision_at(_scored(spark, sf_dir), KS)


def recall_at_precision(spark, sf_dir):
    return metrics.recall_at_precision(_scored(spark, sf_dir), 0.86)


def reliability(spark, sf_dir):
    return metrics.reliability(_scored(spark, sf_dir))


def ece(spark, sf_dir):
    return metrics.expected_calibration_error(_scored(spark, sf_dir))


def adaptive_ece(spark, sf_dir):
    return metrics.adaptive_bins(_scored(spark, sf_dir), 15)


def mcc_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_scored(spark, sf_dir))


def risk_coverage(spark, sf_dir):
    return metrics.risk_coverage(_scored(spark, sf_dir), 1 - F.col("y"))


def queue_order(spark, sf_dir):
    return metrics.queue_order(_scored(spark, sf_dir), 50)


def brier_bins(spark, sf_dir):
    return metrics.brier_bins(_scored(spark, sf_dir), EDGES)


def _by_group(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("grp").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))


def wilson(spark, sf_dir):
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return _by_group(spark, sf_dir).select("grp", "hits", "n", low.alias("low"), high.alias("high"))


def clopper_pearson(spark, sf_dir):
    return _by_group(spark, sf_dir).withColumn("ci", metrics.clopper_pearson(F.col("hits"), F.col("n"))).select("grp", "hits", "n", "ci.low", "ci.high")


def fisher(spark, sf_dir):
    rows = _by_group(spark, sf_dir)
    all_ = F.broadcast(rows.agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n")))
    met = rows.join(all_).select("grp", "hits", (F.col("n") - F.col("hits")).alias("miss"), (F.col("all_hits") - F.col("hits")).alias("else_hits"), (F.col("all_n") - F.col("n") - F.col("all_hits") + F.col("hits")).alias("else_miss"))
    return met.withColumn("p", metrics.fisher(*[F.col(c) for c in ("hits", "miss", "else_hits", "else_miss")]))


def prior_adjust(spark, sf_dir):
    return _scored(spark, sf_dir).select("idx", F.round(metrics.adjust_to_prior(F.col("score"), 0.5, 0.2), 8).alias("adjusted"))


def em_prior(spark, sf_dir):
    share = metrics.em_prior(cut(_scored(spark, sf_dir)), 0.5)
    return spark.range(1).select(F.round(F.lit(share), 6).alias("prior"))


def venn_abers(spark, sf_dir):
    """The interval of each score of odd rows, over the even ones."""
    rows = _scored(spark, sf_dir)
    found = venn.venn_abers(rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1"))
    return found.select("score", *[F.round(c, 9).alias(c) for c in ("p0", "p1", "p")])


def venn_bins(spark, sf_dir):
    """Whether the intervals of odd rows meet what is observed, in ten bins of equal size, at the share of the even rows
    and moved to another."""
    rows = _scored(spark, sf_dir)
    known, asked = rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1")
    plain = cut(venn.intervals(known, asked))
    moved = venn.moved(plain, 0.5, 0.3)
    grid = lambda df: df.select("idx", "y", *[F.round(c, 9).alias(c) for c in ("p0", "p1", "p")])
    return venn.report(grid(plain)).withColumn("shift", F.lit("none")).unionByName(venn.report(grid(moved)).withColumn("shift", F.lit("prior")))


def _events(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").cast("long").alias("y"))


def time_split(spark, sf_dir):
    return metrics.time_split(_events(spark, sf_dir), ["ts", "event_id"]).select("event_id", "split")


def split_report(spark, sf_dir):
    return metrics.time_split(_events(spark, sf_dir), ["ts", "event_id"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"), F.round(F.avg("y"), 6).alias("rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def crossfit_folds(spark, sf_dir):
    return metrics.crossfit_folds(_events(spark, sf_dir), "user_id", "ts, event_id").select("event_id", "half", "fold")


def exchange_folds(spark, sf_dir):
    """Leave one group out: each row with the fold that tests it and how many folds train on it."""
    rows = _scored(spark, sf_dir)
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n_test"))
    n = F.broadcast(groups.agg(F.count(F.lit(1)).alias("n_folds"), F.sum("n_test").alias("all")))
    return groups.join(n).select("grp", "n_test", (F.col("all") - F.col("n_test")).alias("n_train"), "n_folds")


def leak_probe(spark, sf_dir):
    """How well single fields that must not tell anything rank the labels."""
    rows = _events(spark, sf_dir).select("y", F.minute("ts").alias("minute"), F.floor(F.second("ts")).alias("second"), (F.col("event_id") % 100).alias("tail"))
    out = None
    for probe, top in (("minute", 60), ("second", 60), ("tail", 100)):
        auc = metrics.roc_auc(rows.select(F.col(probe).alias("idx"), "y", (F.col(probe) / top).alias("score"))).select(F.lit(probe).alias("probe"), "roc_auc")
        out = auc if out is None else out.unionByName(auc)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        pr_auc, roc_auc, precision_at_k, recall_at_precision, reliability, ece, adaptive_ece, mcc_sweep, risk_coverage, queue_order, brier_bins, wilson, clopper_pearson, fisher,
        prior_adjust, em_prior, venn_abers, venn_bins, time_split, split_report, crossfit_folds, exchange_folds, leak_probe,
    )
}

_STEPS = """per as (select score, sum(y) as pos, count(*) as n from scored group by score),
    st as (select *, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as seen from per)"""
_SPLIT = """k as (select *, row_number() over (order by ts, event_id) as i, count(*) over () as n from events),
    sp as (select *, case when i <= floor(n * 0.6) then 'train' when i <= floor(n * 0.8) then 'validation' else 'test' end as split from k)"""
_AUC = """select '{p}' as probe, round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 8) as roc_auc from (
    select *, sum(n - pos) over (order by v) - (n - pos) as below from (select {v} as v, sum((event_type = 'purchase')::int) as pos, count(*) as n from events group by 1))"""
# the isotonic fit with one more row at s: the least rise from sums before s to sums from s on, moved by that row
_VENN = """c as (select score, sum(y) as y, count(*) as n from scored where idx % 2 = 0 group by 1),
    cum as (select score, sum(n) over (order by score) as n, sum(y) over (order by score) as y from c), q as (select distinct score as s from scored where idx % 2 = 1),
    l as (select s, 0 as n, 0 as y from q union all select s, n, y from q join cum on score < s),
    r as (select s, coalesce(max(n), 0) as n, coalesce(max(y), 0) as y from q left join cum on score <= s group by s union all select s, n, y from q join cum on score > s),
    least as (select s, l.n, l.y, min((r.y - l.y) / (r.n - l.n + 1)) as f0, min((r.y - l.y + 1) / (r.n - l.n + 1)) as f1 from l join r using (s) group by all),
    va as (select s as score, max(f0) as p0, max(f1) as p1 from least group by 1)"""
_ODD = "a as (select idx, y, p0, p1 from scored join va using (score) where idx % 2 = 1)"
_MOVED = "m as (select idx, y, " + ", ".join(f"{c}_ * 0.3::double / 0.5 / ({c}_ * 0.3::double / 0.5 + (1 - {c}_) * 0.7::double / 0.5) as {c}" for c in ("p0", "p1")) + " from (select *, " + ", ".join(f"least(greatest({c}, 1e-6), 1 - 1e-6) as {c}_" for c in ("p0", "p1")) + " from a))"
_BINS = """select bin - 1 as bin, n, round(low, 4) as low, round(high, 4) as high, round(hits / n, 4) as observed, round(round(ci_low, 6), 4) as ci_low, round(round(ci_high, 6), 4) as ci_high,
        high >= round(ci_low, 6) - 1e-9 and low <= round(ci_high, 6) + 1e-9 as inside, '{name}' as shift from (
        select *, greatest((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - w, 0) as ci_low, least((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + w, 1) as ci_high from (
        select *, 1.96::double / (1 + 3.8416 / n) * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4.0 * n * n)) as w from (
        select bin, count(*) as n, avg(round(p0, 9)) as low, avg(round(p1, 9)) as high, sum(y)::bigint as hits from (select *, ntile(10) over (order by round(p1 / (1 - p0 + p1), 9), idx) as bin from {rows}) group by 1)))"""

ORACLES = {
    "venn_abers": b.sql("scored", f"with {_VENN} select score, round(p0, 9) as p0, round(p1, 9) as p1, round(p1 / (1 - p0 + p1), 9) as p from va"),
    "venn_bins": b.sql("scored", f"with {_VENN}, {_ODD}, {_MOVED} {_BINS.format(name='none', rows='a')} union all {_BINS.format(name='prior', rows='m')}"),
    "pr_auc": b.sql("scored", f"with {_STEPS} select round(sum(pos * tp / seen) / sum(pos), 8) as pr_auc from st"),
    "roc_auc": b.sql("scored", """with per as (select score, sum(y) as pos, count(*) as n from scored group by score), u as (select *, sum(n - pos) over (order by score) - (n - pos) as below from per)
        select round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))), 8) as roc_auc from u"""),
    "precision_at_k": b.sql("scored", " union all ".join(f"select {k}::bigint as k, round(avg(y), 6) as precision, round(avg(score), 6) as mean_score from (select * from scored order by score desc, idx limit {k})" for k in KS)),
    "recall_at_precision": b.sql("scored", f"with {_STEPS} select round(coalesce(max(tp) filter (tp >= 0.86 * seen), 0) / sum(pos), 8) as recall from st"),
    "reliability": b.sql("scored", "select least(floor(score * 10), 9)::bigint as bin, count(*) as n, round(avg(score), 8) as mean_score, round(avg(y), 8) as mean_y from scored group by 1"),
    "ece": b.sql("scored", """with r as (select least(floor(score * 10), 9) as bin, count(*) as n, round(avg(score), 8) as s, round(avg(y), 8) as m from scored group by 1) select round(sum(abs(s - m) * n) / sum(n), 6) as ece from r"""),
    "adaptive_ece": b.sql("scored", """select bin - 1 as bin, count(*) as n, round(avg(score), 8) as mean_score, round(avg(y), 8) as mean_y
        from (select *, ntile(15) over (order by score, idx) as bin from scored) group by 1"""),
    "mcc_sweep": b.sql("scored", """with c as (select t, sum(y) filter (cell >= t) as tp, sum(1 - y) filter (cell >= t) as fp, sum(1 - y) filter (cell < t) as tn, sum(y) filter (cell < t) as fn
            from (select y, floor(score * 100 + 1e-9) as cell from scored), (select range as t from range(1, 100)) group by t),
        d as (select t, coalesce(tp, 0)::double as tp, coalesce(fp, 0)::double as fp, coalesce(tn, 0)::double as tn, coalesce(fn, 0)::double as fn from c)
        select round(t / 100, 4) as threshold, tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end as precision,
            case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0 end as f1,
            case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) else 0 end as mcc,
            case when (tp + fn) * (tn + fp) > 0 then round((tp * (tn + fp) + tn * (tp + fn)) / (2 * (tp + fn) * (tn + fp)), 6) else 0 end as balanced_accuracy from d"""),
    "risk_coverage": b.sql("scored", """with k as (select sum(1 - y) over w as e, row_number() over w as k, count(*) over () as n, sum(1 - y) over () as errors from scored window w as (order by score desc, idx rows unbounded preceding)),
        p as (select n, errors::bigint as errors, avg(e / k) as aurc, avg(greatest(k - (n - errors), 0) / k) as oracle from k group by all)
        select n, errors, round(aurc, 6) as aurc, round(oracle, 6) as oracle, round(aurc - oracle, 6) as excess from p"""),
    "queue_order": b.sql("scored", "select idx, score, amount from scored order by round(score, 2) desc, amount desc, score desc, idx limit 50"),
    "brier_bins": b.sql("scored", """select (case when score >= 0.9 then 5 when score >= 0.75 then 4 when score >= 0.5 then 3 when score >= 0.25 then 2 when score >= 0.1 then 1 else 0 end)::bigint as bin, count(*) as n,
        round(avg(score), 8) as mean_score, round(avg(y), 8) as mean_y, round(avg((score - y) * (score - y)), 6) as brier, round(avg(y) * (1 - avg(y)), 6) as constant from scored group by 1"""),
    "wilson": b.sql("scored", """with g as (select grp, sum(toxic)::bigint as hits, count(*) as n from scored group by 1), w as (select *, hits / n as p, 1.96::double as z from g)
        select grp, hits, n, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 0), 6) as low,
               round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1), 6) as high from w"""),
    "prior_adjust": b.sql("scored", """with p as (select idx, least(greatest(score, 1e-6), 1 - 1e-6) as p from scored)
        select idx, round((p * 0.2::double / 0.5::double) / (p * 0.2::double / 0.5::double + (1 - p) * (1 - 0.2::double) / (1 - 0.5::double)), 8) as adjusted from p"""),
    "time_split": f"with {_SPLIT} select event_id, split from sp",
    "split_report": f"with {_SPLIT} select split, count(*) as n, sum((event_type = 'purchase')::int)::bigint as n_positive, round(avg((event_type = 'purchase')::int), 6) as rate, min(ts) as first_ts, max(ts) as last_ts from sp group by split",
    "crossfit_folds": """with h as (select event_id, (2 * (row_number() over (partition by user_id order by ts, event_id) - 1)) // count(*) over (partition by user_id) as half, user_id from events)
        select event_id, half::bigint as half, ('0x' || substr(md5(user_id || '-' || half::bigint), 1, 7))::bigint % 5 as fold from h""",
    "exchange_folds": b.sql("scored", """with g as (select grp, count(*) as n_test from scored group by 1) select grp, n_test, (sum(n_test) over ())::bigint - n_test as n_train, count(*) over () as n_folds from g"""),
    "leak_probe": " union all ".join(_AUC.format(p=p, v=v) for p, v in (("minute", "minute(ts)"), ("second", "second(ts)"), ("tail", "event_id % 100"))),
}

"""Queries that train models, and streams run to their end over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import attributions, crossfit, density, flow, ml, venn, views
from flowlens.plans import binding as b
from flowlens.session import cut, scratch_path
from flowlens.streaming import state

FEATURES = ["n_in", "n_out", "n_senders", "n_recipients", "out_per_in", "forward_ratio", "top_recipient_share", "dwell_median_s", "sweep_gap_cv"]


def _wallets(spark, sf_dir):
    """Wallets with their features, and a label that follows from their activity."""
    e = b.wallet_events(spark, sf_dir)
    return cut(views.deposit_features(e, flow.lifo_pairs(e)).withColumn("y", (F.col("n_out") > F.col("n_in") * 2).cast("int")))


def gbt_score(spark, sf_dir):
    rows = _wallets(spark, sf_dir)
    model = ml.fit_trees(rows.where("crc32(cast(wallet as binary)) % 3 <> 0"), FEATURES)
    return ml.score_trees(model, rows, FEATURES).select("wallet", "y", F.round("p", 6).alias("p"), ml.fuse(F.col("forward_ratio"), F.col("p")).alias("confidence"))


def gbt_importance(spark, sf_dir):
    model = ml.fit_trees(_wallets(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(f, round(v, 6)) for f, v in ml.importance(model, FEATURES)], "feature string, share double")


def _shaped(spark, sf_dir):
    rows = _wallets(spark, sf_dir)
    return cut(attributions.tree_shap(ml.fit_trees(rows, FEATURES), rows, FEATURES, "wallet"))


def tree_shap(spark, sf_dir):
    """What each feature adds to each wallet's margin, exactly."""
    found = attributions.effects_by_feature(_shaped(spark, sf_dir), FEATURES, "wallet")
    return found.select("wallet", "feature", F.round("effect", 9).alias("effect"), "place")


def shap_importance(spark, sf_dir):
    return attributions.global_importance(_shaped(spark, sf_dir), FEATURES).withColumn("share", F.round("share", 6))


def crossfit_scores(spark, sf_dir):
    """Every wallet's score by a model that hasn't seen its fold, all folds trained together."""
    rows = _wallets(spark, sf_dir).withColumn("fold", (F.crc32(F.col("wallet").cast("binary")) % 5).cast("string"))
    found = crossfit.crossfit(rows.select("wallet", "fold", "y", *FEATURES), FEATURES, crossfit.Settings(trees=15))
    return found.select("wallet", "fold", F.col("y").cast("int").alias("y"), F.round("p", 6).alias("p"))


def gbt_calibrated(spark, sf_dir):
    """Scores of held-out wallets as Venn-Abers intervals over the others."""
    scored = gbt_score(spark, sf_dir).select("wallet", "y", F.col("p").alias("score"))
    mark = F.crc32(F.col("wallet").cast("binary")) % 3
    return venn.venn_abers(scored.where(mark == 1), scored.where(mark == 2))


def novelty_score(spark, sf_dir):
    return ml.novelty(b.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "novelty")


def novelty_clusters(spark, sf_dir):
    places = ml.projected(b.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ml.density_clusters(places, "vec_id", ["c1", "c2"])


def novelty_archetypes(spark, sf_dir):
    """The most stable density clusters of all scales."""
    places = ml.projected(b.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return density.hierarchical_clusters(places, "vec_id", ["c1", "c2"])


def _stream(spark, sf_dir, columns):
    schema = b.table(spark, sf_dir, "events").schema
    # a stream reads folders: the one file is picked by its name
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return source.select(*columns)


def _drained(stream, mode, name):
    """All that a stream yields over its files, by way of a table in the shared folder."""
    spark = stream.sparkSession
    base = scratch_path(spark, f"stream-{name}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query = query.foreachBatch(state.by_batch(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def stream_tumbling(spark, sf_dir):
    stream = _stream(spark, sf_dir, [F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"])
    rows = _drained(state.tumbling(stream), "update", "tumbling")
    newest = views.latest(rows, ["start", "event_type"], [F.col("batch").desc()])
    return newest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def stream_dedup(spark, sf_dir):
    stream = _stream(spark, sf_dir, [F.concat(F.lit("n"), F.expr("event_id div 3")).alias("nonce"), F.col("ts").cast("timestamp").alias("ts")])
    return _drained(state.claim_once(stream, "400 days"), "append", "dedup").select("nonce")


def stream_watch(spark, sf_dir):
    """When users, looked at by each of their events, fall due again after a day; errors end the watch."""
    stream = _stream(spark, sf_dir, [F.concat(F.lit("U"), "user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("watched")])
    return _drained(state.watch(stream, 86400), "append", "watch").select("id", F.col("due").cast("timestamp_ntz").alias("due"))


def stream_freeze_state(spark, sf_dir):
    stream = _stream(spark, sf_dir, [F.concat(F.lit("U"), "user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type"])
    stream = stream.where("event_type in ('signup', 'error')").select("address", "ts", "seq", (F.col("event_type") == "signup").alias("added"))
    rows = _drained(state.frozen(stream), "update", "freeze")
    newest = views.latest(rows, ["address"], [F.col("batch").desc()])
    return newest.where("since is not null").select("address", F.col("since").cast("timestamp_ntz").alias("since"))


QUERIES = {f.__name__: f for f in (gbt_score, gbt_importance, tree_shap, shap_importance, crossfit_scores, gbt_calibrated, novelty_score, novelty_clusters, novelty_archetypes, stream_tumbling, stream_dedup, stream_watch, stream_freeze_state)}

ORACLES = {
    "stream_tumbling": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by all",
    "stream_dedup": "select distinct 'n' || (event_id // 3) as nonce from events",
    "stream_watch": """with e as (select 'U' || user_id as id, ts, event_type <> 'error' as watched, lead(ts) over (partition by user_id order by ts, event_id) as next, max(ts) over () as latest from events)
        select id, ts + interval 1 day as due from e where watched and coalesce(next, latest - interval 10 minute) >= ts + interval 1 day""",
    "stream_freeze_state": """with f as (select 'U' || user_id as address, ts, event_id as seq, event_type = 'signup' as added from events where event_type in ('signup', 'error'))
        select address, min(ts) as since from f where added and not exists (select 1 from f g where g.address = f.address and not g.added and row(g.ts, g.seq) > row(f.ts, f.seq)) group by address""",
}

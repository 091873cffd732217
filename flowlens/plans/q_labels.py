"""Queries on label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import labels as ops
from flowlens.plans import binding as b

ALIASES = {"nation": "Peoples Exchange", "nation 1 hot wallet": "Union Exchange"}


def label_dedupe(spark, sf_dir):
    return ops.dedupe(b.label_sources(spark, sf_dir))


def label_conflicts(spark, sf_dir):
    return ops.drop_conflicting(b.label_sources(spark, sf_dir))


def label_lookup(spark, sf_dir):
    keys = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("W"), "c_custkey").alias("address"), F.element_at(F.array(*map(F.lit, ["ASIA", "EUROPE", "AFRICA"])), (F.col("c_custkey") % 3 + 1).cast("int")).alias("chain"))
    rows = label_dedupe(spark, sf_dir)
    family = rows.where("chain = 'AMERICA'").withColumn("chain", F.lit(ops.FAMILY))
    return ops.lookup(keys, rows.unionByName(family))


def label_stats(spark, sf_dir):
    return ops.counts(b.label_sources(spark, sf_dir), ["chain", "category", "tier", "kind", "source"])


def entity_breakdown(spark, sf_dir):
    return b.label_sources(spark, sf_dir).groupBy("entity", "category", "chain", "tier").agg(F.count(F.lit(1)).alias("n"))


def entity_counts(spark, sf_dir):
    return b.label_sources(spark, sf_dir).where("entity like '%1'").groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


def _tags(spark, sf_dir):
    """Threat tags: customers of some segments, by one or two sources."""
    c = b.table(spark, sf_dir, "customer")
    threat = F.element_at(F.array(*map(F.lit, ["sanctions", "terrorism", "ransomware", "scam", "none"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("W"), "c_custkey").alias("address"), threat.alias("threat"), F.lit("official").alias("source"), F.col("c_mktsegment").alias("entity"))
    more = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("W"), "c_custkey").alias("address"), F.lit("scam").alias("threat"), F.lit("reports").alias("source"), F.col("c_name").alias("entity"))
    return rows.unionByName(more).where("threat <> 'none'")


def threat_merge(spark, sf_dir):
    return ops.merge_threats(_tags(spark, sf_dir))


def threat_apply(spark, sf_dir):
    return ops.apply_threats(b.labels(spark, sf_dir), threat_merge(spark, sf_dir))


def threat_stats(spark, sf_dir):
    """Counts by threat, by threat and segment, by threat and source, in one pass over grouping sets."""
    rows = _tags(spark, sf_dir).where("source = 'official' or entity is not null").withColumnRenamed("entity", "segment")
    sides = [F.col("threat"), F.col("segment"), F.col("source")]
    per = rows.groupingSets([[sides[0]], [sides[0], sides[1]], [sides[0], sides[2]]], *sides)
    return per.agg(F.grouping_id("threat", "segment", "source").cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def normalise_labels(spark, sf_dir):
    n, s = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "supplier")
    marks = F.element_at(F.array(*map(F.lit, ["", " Dep: 12", " Hot Wallet", " 14", " Cold-Vault"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    source = F.element_at(F.array(*map(F.lit, ["registry+crowd", "model", "crowd+model", "x+tagset"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.concat("n_name", marks).alias("label"), source.alias("source"))
    return rows.select("s_suppkey", ops.canonical_entity(F.col("label"), ALIASES).alias("entity"), ops.infer_kind(F.col("label")).alias("kind"), ops.tier_of(F.col("source")).alias("tier"))


def seeds(spark, sf_dir):
    return ops.seeds(b.label_sources(spark, sf_dir)).select("address", "chain", "entity", "source")


def hidden_labels(spark, sf_dir):
    keys = b.transfers(spark, sf_dir).where("from_addr = 'W1'").select(F.col("to_addr").alias("address")).distinct()
    return ops.hidden(b.label_sources(spark, sf_dir), keys)


def without_tier(spark, sf_dir):
    return b.label_sources(spark, sf_dir).where("tier <> 'derived'")


def label_search_page(spark, sf_dir):
    return ops.search(b.label_sources(spark, sf_dir), "nation_1", 20, 5)


def tag_check(spark, sf_dir):
    tags = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("W"), "c_custkey").alias("address"), "c_nationkey").join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ops.tag_check(b.transfers(spark, sf_dir), b.labels(spark, sf_dir), tags.select("address", F.col("n_name").alias("tagged")))


QUERIES = {
    f.__name__: f
    for f in (
        label_dedupe, label_conflicts, label_lookup, label_stats, entity_breakdown, entity_counts, threat_merge, threat_apply, threat_stats, normalise_labels,
        seeds, hidden_labels, without_tier, label_search_page, tag_check,
    )
}

_BEST = f"""best as (select * exclude (n) from (select *, row_number() over (partition by address, chain order by {b._sql_rank(b.TIER_RANK, "tier")} desc,
    {b._sql_rank(b.CATEGORY_RANK, "category")} desc, source, confidence desc, entity) as n from label_sources) where n = 1)"""
_TAGS = """tags as (select 'W' || c_custkey as address, ['sanctions', 'terrorism', 'ransomware', 'scam', 'none'][c_custkey % 5 + 1] as threat, 'official' as source, c_mktsegment as entity
        from customer where c_custkey % 3 = 0 and c_custkey % 5 <> 4 union all select 'W' || c_custkey, 'scam', 'reports', c_name from customer where c_custkey % 4 = 0)"""
_MERGED = """ranked as (select *, row_number() over (partition by address order by case threat when 'sanctions' then 4 when 'terrorism' then 3 when 'ransomware' then 2 when 'scam' then 1 else 0 end desc,
        source, entity, threat) as n from tags),
    merged as (select address, max(threat) filter (n = 1) as threat, max(source) filter (n = 1) as threat_source,
        coalesce(string_agg(source || ':' || threat, ',' order by source || ':' || threat) filter (n > 1), '') as threat_also from ranked group by address)"""

ORACLES = {
    "label_dedupe": b.sql("label_sources", f"with {_BEST} select * from best"),
    "label_conflicts": b.sql("label_sources", "select * from label_sources where (address, chain) in (select (address, chain) from label_sources group by address, chain having count(distinct entity) = 1)"),
    "label_lookup": b.sql("label_sources", f"""with {_BEST}, l as (select * from best union all select address, 'FAMILY', entity, category, tier, kind, source, confidence from best where chain = 'AMERICA'),
        k as (select 'W' || c_custkey as address, ['ASIA', 'EUROPE', 'AFRICA'][c_custkey % 3 + 1] as chain from customer)
        select k.address, k.chain, coalesce(a.entity, f.entity) as entity, case when a.address is null then f.category else a.category end as category, case when a.address is null then f.tier else a.tier end as tier
        from k left join l a on a.address = k.address and a.chain = k.chain left join l f on f.address = k.address and f.chain = 'FAMILY' and k.chain in ('EUROPE', 'ASIA')"""),
    "label_stats": b.sql("label_sources", " union all ".join(f"select '{c}' as dimension, {c} as value, count(*) as n from label_sources group by 2" for c in ["chain", "category", "tier", "kind", "source"])),
    "entity_breakdown": b.sql("label_sources", "select entity, category, chain, tier, count(*) as n from label_sources group by all"),
    "entity_counts": b.sql("label_sources", "select chain, count(*) as n from label_sources where entity like '%1' group by chain"),
    "threat_merge": f"with {_TAGS}, {_MERGED} select * from merged",
    "threat_apply": b.sql("labels", f"""with {_TAGS}, {_MERGED}
        select coalesce(l.address, m.address) as address, coalesce(entity, 'unknown') as entity,
               case when threat in ('sanctions', 'terrorism') then 'sanctioned' else coalesce(category, 'threat') end as category, threat
        from labels_rel l full join merged m on l.address = m.address"""),
    "threat_stats": f"""with {_TAGS} select threat, entity as segment, source, grouping_id(threat, entity, source)::bigint as level, count(*) as n from tags
        group by grouping sets ((threat), (threat, entity), (threat, source))""",
    "normalise_labels": """with r as (select s_suppkey, n_name || ['', ' Dep: 12', ' Hot Wallet', ' 14', ' Cold-Vault'][s_suppkey % 5 + 1] as label,
                ['registry+crowd', 'model', 'crowd+model', 'x+tagset'][s_suppkey % 4 + 1] as source from supplier join nation on s_nationkey = n_nationkey),
        g as (select *, trim(regexp_replace(regexp_replace(lower(split_part(label, ' Dep:', 1)), '[^a-z0-9]+', ' ', 'g'), '\\s+[0-9]+$', '')) as slug from r)
        select s_suppkey, case slug when 'nation' then 'Peoples Exchange' when 'nation 1 hot wallet' then 'Union Exchange'
                   else array_to_string(list_transform(string_split(slug, ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as entity,
               case when regexp_matches(lower(label), 'deposit|dep:') then 'deposit' when regexp_matches(lower(label), 'cold|vault') then 'cold'
                    when regexp_matches(lower(label), 'hot|withdraw') then 'hot' when lower(label) like '%reserve%' then 'reserve' else 'unknown' end as kind,
               case when source like '%registry%' then 'published_por' when source like '%tag%' then 'curated' when source like '%crowd%' then 'explorer_tag' else 'derived' end as tier from g""",
    "seeds": b.sql("label_sources", "select address, chain, entity, source from label_sources where category in ('exchange', 'swap') and tier <> 'derived' and kind <> 'deposit'"),
    "hidden_labels": b.sql("label_sources transfers", "select * from label_sources where address not in (select to_addr from transfers where from_addr = 'W1')"),
    "without_tier": b.sql("label_sources", "select * from label_sources where tier <> 'derived'"),
    "label_search_page": b.sql("label_sources", "select * from label_sources where address ilike 'nation_1%' or entity ilike '%nation_1%' order by entity, chain, address, source limit 20 offset 5"),
    "tag_check": b.sql("transfers labels", """with s as (select from_addr, to_addr, count(*) as n from transfers group by all),
        t as (select * from (select *, row_number() over (partition by from_addr order by n desc, to_addr) as i from s) where i = 1),
        g as (select 'W' || c_custkey as address, n_name as tagged from customer join nation on c_nationkey = n_nationkey)
        select g.address, tagged, to_addr as top_to, n, case when to_addr is null then 'no_payments' when l.entity is null then 'unlabelled' when l.entity = tagged then 'agrees' else 'differs' end as verdict
        from g left join t on g.address = from_addr left join labels_rel l on l.address = to_addr"""),
}

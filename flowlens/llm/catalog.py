"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import byte_bpe, decontaminate, exact_dedup, html_extract, labelled_pages, language_id, line_dedup, mixing, prefix_trie, quality, simhash, token_alignment, toxicity, warc
from flowlens.llm.common import scratch_path, table, written


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    potentials = html_extract.train(labelled_pages.labelled_pages(spark))
    return html_extract.extract(table(spark, sf_dir, "pages"), potentials)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its text rewritten without its source's boilerplate lines."""
    cut = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names, "contaminated")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to archives in the shared folder and reads them back."""
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(pages, scratch_path(spark, "warc"))
    found = warc.read_archives(spark, manifest)
    kind = dict(pages.dtypes)["page_id"]
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the byte-level and of the piece vocabulary, over the same bytes."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = token_alignment.align(table(spark, sf_dir, "documents"), *files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = token_alignment.weigh(rows.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the text that they give back."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file).drop("text")
    read = byte_bpe.decode(coded, file)
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations whose beginnings are those of their block's first."""
    turns = written(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "ordered-turns")
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_exact_dedup": f"""
        with d as (select doc_id, {_LOWER} as norm from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from d window w as (partition by norm)""",
    # the level of the targets: sources in order of (2 x size / weight), the first at which no later one is capped
    "op3_mixing": r"""
        with d as (select doc_id, source, md5('mix-' || coalesce(doc_id::varchar, '')) as key,
                          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
        o as (select *, coalesce(sum(2 * source_size) over (order by 2.0 * source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as capped,
                     sum(weight) over (order by 2.0 * source_size / weight, source rows between current row and unbounded following) as open,
                     sum(source_size) over () as total, row_number() over (order by 2.0 * source_size / weight, source) as rn from w),
        l as (select arg_min((1.5 * total::double - capped::double) / open::double, rn) filter (2.0 * source_size / weight >= (1.5 * total - capped) / open) as level from o),
        t as (select source, source_size, case when 2 * source_size < weight * level then (2 * source_size)::double else weight * level end as target from w, l),
        b as (select *, round(target)::bigint as budget from t),
        e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from b),
        p as (select d.*, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size as rest,
                     sum(d.size) over (partition by d.source order by key rows between unbounded preceding and current row) - d.size as before
              from d join e on d.source is not distinct from e.source)
        select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from p""",
    "op5_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        i as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        p as (select distinct item, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as key
              from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from i where len(w) > 0)),
        s as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as key
              from (select d.*, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from p))),
        h as (select doc_id, s.n, k, item from s join p on s.n = p.n and s.key = p.key),
        t as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from h) group by doc_id),
        m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from h) group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join t using (doc_id) left join m using (doc_id)""",
    "op8_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        f as (select *, min(page_id) over (partition by h) as first, sha1(h) as x from p)
        select page_id, strlen(h)::bigint as payload_bytes,
               array_to_string(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (5 * i + 1)::int, 5))::bigint >> s) & 31)::int, 1)), 'string_agg', '')), '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id = first then null else first end as refers_to
        from f""",
    "op10_line_dedup": f"""
        with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line,
                          generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
        t as (select doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13) || chr(12)) as k from l),
        n as (select source, count(*) as host_pages from documents group by source),
        f as (select source, k, count(distinct doc_id) as pages from t where k <> '' group by source, k),
        b as (select f.source, k from f join n on f.source is not distinct from n.source
              where pages >= {line_dedup.MIN_PAGES} and pages > {line_dedup.RATIO} * host_pages),
        m as (select t.*, b.k is not null as gone from t left join b on t.source is not distinct from b.source and t.k = b.k),
        g as (select doc_id, count(*) filter (gone) as n_dropped, count(*) as n,
                     coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from m group by doc_id)
        select d.doc_id, d.source, (case when coalesce(d.text, '') = '' then 0 else g.n end)::bigint as n_lines,
               coalesce(g.n_dropped, 0)::bigint as n_dropped, case when g.n_dropped > 0 then g.text else d.text end as text
        from documents d left join g on d.doc_id = g.doc_id""",
    # a subtree's sums go over its nodes' owners; the digits' crc32 bit by bit: a byte comes in, then eight shifts (-1)
    "op13_prefix_trie": """
        with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
                   from conversations where conv_id is not null),
        i as (select c, xor(4294967295, list_reduce(flatten(list_transform(string_split(c::varchar, ''), lambda k: [ascii(k)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
                  lambda crc, k: case when k >= 0 then xor(crc, k) when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end, 4294967295::bigint)) % 6 as h,
                     c - c % 100 as base from (select distinct c from t)),
        b as (select c, count(*) as n from t group by c),
        r as (select i.c, t.p as d, role, text from i join t on t.c = i.base and p <= h
              union all select i.c, p - h + least(h, coalesce(n, 0)), role, text from i join t on t.c = i.c and p > h left join b on b.c = i.base),
        m as (select c, d, length(text) as size, md5(list(sha256(length(role) || ':' || role || text)) over (partition by c order by d)::varchar) as key from r
              union all select c, 0, 0, '' from i),
        e as (select c, max(d) as last from m group by c),
        g as (select d, key, min(c) as owner, count(*) as n, any_value(size) as size, max(last) = d as leaf,
                     coalesce(string_agg(c::varchar, ',' order by c) filter (last = d), '') as ends from m join e using (c) group by d, key),
        u as (select m.d, m.key, sum((g.n - 1) * g.size) as saved, count(*) filter (leaf) as leaves, count(*) filter (g.d = m.d + 1) as children
              from g join m on m.c = g.owner and m.d <= g.d group by m.d, m.key),
        a as (select g.d, g.key, q.owner as parent from g join m on m.c = g.owner and m.d = g.d - 1 join g q on q.d = m.d and q.key = m.key)
        select owner as conv_id, g.d::bigint as depth, parent as parent_conv_id, n::bigint as n_convs, children::bigint as n_children,
               leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(ends) as ends_sha256
        from g join u on u.d = g.d and u.key = g.key left join a on a.d = g.d and a.key = g.key""",
}

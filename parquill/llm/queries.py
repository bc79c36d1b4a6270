"""Queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parquill.llm import ann, cotraining, jaccard, line_dedup, mixing, packing, quality_rules, secrets, toxicity, url_filter
from parquill.runtime import table

#: Rules and blocked hosts of op4_url_filter.
ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
BLOCK_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "line_stats.n_lines", "line_stats.n_dropped", digest.alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture; shares by count to the power 0.7."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), allow=ALLOW, block=BLOCK, block_hosts=BLOCK_HOSTS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), query="vec_id % 20 = 0", k=20, factor=1.0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_packing, op4_url_filter, op5_toxicity, op6_quality_rules, op7_ann, op8_secrets, op9_jaccard, op10_quality, pipeline)}

_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER
_RULES = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for v, rules in (("allow", ALLOW), ("block", BLOCK)) for r in rules)
_HOSTS = ", ".join(f"('{h}')" for h in BLOCK_HOSTS)

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
        with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        numbered as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from split),
        keyed as (
            select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key
            from numbered),
        repeated as (
            select key, max(doc_id) as top from keyed where length(key) >= 20
            group by key having count(distinct doc_id) >= 3),
        marked as (select k.doc_id, k.pos, k.line, r.key is not null and r.top <> k.doc_id as gone from keyed k left join repeated r on k.key = r.key)
        select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from marked group by doc_id""",
    "op4_url_filter": rf"""
        with rules(rule_host, rule_path, kind) as (values {_RULES}), listed(bad) as (values {_HOSTS}),
        cut as (
            select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
        fits as (
            select c.page_id, r.rule_host || r.rule_path as rule, r.kind,
                row_number() over (partition by c.page_id order by length(r.rule_host || r.rule_path) desc, length(r.rule_host) desc) as k
            from cut c join rules r on (c.host = r.rule_host or ends_with(c.host, '.' || r.rule_host)) and starts_with(c.path, r.rule_path)),
        bad as (select distinct c.page_id from cut c join listed l on c.host = l.bad or ends_with(c.host, '.' || l.bad))
        select c.page_id, c.host, c.path, f.rule, coalesce(f.kind, case when b.page_id is null then 'allow' else 'block' end) as verdict
        from cut c left join fits f on c.page_id = f.page_id and f.k = 1 left join bad b on c.page_id = b.page_id""",
    "op7_ann": """
        with usable as (
            select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) as score
            from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op9_jaccard": rf"""
        with recursive cut as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
        shingles as (
            select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) as s from cut where len(w) > 0),
        sizes as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as h from shingles group by doc_id),
        classes as (select h, min(doc_id) as class_id from sizes group by h),
        own as (select s.doc_id, s.n, c.class_id from sizes s join classes c on s.h = c.h),
        few as (select s.doc_id, s.s from shingles s join own o on s.doc_id = o.doc_id where o.class_id = o.doc_id),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as k from few a join few b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        links as (select b.a, b.b from common b join own x on b.a = x.doc_id join own y on b.b = y.doc_id where 100 * b.k >= 90 * (x.n + y.n - b.k)),
        steps as (select a, b from links union all select b, a from links),
        reach as (
            select class_id as doc, class_id as to_doc from classes
            union
            select r.doc, s.b from reach r join steps s on r.to_doc = s.a),
        component as (select doc, min(to_doc) as component_id from reach group by doc)
        select d.doc_id, coalesce(o.n, 0) as n_shingles, coalesce(o.class_id, d.doc_id) as class_id, coalesce(c.component_id, d.doc_id) as component_id
        from documents d left join own o on d.doc_id = o.doc_id left join component c on o.class_id = c.doc""",
}

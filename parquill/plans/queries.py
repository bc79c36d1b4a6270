"""Queries over the fixture tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parquill.functions import chrf, chunker, text
from parquill.operators import compare, dedupe, leakage, mapping, records, split
from parquill.runtime import checkpoint, table

SHAPE = records.PromptShape()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent user and assistant turns as pairs, in (conv_id, turn) order."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(by).alias("next_role"), F.lead("text").over(by).alias("next_text"))
    pairs = said.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", text.payload(F.col("text")).alias("source"), text.payload(F.col("next_text")).alias("target"))
    return pairs.withColumns({"source_key": text.key(F.col("source")), "target_key": text.key(F.col("target"))})


def _documents_as_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pairs of their first eight characters and themselves; many sources have several targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(8)).alias("source"), F.col("text").alias("target"))
    return docs.withColumns({"source_key": text.key(F.col("source")), "target_key": text.key(F.col("target"))})


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored outputs of two arms made from the pairs: halves of the target, and all but its last tenth."""
    target, n = F.col("target"), F.length("target")
    made = _pairs(spark, sf_dir).select(F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("line"), "target", F.expr("left(target, cast(length(target) div 2 as int))").alias("base_output"), F.when(n % 3 == 0, F.expr("left(target, cast(length(target) div 2 as int))")).otherwise(F.expr("left(target, cast(length(target) - length(target) div 10 as int))")).alias("adapter_output"))
    scored = made
    for arm in ("base", "adapter"):
        counts = chrf.counts(F.col(f"{arm}_output"), target)
        scored = scored.withColumn(f"{arm}_counts", counts).withColumn(f"{arm}_score", chrf.score(F.col(f"{arm}_counts.m"), F.col(f"{arm}_counts.h"), F.col(f"{arm}_counts.r")))
    return scored


def prep_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = text.length_ratio(F.col("source"), F.col("target"))
    return _pairs(spark, sf_dir).select("conv_id", "turn", "source_key", "target_key", F.round(ratio, 6).alias("ratio"))


def _marked(spark: SparkSession, sf_dir: str, allow: bool) -> DataFrame:
    return dedupe.mark_duplicates(_documents_as_pairs(spark, sf_dir), ["doc_id"], allow_conflicts=allow).select("doc_id", "status", F.coalesce("of.doc_id", "doc_id").alias("of_doc"))


def prep_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir, True)


def prep_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir, False)


def prep_conflicted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.conflicted_sources(_documents_as_pairs(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _documents_as_pairs(spark, sf_dir)
    marked = checkpoint(dedupe.mark_duplicates(kept, ["doc_id"], allow_conflicts=True).filter("status <> 'duplicate'"))
    return split.assign_splits(marked, seed=0, valid_fraction=0.1, test_fraction=0.2)


def prep_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "split")


def prep_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(_split(spark, sf_dir))


def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source keys in all, and those in more than one split, of which there are none."""
    by_source = _split(spark, sf_dir).groupBy("source_key").agg(F.countDistinct("split").alias("n"))
    return by_source.agg(F.count("*").alias("n_sources"), F.count_if(F.col("n") > 1).alias("n_crossing"))


def prep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = split.ratio_and_length_stats(_pairs(spark, sf_dir))
    return stats.select(*[F.round(c, 6).alias(c) for c in ("min_ratio", "median_ratio", "max_ratio")], "min_length", "median_length", "max_length")


def prep_length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", text.length_problem(F.col("source"), F.col("target"), 8.0, 2000).alias("problem"))


def leak_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first one that has its canonical text and language: the corpus on both sides."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.col("text").alias("source"), F.col("lang").alias("target"))
    return leakage.overlaps(docs, docs, pair=True)


def leak_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.containments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def leak_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leak_contains(spark, sf_dir).select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(hits, "doc_id", "left_anti").select("doc_id", "n_chars")


def split_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), F.col("text").alias("source"), F.lower("text").alias("target"))
    return leakage.split_digest(items)


def schema_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines of all shapes, classified."""
    message = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    odd = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit(1).alias("extra")))
    case = F.col("conv_id") % 6
    line = (
        F.when(case <= 1, F.to_json(F.struct(plain.alias("messages"))))
        .when(case == 2, F.to_json(F.struct(F.get("m", F.lit(0))["content"].alias("prompt"), F.lit("").alias("completion"))))
        .when(case == 3, F.to_json(F.struct(F.get("m", F.lit(0))["content"].alias("text"))))
        .when(case == 4, F.to_json(F.struct(odd.alias("messages"))))
        .otherwise(F.lit("{broken"))
    )
    schema, problem = records.classify(F.col("raw"))
    return chats.select("conv_id", line.alias("raw")).select("conv_id", schema.alias("schema"), problem.alias("problem"))


def record_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as records, rendered to JSON, parsed and checked."""
    lines = _pairs(spark, sf_dir).select("conv_id", "turn", records.render_record(records.build_record(F.col("source"), F.col("target"), SHAPE)).alias("raw"))
    messages = records.messages_of(F.col("raw"))
    source, target = records.parse_record(messages, SHAPE)
    return lines.select("conv_id", "turn", source.alias("source"), target.alias("target"), records.record_problem(messages, SHAPE).alias("problem"))


def chrf_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).select("line", F.round("base_score", 6).alias("score"))


def chrf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = chrf.pooled(_arms(spark, sf_dir).withColumn("chrf_counts", F.col("base_counts")))
    return pooled.select("n", F.round("corpus_score", 6).alias("corpus_score"))


def arm_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = _arms(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("base_score", "adapter_score")})
    return compare.tally(arms).select("n", "wins", "losses", "ties", F.round("fraction", 6).alias("fraction"))


def arm_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms' corpus scores, their delta and the verdict against the conventional floor; one pass over the arms."""
    arms = _arms(spark, sf_dir)
    sums = [F.sum(F.col(f"{a}_counts")[k][i]).alias(f"{a}_{k}{i}") for a in ("base", "adapter") for k in "mhr" for i in range(chrf.ORDERS)]
    differ = F.avg((F.col("base_output") != F.col("adapter_output")).cast("double")).alias("fraction")
    summed = arms.agg(differ, *sums)
    whole = [chrf.score(*[F.array(*[F.coalesce(f"{a}_{k}{i}", F.lit(0)) for i in range(chrf.ORDERS)]) for k in "mhr"]).alias(a) for a in ("base", "adapter")]
    scored = summed.select("fraction", *whole).withColumn("delta", F.col("adapter") - F.col("base"))
    return scored.select(compare.verdict(F.col("delta"), F.coalesce("fraction", F.lit(0.0)), F.lit(compare.MIN_DELTA)).alias("verdict"), *[F.round(c, 6).alias(c) for c in ("base", "adapter", "delta")])


def bootstrap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.bootstrap_floor(checkpoint(_arms(spark, sf_dir).select("line", "base_score", "adapter_score")), 1.5, seed=7)
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "floor")])


def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines, cut and put together again, by an identity translation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    parts = chunker.chunk_rows(docs, "doc_id", "text", 400)
    whole = chunker.reassemble(parts.withColumn("fragment", chunker.render(F.col("lead"), F.col("text"), F.col("tail"))), "doc_id")
    return whole.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all chunks of a document keep the budget, hold no blank line, and only the first has a lead."""
    parts = chunker.chunk_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 200)
    good = (F.length("text") <= 200) & ~F.contains("text", F.lit("\n\n")) & ((F.col("index") == 0) | (F.col("lead") == ""))
    return parts.groupBy("doc_id").agg(F.bool_and(good).alias("good"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks that fail where a hash says so."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text"))
    return lines.withColumn("ok", (F.col("text") == "") | (F.substring(F.md5(F.concat_ws(":", "doc_id", "index")), 1, 1) >= "8"))


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.breaker(_lines(spark, sf_dir), "doc_id", limit=3, empty=F.col("text") == "").select("doc_id", "index", "ok", "aborted")


def failure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's failed chunks, aborted ones too, and its characters so far at the last chunk."""
    judged = mapping.breaker(_lines(spark, sf_dir), "doc_id", limit=3, empty=F.col("text") == "")
    failed = F.when(~F.col("ok") | F.col("aborted"), F.col("index"))
    return judged.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(failed)), ",").alias("failed"), F.sum(F.length("text")).cast("long").alias("chars_total"))


def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.with_progress(_lines(spark, sf_dir), "doc_id").select("doc_id", "index", "chars_done", "chars_total")


def render_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter("not ok").select("doc_id", "index", F.md5(chunker.marker(F.col("index"), F.col("text"))).alias("marker_md5"))


def token_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunker.token_ceiling(F.col("text")).cast("long").alias("ceiling"))


def token_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as token streams: folded text, and what the guards say of it."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    stream = F.transform("t", lambda x: F.struct(x["text"].alias("text"), F.when(x["role"] == "assistant", "stop").otherwise("length").alias("finish_reason")))
    whole, reason = mapping.fold_tokens(F.col("stream"))
    folded = parts.select("conv_id", stream.alias("stream")).select("conv_id", whole.alias("text"), reason.alias("reason"))
    return folded.select("conv_id", F.md5("text").alias("text_md5"), mapping.completion_problem(F.col("text"), F.col("reason"), ["<think>"]).alias("problem"))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records, one a source and language, against those of the same source."""
    docs = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("delta"))
    runs = docs.select("source", F.concat_ws("-", "source", "lang").alias("run_id"), "delta", F.when(F.col("n") % 3 == 0, "a").otherwise("b").alias("test_sha256"), F.when(F.col("n") % 2 == 0, F.lit(10)).alias("test_limit"), F.lit("p").alias("prompt_shape_fingerprint"))
    pairs = compare.compare_runs(runs, runs, on="source")
    return pairs.select("first_run", "second_run", "comparable", F.array_join("reasons", ",").alias("reasons"), F.round("delta", 6).alias("delta"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        prep_pairs, prep_dedupe, prep_conflicts, prep_conflicted_sources, prep_split_rows, prep_split_counts, split_disjoint, prep_stats, prep_length_guard,
        leak_exact, leak_contains, leak_anti, split_digest, schema_classify, record_roundtrip, chrf_segment, chrf_corpus, arm_tally, arm_verdict,
        bootstrap_floor, chunk_roundtrip, chunk_budget, breaker, failure_list, chunk_progress, render_markers, token_ceiling, token_fold, run_compare,
    )
}

_KEY = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PAIRS = rf"""
    said as (
        select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as next_text
        from conversations window w as (partition by conv_id order by turn)),
    pairs as (
        select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as source, regexp_replace(next_text, '^\s+|\s+$', '', 'g') as target
        from said where role = 'user' and next_role = 'assistant')"""
_RATIO = "cast(greatest(length(source), length(target)) as double) / greatest(1, least(length(source), length(target)))"
_DOC_PAIRS = f"""
    pairs as (
        select doc_id, {_KEY.format("left(text, 8)")} as sk, {_KEY.format("text")} as tk from documents),
    marked as (
        select *, row_number() over (partition by sk, tk order by doc_id) as rn, first_value(doc_id) over (partition by sk, tk order by doc_id) as same,
            first_value(tk) over (partition by sk order by doc_id) as ft, first_value(doc_id) over (partition by sk order by doc_id) as clash
        from pairs)"""
_SPLIT = f"""{_DOC_PAIRS},
    kept as (select * from marked where rn = 1),
    groups as (select sk, count(*) as size, sha256('0' || chr(31) || sk) as h from kept group by sk),
    placed as (select *, cast(sum(size) over (order by h, sk) as bigint) as upto from groups),
    total as (select cast(sum(size) as bigint) as n from groups),
    one as (select min(upto) as b1 from placed, total where upto >= n - cast(floor(n * 0.1::double) as bigint) - cast(floor(n * 0.2::double) as bigint)),
    two as (select min(upto) as b2 from placed, total, one where upto >= b1 + cast(floor(n * 0.1::double) as bigint)),
    assigned as (
        select p.sk, case when upto - size < b1 then 'train' when upto - size < b2 then 'valid' else 'test' end as split
        from placed p, one, two)"""
_ARMS = rf"""{_PAIRS},
    made as (
        select lpad(conv_id::varchar, 12, '0') || ':' || lpad(turn::varchar, 6, '0') as line, target,
            left(target, length(target) // 2) as base_output,
            case when length(target) % 3 = 0 then left(target, length(target) // 2) else left(target, length(target) - length(target) // 10) end as adapter_output
        from pairs),
    sides as (
        select line, 'base' as arm, regexp_replace(base_output, '\s+', '', 'g') as h, regexp_replace(target, '\s+', '', 'g') as r from made
        union all
        select line, 'adapter', regexp_replace(adapter_output, '\s+', '', 'g'), regexp_replace(target, '\s+', '', 'g') from made),
    orders as (select unnest(range(1, 7)) as n),
    hgrams as (select line, arm, n, unnest(list_transform(range(1, length(h) - n + 2), lambda i: substring(h, i, n))) as gram from sides, orders where length(h) >= n),
    rgrams as (select line, arm, n, unnest(list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n))) as gram from sides, orders where length(r) >= n),
    bag as (
        select line, arm, n, gram, sum(a) as a, sum(b) as b
        from (select line, arm, n, gram, 1 as a, 0 as b from hgrams union all select line, arm, n, gram, 0, 1 from rgrams)
        group by line, arm, n, gram),
    counted as (select line, arm, n, sum(least(a, b))::double as m, sum(a)::double as h, sum(b)::double as r from bag group by line, arm, n),
    means as (
        select line, arm, sum(case when h > 0 then m / h else 0 end) / 6 as p, sum(case when r > 0 then m / r else 0 end) / 6 as q
        from counted group by line, arm),
    scored as (
        select s.line, s.arm, case when coalesce(p, 0) = 0 and coalesce(q, 0) = 0 then 0.0 else 100 * 5.0 * p * q / (4.0 * p + q) end as score
        from sides s left join means using (line, arm)),
    pool as (select arm, n, sum(m) as m, sum(h) as h, sum(r) as r from counted group by arm, n),
    pmeans as (select arm, sum(case when h > 0 then m / h else 0 end) / 6 as p, sum(case when r > 0 then m / r else 0 end) / 6 as q from pool group by arm),
    corpus as (select arm, case when p = 0 and q = 0 then 0.0 else 100 * 5.0 * p * q / (4.0 * p + q) end as score from pmeans),
    wide as (
        select line, max(score) filter (where arm = 'base') as base_score, max(score) filter (where arm = 'adapter') as adapter_score
        from scored group by line)"""
_LINES = """
    cut as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
    pieces as (select doc_id, unnest(range(0, len(lines))) as idx, unnest(lines) as text from cut),
    chunks as (
        select doc_id, cast(idx as integer) as index, text, text = '' or substring(md5(doc_id::varchar || ':' || idx::varchar), 1, 1) >= '8' as ok
        from pieces),
    numbered as (select *, row_number() over (partition by doc_id order by index) as n from chunks),
    runs as (
        select *, n - coalesce(max(case when ok then n end) over (partition by doc_id order by index rows unbounded preceding), 0) as run
        from numbered),
    judged as (
        select *, coalesce(max(case when run >= 3 then 1 else 0 end) over (partition by doc_id order by index rows between unbounded preceding and 1 preceding), 0) = 1 and text <> '' as aborted
        from runs)"""
_CANON = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_CONTAINS = f"""
    docs as (select doc_id, n_chars, {_CANON.format("text")} as t from documents),
    items as (select item_id, {_CANON.format("text")} as i from benchmark),
    hits as (select item_id, doc_id from docs join items on contains(t, i) where i <> '')"""

ORACLE_SQL: dict[str, str] = {
    "prep_pairs": f"with {_PAIRS} select conv_id, turn, {_KEY.format('source')} as source_key, {_KEY.format('target')} as target_key, round({_RATIO}, 6) as ratio from pairs",
    "prep_dedupe": f"""with {_DOC_PAIRS} select doc_id, case when rn > 1 then 'duplicate' when tk <> ft then 'conflict' else 'keep' end as status,
        case when rn > 1 then same when tk <> ft then clash else doc_id end as of_doc from marked""",
    "prep_conflicts": f"""with {_DOC_PAIRS} select doc_id, case when tk <> ft then 'problem' when rn > 1 then 'duplicate' else 'keep' end as status,
        case when tk <> ft then clash when rn > 1 then same else doc_id end as of_doc from marked""",
    "prep_conflicted_sources": f"with {_DOC_PAIRS} select sk as source_key, count(*) as n_pairs, count(distinct tk) as n_targets from pairs group by sk having count(distinct tk) > 1",
    "prep_split_rows": f"with {_SPLIT} select k.doc_id, a.split from kept k join assigned a on k.sk = a.sk",
    "prep_split_counts": f"with {_SPLIT} select a.split, count(*) as n_rows, count(distinct k.sk) as n_sources from kept k join assigned a on k.sk = a.sk group by a.split",
    "split_disjoint": f"""with {_SPLIT}, by_source as (select k.sk, count(distinct a.split) as n from kept k join assigned a on k.sk = a.sk group by k.sk)
        select count(*) as n_sources, count(*) filter (where n > 1) as n_crossing from by_source""",
    "prep_stats": f"""with {_PAIRS} select round(min({_RATIO}), 6) as min_ratio, round(median({_RATIO}), 6) as median_ratio, round(max({_RATIO}), 6) as max_ratio,
        cast(min(length(source)) as bigint) as min_length, cast(floor(median(length(source))) as bigint) as median_length, cast(max(length(source)) as bigint) as max_length from pairs""",
    "prep_length_guard": f"""with {_PAIRS} select conv_id, turn, case
        when greatest(length(source), length(target)) > 8.0::double * greatest(1, least(length(source), length(target))) then 'ratio'
        when greatest(length(source), length(target)) > 2000 then 'chars' end as problem from pairs""",
    "leak_exact": f"""with d as (select doc_id, {_CANON.format("text")} as t, lang from documents)
        select a.doc_id as line, min(b.doc_id) as other_line from d a join d b on a.t = b.t and a.lang = b.lang
        group by a.doc_id""",
    "leak_contains": f"with {_CONTAINS} select item_id, doc_id from hits",
    "leak_anti": f"with {_CONTAINS} select doc_id, n_chars from docs where doc_id not in (select doc_id from hits)",
    "split_digest": f"""select sha256(string_agg(replace({_CANON.format("text")}, 'ß', 'ss') || chr(31) || replace({_CANON.format("text")}, 'ß', 'ss'), chr(10) order by item_id)) as digest,
        count(*) as n_lines from benchmark""",
    "schema_classify": """select distinct conv_id, case conv_id % 6 when 0 then 'chat' when 1 then 'chat' when 2 then 'completions' when 3 then 'text' end as schema,
        case conv_id % 6 when 4 then 'message keys' when 5 then 'not JSON' end as problem from conversations""",
    "record_roundtrip": f"with {_PAIRS} select conv_id, turn, source, target, cast(null as varchar) as problem from pairs",
    "chrf_segment": f"with {_ARMS} select line, round(score, 6) as score from scored where arm = 'base'",
    "chrf_corpus": f"with {_ARMS} select (select count(*) from made) as n, round(score, 6) as corpus_score from corpus where arm = 'base'",
    "arm_tally": f"""with {_ARMS} select count(*) as n, count(*) filter (where round(adapter_score, 9) > round(base_score, 9)) as wins, count(*) filter (where round(adapter_score, 9) < round(base_score, 9)) as losses,
        count(*) filter (where round(adapter_score, 9) = round(base_score, 9)) as ties,
        (select round(avg(case when base_output <> adapter_output then 1.0::double else 0.0::double end), 6) from made) as fraction from wide""",
    "arm_verdict": f"""with {_ARMS}, both_arms as (
            select max(score) filter (where arm = 'base') as base, max(score) filter (where arm = 'adapter') as adapter from corpus),
        f as (select avg(case when base_output <> adapter_output then 1.0::double else 0.0::double end) as fraction from made)
        select case when fraction < 0.5 then 'indistinguishable' when abs(adapter - base) <= 1.0 then 'indistinguishable' when adapter > base then 'improved' else 'regressed' end as verdict,
            round(base, 6) as base, round(adapter, 6) as adapter, round(adapter - base, 6) as delta from both_arms, f""",
    "bootstrap_floor": f"""with {_ARMS}, deltas as (select row_number() over (order by line) - 1 as pos, adapter_score - base_score as delta from wide),
        size as (select count(*) as n from deltas),
        drawn as (
            select r, cast('0x' || substring(md5('7:' || r::varchar || ':' || i::varchar), 1, 8) as bigint) % n as pos
            from (select unnest(range(0, 1000)) as r), size, (select unnest(range(0, (select n from size))) as i)),
        resampled as (select r, sum(delta) / (select n from size) as mean from drawn join deltas using (pos) group by r),
        ranked as (select mean, row_number() over (order by mean) - 1 as k from resampled),
        ends as (select max(mean) filter (where k = 24) as low, max(mean) filter (where k = 974) as high from ranked)
        select round(low, 6) as low, round(high, 6) as high, case when low <= 0 and high >= 0 then 1.5::double else 0.0::double end as floor from ends""",
    "chunk_roundtrip": "select doc_id, sha256(replace(text, chr(10), chr(10) || chr(10))) as sha256 from documents where text <> ''",
    "chunk_budget": "select doc_id, true as good from documents where text <> ''",
    "breaker": f"with {_LINES} select doc_id, index, ok, aborted from judged",
    "failure_list": f"""with {_LINES} select doc_id, coalesce(string_agg(case when not ok or aborted then index::varchar end, ',' order by index), '') as failed,
        cast(sum(length(text)) as bigint) as chars_total from judged group by doc_id""",
    "chunk_progress": f"""with {_LINES} select doc_id, index,
        cast(sum(length(text)) over (partition by doc_id order by index rows unbounded preceding) as bigint) as chars_done,
        cast(sum(length(text)) over (partition by doc_id) as bigint) as chars_total from chunks""",
    "render_markers": f"""with {_LINES} select doc_id, index, md5('[[UNTRANSLATED chunk=' || index::varchar || ']]' || chr(10) || text || chr(10) || '[[/UNTRANSLATED chunk=' || index::varchar || ']]') as marker_md5
        from chunks where not ok""",
    "token_ceiling": "select doc_id, cast(greatest(512, ceil(length(text) / 2.0 * 2.0)) as bigint) as ceiling from documents",
    "token_fold": """with folded as (
            select conv_id, string_agg(text, '' order by turn) as text, max_by(role, turn) as last_role from conversations group by conv_id)
        select conv_id, md5(text) as text_md5, case when contains(text, '<think>') then 'reasoning' when last_role <> 'assistant' then 'truncated' end as problem from folded""",
    "run_compare": """with docs as (select source, lang, count(*) as n, round(avg(n_chars), 6) as delta from documents group by source, lang),
        runs as (select source, concat_ws('-', source, lang) as run_id, delta, case when n % 3 = 0 then 'a' else 'b' end as s, case when n % 2 = 0 then 10 end as l from docs)
        select a.run_id as first_run, b.run_id as second_run, a.s = b.s and a.l is not distinct from b.l as comparable,
            case when a.s <> b.s and a.l is distinct from b.l then 'test_sha256,test_limit' when a.s <> b.s then 'test_sha256' when a.l is distinct from b.l then 'test_limit' else '' end as reasons,
            case when a.s = b.s and a.l is not distinct from b.l then round(b.delta - a.delta, 6) end as delta
        from runs a join runs b on a.source is not distinct from b.source""",
}

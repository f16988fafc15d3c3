"""Queries over runs, labels and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions import checks
from twinscript.functions import text as t
from twinscript.operators import factory, harness
from twinscript.plans.texts import W, sql_words
from twinscript.queries import register
from twinscript.sources.tables import table


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return harness.latest(table(spark, d, "run_rows"))


#: Of rows ingested twice the later one; equal ones are equal in all that is used here.
LATEST = "(select * from (select *, row_number() over (partition by run_id, item_id order by ingested_at desc nulls last, translation desc nulls last) as r_ from run_rows) where r_ = 1)"


@register("runs_by_model", f"select model, adapter, count(*) as n, count(error) as errors, cast(sum(output_tokens) as bigint) as tokens from {LATEST} group by 1, 2")
def runs_by_model(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("model", "adapter").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.sum("output_tokens").alias("tokens"))


_P95 = "list_sort(list(latency_s) filter (latency_s is not null))[greatest(cast(floor(count(latency_s) * 0.95) as bigint) - 1, 0) + 1]"


@register("run_latency", f"select model, count(*) as total, round(avg(latency_s), 6) as latency_mean, {_P95} as latency_p95, round(sum(cost_estimate), 6) as cost from {LATEST} group by 1")
def run_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).withColumn("source_text", F.lit(None).cast("string"))
    return harness.run_scores(rows, "model").select("model", "total", F.round("latency_mean", 6).alias("latency_mean"), "latency_p95", F.round("cost", 6).alias("cost"))


@register("late_rows", "select run_id, count(*) as n from run_rows where ingested_at > recorded_at + interval 1 day group by 1")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_rows", "run_id", "recorded_at", "ingested_at").where("ingested_at > recorded_at + interval 1 day").groupBy("run_id").agg(F.count("*").alias("n"))


_RATIO = f"case when {sql_words('arabic')} > 0 then {sql_words('translation')}::double / {sql_words('arabic')} end"


@register("system_scores", f"select system_id, count(*) as total, round(avg(r), 6) as ratio_mean, count(*) filter (coalesce(r < 0.4 or r > 3.0, false)) as ratio_flagged from (select system_id, {_RATIO} as r from consensus_rows) group by 1")
def system_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "consensus_rows", "system_id", "arabic", "translation").withColumn("ratio", t.length_ratio("arabic", "translation"))
    return rows.groupBy("system_id").agg(F.count("*").alias("total"), F.round(F.avg("ratio"), 6).alias("ratio_mean"), F.count_if(t.ratio_flagged("ratio")).alias("ratio_flagged"))


_PARSED = r"try_cast(trim(regexp_replace(regexp_replace(translation, '^\s*```[a-zA-Z]*\s*', ''), '\s*```\s*$', ''), ' ') as json)"


@register("structured_blocks", f"select run_id, item_id, cast(json_array_length({_PARSED}) as bigint) as n_blocks from {LATEST} where translation is not null and json_type({_PARSED}) = 'ARRAY' and regexp_matches(translation, '^\\s*(```[a-zA-Z]*\\s*)?\\[\\s*\\{{')")
def structured_blocks(spark: SparkSession, d: str) -> DataFrame:
    whole = F.col("translation").rlike(r"^\s*(```[a-zA-Z]*\s*)?\[\s*\{")
    return _runs(spark, d).where(whole).select("run_id", "item_id", F.size(t.response_blocks("translation")).cast("bigint").alias("n_blocks")).where("n_blocks is not null and n_blocks >= 0")


_STATUS = "case when s.id is null then 'unexpected' when r.n is null then 'missing' when r.n > 1 then 'duplicate' when r.english is null or trim(r.english, ' ') = '' then 'error' else 'ok' end"
_RECONCILED = f"(select coalesce(s.id, r.id) as id, {_STATUS} as status from (select distinct uri as id from works) s full join (select openiti_uri as id, count(*) as n, min(work_english_title) as english from translations where openiti_uri is not null group by 1) r on s.id = r.id)"


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    back = table(spark, d, "translations", "openiti_uri", "work_english_title").where("openiti_uri is not null").select(F.col("openiti_uri").alias("id"), F.col("work_english_title").alias("english"), F.lit(None).cast("string").alias("error"))
    return harness.reconcile(table(spark, d, "works", "uri").withColumnRenamed("uri", "id"), back)


@register("id_reconcile", f"select id, status from {_RECONCILED}")
def id_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).select("id", "status")


@register("id_loss_report", "select " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("ok", "missing", "duplicate", "unexpected", "error")) + f" from {_RECONCILED}")
def id_loss_report(spark: SparkSession, d: str) -> DataFrame:
    return harness.loss(_reconciled(spark, d)).select("ok", "missing", "duplicate", "unexpected", "error")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "eval_items", "id", "reference_english").select(F.col("id").alias("item_id"), F.col("reference_english").alias("ref"))
    return table(spark, d, "consensus_rows", "row_id", "item_id", "system_id", "translation").join(refs, "item_id").select(F.col("row_id").alias("id"), "system_id", F.col("translation").alias("hyp"), "ref")


def _chrf_sql(by: str) -> str:
    g, on, sel = (f"group by {by}", f"and h.{by} = r.{by}", f"{by}, ") if by else ("", "", "")
    both = f"select c.row_id as id, {'c.' + by + ' as ' + by + ', ' if by else ''} regexp_replace(c.translation, '{W}', '', 'g') as hyp, regexp_replace(e.reference_english, '{W}', '', 'g') as ref from consensus_rows c join eval_items e on c.item_id = e.id where trim(c.translation, ' ') <> '' and trim(e.reference_english, ' ') <> ''"
    gram = lambda s: f"select id, {sel} n, g, count(*) as k from (select id, {sel} n, unnest(list_transform(generate_series(1, length({s}) - n + 1), lambda i: substring({s}, i, n))) as g from p, (select unnest(generate_series(1, 6)) as n) where length({s}) >= n) group by all"
    per = f"select {sel.replace(by, 'coalesce(h.' + by + ', r.' + by + ') as ' + by) if by else ''} coalesce(h.n, r.n) as n, sum(least(coalesce(h.k, 0), coalesce(r.k, 0)))::double as m, sum(coalesce(h.k, 0))::double as hk, sum(coalesce(r.k, 0))::double as rk from ({gram('hyp')}) h full join ({gram('ref')}) r on h.id = r.id and h.n = r.n and h.g = r.g {on} group by all"
    return f"with p as ({both}), c as ({per}), m as (select {sel} avg(m / hk) as p, avg(m / rk) as r from c where hk > 0 and rk > 0 {g}) select {sel} round(case when 4 * p + r > 0 then 5 * p * r / (4 * p + r) * 100 else 0 end, 6) as chrf from m"


@register("chrf_corpus", _chrf_sql(""))
def chrf_corpus(spark: SparkSession, d: str) -> DataFrame:
    return harness.chrf(_scored(spark, d)).select(F.round("chrf", 6).alias("chrf"))


@register("chrf_by_system", _chrf_sql("system_id"))
def chrf_by_system(spark: SparkSession, d: str) -> DataFrame:
    return harness.chrf(_scored(spark, d), "system_id").select("system_id", F.round("chrf", 6).alias("chrf"))


_GOOD = f"(select distinct model, item_id from {LATEST} where error is null and trim(translation, ' ') <> '')"


@register("system_overlap", "with g as (select distinct system_id, item_id from consensus_rows where trim(translation, ' ') <> '' and system_id in ('lite', 'strong')) select system_id, item_id, count(*) over (partition by item_id) as systems from g qualify systems = (select count(distinct system_id) from g)")
def system_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Items that both systems answered."""
    rows = table(spark, d, "consensus_rows", "system_id", "item_id", "translation").where("system_id in ('lite', 'strong')").withColumn("error", F.lit(None).cast("string"))
    return harness.overlap(rows, "system_id", "item_id").select("system_id", "item_id").distinct().withColumn("systems", F.lit(2).cast("bigint"))


@register("item_batches", "select ceil(count(*) / 16.0)::bigint as batches, least(16, count(*)) as fullest, count(*) as items from eval_items")
def item_batches(spark: SparkSession, d: str) -> DataFrame:
    made = harness.batches(table(spark, d, "eval_items", "id"), 16, "id", parts=1).groupBy("batch").agg(F.count("*").alias("n"))
    return made.agg(F.count("*").alias("batches"), F.max("n").alias("fullest"), F.sum("n").alias("items"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "consensus_rows", "row_id", "system_id", "arabic", "translation")


def _one(spark: SparkSession, d: str, check: str) -> DataFrame:
    f = getattr(checks, check)("arabic", "translation")
    verdict = F.when(~F.col("f.applicable"), "n/a").when(F.col("f.passed"), "pass").otherwise("fail")
    return _pairs(spark, d).select("row_id", f.alias("f")).select("row_id", verdict.alias("verdict"))


_Q = "[\"“”«»‘’'']"


@register("chk_quotes", f"select row_id, case when a = 0 then 'n/a' when b > 0 then 'pass' else 'fail' end as verdict from (select row_id, len(regexp_extract_all(coalesce(arabic, ''), '{_Q}')) as a, len(regexp_extract_all(coalesce(translation, ''), '{_Q}')) as b from consensus_rows)")
def chk_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "quotation_coverage")


@register("chk_untranslated", f"select row_id, case when regexp_matches(coalesce(translation, ''), '{t.ARABIC}') then 'fail' else 'pass' end as verdict from consensus_rows")
def chk_untranslated(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "untranslated_arabic")


_N = "list_distinct(list_transform(list_filter(regexp_extract_all(translate(coalesce({}, ''), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[0-9]+'), lambda x: length(x) <= 18), lambda x: cast(x as bigint)))"


@register("chk_numbers", f"select row_id, case when len(a) = 0 then 'n/a' when len(list_filter(a, lambda x: not list_contains(b, x))) = 0 then 'pass' else 'fail' end as verdict from (select row_id, {_N.format('arabic')} as a, {_N.format('translation')} as b from consensus_rows)")
def chk_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "number_coverage")


def _sentences(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(trim({c}, ' '), '([.!?]){W}', '\\1␞', 'g'), '␞'), lambda x: trim(x, ' ') <> '')"


_COUNTS = f"(select row_id, len({_sentences("translate(coalesce(arabic, ''), '؟۔', '?.')")}) as a, len({_sentences("coalesce(translation, '')")}) as b from consensus_rows)"


@register("chk_sentence_ratio", f"select row_id, case when a < 2 then 'n/a' when b::double / a >= 0.5 then 'pass' else 'fail' end as verdict from {_COUNTS}")
def chk_sentence_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "sentence_ratio")


_UNITS = f"(select row_id, list_filter(list_transform({_sentences("coalesce(translation, '')")}, lambda x: lower(trim(x, ' '))), lambda x: length(x) >= 25) as u from consensus_rows)"


@register("chk_repetition", f"select row_id, case when len(u) < 2 then 'n/a' when len(u) = len(list_distinct(u)) then 'pass' else 'fail' end as verdict from {_UNITS}")
def chk_repetition(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "repetition")


_WORDS = r"len(list_filter(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}''’-]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]')))"
_AR_NEG = r"len(list_filter(string_split_regex(a, '[^\p{L}\p{M}\p{N}_]+'), lambda w: w in ('لا', 'ما', 'لم', 'لن', 'غير', 'بلا', 'دون') or starts_with(w, 'ليس')))"
_EN_NEG = r"len(regexp_extract_all(e, '(?i)\b(?:not|no|never|neither|nor|none|cannot|without|nothing|nobody|nowhere)\b|n[''’]t\b'))"
_MEASURED = f"""(select row_id, item_id, system_id, second_publishable, a, e, {_AR_NEG} as na, {_EN_NEG} as ne, {_N.format('a')} as xa, {_N.format('e')} as xe, {_WORDS.format('a')} as wa, {_WORDS.format('e')} as we,
len(regexp_extract_all(e, '{t.ARABIC}')) as u, len(regexp_extract_all(a, '{_Q}')) as qa, len(regexp_extract_all(e, '{_Q}')) as qe, list_filter(list_transform({_sentences('e')}, lambda x: lower(trim(x, ' '))), lambda x: length(x) >= 25) as units,
len({_sentences("translate(a, '؟۔', '?.')")}) as sa, len({_sentences('e')}) as se from (select *, coalesce(arabic, '') as a, coalesce(translation, '') as e from consensus_rows))"""


def _finding(check: str, applicable: str, passed: str, severity: str, value: str) -> str:
    return f"{{'check': '{check}', 'applicable': {applicable}, 'passed': case when {applicable} then coalesce({passed}, false) end, 'severity': {severity}, 'value': case when {applicable} then ({value})::double end}}"


_FINDINGS = ", ".join((
    _finding("negation_parity", "true", "na = 0 or ne::double / na between 0.5 and 2.5", "'critical'", "case when na > 0 then ne::double / na end"),
    _finding("number_coverage", "len(xa) > 0", "len(list_filter(xa, lambda x: not list_contains(xe, x))) = 0", "'major'", "1 - len(list_filter(xa, lambda x: not list_contains(xe, x)))::double / len(xa)"),
    _finding("length_ratio", "wa > 0", "we::double / wa between 0.5 and 3.0", "case when wa > 0 and we::double / wa > 3.0 then 'moderate' else 'major' end", "we::double / wa"),
    _finding("untranslated_arabic", "true", "u = 0", "'major'", "u"),
    _finding("repetition", "len(units) >= 2", "len(units) = len(list_distinct(units))", "'major'", "len(units) - len(list_distinct(units))"),
    _finding("quotation_coverage", "qa > 0", "qe > 0", "'critical'", "qe"),
    _finding("sentence_ratio", "sa >= 2", "se::double / sa >= 0.5", "'major'", "se::double / sa"),
))
_LONG = f"(select row_id, system_id, unnest([{_FINDINGS}], recursive := true) from {_MEASURED})"
_FAILED = f"(select distinct row_id from {_LONG} where applicable and not passed union select row_id from consensus_rows where trim(lower(coalesce(translation, '')), ' ') in ('', 'nan', 'none', 'null', 'n/a'))"
_JUDGED = f"(select row_id, item_id, system_id, coalesce(upper(trim(second_publishable, ' ')) = 'Y', false) as ok, row_id in (select row_id from {_FAILED}) as bad from consensus_rows)"
_SIMULATED = f"""with j as (select * from {_JUDGED}), s as (select distinct item_id from j where system_id in ('lite', 'strong')),
l as (select item_id, max_by(ok, row_id) as ok, max_by(bad, row_id) as bad from j where system_id = 'lite' group by 1), g as (select item_id, max_by(ok, row_id) as ok, max_by(bad, row_id) as bad from j where system_id = 'strong' group by 1),
p as (select s.item_id, coalesce(l.ok, false) as lite_ok, coalesce(l.bad, true) as lite_bad, coalesce(g.ok, false) as strong_ok, coalesce(g.bad, true) as strong_bad, lower(trim(coalesce(e.genre, ''), ' ')) as hint from s left join l using (item_id) left join g using (item_id) left join eval_items e on e.id = s.item_id),
q as (select *, hint in ('verse', 'poetry', 'saj', 'rhymed_prose', 'metalinguistic') or contains(hint, 'verse') or contains(hint, 'maqama') as gate from p), r as (select *, not gate and lite_bad as escalate from q),
m as (select *, case when gate then 'strong' when not escalate then 'lite' when not strong_bad then 'strong' else 'lite' end as sys, case when escalate and strong_bad then 'human' else 'auto' end as queue from r)"""
_UNPIVOTED = " union all ".join(
    f"select '{policy}' as policy, {ok} as ok from m"
    for policy, ok in (
        ("all_strong", "strong_ok"), ("all_lite", "lite_ok"), ("known_lite_else_strong", "lite_ok or strong_ok"), ("source_gate_only", "case when gate then strong_ok else lite_ok end"),
        ("checks_keep_both", "queue = 'human' or case when sys = 'strong' then strong_ok else lite_ok end"), ("checks_overwrite", "case when gate or escalate then strong_ok else lite_ok end"),
    )
)


@register("checks_long", f"select * from {_LONG}")
def checks_long(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("row_id", "system_id", F.explode(checks.findings("arabic", "translation")).alias("f")).select("row_id", "system_id", "f.*")


@register("checks_summary", f"select \"check\", system_id, count(*) as n, count(*) filter (applicable) as applicable, count(*) filter (applicable and not passed) as failed from {_LONG} group by 1, 2")
def checks_summary(spark: SparkSession, d: str) -> DataFrame:
    return checks_long(spark, d).groupBy("check", "system_id").agg(F.count("*").alias("n"), F.count_if("applicable").alias("applicable"), F.count_if(F.col("applicable") & ~F.col("passed")).alias("failed"))


def _verdict(check: str) -> str:
    return f"select row_id, case when not applicable then 'n/a' when passed then 'pass' else 'fail' end as verdict from {_LONG} where \"check\" = '{check}'"


@register("chk_negation", _verdict("negation_parity"))
def chk_negation(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "negation_parity")


@register("chk_length", _verdict("length_ratio"))
def chk_length(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "length_ratio")


_FLAGS = "list_filter(['ENTITY', 'NUMBER', 'ROLE', 'TERM', 'OMISSION', 'ADDITION', 'MISSING'], lambda f: list_contains(list_transform(string_split_regex(coalesce({}, ''), '[|;,]'), lambda x: upper(trim(x, ' '))), f))"
_SITTINGS = f"""(select row_id, upper(trim(coalesce(first_publishable, ''), ' ')) as p1, upper(trim(coalesce(second_publishable, ''), ' ')) as p2, {_FLAGS.format('first_blocking_flags')} as f1, {_FLAGS.format('second_blocking_flags')} as f2,
coalesce(lower(trim(first_confidence, ' ')) = 'high' and lower(trim(second_confidence, ' ')) = 'high', false) as high, lower(coalesce(notes, '')) as notes from consensus_rows)"""
_DISPUTED = "(p1 <> p2 or (p1 = 'N' and p2 = 'N' and len(f1) > 0 and len(f2) > 0 and not list_has_any(f1, f2)) or contains(notes, 'corrupt') or contains(notes, 'specialist'))"
_CLEAN = "(high and f1 = f2 and not contains(notes, 'obscure') and not contains(notes, 'ambig'))"


@register("consensus_classify", f"select row_id, case when p1 = p2 and p1 in ('Y', 'N') then 'Y' else 'N' end as agreement, case when {_DISPUTED} then 'disputed' when {_CLEAN} then 'silver_consensus_high' else 'silver_consensus_med' end as status, case when {_DISPUTED} then 'P1' when {_CLEAN} then 'P3' else 'P2' end as priority, case when {_DISPUTED} then '' else p2 end as publishable, case when {_DISPUTED} then '' when len(f2) = 0 then 'OK' else array_to_string(f2, '|') end as flags from {_SITTINGS}")
def consensus_classify(spark: SparkSession, d: str) -> DataFrame:
    return factory.classify_sittings(table(spark, d, "consensus_rows"))


@register("headline", "select system_id, count(*) filter (upper(trim(second_publishable, ' ')) = 'Y') as y, count(*) filter (upper(trim(second_publishable, ' ')) = 'N') as n from consensus_rows group by 1")
def headline(spark: SparkSession, d: str) -> DataFrame:
    v = F.upper(F.trim("second_publishable"))
    return table(spark, d, "consensus_rows", "system_id", "second_publishable").groupBy("system_id").agg(F.count_if(v == "Y").alias("y"), F.count_if(v == "N").alias("n"))


@register("verify_graded", f"select row_id, problem from (select row_id, case when upper(trim(publishable, ' ')) = 'Y' and len(f) > 0 then 'publishable with a blocking flag' when not coalesce(upper(trim(publishable, ' ')) = 'Y', false) and len(f) = 0 then 'unpublishable without a flag' end as problem from (select row_id, first_publishable as publishable, {_FLAGS.format('first_blocking_flags')} as f from consensus_rows)) where problem is not null")
def verify_graded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "consensus_rows", "row_id", "first_publishable", "first_blocking_flags")
    return factory.graded_errors(rows, rows.select("row_id", F.col("first_publishable").alias("publishable"), F.col("first_blocking_flags").alias("blocking_flags")))


@register("checker_prf", f"with c as (select c.system_id, count(*) filter (bad and not ok) as tp, count(*) filter (bad and ok) as fp, count(*) filter (not bad and not ok) as fn, count(*) filter (not bad and ok) as tn from {_JUDGED} c group by 1) select *, case when tp + fp > 0 then round(tp / (tp + fp), 3) else 0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 3) else 0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 3) else 0 end as f1 from c")
def checker_prf(spark: SparkSession, d: str) -> DataFrame:
    """The checks as a predictor of the second sitting's verdict, per system."""
    rows = table(spark, d, "consensus_rows", "system_id", "arabic", "translation", "second_publishable")
    failed = F.size(checks.failed_flags("arabic", "translation")) > 0
    return factory.prf(rows, failed, F.coalesce(F.upper(F.trim("second_publishable")) != "Y", F.lit(True)), "system_id")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two systems with what the checks say of them and the second sitting's verdict."""
    genre = table(spark, d, "eval_items", "id", "genre").withColumnRenamed("id", "item_id")
    rows = table(spark, d, "consensus_rows", "row_id", "item_id", "system_id", "arabic", "translation", "second_publishable").join(genre, "item_id", "left")
    return rows.select("row_id", "item_id", "system_id", F.col("genre").alias("hint"), F.coalesce(F.upper(F.trim("second_publishable")) == "Y", F.lit(False)).alias("ok"), checks.failed_flags("arabic", "translation").alias("fails"))


def _simulated(spark: SparkSession, d: str) -> DataFrame:
    return factory.simulate(factory.paired(_graded(spark, d), "lite", "strong"))


@register("policy_simulation", f"{_SIMULATED} select policy, count(*) as passages, count(*) filter (ok) as publishable, count(*) filter (not ok) as escaped, round(count(*) filter (not ok)::double / count(*), 3) as escaped_rate from ({_UNPIVOTED}) group by 1")
def policy_simulation(spark: SparkSession, d: str) -> DataFrame:
    """What each of six policies would ship of the items that either system translated."""
    return factory.policy_rates(_simulated(spark, d))


@register("routing_counts", f"{_SIMULATED} select count(*) as passages, count(*) filter (escalate) as escalated, count(*) filter (gate) as gated, count(*) filter (queue = 'human') as human, count(*) filter (sys = 'strong' and escalate) as strong_after_check from m")
def routing_counts(spark: SparkSession, d: str) -> DataFrame:
    escalate = F.col("decision.escalate")
    return _simulated(spark, d).agg(F.count("*").alias("passages"), F.count_if(escalate).alias("escalated"), F.count_if(F.col("decision.primary") == "strong").alias("gated"), F.count_if(F.col("queue") == "human").alias("human"), F.count_if((F.col("system") == "strong") & escalate).alias("strong_after_check"))


@register("accepted_picks", f"{_SIMULATED} select item_id, case when gate then 'strong' when not escalate then 'lite' when not lite_ok and strong_ok then 'strong' else 'lite' end as chosen from m")
def accepted_picks(spark: SparkSession, d: str) -> DataFrame:
    return _simulated(spark, d).select("item_id", "chosen")


@register("merged_rounds", "with e as (select row_id, 1 as round from consensus_rows union all select row_id, 2 from annotations) select round, count(*) as n, count(*) filter (row_id in (select row_id from e group by 1 having count(*) > 1)) as repeated from e group by 1")
def merged_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of labels put together; keys that come more than once are counted, not refused."""
    every = factory.merge_rounds([table(spark, d, "consensus_rows", "row_id"), table(spark, d, "annotations", "row_id")])
    return every.groupBy("round").agg(F.count("*").alias("n"), F.count_if("repeated").alias("repeated"))


@register("term_candidates", "select arabic, en_should, book, arg_min(en_wrong, row_id) as en_wrong from (select row_id, trim(coalesce(arabic_error_span, ''), ' ') as arabic, trim(coalesce(english_error_span, ''), ' ') as en_should, trim(coalesce(source, ''), ' ') as book, '' as en_wrong from consensus_rows where list_contains(list_transform(string_split_regex(coalesce(second_blocking_flags, ''), '[|;,]'), lambda x: upper(trim(x, ' '))), 'TERM')) where length(arabic) >= 2 and en_should <> '' group by 1, 2, 3")
def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Spans of rows that the second sitting flagged for a term."""
    rows = table(spark, d, "consensus_rows", "row_id", "item_id", "source", "second_blocking_flags", "arabic_error_span", "english_error_span")
    graded = rows.select("row_id", "item_id", "source", F.col("second_blocking_flags").alias("blocking_flags"), F.col("arabic_error_span").alias("term_ar"), F.col("english_error_span").alias("term_en_should"), F.lit(None).cast("string").alias("term_en_wrong"))
    return factory.term_candidates(graded, "second sitting").select("arabic", "en_should", "book", "en_wrong")


@register("source_routes", "select case when lower(trim(coalesce(genre, ''), ' ')) in ('verse', 'poetry', 'saj', 'rhymed_prose', 'metalinguistic') or contains(lower(coalesce(genre, '')), 'verse') or contains(lower(coalesce(genre, '')), 'maqama') then 'strong' else 'lite' end as route, count(*) as n from documents group by 1")
def source_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "genre").groupBy(factory.source_route(F.col("genre")).alias("route")).agg(F.count("*").alias("n"))


_TERM = "coalesce(g.status, '') <> 'rejected' and trim(g.arabic, ' ') <> ''"
_HIT = f"(select distinct p.id, g.entry_id from consensus_p p join glossary g on {_TERM} and case when length(g.arabic) <= 2 then regexp_matches(p.text, '(^|[^\\x{{0600}}-\\x{{06FF}}])' || g.arabic || '($|[^\\x{{0600}}-\\x{{06FF}}])') else contains(p.text, g.arabic) end)"
_PASSAGES = "with consensus_p as (select row_id as id, arabic as text, translation as english from consensus_rows)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "consensus_rows", "row_id", "arabic").select(F.col("row_id").alias("id"), F.col("arabic").alias("text"), F.lit(None).cast("string").alias("book"))
    return factory.retrieve(passages, table(spark, d, "glossary", "entry_id", "arabic", "status", "book"))


@register("glossary_retrieve", f"{_PASSAGES} select id, entry_id from {_HIT}")
def glossary_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


_PART = "list_transform(string_split(lower(coalesce(g.en_wrong, '')), '|'), lambda x: trim(regexp_replace(trim(x, ' '), '^\\([^)]*\\)\\s*', ''), ' '))"
_KEYS = f"list_filter(flatten(list_transform({_PART}, lambda x: [trim(regexp_replace(x, '(?s)\\s*[(,;].*$', ''), ' '), trim(x, '() ')])), lambda x: length(x) >= 4)"
_RIGHT = "substring(trim(regexp_replace(lower(coalesce(g.en_should, '')), '(?s)\\(.*$', ''), ' '), 1, 8)"


@register("glossary_contradictions", f"{_PASSAGES} select h.id, h.entry_id from {_HIT} h join glossary g using (entry_id) join consensus_p p on p.id = h.id where len(list_filter({_KEYS}, lambda x: contains(lower(coalesce(p.english, '')), x))) > 0 and ({_RIGHT} = '' or not contains(lower(coalesce(p.english, '')), {_RIGHT}))")
def glossary_contradictions(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "consensus_rows", "row_id", "translation").select(F.col("row_id").alias("id"), F.col("translation").alias("english"))
    return factory.contradictions(_hits(spark, d), out, table(spark, d, "glossary", "entry_id", "en_wrong", "en_should"))

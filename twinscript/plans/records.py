"""Queries over records of releases, runs and gradings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.operators import harness, records
from twinscript.plans.runs import LATEST
from twinscript.plans.texts import sql_words
from twinscript.queries import register
from twinscript.sources.tables import table

_BAND = "case when n between 20 and 80 then '20-80' when n between 100 and 250 then '100-250' when n between 250 and 600 then '250-600' end"
_POOL = f"(select * from (select *, {_BAND} as b, sha256(arabic) as h, row_number() over (partition by sha256(arabic) order by source, source_native_id) as r from (select *, {sql_words('arabic')} as n from eval_items) where {_BAND} is not null and source_split = 'test') where r = 1)"


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return records.candidate_pool(table(spark, d, "eval_items").drop("id", "band", "sha256_arabic"), F.col("source_split") == "test")


@register("candidate_pool", f"select source, b as band, count(*) as n from {_POOL} group by 1, 2")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d).groupBy("source", "band").agg(F.count("*").alias("n"))


@register("data_records", f"select source || ':' || source_native_id as id, h as sha256_arabic, b as band, author, translator, split from {_POOL}")
def data_records(spark: SparkSession, d: str) -> DataFrame:
    return records.data_records(_pool(spark, d)).select("id", "sha256_arabic", "band", "author", "translator", "split")


@register("manifest_records", f"select source || ':' || source_native_id as id, source, source_native_id, h as sha256_arabic, split, b as band, attribution, rights_status from {_POOL}")
def manifest_records(spark: SparkSession, d: str) -> DataFrame:
    return records.manifest_records(_pool(spark, d))


@register("run_ids", "select distinct run_id, strftime(min(recorded_at) over (partition by run_id), '%Y%m%dT%H%M%SZ') || '-' || 'batch' || '-' || replace(regexp_replace(model, '-it$', ''), '-', '_') as made from run_rows where recorded_at is not null")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "run_rows", "run_id", "model", "recorded_at").where("recorded_at is not null").groupBy("run_id", "model").agg(F.min("recorded_at").alias("at"))
    started = first.groupBy("run_id").agg(F.min("at").alias("at")).join(first.select("run_id", "model"), "run_id")
    return started.select("run_id", records.run_id("at", F.concat(F.lit("maker/"), "model"), "batch").alias("made")).distinct()


def _raw(spark: SparkSession, d: str) -> DataFrame:
    rows = harness.latest(table(spark, d, "run_rows"))
    return rows.select(F.col("item_id").alias("id"), F.col("translation").alias("english"), "output_tokens", "latency_s", "error", "run_id")


@register("ingested_rows", f"select item_id, run_id, coalesce(translation, '') as translation, case when error is not null then error when translation is null then 'neither output nor error' end as error from {LATEST}")
def ingested_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows of a batch as run rows."""
    raw = _raw(spark, d)
    made = records.run_rows(raw.withColumn("id", F.concat("id", F.lit("\t"), "run_id")), adapter="batch")
    parts = F.split("item_id", "\t")
    return made.select(parts[0].alias("item_id"), parts[1].alias("run_id"), "translation", "error")


@register("run_summaries", f"select run_id, count(*) as items, count(error) as errors, cast(sum(output_tokens) as bigint) as tokens, round(sum(latency_s), 4) as latency from {LATEST} group by 1")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    return records.run_summary(harness.latest(table(spark, d, "run_rows"))).withColumn("latency", F.round("latency", 4))


_SIDE = "(select item_id, max(translation) as translation, max(second_publishable) as verdict from consensus_rows where system_id = '{}' group by 1)"


@register("compared_runs", f"""with b as (select n.item_id as ni, o.item_id as oi, n.translation as nt, o.translation as ot, n.verdict as nv, o.verdict as ov from {_SIDE.format('lite')} n full join {_SIDE.format('strong')} o on n.item_id = o.item_id)
select field, count(*) filter (ni is not null and oi is not null) as compared, count(*) filter (ni is not null and oi is not null and other) as differing, count(*) filter (oi is null) as only_new, count(*) filter (ni is null) as only_old from (select *, 'translation' as field, nt is distinct from ot as other from b union all select *, 'verdict', nv is distinct from ov from b) group by 1""")
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' outputs as if they were two runs."""
    rows = table(spark, d, "consensus_rows", "item_id", "system_id", "translation", "second_publishable")
    side = lambda s: rows.where(F.col("system_id") == s).groupBy("item_id").agg(F.max("translation").alias("translation"), F.max("second_publishable").alias("verdict"))
    return records.compare_runs(side("lite"), side("strong"), "item_id", ["translation", "verdict"])


_OUT = "(select item_id, system_id, max(translation) as translation from consensus_rows group by 1, 2)"


@register("grading_rows", f"""select 'b1-' || lpad(cast(row_number() over (order by e.id, s.k) as varchar), cast(greatest(4, length(cast(row_number() over (order by e.id, s.k) as varchar))) as integer), '0') as row_id, e.id as item_id, s.system_id, coalesce(o.translation, '') as translation, cast({sql_words('o.translation')} as bigint) as translation_word_count,
case when {sql_words('e.arabic')} > 0 then printf('%.3f', {sql_words('o.translation')}::double / {sql_words('e.arabic')}) else '' end as length_ratio from eval_items e cross join (select * from (values (0, 'lite'), (1, 'strong')) as v(k, system_id)) s left join {_OUT} o on o.item_id = e.id and o.system_id = s.system_id""")
def grading_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of all items and two systems."""
    outputs = table(spark, d, "consensus_rows", "item_id", "system_id", "translation").groupBy("item_id", "system_id").agg(F.max("translation").alias("translation")).withColumn("error", F.lit(None).cast("string"))
    made = records.grading_rows(table(spark, d, "eval_items", "id", "arabic", "source", "genre", "band"), outputs, [("lite", "A"), ("strong", "B")], "b1")
    return made.select("row_id", "item_id", "system_id", "translation", "translation_word_count", "length_ratio")

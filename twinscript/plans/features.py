"""Queries over features of outputs and a classifier held out by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.operators import factory, features
from twinscript.plans.runs import _FLAGS, _LONG
from twinscript.plans.texts import sql_words
from twinscript.queries import register
from twinscript.sources.tables import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "consensus_rows", "row_id", "item_id", "source", "system_id", "arabic", "translation", "second_publishable", "second_blocking_flags")


_WIDE = ", ".join(f"sum((applicable and not passed)::int::double) filter (\"check\" = '{c}') as {c}_failed, round(coalesce(max(value) filter (\"check\" = '{c}'), 0), 6) as {c}_value" for c in features.checks.CORE)


@register("check_features", f"select row_id, {_WIDE}, sum((applicable and not passed)::int)::double as core_failed from {_LONG} group by 1")
def check_features(spark: SparkSession, d: str) -> DataFrame:
    made = features.check_features(_rows(spark, d), "arabic", "translation")
    return made.select("row_id", *(F.round(f, 6).alias(f) if f.endswith("_value") else f for f in features.CHECK_FEATURES if f != "empty_output"))


@register("style_features", f"select row_id, greatest({sql_words('translation')}, 1)::double as words, round(length(coalesce(translation, ''))::double / greatest({sql_words('translation')}, 1), 6) as word_length, (length(coalesce(translation, '')) - length(replace(coalesce(translation, ''), '''', '')))::double as apostrophes from consensus_rows")
def style_features(spark: SparkSession, d: str) -> DataFrame:
    return features.style_features(_rows(spark, d), "translation").select("row_id", "words", F.round("word_length", 6).alias("word_length"), "apostrophes")


@register("blocking_labels", f"select row_id, (not coalesce(upper(trim(second_publishable, ' ')) = 'Y', false))::int as blocking, list_contains({_FLAGS.format('second_blocking_flags')}, 'OMISSION')::int as omission from consensus_rows")
def blocking_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("row_id", features.blocking("second_publishable").alias("blocking"), features.has_flag("second_blocking_flags", "OMISSION").alias("omission"))


@register("grouped_rows", "select source, count(*) as n, list_sort(list(row_id)) as rows from consensus_rows group by 1")
def grouped_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("row_id")).alias("rows"))


def _held_out(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("blocking", features.blocking("second_publishable"))
    made = features.check_features(rows, "arabic", "translation") if kind == "checks" else features.style_features(rows, "translation")
    names = features.CHECK_FEATURES if kind == "checks" else features.STYLE_FEATURES
    judged = features.leave_one_group_out(made, "row_id", "source", "blocking", names)
    return factory.prf(judged, F.col("predicted") == 1, F.col("blocking") == 1)


@register("held_out_by_checks")
def held_out_by_checks(spark: SparkSession, d: str) -> DataFrame:
    """How well the checks predict the second sitting's verdict on sources they weren't fitted to."""
    return _held_out(spark, d, "checks")


@register("held_out_by_style")
def held_out_by_style(spark: SparkSession, d: str) -> DataFrame:
    """The same by the style of the output alone: what it finds is a leak, not quality."""
    return _held_out(spark, d, "style")

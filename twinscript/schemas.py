"""Closed schemas of the relations and their constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "paragraph": "id string, work_id string, language string, structure_id string, sequence int, text string, source_hash string, flags array<string>",
    "sentence": "id string, paragraph_id string, work_id string, language string, sequence int, global_sequence int, text string, source_hash string",
    "structural_link": "work_id string, structural_link_index int, arabic_structure_ids array<string>, english_structure_ids array<string>, method string, confidence double, evidence array<string>, flags array<string>",
    "dp_link": "work_id string, structural_link_index int, arabic_start int, arabic_end int, english_start int, english_end int, operation string, score double, confidence double, uncertainty_radius int, flags array<string>",
    "pair": "source string, source_native_id string, work_id string, author string, genre string, date_or_century string, arabic string, reference_english string, translator string, english_source string, rights_status string, source_split string, notes string",
    "benchmark_item": "id string, source string, source_native_id string, work_id string, author string, genre string, date_or_century string, arabic string, reference_english string, translator string, english_source string, rights_status string, source_split string, notes string, sha256_arabic string, band string, attribution string, split string",
    "block_item": "id string, arabic string, parent_id string, block_index int, block_count int",
    "run_row": "run_id string, item_id string, model string, model_version string, adapter string, quantization string, prompt_template_id string, source_tokens int, output_tokens int, latency_s double, batch_size int, gpu string, cost_estimate double, translation string, error string",
    "glossary_entry": "arabic string, lemma string, en_should string, en_wrong string, kind string, book string, item_ids string, status string, source_label string, reviewer string, train_eligible string",
    "work": "uri string, priority_rank int, author string, title string, author_death_ah int, genre string, source_lib_claim string, source_evidence string, meta_found int, arabic_rights string, english_rights string, commercial_status string",
    "ledger_word": "edition_key string, id string, block_id string, block_sequence int, word_sequence int, text string",
    "catalog_hit": "source_id string, title string, authors string, subjects string, year string, language string, rights string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])


def enforce(df: DataFrame, name: str) -> DataFrame:
    """df in the closed schema: unknown columns are refused, missing ones are null."""
    wanted = schema(name)
    unknown = sorted(set(df.columns) - set(wanted.fieldNames()))
    if unknown:
        raise ValueError(f"{name} has no column {', '.join(unknown)}")
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column], sequence: tuple[list[str], str] | None = None) -> DataFrame:
    """(rule, key) of every row that breaks a rule: null keys, repeated keys, the given conditions, gaps in a sequence."""
    as_key = F.concat_ws("/", *(F.col(k).cast("string") for k in key)).alias("key")
    checks = {"key is null": reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))} | {k: ~F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    broken = df.select(as_key, F.explode(F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())).alias("rule")).select("rule", "key")
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("key is repeated").alias("rule"), as_key)
    out = broken.unionByName(twice)
    if sequence:
        by, at = sequence
        w = Window.partitionBy(*by).orderBy(at)
        gap = df.withColumn("_gap", F.coalesce(F.col(at) - F.lag(at).over(w) - 1, F.col(at))).where("_gap <> 0")
        out = out.unionByName(gap.select(F.lit("sequence isn't contiguous").alias("rule"), as_key))
    return out


def require(df: DataFrame, found: DataFrame) -> DataFrame:
    """df, or an error that names a few of the violations."""
    few = found.limit(5).collect()
    if few:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in few))
    return df

"""Records of releases, runs and gradings: pools of candidates, ids, run rows and summaries, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t

# Fields of a release's records with and without text, and of a sheet to be graded.
DATA = (
    "id", "source", "source_native_id", "work_id", "author", "genre", "date_or_century", "arabic", "reference_english", "translator", "english_source", "rights_status", "source_split", "notes", "sha256_arabic", "band", "attribution", "split",
)
MANIFEST = ("id", "source", "source_native_id", "sha256_arabic", "split", "band", "attribution", "rights_status")
TO_GRADE = (
    "publishable", "blocking_flags", "cosmetic_flags", "arabic_error_span", "english_error_span", "term_ar", "term_en_wrong", "term_en_should", "entity_ar", "entity_en_wrong", "entity_en_should", "role_speaker_ar", "role_assigned_wrong", "notes", "confidence",
)


def item_id(source: Column | str = "source", native: Column | str = "source_native_id") -> Column:
    return F.concat(source, F.lit(":"), native)


def candidate_pool(pairs: DataFrame, eligible: Column) -> DataFrame:
    """Eligible pairs of a known length band, one for each Arabic text: the first by source and native id; with sha256_arabic and band."""
    banded = pairs.where(F.coalesce(eligible, F.lit(False))).withColumn("_n", t.word_count("arabic"))
    kept = banded.withColumn("band", t.length_band("_n")).where("band is not null").drop("_n").withColumn("sha256_arabic", t.sha("arabic"))
    first = kept.groupBy("sha256_arabic").agg(F.min(F.struct("source", "source_native_id")).alias("_k")).select("sha256_arabic", "_k.source", "_k.source_native_id")
    return kept.join(first, ["sha256_arabic", "source", "source_native_id"], "left_semi")


def data_records(pool: DataFrame) -> DataFrame:
    """DATA fields of pairs that have a hash, band, attribution and split."""
    return pool.withColumn("id", item_id()).select(*DATA)


def manifest_records(pool: DataFrame) -> DataFrame:
    """MANIFEST fields: no text."""
    return pool.withColumn("id", item_id()).select(*MANIFEST)


def model_slug(repository: Column | str) -> Column:
    """The last part of a model's path, without the ending for instructed models, hyphens as underscores."""
    return F.replace(F.regexp_replace(F.regexp_extract(repository, "([^/]*)$", 1), "-it$", ""), F.lit("-"), F.lit("_"))


def run_id(started: Column | str, repository: Column | str, adapter: str) -> Column:
    """Stamp of the start, adapter and model."""
    return F.concat_ws("-", F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.lit(adapter), model_slug(repository))


def run_rows(raw: DataFrame, **of_run: str | None) -> DataFrame:
    """raw(id, english, output_tokens, latency_s, error) as run rows; a row with neither output nor error, or without an id, is an error; of_run gives the run's own fields."""
    nothing = F.when(F.col("english").isNull() & F.col("error").isNull(), "neither output nor error").when(F.col("id").isNull() | (F.trim("id") == ""), "no id")
    fixed = {c: F.lit(v).cast("string") for c, v in of_run.items()}
    return raw.select(*(c.alias(k) for k, c in fixed.items()), F.col("id").alias("item_id"), "output_tokens", "latency_s", F.coalesce("english", F.lit("")).alias("translation"), F.coalesce("error", nothing).alias("error"))


def run_summary(rows: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, items, errors, tokens, latency): one row for each run."""
    return rows.groupBy(by).agg(F.count("*").alias("items"), F.count("error").alias("errors"), F.sum("output_tokens").alias("tokens"), F.sum("latency_s").alias("latency"))


def compare_runs(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, compared, differing, only_new, only_old): fields of two runs' rows side by side, one row for each field; texts aren't shown."""
    side = lambda df, p: df.select(key, F.lit(True).alias(f"_{p}"), *(F.col(f).cast("string").alias(f"{p}_{f}") for f in fields))
    both = side(new, "n").join(side(old, "o"), key, "full_outer")
    met = F.col("_n").isNotNull() & F.col("_o").isNotNull()
    each = both.select(met.alias("met"), "_n", "_o", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (~F.col(f"n_{f}").eqNullSafe(F.col(f"o_{f}"))).alias("other")) for f in fields))).alias("x"))
    return each.groupBy("x.field").agg(F.count_if("met").alias("compared"), F.count_if(F.col("met") & F.col("x.other")).alias("differing"), F.count_if(F.col("_o").isNull()).alias("only_new"), F.count_if(F.col("_n").isNull()).alias("only_old"))


def grading_rows(items: DataFrame, outputs: DataFrame, systems: list[tuple[str, str]], batch: str) -> DataFrame:
    """A row to grade for each of items(id, arabic, source, genre, band) and system, in order of item and system; outputs(item_id, system_id, translation, error) may lack some. Rows are numbered in one task: a sheet is as long as people can grade."""
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("at"), F.lit(s).alias("system_id"), F.lit(label).alias("system_label")) for k, (s, label) in enumerate(systems))))
    every = items.select(F.col("id").alias("item_id"), "arabic", "source", "genre", "band", named.alias("s")).select("*", "s.*").drop("s")
    got = every.join(outputs.select("item_id", "system_id", "translation", "error"), ["item_id", "system_id"], "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    n = F.row_number().over(Window.orderBy("item_id", "at"))
    number = F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    ratio = F.format_string("%.3f", t.length_ratio("arabic", "translation"))
    return got.select(
        F.concat(F.lit(f"{batch}-"), number).alias("row_id"), F.lit(batch).alias("batch_id"), "item_id", *(blank(c).alias(c) for c in ("source", "genre", "band")), "system_id", "system_label", *(blank(c).alias(c) for c in ("arabic", "translation", "error")),
        t.word_count("arabic").alias("arabic_word_count"), t.word_count("translation").alias("translation_word_count"), F.when(t.word_count("arabic") > 0, ratio).otherwise("").alias("length_ratio"), *(F.lit("").alias(c) for c in TO_GRADE),
    )

"""Intervals in time: unions, coverage, as-of lookups, the display mode of a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t


def interval_union(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals that cover the same points; touching ones are merged."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*by, start, end).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covered_length(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    return interval_union(rows, by, start, end).groupBy(*by).agg(F.count("*").alias("islands"), F.sum(F.col(end) - F.col(start)).alias("covered"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value that right(key, at, value) last had at or before its time: one union and one window, no range join."""
    a = left.select(key, at, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"), *[c for c in left.columns if c not in (key, at)])
    b = right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def display_mode(confidence: Column, flags: Column, one_to_one: Column) -> Column:
    """1 sentence by sentence, 2 paragraph by paragraph, 3 structure only."""
    unsure = F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.isin("unanchored", "review_required"))
    return F.when(unsure | confidence.isNull() | (confidence < 0.4), 3).when(one_to_one & (confidence >= 0.7), 1).otherwise(2)


def tokens(c: Column | str) -> Column:
    """Words as they are compared between editions: vowel marks, elongation and everything but letters and digits off, one spelling for the forms of alif, ya and ta."""
    bare = F.regexp_replace(F.lower(c), t.VOWEL_MARKS, "")
    same = F.translate(bare, "أإآٱىة", "اااايه")
    return F.filter(F.split(F.regexp_replace(same, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def find_spans(words: DataFrame, patterns: DataFrame, key: str, name: str) -> DataFrame:
    """(name, key, start, end): where the tokens of patterns(name, tokens) stand one after the other in words(key, at, token); end is excluded.

    A pattern is looked for by its rarest token, so common words seed nothing; the other tokens are then met by key,
    place and word. A pattern without tokens is nowhere.
    """
    w = words.select(key, "at", "token")
    parts = patterns.where("size(tokens) > 0").select(name, F.size("tokens").alias("n"), F.posexplode("tokens").alias("k", "token"))
    counts = w.groupBy("token").agg(F.count("*").alias("_df"))
    rarest = parts.join(counts, "token", "left").groupBy(name).agg(F.min_by(F.struct("token", "k", "n"), F.struct(F.coalesce("_df", F.lit(0)), "k")).alias("r")).select(name, "r.*")
    starts = rarest.join(w, "token").select(name, key, (F.col("at") - F.col("k")).alias("start"), "n")
    met = starts.join(parts.select(name, "k", "token"), name).withColumn("at", F.col("start") + F.col("k")).join(w.distinct(), [key, "at", "token"])
    return met.groupBy(name, key, "start", "n").agg(F.count_distinct("k").alias("found")).where("found = n").select(name, key, "start", (F.col("start") + F.col("n")).alias("end"))


def first_spans(spans: DataFrame, name: str, key: str) -> DataFrame:
    """The first span of each pattern in each key."""
    return spans.groupBy(name, key).agg(F.min(F.struct("start", "end")).alias("s")).select(name, key, "s.start", "s.end")


def clamped(events: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """events(key, start, end) cut to bounds(key, low, high), with outside: whether something was cut off; events that lie outside altogether are left out."""
    both = events.join(bounds, key).withColumn("outside", (F.col("start") < F.col("low")) | (F.col("end") > F.col("high")))
    cut = both.withColumn("start", F.greatest("start", "low")).withColumn("end", F.least("end", "high"))
    return cut.where("start < end").drop("low", "high")

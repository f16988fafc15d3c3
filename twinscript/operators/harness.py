"""Runs of translation systems: batches, the id contract, scores, comparison of systems."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.functions import text as t


def batches(items: DataFrame, size: int, *order: str, parts: int = 64) -> DataFrame:
    """items with batch, the name of a group of at most so many rows; rows are numbered in so many parts of a hash, so no global sort is needed (one part numbers all in order)."""
    parts = F.pmod(F.xxhash64(*order), F.lit(parts))
    w = Window.partitionBy("_part").orderBy(*order)
    return items.withColumn("_part", parts).withColumn("batch", F.concat_ws("-", F.col("_part").cast("string"), F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("_part")


def reconcile(sent: DataFrame, returned: DataFrame) -> DataFrame:
    """(id, status, english): each sent or returned id as ok, missing, duplicate, unexpected or error."""
    r = returned.groupBy("id").agg(F.count("*").alias("n"), F.min("english").alias("english"), F.max("error").alias("error"))
    both = sent.select("id").distinct().withColumn("sent", F.lit(True)).join(r, "id", "full_outer")
    status = F.when(F.col("sent").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("error").isNotNull() | (F.trim(F.coalesce("english", F.lit(""))) == ""), "error").otherwise("ok")
    return both.select("id", status.alias("status"), F.when(status == "ok", F.col("english")).alias("english"))


def loss(reconciled: DataFrame, *by: str) -> DataFrame:
    """Counts of the statuses and the share of sent ids that came back well."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = reconciled.groupBy(*by).agg(F.count_if(F.col("status") != "unexpected").alias("sent"), *map(n, ("ok", "missing", "duplicate", "unexpected", "error")))
    return out.withColumn("preserved", F.when(F.col("sent") > 0, F.col("ok") / F.col("sent")))


def latest(rows: DataFrame) -> DataFrame:
    """The row of each (run_id, item_id) that was ingested last."""
    rest = [c for c in rows.columns if c not in ("run_id", "item_id")]
    newest = F.max_by(F.struct(*rest), F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.coalesce("translation", F.lit("")), F.xxhash64(*rest))).alias("r")
    return rows.groupBy("run_id", "item_id").agg(newest).select("run_id", "item_id", "r.*")


def run_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Error rate, untranslated share, length ratio, latency and cost of rows(translation, error, source_text, ...)."""
    good = F.col("error").isNull()
    ratio = F.when(good, t.length_ratio("source_text", "translation"))
    scored = rows.withColumn("_ratio", ratio).withColumn("_good", good)
    lat = F.filter(F.array_sort(F.collect_list("latency_s")), lambda x: x.isNotNull())
    at = F.greatest(F.floor(F.size("_lat") * 0.95) - 1, F.lit(0)) + 1
    out = scored.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~good).alias("errors"), F.count_if(good & t.has_arabic("translation")).alias("untranslated"), F.count_if(good & t.ratio_flagged("_ratio")).alias("ratio_flagged"),
        F.avg("_ratio").alias("ratio_mean"), F.avg("latency_s").alias("latency_mean"), lat.alias("_lat"), F.sum("cost_estimate").alias("cost"),
    )
    return out.withColumn("error_rate", F.col("errors") / F.col("total")).withColumn("latency_p95", F.when(F.size("_lat") > 0, F.element_at("_lat", at.cast("int")))).drop("_lat")


def ngram_counts(hyp: Column | str, ref: Column | str, order: int) -> Column:
    """Array of matches, n-grams of the output and n-grams of the reference for each order, of texts without white space.

    Both texts are on one row, so they are counted in an Arrow batch and only sums go on.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(hyps: pd.Series, refs: pd.Series) -> pd.Series:
        def one(h: str, r: str) -> list[int]:
            out = []
            for n in range(1, order + 1):
                a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h, r))
                out += [sum(min(k, b[g]) for g, k in a.items() if g in b), a.total(), b.total()]
            return out

        return pd.Series([one(h, r) for h, r in zip(hyps, refs, strict=True)])

    bare = lambda c: F.regexp_replace(c, t.SPACE + "+", "")
    return count(bare(hyp), bare(ref))


def chrf(pairs: DataFrame, *by: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF of pairs(id, hyp, ref) per group: counts are summed over the corpus, then precision and recall averaged over orders; null where no pair has two texts."""
    counted = pairs.where("trim(hyp) <> '' and trim(ref) <> ''").select(*by, ngram_counts("hyp", "ref", order).alias("_k"))
    sums = counted.groupBy(*by).agg(*(F.sum(F.get("_k", F.lit(k))).alias(f"_{k}") for k in range(3 * order)))
    orders = F.filter(F.array(*(F.struct(*(F.col(f"_{3 * n + k}").alias(c) for k, c in enumerate("mhr"))) for n in range(order))), lambda x: (x["h"] > 0) & (x["r"] > 0))
    mean = lambda c: F.aggregate("_o", F.lit(0.0), lambda s, x: s + x["m"] / x[c]) / F.size("_o")
    means = sums.select(*by, orders.alias("_o")).where("size(_o) > 0").select(*by, mean("h").alias("p"), mean("r").alias("rec"))
    b = beta * beta
    score = F.when(b * F.col("p") + F.col("rec") > 0, (1 + b) * F.col("p") * F.col("rec") / (b * F.col("p") + F.col("rec")) * 100).otherwise(0.0)
    return means.select(*by, score.alias("chrf"))


def overlap(rows: DataFrame, system: str, item: str) -> DataFrame:
    """The rows of items that every system answered without error."""
    good = rows.where("error is null and trim(translation) <> ''")
    n = good.agg(F.count_distinct(system).alias("_all"))
    whole = good.groupBy(item).agg(F.count_distinct(system).alias("_n")).join(n, F.col("_n") == F.col("_all")).select(item)
    return good.join(whole, item, "left_semi")

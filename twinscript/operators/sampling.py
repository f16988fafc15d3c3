"""Samples, splits and selections in hash order: the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t


def first_by_hash(rows: DataFrame, content: str, key: str, *order: str) -> DataFrame:
    """(sha, key) of the row of each distinct content that is first in the given order.

    Only hashes, keys and what they are ordered by are shuffled; semi_first gives the whole rows.
    """
    return rows.select(t.sha(content).alias("sha"), key, F.struct(*order).alias("_o")).groupBy("sha").agg(F.min_by(key, "_o").alias(key))


def semi_first(rows: DataFrame, content: str, key: str, *order: str) -> DataFrame:
    """The rows, all columns, that first_by_hash chooses; key must identify a row."""
    return rows.join(first_by_hash(rows, content, key, *order).select(key), key, "left_semi")


def per_stratum(rows: DataFrame, strata: list[str], n: int | Column, seed: int, key: str) -> DataFrame:
    """n rows of each stratum in hash order."""
    w = Window.partitionBy(*strata).orderBy(t.hash_order(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def split(rows: DataFrame, strata: list[str], sizes: dict[str, int], seed: int, key: str) -> DataFrame:
    """rows with split: the first sizes of each stratum to the first split, the next to the second, and so on; the rest null."""
    w = Window.partitionBy(*strata).orderBy(t.hash_order(seed, key), key)
    ranked = rows.withColumn("_r", F.row_number().over(w))
    out, low = F.lit(None).cast("string"), 0
    for name, n in sizes.items():
        out = F.when(F.col("_r").between(low + 1, low + n), name).otherwise(out)
        low += n
    return ranked.withColumn("split", out).drop("_r")


def allocate(sizes: DataFrame, target: int, group: str = "grp", size: str = "n") -> DataFrame:
    """(group, n, allotted): target shared out by size, largest remainders first, ties by name."""
    every = Window.partitionBy()
    total = sizes.agg(F.sum(size).alias("_all")).withColumn("_one", F.lit(1))
    with_all = sizes.withColumn("_one", F.lit(1)).join(total, "_one").withColumn("_exact", F.col(size) * F.least(F.lit(target), F.col("_all")) / F.col("_all")).withColumn("_base", F.floor("_exact"))
    left = with_all.withColumn("_left", F.least(F.lit(target), F.col("_all")) - F.sum("_base").over(every))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.col("_base")), group))
    return left.withColumn("_rank", rank).select(group, size, (F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("allotted"))


def round_robin(rows: DataFrame, group: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows: the best of each group, then the second of each, groups and members in hash order."""
    w = Window.partitionBy(group).orderBy(t.hash_order(seed, key), key)
    return rows.withColumn("_turn", F.row_number().over(w)).orderBy("_turn", t.hash_order(seed, group), key).limit(n).drop("_turn")


def audit_sample(rows: DataFrame, rules: list[Column], n: int, seed: int, key: str) -> DataFrame:
    """n rows: those that meet the earliest rule first, then hash order."""
    rank = F.coalesce(*(F.when(r, F.lit(i)) for i, r in enumerate(rules)), F.lit(len(rules)))
    return rows.withColumn("priority", rank).orderBy("priority", t.hash_order(seed, key), key).limit(n)


def exact_contamination(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Pairs of training rows(id, text) and held-out rows(item_id, text) of equal folded text."""
    a = train.select("id", t.sha(t.fold("text")).alias("h")).where("h is not null")
    b = held_out.select("item_id", t.sha(t.fold("text")).alias("h")).where("h is not null")
    return a.join(b, "h").select("id", "item_id")

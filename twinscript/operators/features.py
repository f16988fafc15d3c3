"""Features of outputs, a linear classifier on them, and its test on groups held out in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.functions import checks
from twinscript.functions import text as t

CHECK_FEATURES = tuple(f"{check}_{kind}" for check in checks.CORE for kind in ("failed", "value")) + ("core_failed", "empty_output")
STYLE_FEATURES = ("words", "word_length", "divine", "apostrophes", "capitals")


def check_features(rows: DataFrame, source: str, output: str) -> DataFrame:
    """rows with a column for each of CHECK_FEATURES: whether a check failed, its value (0 where it doesn't apply), how many failed, whether the output is blank."""
    found = rows.withColumn("_f", checks.findings(source, output))
    at = lambda k: F.col("_f")[k]
    failed = lambda k: (at(k)["applicable"] & ~at(k)["passed"]).cast("double")
    made = {f"{check}_failed": failed(k) for k, check in enumerate(checks.CORE)} | {f"{check}_value": F.coalesce(at(k)["value"], F.lit(0.0)) for k, check in enumerate(checks.CORE)}
    total = F.aggregate("_f", F.lit(0.0), lambda n, f: n + (f["applicable"] & ~f["passed"]).cast("double"))
    blank = (F.trim(F.coalesce(output, F.lit(""))) == "").cast("double")
    return found.withColumns(made | {"core_failed": total, "empty_output": blank}).drop("_f")


def style_features(rows: DataFrame, output: str) -> DataFrame:
    """rows with STYLE_FEATURES of an output alone: words, characters a word, share of words for God, apostrophes, share of capitalised words."""
    c = F.coalesce(output, F.lit(""))
    words = t.words(c)
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda test: F.size(F.filter(words, test)) / n
    divine = share(lambda w: F.lower(F.regexp_replace(w, "^[.,;:]+|[.,;:]+$", "")).isin("allah", "god"))
    return rows.withColumns({"words": n.cast("double"), "word_length": F.length(c) / n, "divine": divine, "apostrophes": F.regexp_count(c, F.lit("'")).cast("double"), "capitals": share(lambda w: w.rlike(r"^\p{Lu}"))})


def blocking(publishable: Column | str) -> Column:
    """1 unless the verdict is yes."""
    return (~F.coalesce(F.upper(F.trim(publishable)) == "Y", F.lit(False))).cast("int")


def has_flag(flags: Column | str, flag: str) -> Column:
    return F.array_contains(t.flag_set(flags), flag).cast("int")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.4) -> tuple[np.ndarray, np.ndarray, np.ndarray] | int:
    """Weights of a logistic regression on standardised features, both labels weighing the same, with means and deviations; the label itself if there is only one."""
    if len(set(y.tolist())) < 2:
        return int(y[0])
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([(x - mean) / deviation, np.ones((len(x), 1))])
    ones = y.sum()
    balance = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -20, 20)))
        w -= rate * (a.T @ ((p - y) * balance)) / len(y)
    return w, mean, deviation


def predict(model: tuple[np.ndarray, np.ndarray, np.ndarray] | int, x: np.ndarray) -> np.ndarray:
    if isinstance(model, int):
        return np.full(len(x), model)
    w, mean, deviation = model
    return (np.hstack([(x - mean) / deviation, np.ones((len(x), 1))]) @ w >= 0).astype(int)


def leave_one_group_out(rows: DataFrame, key: str, group: str, label: str, features: tuple[str, ...], most: int = 50_000) -> DataFrame:
    """(key, group, label, predicted): each row judged by a classifier fitted without its group.

    A classifier is fitted for each group on a bounded sample of labelled rows, the first so many in hash order (all
    of them up to the bound); every row is judged. The sample goes to the executors once, each group is one task's.
    """
    x = [F.col(f).cast("double").alias(f) for f in features]
    sample = rows.select(group, F.col(label).cast("int").alias(label), *x).orderBy(t.hash_order("sample", key)).limit(most).toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((sample[group].fillna("").to_numpy(str), sample[label].to_numpy(), sample[list(features)].to_numpy(float)))
    groups = rows.select(F.coalesce(group, F.lit("")).alias("_g")).distinct()

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, y, values = sent.value
        for pdf in batches:
            out = []
            for held in pdf["_g"]:
                some = g != held
                model = fit(values[some], y[some]) if some.any() else 0
                out.append((held, [float(model)], [], []) if isinstance(model, int) else (held, *(v.tolist() for v in model)))
            yield pd.DataFrame(out, columns=["_g", "_w", "_m", "_d"])

    models = groups.mapInPandas(train, "_g string, _w array<double>, _m array<double>, _d array<double>")
    judged = rows.withColumn("_g", F.coalesce(group, F.lit(""))).join(models, "_g")
    scaled = F.zip_with(F.zip_with(F.array(*x), "_m", lambda a, m: a - m), "_d", lambda a, s: a / s)
    score = F.aggregate(F.zip_with(scaled, F.slice("_w", 1, len(features)), lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v) + F.element_at("_w", -1)
    verdict = F.when(F.size("_m") == 0, F.element_at("_w", 1) >= 0.5).otherwise(score >= 0)
    return judged.select(key, group, F.col(label).cast("int").alias(label), verdict.cast("int").alias("predicted"))

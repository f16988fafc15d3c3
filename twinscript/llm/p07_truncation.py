"""Problem 7: values that lost their end.

Per source (model and adapter) and unit of length (characters, UTF-8 bytes, reported tokens) the histogram of
lengths goes through a right-censored log-normal fit by maximum likelihood: candidate limits are lengths far more
frequent than the fitted density and their surroundings allow, and the values at a limit count as censored there.
The ratio of observed to expected values at a limit is each value's prior odds of being cut. They are combined
with evidence from the ending: a missing closing mark, an unclosed quotation, a half character, an unfinished
response wrapper, and whether the last word ends statements or rather is a word from inside one or the beginning
of a longer word, judged by counts over all texts.

Defined results: null and empty values aren't cut (there is nothing stored that lost its end); of rows of one key
the one ingested last counts, ties to the greater text; a source of fewer than LEAST_AT_LIMIT equal lengths has no
limit, and only the ending counts; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

#: Fewest values at a candidate limit, least ratio of observed to expected ones, and the odds' bound.
LEAST_AT_LIMIT, LEAST_RATIO, MOST_ODDS = 4, 4.0, 1000.0
#: Odds of a cut away from limits, and the likelihood ratios (cut : complete) of the other evidence.
BASE_ODDS, NO_MARK, MARK, OPEN_QUOTE = 0.02, 16.0, 0.02, 12.0
#: A text that was cut by bytes lacks up to three of them.
BYTE_SLACK = 3
# Ends of texts are matched at the beginning of the reversed text, so that no pattern is tried at every place.
CLOSING = r"^\s*([;—–-]+|\)\s*\d+(\s*\.p)?\s*\()?\s*[\"”’»)\]*_]*[.!?؟۔。！？]"
# How a stored response in the structured format begins and ends.
WRAPPED, CLOSED = r"^\s*(```|\[\s*\{|\{\s*\")", r"^\s*(\]|\}|```)"
CUT_SIGN = r"^\s*((\.\.\.|…)\s*|�)+"
#: Beginnings of words are met by their first so many letters: each next length adds about half.
LADDER = (1, 2, 3)


def limits_of(lengths: np.ndarray, counts: np.ndarray, slack: int = 0) -> list[tuple[int, float, float, float]]:
    """(limit, odds that a value at it is cut, mu, sigma) for one histogram of positive lengths."""
    order = np.argsort(lengths)
    v, n = lengths[order].astype(float), counts[order].astype(float)
    if not len(v):
        return []
    total = n.sum()
    logs = np.log(v)
    sums = np.concatenate([[0.0], np.cumsum(n)])
    until = lambda x: sums[np.searchsorted(v, x, "right")]
    below = lambda x: sums[np.searchsorted(v, x, "left")]
    mass = until(v) - below(v - slack)
    reach = np.maximum(8, 0.15 * v)
    around = (until(v + reach) - below(v - reach) - mass) / (2 * reach)
    expected = np.maximum(around, 0.25) * (slack + 1)
    candidate = (n >= LEAST_AT_LIMIT) & (mass / expected >= LEAST_RATIO) & (mass - expected > 3 * np.sqrt(expected))
    if not candidate.any():
        return []
    censored = np.zeros(len(v), bool)
    for x in v[candidate]:
        censored |= (v >= x - slack) & (v <= x)
    # EM for a normal of the logs with right-censored values
    mu, sigma = np.average(logs, weights=n), max(np.sqrt(np.average((logs - np.average(logs, weights=n)) ** 2, weights=n)), 0.05)
    for _ in range(50):
        z = (logs - mu) / sigma
        tail = np.maximum(_survival(z), 1e-12)
        hazard = np.exp(-0.5 * z**2) / np.sqrt(2 * np.pi) / tail
        first = np.where(censored, mu + sigma * hazard, logs)
        second = np.where(censored, mu**2 + sigma**2 + sigma * hazard * (logs + mu), logs**2)
        new = np.average(first, weights=n)
        sigma, mu = max(np.sqrt(max(np.average(second, weights=n) - new**2, 0)), 0.05), new
    out = []
    for x, m in zip(v[candidate], mass[candidate], strict=True):
        fitted = total * (_survival((np.log(max(x - slack - 0.5, 0.5)) - mu) / sigma) - _survival((np.log(x + 0.5) - mu) / sigma))
        likely = max(fitted, 0.05, 0.5 * around[v == x][0] * (slack + 1))
        if m / likely >= LEAST_RATIO:
            out.append((int(x), float(min((m - likely) / likely, MOST_ODDS)), float(mu), float(sigma)))
    best: list[tuple[int, float, float, float]] = []
    for x in sorted(out, key=lambda t: -t[1]):  # one limit of those within a slack
        if all(abs(x[0] - y[0]) > slack for y in best):
            best.append(x)
    return sorted(best)


def _survival(z):
    """Of the standard normal distribution."""
    import math

    return 0.5 * np.vectorize(math.erfc)(np.asarray(z, float) / math.sqrt(2))


def censoring_limits(values: DataFrame) -> DataFrame:
    """(model, adapter, unit, value, odds, limit): each length that stands for a limit of its source."""
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).cast("int").alias("value")) for u in ("chars", "bytes", "tokens")))).alias("u")
    histogram = values.select("model", "adapter", units).select("model", "adapter", "u.*").where("value > 0").groupBy("model", "adapter", "unit", "value").agg(F.count("*").alias("n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        slack = BYTE_SLACK if key[2] == "bytes" else 0
        found = limits_of(pdf.value.to_numpy(), pdf.n.to_numpy(), slack)
        rows = [(*key, x - k, odds, x) for x, odds, _, _ in found for k in range(slack + 1)]
        return pd.DataFrame(rows, columns=["model", "adapter", "unit", "value", "odds", "limit"])

    # a group is one source's histogram: at most one row for each length that occurs
    return histogram.groupBy("model", "adapter", "unit").applyInPandas(fit, "model string, adapter string, unit string, value int, odds double, limit int")


def _measured(runs: DataFrame) -> DataFrame:
    rows = runs.select("run_id", "item_id", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("adapter", F.lit("")).alias("adapter"), F.col("translation").alias("text"), F.col("output_tokens").alias("tokens"), "ingested_at")
    newest = F.max_by(F.struct("model", "adapter", "text", "tokens"), F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.coalesce("text", F.lit(""))))
    kept = rows.groupBy("run_id", "item_id").agg(newest.alias("r")).select("run_id", "item_id", "r.*")
    back = kept.withColumn("back", F.reverse("text")).withColumn("kept_back", F.regexp_replace("back", CUT_SIGN, ""))
    body, wrapped = F.reverse("kept_back"), F.coalesce(F.col("text").rlike(WRAPPED), F.lit(False))
    quotes = F.length("body") - F.length(F.replace("body", F.lit('"')))
    marks = lambda chars: F.length("body") - F.length(F.translate("body", chars, ""))
    return cut_lineage(
        back.withColumn("body", body)
        .withColumn("tokens_of", F.filter(F.split(F.trim("body"), r"\s+"), lambda x: x != ""))
        .select(
            "run_id", "item_id", "model", "adapter", "tokens", F.length("body").alias("chars"), F.octet_length("body").alias("bytes"), wrapped.alias("wrapped"),
            F.coalesce(F.length("back") != F.length("kept_back"), F.lit(False)).alias("signed"), F.col("kept_back").rlike(CLOSING).alias("closes"), F.col("back").rlike(CLOSED).alias("closed"),
            F.col("back").rlike(r"^\s*�").alias("half"), (F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), ((quotes % 2 == 1) | (marks("“«") != marks("”»"))).alias("open_quote"), "tokens_of",
        )
    )


def _closing(word: Column) -> Column:
    return F.reverse(word).rlike(CLOSING)


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\"“«‘(]+|[\"”»’),;:.!?؟۔]+$", ""))


def word_evidence(measured: DataFrame) -> DataFrame:
    """(word, ending): log-likelihood ratio that a text whose last word this is was cut rather than complete."""
    plain = measured.where("not wrapped and size(tokens_of) > 0")
    whole = plain.select(F.col("tokens_of").alias("tokens")).withColumn("size", F.size("tokens")).withColumn("after_mark", _closing(F.get("tokens", F.col("size") - 2)))
    words = whole.select("size", "after_mark", F.posexplode("tokens").alias("at", "w"))
    last = F.col("at") == F.col("size") - 1
    final = _closing(F.col("w")) | (last & F.coalesce("after_mark", F.lit(False)))
    counted = cut_lineage(words.select(_bare(F.col("w")).alias("word"), final.cast("long").alias("final"), last.cast("long").alias("last")).groupBy("word").agg(F.count("*").alias("n"), F.sum("final").alias("final"), F.sum("last").alias("last")))
    totals = counted.agg(F.sum("n").alias("all"), F.sum("final").alias("finals")).withColumn("one", F.lit(1))
    ends = counted.where("last > 0")
    both = ends.join(_longer(ends.select("word"), counted.select("word", "n")), "word", "left").na.fill(0).withColumn("one", F.lit(1)).join(totals, "one")
    complete = F.col("final") / F.greatest("finals", F.lit(1)) + 2e-5
    cut = (F.col("n") / F.col("all")) / 6 + (F.col("longer") / F.col("all")) / 6 + 4e-6
    return both.select("word", F.log(cut / complete).alias("ending"))


def _longer(beginnings: DataFrame, words: DataFrame) -> DataFrame:
    """(word, longer): how often words occur that begin with a word of beginnings(word) and are longer; words(word, n).

    Both sides meet by their first letters, as many of a ladder of lengths as the beginning has, so a word offers a few
    beginnings of itself instead of all.
    """
    most = beginnings.agg(F.max(F.length("word"))).first()[0] or 0
    ladder = list(LADDER)
    while ladder[-1] < most:
        ladder.append(ladder[-1] + ladder[-1] // 2)
    rungs = F.array(*map(F.lit, ladder))
    short = beginnings.where("length(word) > 0").withColumn("k", F.array_max(F.filter(rungs, lambda k: k <= F.length("word")))).select(F.col("word").alias("begin"), "k", F.expr("substring(word, 1, k)").alias("head"))
    offered = words.select("word", "n", F.explode(F.filter(rungs, lambda k: k < F.length("word"))).alias("k")).withColumn("head", F.expr("substring(word, 1, k)"))
    met = offered.join(short, ["k", "head"]).where((F.length("word") > F.length("begin")) & F.startswith("word", "begin"))
    return met.groupBy(F.col("begin").alias("word")).agg(F.sum("n").alias("longer"))


def truncated(runs: DataFrame) -> DataFrame:
    """(run_id, item_id, model, adapter, cut, odds, limit) for every key of runs."""
    m = _measured(runs)
    limits = censoring_limits(m.where("not blank"))
    at = m
    odds = []
    for unit in ("chars", "bytes", "tokens"):
        some = limits.where(F.col("unit") == unit).groupBy("model", "adapter", F.col("value").alias(unit)).agg(F.max("odds").alias(f"odds_{unit}"), F.max("limit").alias(f"limit_{unit}"))
        at = at.join(some.withColumn(unit, F.col(unit).cast("int")), ["model", "adapter", unit], "left")
        odds.append(F.coalesce(f"odds_{unit}", F.lit(0.0)))
    prior = F.log(F.greatest(*odds, F.lit(BASE_ODDS)))
    at = at.withColumn("word", _bare(F.get("tokens_of", F.size("tokens_of") - 1))).drop("tokens_of").join(word_evidence(m), "word", "left")
    marked = F.col("closes") & ~F.col("signed")
    plain = prior + F.when(marked, F.log(F.lit(MARK))).otherwise(F.log(F.lit(NO_MARK)) + F.coalesce("ending", F.lit(0.0))) + F.when(F.col("open_quote") & ~marked, F.log(F.lit(OPEN_QUOTE))).otherwise(0.0)
    logit = (
        F.when(F.col("blank"), F.lit(-50.0))
        .when(F.col("half"), F.lit(50.0))
        .when(F.col("wrapped"), F.when(F.col("closed"), F.lit(-50.0)).otherwise(F.lit(50.0)))
        .otherwise(plain)
    )
    limit = F.coalesce(*(f"limit_{u}" for u in ("chars", "bytes", "tokens")))
    return at.select("run_id", "item_id", "model", "adapter", (logit > 0).alias("cut"), logit.alias("odds"), limit.alias("limit"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "run_rows")).where("cut").select("run_id", "item_id")


@query("p7_share")
def p7_share(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates; rows without a translation count among its rows."""
    return truncated(table(spark, d, "run_rows")).groupBy("model", "adapter").agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("long")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"))

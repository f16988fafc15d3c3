"""Problem 5: one verdict per item from labellers who disagree.

Model: a label is truthful with the labeller's competence, else drawn from the labeller's own guess distribution;
expectation-maximisation estimates both and the posterior of each item's verdict. The labels stay partitioned by
item through all iterations (window sums, no shuffle of the labels for the E-step); each iteration shuffles one
partial sum per labeller and partition, and the parameters, one row per labeller and label, go to a checkpoint,
never to the driver. Rounds end when no competence moves by more than CONVERGED. The prior is the mean posterior of
the items, so an item of many labels weighs no more than another. Agreement is the share of agreeing pairs of an
item's labels, and its excess over what the labellers' own rates of yes would give by chance.

A labeller's latest usable label of an item counts; a label of no known spelling isn't usable. The two sittings of
consensus_rows are two labellers. Defined results: an item without any usable label gets the verdict of the prior
and agreement null; repeated rows count once; ties in time go to the label with the higher confidence, then to
'N'; a labeller of none but unusable labels isn't listed; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

#: Most rounds of expectation-maximisation, change of a competence that ends them, and the Dirichlet and beta counts that smooth its parameters.
ROUNDS, CONVERGED, GUESS_COUNT, COMPETENCE_COUNTS = 30, 0.01, 0.5, (2.0, 1.0)
#: Spellings of the two labels, after trimming and lower-casing.
YES, NO = ("y", "yes", "true", "1"), ("n", "no", "false", "0")


def usable(label: Column) -> Column:
    """'Y', 'N' or null."""
    word = F.lower(F.trim(label))
    return F.when(word.isin(*YES), "Y").when(word.isin(*NO), "N")


def latest_labels(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """(item, labeller, label): each labeller's latest usable label of each item of rows."""
    sittings = F.array(
        F.struct(F.lit("sitting:first").alias("labeller"), F.col("first_publishable").alias("label"), F.col("first_confidence").alias("confidence")),
        F.struct(F.lit("sitting:second").alias("labeller"), F.col("second_publishable").alias("label"), F.col("second_confidence").alias("confidence")),
    )
    a = rows.select(F.col("row_id").alias("item"), F.explode(sittings).alias("s")).select("item", "s.labeller", "s.label", "s.confidence", F.lit(None).cast("timestamp").alias("at"))
    b = annotations.select(F.col("row_id").alias("item"), F.col("annotator_id").alias("labeller"), F.col("publishable").alias("label"), "confidence", F.col("labelled_at").alias("at"))
    both = a.unionByName(b).withColumn("label", usable(F.col("label"))).where("item is not null and labeller is not null and label is not null")
    sure = F.when(F.lower("confidence") == "high", 3).when(F.lower("confidence") == "medium", 2).when(F.lower("confidence") == "low", 1).otherwise(0)
    newest = F.max(F.struct(F.coalesce(F.col("at"), F.timestamp_seconds(F.lit(0))), sure, F.when(F.col("label") == "N", 1).otherwise(0), F.struct("label"))).alias("m")
    latest = both.groupBy("item", "labeller").agg(newest).select("item", "labeller", F.col("m").getField("col4").getField("label").alias("label"))
    return latest.join(rows.select(F.col("row_id").alias("item")).distinct(), "item", "left_semi")


def fit(labels: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Posteriors (item, p, n, agreement) and labellers (labeller, n, competence, guess_yes) of labels(item, labeller, label)."""
    by_item = Window.partitionBy("item")
    held = labels.select("item", "labeller", (F.col("label") == "Y").alias("yes")).repartition("item").withColumn("labels", F.count("*").over(by_item)).persist()
    first = F.avg(F.col("yes").cast("double")).over(by_item)
    params: DataFrame | None = None
    scored = held.withColumn("p", F.least(F.greatest(first, F.lit(0.05)), F.lit(0.95)))
    for _ in range(rounds):
        if params is not None:
            scored = _posterior(held, params)
        # responsibility of truthfulness for this label, given the item's verdict
        competence, guess = (F.coalesce(c, F.lit(v)) for c, v in ((F.col("competence"), 0.7), (F.col("guess"), 0.5))) if params is not None else (F.lit(0.7), F.lit(0.5))
        agrees = F.when(F.col("yes"), F.col("p")).otherwise(1 - F.col("p"))
        drawn = F.when(F.col("yes"), guess).otherwise(1 - guess)
        truthful = agrees * competence / (competence + (1 - competence) * drawn)
        # each item's posterior is shared out among its labels, so that it counts once
        sums = scored.select("labeller", "yes", truthful.alias("t"), (F.col("p") / F.col("labels")).alias("part"), (1 / F.col("labels")).alias("whole")).groupBy("labeller").agg(
            F.count("*").alias("n"), F.sum("t").alias("t"), F.sum(F.when(F.col("yes"), 1 - F.col("t")).otherwise(0.0)).alias("g_yes"), F.sum(1 - F.col("t")).alias("g"), F.sum("part").alias("part"), F.sum("whole").alias("whole"),
            F.avg(F.col("yes").cast("double")).alias("rate"),
        )
        a, b = COMPETENCE_COUNTS
        every = Window.partitionBy()
        last, params = params, cut_lineage(sums.select(
            "labeller", "n", "rate", ((F.col("t") + a - 1 + 0.5) / (F.col("n") + a + b - 2 + 1)).alias("competence"),
            ((F.col("g_yes") + GUESS_COUNT) / (F.col("g") + 2 * GUESS_COUNT)).alias("guess"),
            (F.sum("part").over(every) / F.sum("whole").over(every)).alias("prior"),
        ))
        if last is not None and params.join(last.select("labeller", F.col("competence").alias("before")), "labeller").where(F.abs(F.col("competence") - F.col("before")) > CONVERGED).isEmpty():
            break
    final = _posterior(held, params)
    yes, rate = F.col("yes").cast("double"), F.col("rate")
    items = final.groupBy("item").agg(F.max("p").alias("p"), F.count("*").alias("n"), F.sum(yes).alias("k"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr"))
    n, k, r = F.col("n"), F.col("k"), F.col("r")
    pairs = n * (n - 1)
    agreement = F.when(n > 1, (k * (k - 1) + (n - k) * (n - k - 1)) / pairs)
    # pairs of different labellers that both say yes, or both no, if each says it at its own rate
    both, neither = r * r - F.col("rr"), (n - r) * (n - r) - (n - 2 * r + F.col("rr"))
    chance = F.when(n > 1, (both + neither) / pairs)
    items = items.select("item", "p", "n", agreement.alias("agreement"), F.when(chance < 1, (agreement - chance) / (1 - chance)).alias("beyond_chance"))
    return items, params.select("labeller", "n", "competence", F.col("guess").alias("guess_yes"), "prior")


def _posterior(held: DataFrame, params: DataFrame) -> DataFrame:
    """held with the labellers' parameters and p, the posterior that the item's verdict is yes."""
    joined = held.join(params.drop("n"), "labeller")
    drawn = F.when(F.col("yes"), F.col("guess")).otherwise(1 - F.col("guess"))
    hit, miss = F.log(F.col("competence") + (1 - F.col("competence")) * drawn + 1e-9), F.log((1 - F.col("competence")) * drawn + 1e-9)
    # the labels are partitioned by item; a broadcast join with the small parameters keeps that
    odds = F.sum(F.when(F.col("yes"), hit - miss).otherwise(miss - hit)).over(Window.partitionBy("item")) + F.log(F.col("prior") / (1 - F.col("prior")))
    return joined.withColumn("p", 1 / (1 + F.exp(-odds)))


def consensus(rows: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    items, labellers = fit(latest_labels(rows, annotations))
    prior = labellers.agg(F.coalesce(F.max("prior"), F.lit(0.5)).alias("prior")).withColumn("one", F.lit(1))
    every = rows.where("row_id is not null").select(F.col("row_id").alias("item")).distinct().join(items, "item", "left").withColumn("one", F.lit(1)).join(prior, "one")
    verdict = F.when(F.coalesce("p", "prior") >= 0.5, "Y").otherwise("N")
    out = every.select(F.col("item").alias("row_id"), verdict.alias("publishable"), F.coalesce("p", "prior").alias("probability"), F.coalesce("n", F.lit(0)).alias("labels"), "agreement", "beyond_chance")
    return out, labellers.drop("prior")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "consensus_rows"), table(spark, d, "annotations")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus(*_tables(spark, d))[0].select("row_id", "publishable")


@query("p5_agreement")
def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus(*_tables(spark, d))[0]


@query("p5_reliability")
def p5_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus(*_tables(spark, d))[1]

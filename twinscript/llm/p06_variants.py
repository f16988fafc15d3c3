"""Problem 6: spellings of one person's name.

Noisy-channel attribution. Each distinct spelling is parsed into family, given name, father, by-name, death year
and initials, in one romanisation. Spellings with family and given name propose persons, the canonical forms; a
person's prior is the number of its rows. Every spelling goes to the person of highest posterior: the prior times the
likelihood of a typing error, times that of the abbreviation and of the parts that agree. A full spelling is either
its own person's or a typing error of a more frequent one that nothing contradicts; a chain of such errors is followed
to its end. Abbreviated spellings (an initial, a father's name, a family name alone, Arabic script) are compared with
all persons that nothing in the spelling contradicts; below LEAST_POSTERIOR a spelling stays by itself. The likelihoods
are fitted to the spellings: how many rows hold typing errors, how often names at one error are different persons' (by
those whose further parts contradict each other), and how often a further part agrees by chance. All steps join
distinct parsed spellings by equality (a typing error by a shared deletion), so that no family is gathered into one task.

Defined results: null, empty and placeholder names name no one; a spelling that parses to no family is left out;
repeated rows count for the prior only; ties go to the person first in code-point order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.llm._names import author_parts, deletions, one_edit, translator_parts
from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

#: Least posterior of an attribution, and least length of a word with a typing error.
LEAST_POSTERIOR, LEAST_LETTERS = 0.6, 5


def _same_or_missing(a: str, b: str):
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))


def _near_or_missing(a: str, b: str):
    return F.col(a).isNull() | F.col(b).isNull() | (F.levenshtein(F.col(a), F.col(b)) <= 2)


def parsed(rows: DataFrame) -> DataFrame:
    """(role, name, n, parts...) of rows(role, name): the distinct spellings that name someone."""
    counted = rows.where("name is not null").groupBy("role", "name").agg(F.count("*").alias("n"))
    a = counted.where("role = 'author'").withColumn("p", author_parts("name"))
    t = counted.where("role <> 'author'").withColumn("p", translator_parts("name"))
    return a.unionByName(t).select("role", "name", "n", "p.*").where("family is not null and bones is not null and length(bones) > 0")


def persons(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(role, family, given, person, posterior, n, forms, father, kunya, death, bones, given_bones, father_bones): canonical forms and their variants by a typing error, and the fitted likelihoods (role, typo, apart).

    person is the key of the canonical form a row is attributed to, posterior that of its first step.
    """
    full = spellings.where("given is not null and not startswith(family, '؟')")
    p = full.groupBy("role", "family", "given").agg(
        F.sum("n").alias("n"), F.count("*").alias("forms"), F.mode("father").alias("father"), F.mode("kunya").alias("kunya"), F.mode("death").alias("death"),
        F.first("bones").alias("bones"), F.first("given_bones").alias("given_bones"), F.mode("father_bones").alias("father_bones"),
    )
    p = cut_lineage(p.withColumn("key", F.concat_ws("|", "family", "given")).withColumn("weight", F.col("forms") + F.log1p(F.col("n"))))
    a, b = p.select([F.col(c).alias(f"a_{c}") for c in p.columns]), p.select([F.col(c).alias(f"b_{c}") for c in p.columns])

    def near(same: str, other: str) -> DataFrame:
        x = a.where(F.length(f"a_{other}") >= LEAST_LETTERS).withColumn("cut", F.explode(deletions(f"a_{other}")))
        y = b.where(F.length(f"b_{other}") >= LEAST_LETTERS).withColumn("cut", F.explode(deletions(f"b_{other}")))
        on = (F.col("a_role") == F.col("b_role")) & (F.col(f"a_{same}") == F.col(f"b_{same}")) & (F.col("cut") == F.col("cut2"))
        return x.join(y.withColumnRenamed("cut", "cut2"), on).where(F.col("a_key") != F.col("b_key")).where(one_edit(f"a_{other}", f"b_{other}")).drop("cut", "cut2").distinct()

    pairs = near("given", "family").unionByName(near("family", "given"))
    fits = _same_or_missing("a_death", "b_death") & F.when(F.col("a_role") == "author", _near_or_missing("a_father", "b_father") & _near_or_missing("a_kunya", "b_kunya")).otherwise(_same_or_missing("a_father", "b_father"))
    told = F.lit(False)
    for c in ("death", "father", "kunya"):
        told |= F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull()
    stronger = (F.col("b_weight") > F.col("a_weight")) | ((F.col("b_weight") == F.col("a_weight")) & (F.col("b_key") < F.col("a_key")))
    pairs = cut_lineage(pairs.withColumns({"fits": F.coalesce(fits, F.lit(False)), "told": told}).where(stronger).select(F.col("a_role").alias("role"), F.col("a_key").alias("key"), "a_n", "b_key", "b_n", "b_weight", "fits", "told"))
    rates = _rates(p, pairs)
    # a typing error of the other, or another person who happens to be spelt so
    error, other = F.col("b_n") * F.col("typo"), F.col("a_n") * (1 - F.col("typo")) * F.col("apart")
    best = pairs.where("fits").join(F.broadcast(rates), "role").withColumn("posterior", error / (error + other)).where(F.col("posterior") >= LEAST_POSTERIOR)
    best = cut_lineage(best.groupBy("role", "key").agg(F.max_by(F.struct(F.col("b_key").alias("next"), "posterior"), F.struct("b_weight", "b_key")).alias("b")).select("role", "key", "b.*"))
    while True:  # each round doubles the steps until every chain has reached its end; weights grow along it, so it has no cycle
        step = best.select("role", F.col("key").alias("next"), F.col("next").alias("after"))
        best = cut_lineage(best.join(step, ["role", "next"], "left").select("role", "key", "posterior", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moved")))
        if best.where("moved").isEmpty():
            break
        best = best.drop("moved")
    best = best.drop("moved")
    p = p.join(best, ["role", "key"], "left").withColumn("person", F.coalesce("next", "key")).withColumn("posterior", F.coalesce("posterior", F.lit(1.0))).drop("next", "key")
    return cut_lineage(p), rates


def _rates(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(role, typo, apart): one row for each role. typo is the share of rows whose spelling is one error from a stronger one that fits; apart that of such pairs which their further parts, where both have some, show to be two persons."""
    errors = pairs.where("fits").groupBy("role", "key").agg(F.max("a_n").alias("n")).groupBy("role").agg(F.sum("n").alias("errors"))
    apart = pairs.where("told").groupBy("role").agg(F.count_if(~F.col("fits")).alias("two"), F.count("*").alias("told"))
    every = forms.groupBy("role").agg(F.sum("n").alias("all")).join(errors, "role", "left").join(apart, "role", "left").na.fill(0)
    return cut_lineage(every.select("role", ((F.col("errors") + 1) / (F.col("all") + 2)).alias("typo"), ((F.col("two") + 1) / (F.col("told") + 2)).alias("apart")))


def _by_chance(whole: DataFrame) -> DataFrame:
    """(role, chance_father, chance_kunya, chance_death): how likely two persons have the same of a further part."""
    out = whole.select("role").distinct()
    for c in ("father", "kunya", "death"):
        values = whole.where(F.col(f"p_{c}").isNotNull()).groupBy("role", f"p_{c}").agg(F.count("*").alias("k"))
        n = F.sum("k")
        out = out.join(values.groupBy("role").agg(((F.sum(F.col("k") * F.col("k")) + 1) / (n * n + 2)).alias(f"chance_{c}")), "role", "left")
    return out.na.fill(1.0)


def attributions(spellings: DataFrame) -> DataFrame:
    """(role, name, person, posterior) of every parsed spelling; person is unique within the role."""
    s = cut_lineage(spellings)
    p, rates = persons(s)
    full = s.where("given is not null and not startswith(family, '؟')").join(p.select("role", "family", "given", "person", "posterior"), ["role", "family", "given"]).select("role", "name", "person", "posterior")
    whole = p.groupBy("role", "person").agg(
        F.sum("n").alias("p_n"), F.max_by("father", "n").alias("p_father"), F.max_by("kunya", "n").alias("p_kunya"), F.max_by("death", "n").alias("p_death"),
        F.max_by("family", "weight").alias("p_family"), F.max_by("given", "weight").alias("p_given"), F.max_by("bones", "weight").alias("p_bones"),
        F.max_by("given_bones", "weight").alias("p_given_bones"), F.max_by("father_bones", "weight").alias("p_father_bones"),
    )
    whole = cut_lineage(whole)
    part = s.where("given is null or startswith(family, '؟')")
    # an initial is part of the key where the spelling has one, so a common family name meets few persons
    sides = p.select("role", "family", F.substring("given", 1, 1).alias("initial"), "person").distinct()
    sides = cut_lineage(sides.unionByName(sides.withColumn("initial", F.lit("")).distinct()))
    part = part.withColumn("initial", F.coalesce("initials", F.lit("")))
    exact = part.join(sides, ["role", "family", "initial"]).withColumn("error", F.lit(False))
    cut = part.where(F.length("family") >= LEAST_LETTERS).withColumn("cut", F.explode(deletions("family")))
    other = sides.where(F.length("family") >= LEAST_LETTERS).select("role", "initial", F.col("family").alias("f2"), "person", F.explode(deletions("family")).alias("cut"))
    typed = cut.join(other, ["role", "initial", "cut"]).where(F.col("family") != F.col("f2")).where(one_edit("family", "f2")).drop("cut", "f2").distinct().withColumn("error", F.lit(True))
    arabic = part.where("startswith(family, '؟')").join(whole.select("role", F.col("p_bones").alias("bones"), F.col("p_given_bones").alias("given_bones"), "person"), ["role", "bones", "given_bones"]).withColumn("error", F.lit(False))
    columns = ["role", "name", "given_bones", "father", "father_bones", "kunya", "death", "initials", "person", "error"]
    candidates = exact.select(columns).unionByName(typed.select(columns)).unionByName(arabic.select(columns)).join(whole, ["role", "person"])
    agrees = (
        (F.col("initials").isNull() | F.col("p_given").startswith(F.col("initials")))
        & F.when(F.col("role") == "author", _near_or_missing("father", "p_father") & _same_or_missing("father_bones", "p_father_bones")).otherwise(_same_or_missing("father", "p_father"))
        & _near_or_missing("kunya", "p_kunya")
        & _same_or_missing("death", "p_death")
    )
    # what agrees though it could differ speaks for the person, the more so the less likely it is by chance
    sure = lambda c: F.when(F.col(c).isNotNull() & F.col(f"p_{c}").isNotNull(), 1 / F.col(f"chance_{c}")).otherwise(1.0)
    candidates = candidates.join(F.broadcast(rates.join(_by_chance(whole), "role")), "role")
    score = F.col("p_n") * F.when(F.col("error"), F.col("typo")).otherwise(1 - F.col("typo")) * sure("father") * sure("kunya") * sure("death")
    scored = candidates.where(agrees).groupBy("role", "name", "person").agg(F.max(score).alias("score"))
    w = Window.partitionBy("role", "name")
    ranked = scored.withColumn("posterior", F.col("score") / F.sum("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "person")))
    attached = ranked.where(F.col("rank") == 1).where(F.col("posterior") >= LEAST_POSTERIOR).select("role", "name", "person", "posterior")
    alone = part.drop("initial").join(attached, ["role", "name"], "left_anti")
    # what is left names persons without a full form: by family and what else is known; a family name alone goes to the only such person
    rest = F.coalesce("initials", "given_bones", F.lit("")), F.coalesce("father_bones", "father", F.lit("")), F.coalesce("kunya", F.lit(""))
    alone = alone.withColumn("rest", F.concat_ws("|", *rest)).withColumn("bare", F.col("rest") == "||")
    others = alone.where("not bare").groupBy("role", "family").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    known = F.when(F.col("bare") & (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("rest"))
    own = alone.join(others, ["role", "family"], "left").select("role", "name", F.concat_ws("|", F.lit("?"), "family", known).alias("person"), F.lit(1.0).alias("posterior"))
    return full.unionByName(attached).unionByName(own)


def variant_pairs(rows: DataFrame) -> DataFrame:
    """(role, name_a, name_b) of rows(role, name): spellings of one person."""
    a = cut_lineage(attributions(parsed(rows)).select("role", "name", "person"))
    b = a.select("role", "person", F.col("name").alias("name_b"))
    return a.withColumnRenamed("name", "name_a").join(b, ["role", "person"]).where("name_a < name_b").select("role", "name_a", "name_b").distinct()


def name_rows(translations: DataFrame) -> DataFrame:
    roles = F.explode(F.array(F.struct(F.lit("author").alias("role"), F.col("author").alias("name")), F.struct(F.lit("translator").alias("role"), F.col("translator").alias("name"))))
    return translations.select(roles.alias("r")).select("r.role", "r.name")


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(name_rows(table(spark, d, "translations", "author", "translator")))


@query("p6_attributions")
def p6_attributions(spark: SparkSession, d: str) -> DataFrame:
    return attributions(parsed(name_rows(table(spark, d, "translations", "author", "translator"))))

"""Catalogue of works and editions: resolving, joining by rule and by token, quarantine, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t


def resolve_source(row_claim: Column, evidence: Column) -> Column:
    """A work's library: the stated claim, else the field of the evidence document."""
    return F.coalesce(F.when(F.trim(row_claim) != "", row_claim), F.get_json_object(evidence, "$.source_lib"))


def death_from_uri(uri: Column | str) -> Column:
    """The year of death (hijri) that a work's uri begins with."""
    found = F.regexp_extract(F.col(uri) if isinstance(uri, str) else uri, "^([0-9]{1,4})", 1)
    return F.when(found != "", found.cast("int"))


def year(c: Column | str) -> Column:
    """The first year of 1700 to 2099 in free text."""
    found = F.regexp_extract(c if isinstance(c, Column) else F.col(c), "(1[789][0-9]{2}|20[0-9]{2})", 1)
    return F.when(found != "", found.cast("int"))


def joinable_works(works: DataFrame, modern: int = 1350) -> DataFrame:
    """Works but those whose author died in or after that year (hijri); a uri without a year stays."""
    year = death_from_uri(F.regexp_extract("uri", "([^/]*)$", 1))
    return works.where(F.col("uri").isNotNull() & (year.isNull() | (year < modern)))


def token_index(works: DataFrame) -> DataFrame:
    """(uri, token): distinct tokens of uri, author and title."""
    tokens = F.array_distinct(F.concat(t.uri_tokens("uri"), t.title_tokens("author"), t.title_tokens("title")))
    return works.where("uri is not null").select("uri", F.explode(tokens).alias("token")).distinct()


def token_join(hits: DataFrame, index: DataFrame, least: float = 0.5, rare: int = 2) -> DataFrame:
    """(id, uri, score): the work whose tokens weigh most among those of hits(id, title, authors), if it is near enough; ties to the first uri.

    A token weighs one part of the works it occurs in. The best work must share a token of at most so many works and
    reach the least score. Only a hit with such a rare token can be joined, and only a work that weighs more than the
    rare one's least weight can outbid it: of a hit's tokens, from the commonest on, those that together weigh no more
    can't seed such a work by themselves. So works are looked up by the other tokens only, each of which is in few
    works, and the result is that of comparing every hit with every work.
    """
    weights = index.groupBy("token").agg(F.count("*").alias("df")).withColumn("weight", 1 / F.col("df"))
    tokens = hits.select("id", F.explode(F.array_union(t.title_tokens("title"), t.title_tokens("authors"))).alias("token")).distinct().join(weights, "token")
    each = Window.partitionBy("id")
    below = F.sum("weight").over(each.orderBy("weight", "token"))
    sure = tokens.withColumn("rarest", F.min("df").over(each)).where(F.col("rarest") <= rare).withColumn("below", below)
    seeds = sure.where((F.col("below") > F.least(F.lit(least), F.lit(1 / rare)) - 1e-9) | (F.col("df") <= rare)).join(index, "token").select("id", "uri").distinct()
    scored = seeds.join(sure.select("id", "token", "weight", "df"), "id").join(index, ["uri", "token"]).groupBy("id", "uri").agg(F.round(F.sum("weight"), 9).alias("score"), F.count_if(F.col("df") <= rare).alias("rare"))
    best = scored.groupBy("id").agg(F.min_by(F.struct("uri", "score", "rare"), F.struct(-F.col("score"), "uri")).alias("b")).select("id", "b.*")
    return best.where((F.col("rare") >= 1) & (F.col("score") >= least)).select("id", "uri", "score")


def join_hits(hits: DataFrame, works: DataFrame, rules: list[tuple[tuple[str, ...], str]], *columns: str) -> DataFrame:
    """(id, uri, reason): the work of the first alias rule that a hit's columns meet and the works hold, else that of its tokens; hits without either are left out."""
    named = alias_join(hits, rules, F.concat_ws(" ", *columns)).where("alias_uri is not null").select("id", F.col("alias_uri").alias("uri"))
    by_alias = named.join(works.select("uri").distinct(), "uri", "left_semi").select("id", "uri", F.lit("alias").alias("reason"))
    rest = hits.join(by_alias, "id", "left_anti")
    return by_alias.unionByName(token_join(rest, token_index(joinable_works(works))).select("id", "uri", F.lit("tokens").alias("reason")))


def alias_join(hits: DataFrame, rules: list[tuple[tuple[str, ...], str]], blob: Column) -> DataFrame:
    """hits with uri of the first rule all of whose phrases occur in the blob as whole words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(blob), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    uri = F.coalesce(*(F.when(_all(padded, needles), F.lit(to)) for needles, to in rules), F.lit(None).cast("string"))
    return hits.withColumn("alias_uri", uri)


def _all(padded: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in needles:
        out = out & F.contains(padded, F.lit(f" {n.lower()} "))
    return out


def unmatched(hits: DataFrame, joined: DataFrame) -> DataFrame:
    return hits.join(joined.select("id"), "id", "left_anti")


def quarantine(rows: DataFrame, where: Column) -> DataFrame:
    """rows with usage_policy set to quarantine and visibility to private where the predicate holds."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumn("usage_policy", F.when(hit, "quarantine").otherwise(F.col("usage_policy"))).withColumn("visibility", F.when(hit, "private").otherwise(F.col("visibility")))


def mark_duplicates(rows: DataFrame, trusted: Column, key: str = "openiti_uri") -> DataFrame:
    """rows with duplicate: another, trusted row has the same key."""
    keys = rows.where(trusted).select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return rows.join(keys, key, "left").withColumn("duplicate", F.coalesce("_known", F.lit(False)) & ~F.coalesce(trusted, F.lit(False))).drop("_known")


def coalesce_update(rows: DataFrame, news: DataFrame, key: str, column: str) -> DataFrame:
    """rows with blank values of the column taken from news(key, column)."""
    n = news.select(key, F.col(column).alias("_new"))
    return rows.join(n, key, "left").withColumn(column, F.coalesce(F.when(F.trim(column) != "", F.col(column)), F.col("_new"))).drop("_new")


def review_queue(rows: DataFrame, where: Column) -> DataFrame:
    """(openiti_uri, n, ids) of the rows under review."""
    return rows.where(where).groupBy("openiti_uri").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def title_page_ok(text: Column, needles: list[str], reject: list[str], window: int = 80_000) -> Column:
    """Whether the first characters, a window as wide as a title page may take, hold all needles and nothing to reject."""
    head = t.fold(F.substring(text, 1, window))
    ok = F.lit(True)
    for n in needles:
        ok = ok & F.contains(head, F.lit(n.lower()))
    for n in reject:
        ok = ok & ~F.contains(head, F.lit(n.lower()))
    return F.coalesce(ok, F.lit(False))


def keyword_hits(rows: DataFrame, keywords: list[str], *columns: str) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", *columns))
    return rows.where(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(blob, k)))


def edition_statistics(rows: DataFrame, works: DataFrame) -> DataFrame:
    """One row: editions, works, joined editions, distinct works joined, by policy."""
    known = works.select(F.col("uri").alias("openiti_uri")).distinct().withColumn("_known", F.lit(True))
    r = rows.join(known, "openiti_uri", "left")
    return r.agg(
        F.count("*").alias("editions"), F.count_if(F.col("openiti_uri").isNotNull()).alias("with_uri"), F.count_if(F.col("_known")).alias("joined"), F.count_distinct(F.when(F.col("_known"), F.col("openiti_uri"))).alias("works_joined"),
        F.count_if(F.col("usage_policy") == "train_ok").alias("train_ok"), F.count_if(F.col("visibility") == "public").alias("public"),
    )

"""Queries over works and editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions import text
from twinscript.operators import catalog
from twinscript.queries import register
from twinscript.sources.tables import table

_WORKS = "(select uri, any_value(priority_rank) as priority_rank, max(author) as author, max(title) as title, max(source_lib_claim) as source_lib_claim, max(meta_found) as meta_found from works where uri is not null group by uri)"


def _works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "works").where("uri is not null").groupBy("uri").agg(F.first("priority_rank").alias("priority_rank"), F.max("author").alias("author"), F.max("title").alias("title"), F.max("source_lib_claim").alias("source_lib_claim"), F.max("meta_found").alias("meta_found"))


@register("resolver_coverage", f"select count(*) as n, count(source_lib_claim) as resolved, round(count(source_lib_claim)::double / count(*), 6) as coverage, count(*) filter (meta_found = 1) as with_meta from {_WORKS}")
def resolver_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _works(spark, d).agg(F.count("*").alias("n"), F.count("source_lib_claim").alias("resolved"), F.round(F.count("source_lib_claim") / F.count("*"), 6).alias("coverage"), F.count_if(F.col("meta_found") == 1).alias("with_meta"))


@register("lib_distribution", "select source_lib_claim, count(*) as n from works group by 1")
def lib_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "works", "source_lib_claim").groupBy("source_lib_claim").agg(F.count("*").alias("n"))


@register("uri_death_years", "select uri, cast(nullif(regexp_extract(uri, '^([0-9]{1,4})', 1), '') as integer) as death from (select distinct uri from works)")
def uri_death_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "works", "uri").distinct().select("uri", catalog.death_from_uri("uri").alias("death"))


_CAMEL = "array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_extract({}, '([^/]*)$', 1), '^[0-9]+', ''), '[A-Z]?[a-z]+|[A-Z]+'), lambda x: lower(x)), ' ')"
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_TOKENS)


def _tokens(c: str) -> str:
    plain = f"trim(regexp_replace(lower(regexp_replace(translate(coalesce({c}, ''), '{text.ACCENTED}', '{text.BASE}'), '[\\p{{M}}ʿʾ]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_distinct(list_filter(string_split({plain}, ' '), lambda x: length(x) >= 3 and x not in ({_STOPS})))"


@register("uri_tokens", f"select uri, unnest({_tokens(_CAMEL.format('uri'))}) as token from (select distinct uri from works)")
def uri_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "works", "uri").distinct().select("uri", F.explode(text.uri_tokens("uri")).alias("token"))


@register("publication_years", "select id, cast(nullif(regexp_extract(publication_year, '(1[789][0-9]{2}|20[0-9]{2})', 1), '') as integer) as year from translations")
def publication_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations", "id", "publication_year").select("id", catalog.year("publication_year").alias("year"))


@register("edition_statistics", "select count(*) as editions, count(t.openiti_uri) as with_uri, count(w.uri) as joined, count(distinct w.uri) as works_joined, count(*) filter (usage_policy = 'train_ok') as train_ok, count(*) filter (visibility = 'public') as public from translations t left join (select distinct uri from works) w on t.openiti_uri = w.uri")
def edition_statistics(spark: SparkSession, d: str) -> DataFrame:
    return catalog.edition_statistics(table(spark, d, "translations", "openiti_uri", "usage_policy", "visibility"), table(spark, d, "works", "uri"))


@register("policy_counts", "select usage_policy, source, count(*) as n from translations group by rollup (usage_policy, source)")
def policy_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations", "usage_policy", "source").rollup("usage_policy", "source").agg(F.count("*").alias("n"))


@register("quarantine", "select id, case when coalesce(confidence = 'low', false) then 'quarantine' else usage_policy end as usage_policy, case when coalesce(confidence = 'low', false) then 'private' else visibility end as visibility from translations")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return catalog.quarantine(table(spark, d, "translations", "id", "usage_policy", "visibility", "confidence"), F.col("confidence") == "low").select("id", "usage_policy", "visibility")


@register("mark_duplicates", "select id, coalesce(openiti_uri in (select openiti_uri from translations where confidence = 'high' and openiti_uri is not null), false) and not coalesce(confidence = 'high', false) as duplicate from translations")
def mark_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.mark_duplicates(table(spark, d, "translations", "id", "openiti_uri", "confidence"), F.col("confidence") == "high").select("id", "duplicate")


@register("coalesce_update", "select t.id, coalesce(nullif(trim(t.translator_death_year, ' '), ''), n.y) as translator_death_year from translations t left join (select translator, max(translator_death_year) as y from translations where trim(translator_death_year, ' ') <> '' group by 1) n using (translator)")
def coalesce_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations", "id", "translator", "translator_death_year").withColumn("translator_death_year", F.trim("translator_death_year"))
    news = table(spark, d, "translations", "translator", "translator_death_year").where("trim(translator_death_year) <> ''").groupBy("translator").agg(F.max("translator_death_year").alias("translator_death_year"))
    return catalog.coalesce_update(rows, news, "translator", "translator_death_year").select("id", "translator_death_year")


@register("review_queue", "select openiti_uri, count(*) as n, list_sort(list(id)) as ids from translations where alignment_status = 'partial' and openiti_uri is not null group by 1")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return catalog.review_queue(table(spark, d, "translations", "id", "openiti_uri", "alignment_status"), (F.col("alignment_status") == "partial") & F.col("openiti_uri").isNotNull())


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations", "id", "work_english_title", "author").select("id", F.col("work_english_title").alias("title"), F.col("author").alias("authors"))


_INDEX = f"(select distinct uri, unnest(list_concat({_tokens(_CAMEL.format('uri'))}, {_tokens('author')}, {_tokens('title')})) as token from {_WORKS})"
_JOINABLE = f"(select * from {_INDEX} where coalesce(try_cast(regexp_extract(uri, '^([0-9]{{1,4}})', 1) as int), 0) < 1350)"
_SCORED = f"""with ix as (select * from {_INDEX}), df as (select token, count(*) as df from ix group by 1), tk as (select distinct id, unnest(list_concat({_tokens('work_english_title')}, {_tokens('author')})) as token from translations),
sc as (select id, uri, round(sum(1.0::double / df), 9) as score, count(*) filter (df <= 2) as rare from tk join ix using (token) join df using (token) group by 1, 2),
b as (select *, row_number() over (partition by id order by score desc, uri) as r from sc) select id, uri, score from b where r = 1 and rare >= 1 and score >= 0.5"""


@register("token_index", f"select uri, token from {_INDEX}")
def token_index(spark: SparkSession, d: str) -> DataFrame:
    return catalog.token_index(_works(spark, d))


@register("token_join", _SCORED)
def token_join(spark: SparkSession, d: str) -> DataFrame:
    return catalog.token_join(_hits(spark, d), catalog.token_index(_works(spark, d)))


@register("unmatched_hits", f"select id from translations where id not in (select id from ({_SCORED}))")
def unmatched_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    return catalog.unmatched(hits, catalog.token_join(hits, catalog.token_index(_works(spark, d)))).select("id")


_BLOB = r"' ' || regexp_replace(lower(concat_ws(' ', work_english_title, author)), '[^\p{L}\p{N}]+', ' ', 'g') || ' '"


@register("alias_join", f"select id, case when contains(b, ' gift ') and contains(b, ' symbols ') then 'gift-symbols' when contains(b, ' collected poems ') then 'poems' end as alias_uri from (select id, {_BLOB} as b from translations)")
def alias_join(spark: SparkSession, d: str) -> DataFrame:
    rules = [(("gift", "symbols"), "gift-symbols"), (("collected poems",), "poems")]
    rows = table(spark, d, "translations", "id", "work_english_title", "author")
    return catalog.alias_join(rows, rules, F.concat_ws(" ", "work_english_title", "author")).select("id", "alias_uri")


_CASCADE = _SCORED.replace(_INDEX, _JOINABLE)


@register("join_reasons", f"with a as (select t.id, w.uri from (select id, case when contains(b, ' gift ') and contains(b, ' symbols ') then (select min(uri) from works) end as uri from (select id, {_BLOB} as b from translations)) t join (select distinct uri from works) w using (uri)), k as ({_CASCADE}) select id, uri, 'alias' as reason from a union all select id, uri, 'tokens' from k where id not in (select id from a)")
def join_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Aliases first, tokens for the rest; the alias here stands for the first uri of the catalogue."""
    works = _works(spark, d)
    rules = [(("gift", "symbols"), works.agg(F.min("uri")).first()[0])]
    return catalog.join_hits(_hits(spark, d), works, rules, "title", "authors")


@register("keyword_hits", "select id from translations where contains(lower(concat_ws(' ', work_english_title, notes)), 'poems') or contains(lower(concat_ws(' ', work_english_title, notes)), 'history')")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keyword_hits(table(spark, d, "translations", "id", "work_english_title", "notes"), ["poems", "history"], "work_english_title", "notes").select("id")


@register("works_per_author", f"select author, count(*) as works, min(priority_rank) as best_rank from {_WORKS} where author is not null group by 1")
def works_per_author(spark: SparkSession, d: str) -> DataFrame:
    return _works(spark, d).where("author is not null").groupBy("author").agg(F.count("*").alias("works"), F.min("priority_rank").alias("best_rank"))


@register("editions_per_work", "select w.uri, count(t.id) as editions from (select distinct uri from works) w left join translations t on t.openiti_uri = w.uri group by 1")
def editions_per_work(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translations", "id", "openiti_uri").withColumnRenamed("openiti_uri", "uri")
    return table(spark, d, "works", "uri").distinct().join(t, "uri", "left").groupBy("uri").agg(F.count("id").alias("editions"))

"""Queries over sources as they arrive: the test tables are written out in a source's form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.operators import records
from twinscript.queries import register
from twinscript.sources import catalogs
from twinscript.sources.tables import table


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """Dump lines of the editions, with a header, a blank and a broken line."""
    rows = table(spark, d, "translations", "id", "rights_status", "work_english_title", "publication_year", "author", "source")
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]", " ")
    of = {"htid": F.col("id").cast("string"), "rights": clean("rights_status"), "title": clean("work_english_title"), "rights_date_used": clean("publication_year"), "lang": F.when(F.col("id") % 3 == 0, "eng").when(F.col("id") % 3 == 1, "ger").otherwise(""), "author": clean("author")}
    line = F.concat_ws("\t", *(of.get(f, F.lit("x")) for f in catalogs.DUMP_FIELDS))
    return rows.select(line.alias("value")).unionByName(spark.createDataFrame([("htid\taccess",), ("",), ("a\tb",)], "value string"))


_CLEAN = "regexp_replace(coalesce({}, ''), '[\\t\\r\\n]', ' ', 'g')"


@register("dump_rows", f"select cast(id as varchar) as htid, {_CLEAN.format('work_english_title')} as title, {_CLEAN.format('author')} as author from translations")
def dump_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.dump_rows(_dump(spark, d)).select("htid", "title", "author")


@register("dump_hits", f"select cast(id as varchar) as source_id, {_CLEAN.format('work_english_title')} as title, {_CLEAN.format('publication_year')} as year from translations where rights_status = 'licensed' and id % 3 <> 1 and (contains(lower({_CLEAN.format('work_english_title')}), 'gift') or contains(lower({_CLEAN.format('work_english_title')} || ' ' || {_CLEAN.format('author')}), 'abu'))")
def dump_hits(spark: SparkSession, d: str) -> DataFrame:
    found = catalogs.candidates(catalogs.dump_rows(_dump(spark, d)), ["gift", "abu"], ("licensed",))
    return catalogs.hits(found).select("source_id", "title", "year")


@register("category_hits", "select distinct uri as source_id, 'listed' as subjects from works where meta_found = 1")
def category_hits(spark: SparkSession, d: str) -> DataFrame:
    """Works as a category answer for each genre, those without metadata under another kind of page."""
    members = table(spark, d, "works", "uri", "genre", "meta_found").distinct().groupBy("genre").agg(F.collect_list(F.struct(F.when(F.col("meta_found") == 1, 0).otherwise(14).alias("ns"), F.col("uri").alias("title"))).alias("categorymembers"))
    answers = members.select(F.to_json(F.struct(F.struct("categorymembers").alias("query"))).alias("value"))
    return catalogs.category_hits(answers, "listed").select("source_id", "subjects").distinct()


@register("archive_hits", "select source_id, coalesce(work_english_title, '') as title, coalesce(author, '') as authors, substring(coalesce(publication_year, ''), 1, 4) as year from translations where source_id <> ''")
def archive_hits(spark: SparkSession, d: str) -> DataFrame:
    """Editions as one search answer for each source."""
    rows = table(spark, d, "translations", "source", "source_id", "work_english_title", "author", "publication_year")
    items = rows.groupBy("source").agg(F.collect_list(F.struct(F.col("source_id").alias("identifier"), F.col("work_english_title").alias("title"), F.col("author").alias("creator"), F.col("publication_year").alias("year"))).alias("items"))
    return catalogs.archive_hits(items.select(F.to_json(F.struct("items")).alias("value"))).select("source_id", "title", "authors", "year")


@register("latest_dump", "select source || '.txt.gz' as filename from translations where visibility = 'public' group by source order by max(id) desc, source desc limit 1")
def latest_dump(spark: SparkSession, d: str) -> DataFrame:
    """Of a list of files, one for each source, the newest full one."""
    rows = table(spark, d, "translations", "id", "source", "visibility")
    files = rows.groupBy(F.concat("source", F.lit(".txt.gz")).alias("filename"), (F.col("visibility") == "public").alias("full")).agg(F.lpad(F.max("id").cast("string"), 12, "0").alias("created"))
    return catalogs.latest_full(files).select("filename")


_RANKED = "(select uri, min(priority_rank) as rank, max(author) as author, max(title) as title, max(author_death_ah) as death, max(genre) as genre, max(meta_found) as found from works where uri is not null group by 1)"


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    works = table(spark, d, "works", "uri", "priority_rank", "author", "title", "author_death_ah", "genre", "meta_found").where("uri is not null").groupBy("uri").agg(*(F.max(c).alias(c) for c in ("author", "title", "author_death_ah", "genre", "meta_found")), F.min("priority_rank").alias("rank"))
    meta = F.to_json(F.struct(F.array("genre").alias("tags"), F.col("author").alias("author_en"), F.lit("").alias("title_en"), F.col("title").alias("title_ar"), F.col("author_death_ah").alias("death_ah"), F.concat(F.lit("https://x.example/"), "uri", F.lit(".Shamela0012345-ara1.completed")).alias("url")))
    body = F.when(F.col("meta_found") == 1, meta).otherwise("not found")
    return works.select("uri", "rank"), works.select("uri", body.alias("body"))


@register("metadata_found", f"select uri, coalesce(found = 1, false) as found from {_RANKED}")
def metadata_found(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.metadata(_documents(spark, d)[1], "uri", "body").select("uri", F.col("meta").isNotNull().alias("found"))


@register("work_rows", f"select uri, rank as priority_rank, case when found = 1 then author end as author, case when found = 1 then nullif(title, '') end as title, coalesce(try_cast(nullif(regexp_extract(uri, '^([0-9]{{4}})', 1), '') as int), case when found = 1 then death end) as author_death_ah, case when found = 1 then genre end as genre, case when found = 1 then 'Shamela' end as source_lib_claim, coalesce(found = 1, false)::int as meta_found from {_RANKED}")
def work_rows(spark: SparkSession, d: str) -> DataFrame:
    """The works table built again from ranked uris and JSON documents."""
    ranked, bodies = _documents(spark, d)
    return catalogs.work_rows(ranked, catalogs.metadata(bodies, "uri", "body")).select("uri", "priority_rank", "author", "title", "author_death_ah", "genre", "source_lib_claim", "meta_found")


@register("resolved_sources", f"select uri, case when regexp_matches(uri, '^[0-9]{{4}}') then 'uri_prefix' when found = 1 and death is not null then 'meta.death_ah' end as death_evidence, case when found = 1 then 'meta.url_tail' end as lib_evidence from {_RANKED}")
def resolved_sources(spark: SparkSession, d: str) -> DataFrame:
    ranked, bodies = _documents(spark, d)
    return catalogs.resolved(ranked.join(catalogs.metadata(bodies, "uri", "body"), "uri", "left")).select("uri", "death_evidence", "lib_evidence")


@register("document_problems", "select id, case when source_hash is not null and source_hash <> sha256(text) then 'hash' end as problem from paragraphs where language in ('ar', 'en')")
def document_problems(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs written as one JSON document for each paragraph's structure and read with its contract."""
    p = table(spark, d, "paragraphs", "id", "work_id", "language", "structure_id", "text", "source_hash", "flags").where("language in ('ar', 'en')")
    one = F.struct("id", F.lit(0).alias("sequence"), "text", "source_hash", "flags")
    document = F.struct("work_id", "language", F.array(F.struct(F.col("structure_id").alias("id"), F.lit(0).alias("sequence"), F.array(one).alias("paragraphs"))).alias("structures"))
    return catalogs.document_paragraphs(p.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))).select("id", "problem")


@register("item_ids", "select id, source || ':' || source_native_id as item_id from eval_items")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "id", "source", "source_native_id").select("id", records.item_id().alias("item_id"))

"""Catalogues and metadata as they arrive: tab-separated dumps, JSON answers, keyed JSON documents. Fetching them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions import text as t

# The fields of a full catalogue dump, in order.
DUMP_FIELDS = (
    "htid access rights ht_bib_key description source source_bib_num oclc_num isbn issn lccn title imprint rights_reason_code rights_timestamp us_gov_doc_flag rights_date_used pub_place lang bib_fmt "
    "collection_code content_provider_code responsible_entity_code digitization_agent_code access_profile_code author"
).split()
HIT_FIELDS = {"source_id": "htid", "title": "title", "authors": "author", "subjects": "imprint", "year": "rights_date_used", "language": "lang", "rights": "rights"}
ARCHIVE = "items array<struct<identifier string, title string, creator string, subject string, year string, date string, language string>>"
# Fixed value: the source library, number and version that end the name of a text's file.
SOURCE_TAIL = r"\.([A-Za-z]+?)([0-9]{2,})-([a-zA-Z0-9]+)(?:\.[A-Za-z0-9]+)?$"
CATEGORY = "query struct<categorymembers array<struct<ns int, title string>>>"
META = "tags array<string>, author_en string, author_ar string, author string, title_en string, title_ar string, title string, url string, death_ah int"


def dump_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Dump lines as DUMP_FIELDS; blank lines, the header and lines of fewer than twelve fields are left out, missing fields are empty."""
    parts = F.split(F.regexp_replace(line, r"[\r\n]+$", ""), "\t", -1)
    kept = lines.where((F.trim(line) != "") & ~F.col(line).startswith("htid")).select(parts.alias("_p")).where(F.size("_p") >= 12)
    return kept.select(*(F.coalesce(F.get("_p", F.lit(k)), F.lit("")).alias(f) for k, f in enumerate(DUMP_FIELDS)))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump, also compressed."""
    return dump_rows(spark.read.text(path))


def candidates(rows: DataFrame, keywords: list[str], rights: tuple[str, ...]) -> DataFrame:
    """Rows with one of the rights, in English or without a language, that hold a keyword in title, author or imprint."""
    english = (F.col("lang") == "") | F.array_contains(F.split(F.lower("lang"), ","), "eng")
    blob = F.lower(F.concat_ws(" ", "title", "author", "imprint"))
    named = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(blob, k)) if keywords else F.lit(False)
    return rows.where(F.lower("rights").isin(*rights) & english & named)


def hits(rows: DataFrame) -> DataFrame:
    """Catalogue hits of dump rows."""
    return rows.select(*(F.col(f).alias(to) for to, f in HIT_FIELDS.items()))


def category_hits(answers: DataFrame, subject: str, body: str = "value") -> DataFrame:
    """Hits of the pages, not of other kinds, that a category answer lists."""
    member = answers.select(F.explode(F.from_json(body, CATEGORY)["query"]["categorymembers"]).alias("m")).where("m.ns = 0 and m.title <> ''")
    blank = F.lit("")
    return member.select(F.col("m.title").alias("source_id"), F.col("m.title").alias("title"), blank.alias("authors"), F.lit(subject).alias("subjects"), blank.alias("year"), F.lit("en").alias("language"))


def archive_hits(answers: DataFrame, body: str = "value") -> DataFrame:
    """Hits of the items that a search answer lists; those without an identifier are left out."""
    item = answers.select(F.explode(F.from_json(body, ARCHIVE)["items"]).alias("i")).where("i.identifier <> ''")
    text = lambda *c: F.coalesce(*(F.col(f"i.{x}") for x in c), F.lit(""))
    return item.select(F.col("i.identifier").alias("source_id"), text("title").alias("title"), text("creator").alias("authors"), text("subject").alias("subjects"), F.substring(text("year", "date"), 1, 4).alias("year"), text("language").alias("language"))


def latest_full(files: DataFrame) -> DataFrame:
    """The one row of files(filename, full, created) that is a full dump and was created last."""
    return files.where("full").orderBy(F.desc(F.coalesce("created", "filename")), F.desc("filename")).limit(1)


def metadata(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, meta): keyed JSON documents; one that isn't an object is null."""
    return documents.select(key, F.when(F.trim(body).startswith("{"), F.from_json(body, META)).alias("meta"))


def resolved(works: DataFrame) -> DataFrame:
    """works(uri, meta) with author_death_ah and source_lib_claim and where each was read: in the uri, or the metadata; null where nowhere."""
    year = F.regexp_extract("uri", "^([0-9]{4})", 1)
    tail = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), SOURCE_TAIL, 1)
    url, own = tail(F.col("meta.url")), tail(F.col("uri"))
    return works.withColumns({
        "author_death_ah": F.when(year != "", year.cast("int")).otherwise(F.col("meta.death_ah")), "death_evidence": F.when(year != "", "uri_prefix").when(F.col("meta.death_ah").isNotNull(), "meta.death_ah"),
        "source_lib_claim": F.when(url != "", url).when(own != "", own), "lib_evidence": F.when(url != "", "meta.url_tail").when(own != "", "uri_tail"),
    })


def pick(*names: str) -> Column:
    """The first of the metadata's fields that isn't empty."""
    return F.coalesce(*(F.when(F.col(f"meta.{n}") != "", F.col(f"meta.{n}")) for n in names))


def work_rows(ranked: DataFrame, meta: DataFrame) -> DataFrame:
    """The works table of ranked(uri, rank) and metadata(uri, meta); without a tag other than null no genre, and an author given only as an empty text stays empty."""
    both = resolved(ranked.join(meta, "uri", "left"))
    genre = F.when(F.size(F.array_compact("meta.tags")) > 0, F.array_join("meta.tags", ";"))
    author = F.coalesce(pick("author_en", "author_ar", "author"), "meta.author_en", "meta.author_ar", "meta.author")
    evidence = F.to_json(F.struct(F.col("death_evidence").alias("author_death_ah"), F.col("lib_evidence").alias("source_lib_claim")), {"ignoreNullFields": "false"})
    return both.select(
        "uri", F.col("rank").alias("priority_rank"), author.alias("author"), pick("title_en", "title_ar", "title").alias("title"), "author_death_ah", genre.alias("genre"), "source_lib_claim",
        evidence.alias("source_evidence"), F.col("meta").isNotNull().cast("int").alias("meta_found"), *(F.lit("UNKNOWN").alias(c) for c in ("arabic_rights", "english_rights", "commercial_status")),
    )


DOCUMENT = "schema string, work_id string, language string, source_name string, source_hash string, structures array<struct<id:string,sequence:int,heading:string,anchor_key:string,paragraphs:array<struct<id:string,sequence:int,text:string,source_hash:string,flags:array<string>>>>>"


def document_paragraphs(documents: DataFrame, body: str = "value") -> DataFrame:
    """Paragraphs of normalised documents with problem, what breaks their contract: a language that isn't known, a hash that isn't the text's, a running number that isn't its place; null if nothing does."""
    d = documents.select(F.from_json(body, DOCUMENT).alias("d")).select("d.work_id", "d.language", F.posexplode("d.structures").alias("place", "s"))
    p = d.select("work_id", "language", F.col("s.id").alias("structure_id"), (F.col("s.sequence") != F.col("place")).alias("_moved"), F.posexplode("s.paragraphs").alias("at", "p"))
    problem = F.when(~F.col("language").isin("ar", "en"), "language").when(F.col("_moved") | (F.col("p.sequence") != F.col("at")), "sequence").when(F.col("p.source_hash").isNotNull() & (F.col("p.source_hash") != t.sha("p.text")), "hash")
    return p.select(F.col("p.id").alias("id"), "work_id", "language", "structure_id", F.col("p.sequence").alias("sequence"), F.col("p.text").alias("text"), F.col("p.source_hash").alias("source_hash"), F.col("p.flags").alias("flags"), problem.alias("problem"))

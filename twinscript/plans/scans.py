"""Queries over texts as ordered lines of scanned editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions import text as t
from twinscript.operators import documents as docs
from twinscript.operators import scans
from twinscript.plans.texts import sql_squeeze, sql_words
from twinscript.queries import register
from twinscript.sources.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return docs.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


_LINES = r"(select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line from (select doc_id, string_split_regex(text, '\r?\n') as l from documents where text is not null))"
_LETTERS = r"length(regexp_replace(x, '[^\p{L}]', '', 'g'))"
_HEAD = rf"(x <> '' and {_LETTERS} >= 3 and length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) >= 0.8 * {_LETTERS} and {sql_words('x')} <= 8)"


@register("head_lines", f"select doc_id, count(*) as n from (select doc_id, trim(line, ' ') as x from {_LINES}) where {_HEAD} group by 1")
def head_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(scans.is_head("line")).groupBy("doc_id").agg(F.count("*").alias("n"))


_PAGE = f"(x <> '' and length(x) <= 8 and (regexp_matches(x, '{scans.ROMAN}') or (regexp_matches(x, '{scans.PAGE_NUMBER}') and (regexp_matches(x, '\\d') or lower(x) in {scans.MISREAD}))))"


@register("scan_page_numbers", f"select doc_id, count(*) filter ({_PAGE}) as n, count(*) as lines from (select doc_id, trim(line, ' ') as x from {_LINES}) group by 1")
def scan_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("doc_id").agg(F.count_if(scans.is_page_number("line")).alias("n"), F.count("*").alias("lines"))


_FIRST, _LAST = (x.replace("'", "''") for x in (scans.HEAD_FIRST, scans.HEAD_LAST))
_PAGE_HEADS = f"""(select doc_id, pos, line, case when a <> '' then a when b <> '' then b end as page, case when a <> '' then regexp_extract(line, '{_FIRST}', 2) when b <> '' then regexp_extract(line, '{_LAST}', 1) end as title
from (select *, regexp_extract(line, '{_FIRST}', 1) as a, regexp_extract(line, '{_LAST}', 2) as b from {_LINES}))"""


@register("page_heads", f"select doc_id, cast(page as int) as page, trim(regexp_replace(regexp_replace(title, '{scans.YEAR}', ' ', 'g'), '[ .]+', ' ', 'g'), ' ') as title from {_PAGE_HEADS} where page is not null")
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", scans.page_head("line").alias("h")).where("h is not null").select("doc_id", "h.page", "h.title")


_CARRIED = f"(select doc_id, pos, case when page is null then line else '' end as line, last_value(cast(page as int) ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as page from {_PAGE_HEADS})"
_BLOCKS = f"(select doc_id, min(pos) as first, list(line order by pos) as lines, arg_min(page, pos) as page from (select *, sum((trim(line, ' ') = '')::int) over (partition by doc_id order by pos rows between unbounded preceding and current row) as b from {_CARRIED}) where trim(line, ' ') <> '' group by doc_id, b)"


@register("scan_blocks", f"select doc_id, row_number() over (partition by doc_id order by first) as block, len(lines) as lines, page from {_BLOCKS}")
def scan_blocks(spark: SparkSession, d: str) -> DataFrame:
    made = scans.blocks(scans.carried(_lines(spark, d), "doc_id"), "doc_id")
    return made.select("doc_id", F.col("block").cast("bigint").alias("block"), F.size("lines").cast("bigint").alias("lines"), "page")


_NOTE_START, _JOINED = scans.NOTE_START.replace("'", "''"), "array_to_string(lines, ' ')"
_NOTE = f"(len(lines) between 1 and {scans.NOTE_LINES} and {sql_words(_JOINED)} <= {scans.NOTE_WORDS} and regexp_matches(lines[1], '{_NOTE_START}') and (regexp_matches({_JOINED}, '{scans.CITATION}') or {sql_words(_JOINED)} <= {scans.BARE_NOTE_WORDS}))"


@register("scan_notes", f"select doc_id, count(*) filter ({_NOTE}) as notes, count(*) as blocks from {_BLOCKS} group by 1")
def scan_notes(spark: SparkSession, d: str) -> DataFrame:
    made = scans.blocks(scans.carried(_lines(spark, d), "doc_id"), "doc_id")
    return made.groupBy("doc_id").agg(F.count_if(scans.is_note("lines")).alias("notes"), F.count("*").alias("blocks"))


_BODY = f"(select doc_id, first, {sql_squeeze('array_to_string(lines, chr(10))')} as text, page from {_BLOCKS} where not {_NOTE})"
_ENDS = "regexp_matches(p, '[.!?][\"''”’)\\]]?$')"
_OPEN = f"(select *, sum(case when p is null or ({_ENDS} and not regexp_matches(text, '^\\p{{Ll}}')) then 1 else 0 end) over (partition by doc_id order by first rows between unbounded preceding and current row) as k from (select *, lag(text) over (partition by doc_id order by first) as p from {_BODY} where text <> ''))"


@register("scan_paragraphs", f"select doc_id, cast(k as bigint) as paragraph, string_agg(text, ' ' order by first) as text, arg_min(page, first) as page from {_OPEN} group by 1, 2")
def scan_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs over page turns, without heads and footnotes, on the page they begin on."""
    made = scans.blocks(scans.carried(_lines(spark, d), "doc_id"), "doc_id")
    return scans.joined_blocks(made, "doc_id").select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "text", "page")


_RUN_IN = r"(?s)^([^.?!]{4,70}[.?])\s+([A-Z''\"(\[].*)$"


@register("run_in_headings", f"select doc_id, trim(h, ' ') as heading from (select doc_id, regexp_extract(trim(text, ' '), '{_RUN_IN}', 1) as h, regexp_extract(trim(text, ' '), '{_RUN_IN}', 2) as r from documents) where h <> '' and {sql_words('h')} <= 8 and {sql_words('r')} >= 25 and not regexp_matches(h, '(?i):|\\b(from|said|says)\\b')")
def run_in_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", scans.run_in_heading("text")["heading"].alias("heading")).where("heading is not null")


_DASH = r":\s*[—–-]{1,2}"


@register("chain_heads", f"select id, case when regexp_matches(substring(reference_english, 1, 400), '{_DASH}') then regexp_extract(reference_english, '(?s)^(.*?){_DASH}', 1) else array_to_string(list_filter(string_split_regex(reference_english, '{t.SPACE}+'), lambda w: w <> '')[1:18], ' ') end as head from eval_items where reference_english is not null")
def chain_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "id", "reference_english").where("reference_english is not null").select("id", scans.chain_head("reference_english").alias("head"))


_SECTION = r"^\s*(\d{1,3})[.)]\s+\S.*$"
_CUT = f"(select doc_id, pos, line, regexp_matches(line, '{_SECTION}') as h, sum(regexp_matches(line, '{_SECTION}')::int) over (partition by doc_id order by pos rows between unbounded preceding and current row) as s from {_LINES})"
_SECTIONS = f"(select doc_id, cast(s as bigint) as section, max(line) filter (h) as heading, {sql_squeeze('coalesce(string_agg(line, chr(10) order by pos) filter (not h), ' + repr('') + ')')} as body from {_CUT} where s > 0 group by 1, 2)"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return scans.sections(_lines(spark, d), "doc_id", _SECTION)


@register("headed_sections", f"select doc_id, section, regexp_extract(heading, '{_SECTION}', 1) as number, body from {_SECTIONS}")
def headed_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("doc_id", "section", "number", "body")


_NUMBERED = f"(select *, sum((n = 1)::int) over (partition by doc_id order by section rows between unbounded preceding and current row) as ones from (select *, try_cast(regexp_extract(heading, '{_SECTION}', 1) as int) as n from {_SECTIONS}) where n is not null)"


@register("numbered_sections", f"select doc_id, row_number() over (partition by doc_id order by section) as section, n as number from {_NUMBERED} where ones = 1")
def numbered_sections(spark: SparkSession, d: str) -> DataFrame:
    made = scans.numbered_sections(_sections(spark, d), "doc_id")
    return made.select("doc_id", F.col("section").cast("bigint").alias("section"), F.col("number").cast("int").alias("number"))


@register("first_sections", f"select doc_id, min(section) as section, regexp_extract(heading, '{_SECTION}', 1) as number from {_SECTIONS} group by doc_id, regexp_extract(heading, '{_SECTION}', 1)")
def first_sections(spark: SparkSession, d: str) -> DataFrame:
    return scans.first_of_each(_sections(spark, d), "doc_id", "number").select("doc_id", "section", "number")


@register("margin_free_lines")
def margin_free_lines(spark: SparkSession, d: str) -> DataFrame:
    return scans.margin_numbers(_lines(spark, d), "doc_id", least=3).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_ORDINALS = ", ".join(f"('{w}', {n})" for w, n in scans.ordinals().items())


@register("ordinal_headings", f"select n_nationkey, v.number from nation join (select * from (values {_ORDINALS}) as o(word, number)) v on v.number = n_nationkey + 1")
def ordinal_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings made of each nation's number and read again."""
    words = F.create_map(*(F.lit(x) for w, n in scans.ordinals().items() for x in (n, w)))
    headed = table(spark, d, "nation", "n_nationkey").select("n_nationkey", F.concat(F.lit("The "), F.initcap(words[F.col("n_nationkey") + 1]), F.lit(" Assembly")).alias("heading"))
    return headed.select("n_nationkey", scans.english_ordinal("heading").alias("number"))


@register("spelt_years")
def spelt_years(spark: SparkSession, d: str) -> DataFrame:
    """Years spelt out in the Arabic paragraphs."""
    return table(spark, d, "paragraphs", "id", "text").select("id", scans.arabic_year("text").alias("year")).where("year is not null")


@register("year_blocks", f"select doc_id, page as year, min(k) as first, count(*) as paragraphs from (select doc_id, cast(k as bigint) as k, arg_min(page, first) as page from {_OPEN} group by 1, 2) where page is not null group by 1, 2")
def year_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs by what their page's head states; here the page number stands for the year, which these heads lack."""
    made = scans.joined_blocks(scans.blocks(scans.carried(_lines(spark, d), "doc_id").drop("year").withColumnRenamed("page", "year"), "doc_id"), "doc_id")
    return scans.year_blocks(made, "doc_id").select("doc_id", "year", F.col("first").cast("bigint").alias("first"), "paragraphs")


@register("ebook_bodies", "select doc_id, length(text) as chars from documents where text is not null")
def ebook_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each text wrapped as an ebook and taken out again."""
    wrapped = F.concat(F.lit("Licence\n*** START OF THE EBOOK X ***"), "text", F.lit("*** END OF THE EBOOK X ***\nLicence"))
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", F.length(scans.ebook_body(wrapped)).cast("bigint").alias("chars"))

"""Queries over documents, paragraphs and items: measuring, splitting, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions import inject
from twinscript.functions import text as t
from twinscript.operators import documents as docs
from twinscript.operators import sampling, segment
from twinscript.queries import register
from twinscript.sinks import require_textless
from twinscript.sources.tables import table

W = t.SPACE + "+"


def sql_words(c: str) -> str:
    return f"coalesce(len(list_filter(string_split_regex({c}, '{W}'), lambda w: w <> '')), 0)"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{W}', ' ', 'g'), ' ')"


BAND = "case when n between 20 and 80 then '20-80' when n between 100 and 250 then '100-250' when n between 250 and 600 then '250-600' end"
COUNTED = f"(select doc_id, source, lang, genre, text, {sql_words('text')} as n from documents)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "lang", "source", "genre")


@register("words_per_doc", f"select doc_id, cast(n as bigint) as n_words from {COUNTED}")
def words_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", t.word_count("text").alias("n_words"))


@register("band_counts", f"select {BAND} as band, count(*) as n_docs, cast(sum(n) as bigint) as n_words from {COUNTED} group by 1")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select(t.word_count("text").alias("n"))
    return rows.groupBy(t.length_band("n").alias("band")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"))


@register("band_by_source", f"select source, band, count(*) as n_docs from (select source, {BAND} as band from {COUNTED}) group by grouping sets ((source, band), (source), ())")
def band_by_source(spark: SparkSession, d: str) -> DataFrame:
    # counted in a step of its own: bands would count the words once for each bound
    counted = _documents(spark, d).select("source", t.word_count("text").alias("n")).groupBy("source", "n").agg(F.count("*").alias("k"))
    rows = counted.select("source", t.length_band("n").alias("band"), "k")
    return rows.groupingSets([["source", "band"], ["source"], []], "source", "band").agg(F.sum("k").alias("n_docs"))


@register("dedupe_first", "select sha256(text) as sha, arg_min(doc_id, (source, doc_id)) as doc_id from documents where text is not null group by 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "source", "text").where("text is not null")
    return sampling.first_by_hash(rows, "text", "doc_id", "source", "doc_id")


@register("duplicate_groups", "select sha256(text) as sha, count(*) as n_docs, count(distinct source) as n_sources from documents where text is not null group by 1 having count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("text is not null").groupBy(t.sha("text").alias("sha")).agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources")).where("n_docs > 1")


def sql_fold(c: str) -> str:
    return sql_squeeze(f"lower({c})")


@register("contamination_exact", f"select d.doc_id as id, e.doc_id as item_id from documents d join documents e on {sql_fold('d.text')} = {sql_fold('e.text')} where d.source <> 'hadithbase' and e.source = 'hadithbase'")
def contamination_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents that equal one of a source that is held out, but for case and white space."""
    rows = table(spark, d, "documents", "doc_id", "source", "text").where("source is not null")
    held_out = rows.where("source = 'hadithbase'").select(F.col("doc_id").alias("item_id"), "text")
    return sampling.exact_contamination(rows.where("source <> 'hadithbase'").select(F.col("doc_id").alias("id"), "text"), held_out)


@register("sentence_counts", f"select doc_id, cast(coalesce(len(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?]){W}', '\\1␞', 'g'), '␞'), lambda x: trim(x, ' ') <> '')), 0) as bigint) as n_sentences from documents")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.coalesce(F.size(t.sentences("text")), F.lit(0)).cast("bigint").alias("n_sentences"))


@register("number_mentions", "select doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[0-9]+'), lambda x: length(x) <= 18), lambda x: cast(x as bigint)))) as number from documents")
def number_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.explode(t.numbers("text")).alias("number"))


@register("blocks_words_total", f"select doc_id, cast(n as bigint) as n_words from {COUNTED} where n > 0")
def blocks_words_total(spark: SparkSession, d: str) -> DataFrame:
    """Blocks lose no word: their words add up to the text's."""
    items = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("id"), "text")
    return segment.blockify(items, "text").groupBy(F.col("parent_id").cast("bigint").alias("doc_id")).agg(F.sum(t.word_count("arabic")).alias("n_words"))


@register("block_stats")
def block_stats(spark: SparkSession, d: str) -> DataFrame:
    return segment.block_stats(segment.blockify(table(spark, d, "eval_items", "id", "arabic")))


@register("reassembled_items", f"select id as parent_id, {sql_squeeze('arabic')} as translation, cast(null as varchar) as error from eval_items where {sql_words('arabic')} > 0")
def reassembled_items(spark: SparkSession, d: str) -> DataFrame:
    blocks = segment.blockify(table(spark, d, "eval_items", "id", "arabic"))
    results = blocks.select(F.col("id").alias("item_id"), F.col("arabic").alias("translation"), F.lit(None).cast("string").alias("error"))
    return segment.reassemble(results, segment.expected_counts(blocks))


@register("paragraph_blocks", f"select doc_id, cast(i - 1 as integer) as \"at\", p[i] as paragraph from (select doc_id, p, unnest(generate_series(1, len(p))) as i from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '-[ \\t]*\\r?\\n[ \\t]*(\\p{{Ll}})', '\\1', 'g'), '\\r?\\n[ \\t]*(?:\\r?\\n[ \\t]*)+'), lambda x: {sql_squeeze('x')}), lambda x: x <> '') as p from documents where text is not null))")
def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(docs.paragraphs(docs.dehyphenate("text"))).alias("at", "paragraph"))


_HEAD_TEXT = f"trim(regexp_replace(regexp_replace(line, '^\\s*[0-9]+\\s+|\\s+[0-9]+\\s*$', '', 'g'), '{W}', ' ', 'g'), ' ')"


@register("running_heads", f"select head, count(*) as n from (select {_HEAD_TEXT} as head from (select unnest(string_split_regex(text, '\\r?\\n')) as line from documents)) where length(head) between 8 and 80 and upper(head) = head and regexp_matches(head, '\\p{{Lu}}') and {sql_words('head')} between 2 and 8 group by 1 having count(*) >= 3")
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    return docs.running_heads(docs.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), [])


@register("page_number_lines", r"select source, count(*) filter (regexp_matches(line, '^\s*[\[(]?[0-9IVXLCivxlc]{1,6}[\])]?\s*$')) as n, count(*) as lines from (select source, unnest(string_split_regex(text, '\r?\n')) as line from documents) group by 1")
def page_number_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = docs.lines(table(spark, d, "documents", "source", "text"), "source", "text")
    return rows.groupBy("source").agg(F.count_if(docs.page_number("line")).alias("n"), F.count("*").alias("lines"))


_MARKUP = r"regexp_replace(text, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _MARKUP = f"replace({_MARKUP}, '{_entity}', '{_char}')"


@register("markup_text", f"select doc_id, {sql_squeeze(_MARKUP)} as text from documents")
def markup_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", docs.markup_text("text").alias("text"))


_SPLIT = "sha256('7:' || id), id"


@register("stratified_split", f"select id, band, attribution, case when r between 1 and 8 then 'test' when r between 9 and 10 then 'dev' end as split from (select id, band, attribution, row_number() over (partition by band, attribution order by {_SPLIT}) as r from eval_items)")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(table(spark, d, "eval_items", "id", "band", "attribution"), ["band", "attribution"], {"test": 8, "dev": 2}, 7, "id")


@register("stratum_shortfall", "select band, attribution, count(*) as available, greatest(10 - count(*), 0) as shortfall from eval_items group by 1, 2")
def stratum_shortfall(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "band", "attribution").groupBy("band", "attribution").agg(F.count("*").alias("available"), F.greatest(F.lit(10) - F.count("*"), F.lit(0)).cast("bigint").alias("shortfall"))


_ALLOT = """with s as (select source as grp, count(*) as n from documents group by 1), e as (select grp, n, n * least(500, (select sum(n) from s))::double / (select sum(n) from s) as x from s),
r as (select grp, n, floor(x) as b, row_number() over (order by x - floor(x) desc, grp) as k, least(500, (select sum(n) from s)) - (select sum(floor(x)) from e) as l from e)
select grp, n, cast(b + case when k <= l then 1 else 0 end as bigint) as allotted from r"""


@register("allocate_counts", _ALLOT)
def allocate_counts(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents", "source").groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("n"))
    return sampling.allocate(sizes, 500)


@register("holdout_sample", "select id, source from (select id, source, row_number() over (partition by source order by sha256('11:' || id), id) as r from eval_items where id not in (select item_id from consensus_rows where item_id is not null)) where r <= 5")
def holdout_sample(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "consensus_rows", "item_id").withColumnRenamed("item_id", "id")
    return sampling.per_stratum(table(spark, d, "eval_items", "id", "source").join(used, "id", "left_anti"), ["source"], 5, 11, "id")


@register("round_robin_select", "select id, source from (select id, source, row_number() over (partition by source order by sha256('3:' || id), id) as r from eval_items) order by r, sha256('3:' || source), id limit 40")
def round_robin_select(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "eval_items", "id", "source"), "source", 40, 3, "id")


@register("audit_sample", "select row_id, agreement, system_id from (select row_id, agreement, system_id, case when agreement = 'N' then 0 when consensus_label_status = 'disputed' then 1 else 2 end as p from consensus_rows) order by p, sha256('5:' || row_id), row_id limit 24")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "consensus_rows", "row_id", "agreement", "system_id", "consensus_label_status")
    return sampling.audit_sample(rows, [F.col("agreement") == "N", F.col("consensus_label_status") == "disputed"], 24, 5, "row_id").select("row_id", "agreement", "system_id")


@register("manifest_textless", f"select id, source, band, split, sha256(arabic) as sha, cast({sql_words('arabic')} as bigint) as n_words from eval_items")
def manifest_textless(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_items", "id", "source", "band", "split", "arabic").select("id", "source", "band", "split", t.sha("arabic").alias("sha"), t.word_count("arabic").alias("n_words"))
    return require_textless(rows)


@register("inject_counts")
def inject_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each injector applies to the reference translations."""
    rows = table(spark, d, "eval_items", "id", "reference_english")
    return inject.inject(rows, "reference_english").groupBy("x.injector", "x.taxonomy", "x.severity").agg(F.count("*").alias("n"))


@register("inject_variants")
def inject_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return inject.inject(rows.where("text is not null"), "text").select("doc_id", "x.injector", "x.corrupted")


@register("detection_summary")
def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    """Share of corruptions that lower a score; the score here is the overlap of words with the source's reference."""
    rows = inject.inject(table(spark, d, "eval_items", "id", "reference_english").withColumnRenamed("reference_english", "clean"), "clean")
    bag = lambda c: F.array_distinct(t.words(F.lower(c)))
    score = F.size(F.array_intersect(bag(F.col("clean")), bag(F.col("x.corrupted")))) / F.greatest(F.size(bag(F.col("clean"))), F.size(bag(F.col("x.corrupted"))), F.lit(1))
    delta = (1 - score).alias("delta")
    return rows.select("x.injector", delta).groupBy("injector").agg(
        F.count("*").alias("n"), F.round(F.avg("delta"), 5).alias("mean_delta"), F.round(F.percentile("delta", 0.5), 5).alias("median_delta"), F.round(F.avg((F.col("delta") > 0.02).cast("double")), 4).alias("detection_rate")
    )

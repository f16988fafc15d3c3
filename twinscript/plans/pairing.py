"""Queries that pair units of two sides: by order, by names, by length between names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.functions import names
from twinscript.functions import text as t
from twinscript.operators import pairing
from twinscript.plans.texts import sql_words
from twinscript.queries import register
from twinscript.sources.tables import table


def _paragraphs(spark: SparkSession, d: str, language: str) -> DataFrame:
    """(work_id, at, text) of the paragraphs that are split into sentences; at counts the first sentences."""
    s = table(spark, d, "sentences", "work_id", "language", "paragraph_id", "global_sequence", "text").where(F.col("language") == language)
    return s.groupBy("work_id", "paragraph_id").agg(F.min("global_sequence").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_sequence", "text"))), lambda x: x["text"]), " ").alias("text")).select("work_id", "at", "text")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "consensus_rows", "row_id", "arabic", "translation")


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '{t.VOWEL_MARKS}', '', 'g')"


_SINGLE = {k: v for k, v in t.SKELETON.items() if len(v) == 1}
_LETTERS = "".join(t.SKELETON)


def _skeleton(c: str, ta: str) -> str:
    out = f"translate(regexp_replace({_bare(c)}, '[^ة{_LETTERS}]', '', 'g'), 'ة{''.join(_SINGLE)}', '{ta}{''.join(_SINGLE.values())}')"
    for letter, latin in t.SKELETON.items():
        if len(latin) > 1:
            out = f"replace({out}, '{letter}', '{latin}')"
    return _single(out)


def _single(c: str) -> str:
    """Doubles once; the letters one by one, since the pattern needs a reference to itself."""
    return f"array_to_string(list_filter(string_split({c}, ''), lambda x, i: i = 1 or x <> string_split({c}, '')[i - 1]), '')"


@register("skeletons", f"select entry_id, {_skeleton('arabic', 'h')} as arabic from glossary")
def skeletons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary", "entry_id", "arabic").select("entry_id", t.arabic_skeleton("arabic").alias("arabic"))


@register("search_blobs", f"select id, {_skeleton('arabic', 'h')} || '|' || {_skeleton('arabic', 't')} as blob from (select id, substring(arabic, 1, 60) as arabic from eval_items)")
def search_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Openings of the items as they are searched for names."""
    return table(spark, d, "eval_items", "id", "arabic").select("id", names.search_blob(F.substring("arabic", 1, 60)).alias("blob"))


_STOPS = ", ".join(f"'{w}'" for w in (names.FUNCTION_WORDS + " " + names.TITLE_WORDS).split())
_CHAIN = ", ".join(f"'{w}'" for w in names.CHAIN_SKELETONS)
_PARTS = "flatten(list_transform(regexp_extract_all(coalesce(translation, ''), '[A-Za-z][A-Za-z''’ʿʻ-]*'), lambda w: string_split(w, '-')))"
_CASED = r"(regexp_matches(w, '^\p{Lu}') or (length(w) >= 3 and length(regexp_replace(w, '[^\p{Lu}]', '', 'g')) * 2 >= length(w)))"
_NAMED = f"list_filter(list_transform({_PARTS}, lambda w: trim(w, '''’ʿʻ')), lambda w: w <> '' and lower(w) not in ({_STOPS}) and {_CASED})"
_BONES = f"list_filter(list_transform({_NAMED}, lambda w: regexp_replace(lower(w), '[^b-df-hj-np-tvxz]', '', 'g')), lambda s: s <> '')"
_NAMES = f"(select row_id, s from (select row_id, unnest({_BONES}) as raw from consensus_rows) , lateral (select {_single('raw')} as s) where length(s) >= 2 and s not in ({_CHAIN}))"


@register("name_skeletons", f"select row_id, s as skeleton, count(*) as n from {_NAMES} group by 1, 2")
def name_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("row_id", F.explode(names.name_skeletons("translation")).alias("skeleton")).groupBy("row_id", "skeleton").agg(F.count("*").alias("n"))


_ARABIC = f"(select row_id, {_skeleton('coalesce(arabic, ' + repr('') + ')', 'h')} as h, {_skeleton('coalesce(arabic, ' + repr('') + ')', 't')} as w from consensus_rows)"


@register("name_evidence", f"select a.row_id, count(s) as names, count(*) filter (contains(h, s) or contains(w, s)) as matched, cast(coalesce(sum(length(s)) filter ((contains(h, s) or contains(w, s)) and length(s) >= 3), 0) as bigint) as mass from {_ARABIC} a left join {_NAMES} n using (row_id) group by 1")
def name_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = names.evidence(names.name_skeletons(F.coalesce("translation", F.lit(""))), *(t.arabic_skeleton(F.coalesce("arabic", F.lit("")), ta) for ta in "ht"))
    return _pairs(spark, d).select("row_id", e.alias("e")).select("row_id", (F.size("e.matched") + F.size("e.missed")).cast("bigint").alias("names"), F.size("e.matched").cast("bigint").alias("matched"), F.col("e.mass").cast("bigint").alias("mass"))


@register("anchor_scores", f"select a.row_id, round(coalesce(count(*) filter (contains(h, s) or contains(w, s)) / nullif(count(s), 0), 0), 6) as score from {_ARABIC} a left join {_NAMES} n using (row_id) group by 1")
def anchor_scores(spark: SparkSession, d: str) -> DataFrame:
    score = names.anchor_score(F.coalesce("translation", F.lit("")), F.coalesce("arabic", F.lit("")))
    return _pairs(spark, d).select("row_id", F.round(score, 6).alias("score"))


_UNITS = "(select work_id, language, min(global_sequence) as pos, string_agg(text, ' ' order by global_sequence) as text from sentences group by work_id, language, paragraph_id)"
_RANKED = f"(select *, row_number() over (partition by work_id, language order by pos) as pair from {_UNITS})"


@register("paired_in_order", f"select a.work_id, a.pair, a.pos as a_at, b.pos as b_at from {_RANKED} a join {_RANKED} b on a.work_id = b.work_id and a.pair = b.pair where a.language = 'ar' and b.language = 'en'")
def paired_in_order(spark: SparkSession, d: str) -> DataFrame:
    a, b = (_paragraphs(spark, d, la).select("work_id", "at") for la in ("ar", "en"))
    return pairing.in_order(a, b, "work_id", "at").select("work_id", F.col("pair").cast("bigint").alias("pair"), "a_at", "b_at")


@register("rising_anchors")
def rising_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of both languages that share names, in rising order."""
    a, b = (_paragraphs(spark, d, la).withColumnRenamed("text", "title") for la in ("ar", "en"))
    return pairing.rising_anchors(a, b, "work_id")


@register("zipped_units")
def zipped_units(spark: SparkSession, d: str) -> DataFrame:
    """English paragraphs of each Arabic one, by lengths between anchors."""
    a, b = (_paragraphs(spark, d, la) for la in ("ar", "en"))
    anchors = pairing.rising_anchors(a.withColumnRenamed("text", "title"), b.withColumnRenamed("text", "title"), "work_id")
    sized = lambda df, side: df.select("work_id", F.lit(side).alias("side"), "at", t.word_count("text").alias("words"))
    return pairing.zipped(sized(a, "a").unionByName(sized(b, "b")), "work_id", anchors)


_SIZED = f"(select work_id, pos, {sql_words('text')} as n from {_UNITS} where language = 'ar')"


@register("shared_cuts", f"select work_id, cut, min(pos) as first, max(pos) + 1 as last, cast(sum(n) as bigint) as words from (select *, (coalesce(sum(n) over (partition by work_id order by pos rows between unbounded preceding and 1 preceding), 0) // 60)::bigint as cut from {_SIZED}) group by 1, 2")
def shared_cuts(spark: SparkSession, d: str) -> DataFrame:
    sized = _paragraphs(spark, d, "ar").select("work_id", "at", t.word_count("text").alias("words"))
    return pairing.shared_cuts(sized, "work_id", 60)


_LINKED = "(select distinct work_id, arabic_start, arabic_end, english_start, english_end from dp_links where arabic_end > arabic_start and english_end > english_start and confidence >= 0.5)"


def _side(language: str, first: str, last: str) -> str:
    return f"(select coalesce(string_agg(text, ' ' order by global_sequence), '') from sentences s where s.work_id = l.work_id and s.language = '{language}' and s.global_sequence >= l.{first} and s.global_sequence < l.{last})"


@register("link_passages", f"select work_id, arabic_start, english_start, arabic_end, english_end, {_side('ar', 'arabic_start', 'arabic_end')} as arabic, {_side('en', 'english_start', 'english_end')} as english from {_LINKED} l")
def link_passages(spark: SparkSession, d: str) -> DataFrame:
    """The confident proposals with the texts they link."""
    links = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end", "english_start", "english_end", "confidence").where("arabic_end > arabic_start and english_end > english_start and confidence >= 0.5").drop("confidence").distinct()
    s = table(spark, d, "sentences", "work_id", "language", "global_sequence", "text").withColumnRenamed("global_sequence", "at")
    one = pairing.passages(links, s.where("language = 'ar'"), "work_id", "arabic", "arabic_start", "arabic_end")
    both = pairing.passages(one, s.where("language = 'en'"), "work_id", "english", "english_start", "english_end")
    return both.select("work_id", "arabic_start", "english_start", "arabic_end", "english_end", "arabic", "english")


@register("section_hits", "select count(*) filter (g.english_start - 1 < l.english_end and g.english_end + 1 > l.english_start) as hits, count(*) as n from (select distinct * exclude (score, confidence, operation, uncertainty_radius, flags, structural_link_index) from dp_links where confidence >= 0.7) g join (select distinct work_id, arabic_start, english_start, english_end from dp_links where confidence < 0.7) l on g.work_id = l.work_id and g.arabic_start = l.arabic_start")
def section_hits(spark: SparkSession, d: str) -> DataFrame:
    """Weaker proposals near a confident one of the same start."""
    rows = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end", "english_start", "english_end", "confidence")
    g = rows.where("confidence >= 0.7").drop("confidence").distinct().withColumnsRenamed({"english_start": "g_start", "english_end": "g_end"})
    w = rows.where("confidence < 0.7").select("work_id", "arabic_start", "english_start", "english_end").distinct()
    hit = pairing.range_hit("g_start", "g_end", "english_start", "english_end", 1)
    return g.join(w, ["work_id", "arabic_start"]).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


@register("names_shared")
def names_shared(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("row_id", pairing.name_mass(F.coalesce("translation", F.lit("")), F.coalesce("arabic", F.lit(""))).alias("mass"))

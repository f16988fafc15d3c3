"""Queries over bilingual works: structure, links, coverage, kernels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t
from twinscript.operators import alignment, timeline
from twinscript.queries import register
from twinscript.schemas import violations
from twinscript.sources.tables import table


@register("stale_hashes", "select id from sentences where source_hash is null or source_hash <> sha256(text)")
def stale_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentences", "id", "text", "source_hash")
    return violations(rows, ["id"], {"hash": F.col("source_hash") == t.sha("text")}).where("rule = 'hash'").select(F.col("key").alias("id"))


@register("sequence_gaps", "with w as (select distinct id, block_id, word_sequence from ledger_words where text <> '') select id from (select id, word_sequence, lag(word_sequence) over (partition by block_id order by word_sequence) as p from w) where coalesce(word_sequence - p - 1, word_sequence) <> 0")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Words before which a block lacks some, empty ones being left out."""
    rows = table(spark, d, "ledger_words", "id", "block_id", "word_sequence", "text").where("text <> ''").drop("text").distinct()
    return violations(rows, ["id"], {}, (["block_id"], "word_sequence")).where("rule <> 'key is repeated'").select(F.col("key").alias("id"))


@register("work_sizes", "select work_id, language, count(*) as sentences, count(distinct paragraph_id) as paragraphs, cast(max(global_sequence) as integer) as last from sentences group by 1, 2")
def work_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences", "work_id", "language", "paragraph_id", "global_sequence").groupBy("work_id", "language").agg(F.count("*").alias("sentences"), F.countDistinct("paragraph_id").alias("paragraphs"), F.max("global_sequence").alias("last"))


_COVERED = "(select distinct work_id, unnest(generate_series(arabic_start, arabic_end - 1)) as x from dp_links where arabic_end > arabic_start)"


@register("dp_coverage", f"select s.work_id, count(*) as n, count(c.x) as covered, round(count(c.x)::double / count(*), 6) as coverage from (select work_id, global_sequence as g from sentences where language = 'ar') s left join {_COVERED} c on s.work_id = c.work_id and s.g = c.x group by 1")
def dp_coverage(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end").where("arabic_end > arabic_start")
    covered = links.select("work_id", F.explode(F.sequence("arabic_start", F.col("arabic_end") - 1)).alias("x")).select(F.concat_ws("/", "work_id", F.col("x").cast("string")).alias("place"))
    ids = table(spark, d, "sentences", "work_id", "language", "global_sequence").where("language = 'ar'").select("work_id", F.concat_ws("/", "work_id", F.col("global_sequence").cast("string")).alias("place"))
    return alignment.coverage(ids, covered, "place", "work_id")


@register("overlapping_links", "select work_id, arabic_start, arabic_end, count(*) as n from (select *, max(arabic_end) over (partition by work_id order by arabic_start, arabic_end rows between unbounded preceding and 1 preceding) as b from dp_links) where arabic_start < b group by 1, 2, 3")
def overlapping_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end")
    return alignment.range_overlaps(rows).groupBy("work_id", "arabic_start", "arabic_end").agg(F.count("*").alias("n"))


_AWAY = "min(case when l.work_id is null then null when g.y < l.english_start then l.english_start - g.y when g.y >= l.english_end then g.y - l.english_end + 1 else 0 end)"


@register("gold_metrics", f"select count(*) as gold, round(avg((coalesce(a = 0, false))::int), 6) as exact, round(avg((coalesce(a <= 1, false))::int), 6) as within_1, round(avg((coalesce(a <= 2, false))::int), 6) as within_2, round(avg((a is null or a > 2)::int), 6) as missed from (select g.work_id, g.x, g.y, {_AWAY} as a from (select distinct work_id, arabic_start as x, english_start as y from dp_links where confidence >= 0.5) g left join dp_links l on g.work_id = l.work_id and g.x >= l.arabic_start and g.x < l.arabic_end and l.confidence < 0.9 group by 1, 2, 3)")
def gold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The weaker proposals measured against the confident ones."""
    rows = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end", "english_start", "english_end", "confidence")
    gold = rows.where("confidence >= 0.5").select("work_id", F.col("arabic_start").alias("x"), F.col("english_start").alias("y")).distinct()
    links = rows.where("confidence < 0.9").select("work_id", F.col("arabic_start").alias("x_start"), F.col("arabic_end").alias("x_end"), F.col("english_start").alias("y_start"), F.col("english_end").alias("y_end"))
    return alignment.gold_metrics(links, gold)


@register("buffer_hits", "select g.work_id, g.x, g.y, coalesce(bool_or(g.y >= l.english_start - 1 and g.y < l.english_end + 1), false) as hit from (select distinct work_id, arabic_start as x, english_start as y from dp_links where confidence >= 0.5) g left join dp_links l on g.work_id = l.work_id and g.x >= l.arabic_start and g.x < l.arabic_end and l.confidence < 0.9 group by 1, 2, 3")
def buffer_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end", "english_start", "english_end", "confidence")
    gold = rows.where("confidence >= 0.5").select("work_id", F.col("arabic_start").alias("x"), F.col("english_start").alias("y")).distinct()
    links = rows.where("confidence < 0.9").select("work_id", F.col("arabic_start").alias("x_start"), F.col("arabic_end").alias("x_end"), F.col("english_start").alias("y_start"), F.col("english_end").alias("y_end"))
    return alignment.buffer_hits(links, gold, 1)


@register("display_modes", "select case when coalesce(list_has_any(flags, ['unanchored', 'review_required']), false) or confidence is null or confidence < 0.4 then 3 when operation = '1:1' and confidence >= 0.7 then 1 else 2 end as mode, count(*) as n from dp_links group by 1")
def display_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dp_links", "confidence", "flags", "operation")
    return rows.groupBy(timeline.display_mode(F.col("confidence"), F.col("flags"), F.col("operation") == "1:1").alias("mode")).agg(F.count("*").alias("n"))


@register("dangling_links", "select distinct work_id, structural_link_index from structural_links, unnest(list_concat(arabic_structure_ids, english_structure_ids)) as u(s) where s not in (select structure_id from paragraphs where structure_id is not null and sequence >= 2)")
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to a structure that isn't there or has fewer than three paragraphs."""
    links = table(spark, d, "structural_links", "work_id", "structural_link_index", "arabic_structure_ids", "english_structure_ids")
    ids = links.select("work_id", "structural_link_index", F.explode(F.concat("arabic_structure_ids", "english_structure_ids")).alias("structure_id"))
    known = table(spark, d, "paragraphs", "structure_id", "sequence").where("sequence >= 2").select("structure_id").distinct()
    return ids.join(known, "structure_id", "left_anti").select("work_id", "structural_link_index").distinct()


@register("link_contract", "select case when a = 0 or e = 0 then 'one side only' when foreign_ > 0 then 'another work' when a = 1 and e = 1 then 'one to one' else 'several' end as kind, count(*) as n from (select len(coalesce(arabic_structure_ids, [])) as a, len(coalesce(english_structure_ids, [])) as e, len(list_filter(list_concat(arabic_structure_ids, english_structure_ids), lambda s: not starts_with(s, work_id || ':'))) as foreign_ from structural_links) group by 1")
def link_contract(spark: SparkSession, d: str) -> DataFrame:
    """Structural links by what they name: structures of one side only, of another work, one of each side, or several."""
    links = table(spark, d, "structural_links", "work_id", "structural_link_index", "arabic_structure_ids", "english_structure_ids")
    a, e = (F.coalesce(c, F.array().cast("array<string>")) for c in ("arabic_structure_ids", "english_structure_ids"))
    foreign = F.exists(F.concat(a, e), lambda s: ~F.startswith(s, F.concat("work_id", F.lit(":"))))
    kind = F.when((F.size(a) == 0) | (F.size(e) == 0), "one side only").when(foreign, "another work").when((F.size(a) == 1) & (F.size(e) == 1), "one to one").otherwise("several")
    return links.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register("overlapping_proposals", "select ranges, count(*) as places from (select work_id, x, count(distinct (english_start, english_end)) as ranges from dp_links, unnest(generate_series(arabic_start, arabic_end - 1)) as u(x) where arabic_end > arabic_start group by 1, 2) group by 1")
def overlapping_proposals(spark: SparkSession, d: str) -> DataFrame:
    """How many different English ranges proposals link an Arabic place to."""
    links = table(spark, d, "dp_links", "work_id", "arabic_start", "arabic_end", "english_start", "english_end").where("arabic_end > arabic_start")
    places = links.select("work_id", F.explode(F.sequence("arabic_start", F.col("arabic_end") - 1)).alias("x"), F.struct("english_start", "english_end").alias("to"))
    return places.groupBy("work_id", "x").agg(F.count_distinct("to").alias("ranges")).groupBy("ranges").agg(F.count("*").alias("places"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """(unit, side, seq, text) of linked structures; a unit is one structural link."""
    links = table(spark, d, "structural_links", "work_id", "structural_link_index", "arabic_structure_ids", "english_structure_ids").select(F.concat_ws("#", "work_id", F.col("structural_link_index").cast("string")).alias("unit"), "arabic_structure_ids", "english_structure_ids")
    sides = links.select("unit", F.lit("a").alias("side"), F.explode("arabic_structure_ids").alias("structure_id")).unionByName(links.select("unit", F.lit("b").alias("side"), F.explode("english_structure_ids").alias("structure_id")))
    p = table(spark, d, "paragraphs", "id", "structure_id").withColumnRenamed("id", "paragraph_id")
    s = table(spark, d, "sentences", "paragraph_id", "global_sequence", "text")
    return sides.join(p, "structure_id").join(s, "paragraph_id").select("unit", "side", F.col("global_sequence").alias("seq"), "text")


@register("dp_align_units")
def dp_align_units(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align_groups(_units(spark, d))


@register("length_partition")
def length_partition(spark: SparkSession, d: str) -> DataFrame:
    """Target sentences of each linked unit shared out among the source's by length; where there are fewer of them some of the source get none (null)."""
    sized = _units(spark, d).groupBy("unit", "side", "seq").agg(F.sum(F.length("text")).alias("n"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == s].sort_values("seq") for s in "ab")
        rows = []
        if len(a):
            shared = alignment.length_partition(a.n.tolist(), b.n.tolist(), int(len(b) >= len(a)), max(1, -(-len(b) // len(a)) + 3))
            rows = [(key[0], s, int(b.seq.iloc[i]) if k > i else None, int(b.seq.iloc[k - 1]) if k > i else None) for s, (i, k) in zip(a.seq, shared, strict=True)]
        return pd.DataFrame(rows, columns=["unit", "seq", "first", "last"]).astype({"first": "Int32", "last": "Int32"})

    return sized.groupBy("unit").applyInPandas(work, "unit string, seq int, first int, last int")


@register("ledger_sizes", "select edition_key, count(*) as words, count(distinct block_id) as blocks from (select distinct * from ledger_words) group by 1")
def ledger_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger_words", "edition_key", "id", "block_id", "block_sequence", "word_sequence", "text").distinct().groupBy("edition_key").agg(F.count("*").alias("words"), F.countDistinct("block_id").alias("blocks"))


@register("ledger_blocks", "select block_id, string_agg(text, ' ' order by word_sequence, id) as text from (select distinct * from ledger_words) where text <> '' group by 1")
def ledger_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ledger_words", "id", "block_id", "word_sequence", "text").where("text <> ''").distinct()
    return rows.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_sequence", "id", "text"))), lambda x: x["text"]), " ").alias("text"))


@register("vectors_per_label", "select label, count(*) as vectors from embeddings group by 1")
def vectors_per_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "label").groupBy("label").agg(F.count("*").alias("vectors"))


@register("span_mean_cosine", "with m as (select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, unnest(generate_series(1, len(embedding))) as i from embeddings) group by 1, 2), u as (select label, list(m order by i) as v from m group by 1) select e.vec_id, round(list_cosine_similarity(e.embedding::double[], u.v), 4) as cosine from embeddings e join u using (label)")
def span_mean_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the mean of its label."""
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(mean, "label").select("vec_id", F.round(dot(F.col("embedding"), F.col("v")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("v"), F.col("v"))), 4).alias("cosine"))


def _tokens_sql(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(translate(regexp_replace(lower({c}), '{t.VOWEL_MARKS}', '', 'g'), 'أإآٱىة', 'اااايه'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


_LEDGER = f"(select block_id, row_number() over (partition by block_id order by word_sequence, id, i) - 1 as pos, tk[i] as token from (select *, unnest(generate_series(1, len(tk))) as i from (select distinct block_id, word_sequence, id, {_tokens_sql('text')} as tk from ledger_words where text is not null)))"
_PATTERNS = f"(select entry_id, unnest(generate_series(1, len(tk))) - 1 as k, len(tk) as n, unnest(tk) as token from (select entry_id, {_tokens_sql('arabic')} as tk from glossary))"
_SPANS = f"(select entry_id, block_id, start, start + n as \"end\" from (select entry_id, block_id, pos - k as start, n, k from {_LEDGER} w join {_PATTERNS} p using (token)) group by entry_id, block_id, start, n having count(distinct k) = n)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "ledger_words", "block_id", "word_sequence", "id", "text").where("text is not null").distinct()
    each = words.select("block_id", "word_sequence", "id", F.posexplode(timeline.tokens("text")).alias("i", "token"))
    placed = each.select("block_id", "token", (F.row_number().over(Window.partitionBy("block_id").orderBy("word_sequence", "id", "i")) - 1).alias("at"))
    return timeline.find_spans(placed, table(spark, d, "glossary", "entry_id", "arabic").select("entry_id", timeline.tokens("arabic").alias("tokens")), "block_id", "entry_id")


@register("ledger_spans", f"select * from {_SPANS}")
def ledger_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the glossary's terms stand among the ledger's words, word by word."""
    return _spans(spark, d)


@register("first_ledger_spans", f"select entry_id, block_id, min(start) as start, arg_min(\"end\", start) as \"end\" from {_SPANS} group by 1, 2")
def first_ledger_spans(spark: SparkSession, d: str) -> DataFrame:
    return timeline.first_spans(_spans(spark, d), "entry_id", "block_id")


@register("clamped_spans", f"select block_id, entry_id, greatest(start, 2) as start, least(\"end\", 10) as \"end\", start < 2 or \"end\" > 10 as outside from {_SPANS} where greatest(start, 2) < least(\"end\", 10)")
def clamped_spans(spark: SparkSession, d: str) -> DataFrame:
    """Those spans cut to the places 2 to 10 of each block."""
    spans = _spans(spark, d)
    return timeline.clamped(spans, spans.select("block_id").distinct().select("block_id", F.lit(2).alias("low"), F.lit(10).alias("high")), "block_id").select("block_id", "entry_id", "start", "end", "outside")

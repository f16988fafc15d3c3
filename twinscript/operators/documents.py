"""Cleaning of scanned and marked-up sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t


def dehyphenate(c: Column | str) -> Column:
    """Words broken at a line end joined; a hyphen before a capital stays."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"-[ \t]*\r?\n[ \t]*(?=\p{Ll})", "")


def paragraphs(c: Column | str) -> Column:
    """Blocks between blank lines, white space collapsed."""
    blocks = F.split(F.col(c) if isinstance(c, str) else c, r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
    return F.filter(F.transform(blocks, t.squeeze), lambda x: x != "")


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line)"""
    return texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))


def running_heads(rows: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Lines of 8 to 80 characters and 2 to 8 words in capitals that come back; page numbers at their ends don't count."""
    head = t.squeeze(F.regexp_replace("line", r"^\s*[0-9]+\s+|\s+[0-9]+\s*$", ""))
    n = F.size(t.words(head))
    seen = rows.select(*by, head.alias("head")).where(F.length("head").between(8, 80) & n.isNotNull())
    upper = (F.upper("head") == F.col("head")) & F.col("head").rlike(r"\p{Lu}")
    return seen.where(upper & F.size(t.words("head")).between(2, 8)).groupBy(*by, "head").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def page_number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"^\s*[\[(]?[0-9IVXLCivxlc]{1,6}[\])]?\s*$")


def markup_text(c: Column | str) -> Column:
    """Markup and entities off."""
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return t.squeeze(x)


# The line marks of the plain-text corpus format.
META, HEADING, PARAGRAPH, CONTINUED = "#META#", r"^(#{1,6}) \|+ ?(.*)$", r"^# (.*)$", "~~"
INLINE = r"PageV\d+P\d+|ms\d+|%~%"
NULLS = ("NODATA", "NOTGIVEN", "NOT GIVEN", "N/A", "NONE", "")


def marked_lines(rows: DataFrame, key: str) -> DataFrame:
    """lines(key, at, line) with kind (meta, heading, paragraph, continued, other), level and clean text."""
    line = F.col("line")
    kind = F.when(line.startswith(META), "meta").when(line.rlike(HEADING), "heading").when(line.startswith(CONTINUED), "continued").when(line.rlike(PARAGRAPH), "paragraph").otherwise("other")
    body = F.when(kind == "heading", F.regexp_extract(line, HEADING, 2)).when(kind == "continued", F.expr("substring(line, 3)")).when(kind == "paragraph", F.expr("substring(line, 3)")).otherwise(line)
    return rows.select(key, "at", kind.alias("kind"), F.when(kind == "heading", F.length(F.regexp_extract(line, HEADING, 1))).alias("level"), t.squeeze(F.regexp_replace(body, INLINE, " ")).alias("text"))


def marked_paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """(key, section, paragraph, heading, text) of marked lines: continuations joined, headings carried forward."""
    m = marked_lines(rows, key).where("kind in ('heading', 'paragraph', 'continued')")
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(w)).withColumn("unit", F.sum((F.col("kind") != "continued").cast("int")).over(w)).withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w))
    joined = m.groupBy(key, "section", "unit", "heading").agg(F.min_by("kind", "at").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    p = Window.partitionBy(key, "section").orderBy("unit")
    return joined.where("kind = 'paragraph'").withColumn("paragraph", F.row_number().over(p)).select(key, "section", "paragraph", "heading", "text")


def meta_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, name, value) of metadata lines; stated nulls are null."""
    pair = F.regexp_extract("line", r"^#META#\s*(.*?)\s*::\s*(.*)$", 1), F.trim(F.regexp_extract("line", r"^#META#\s*(.*?)\s*::\s*(.*)$", 2))
    return rows.where(F.col("line").startswith(META) & F.contains("line", F.lit("::"))).select(key, pair[0].alias("name"), F.when(~F.upper(pair[1]).isin(*NULLS), pair[1]).alias("value"))

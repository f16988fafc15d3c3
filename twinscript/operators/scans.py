"""Scanned editions as ordered lines: heads, page numbers, footnotes, blocks over page turns, years and numbered sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import text as t

# What page numbers look like in a scan, and letters that scans give for digits.
PAGE_NUMBER, MISREAD = r"^[\s.\dIVXLivxlijJyx$&lo]{1,8}$", ("$j", "jy", "j6", "jo", "io", "il")
ROMAN = r"^[IVXLCivxlc]+\.?$"
# How footnotes open in two kinds of scans, hints of a citation, and bounds of a note.
NOTE_START = r"^\s*(?:\d{1,2}[-.\s\"']+|[*•§]\s*|[JjxXsSlI'\"&]{1,2}[-.\s\"']+)[A-Za-z\"'(\[]"
CITATION = r"(?i)\bvol\.|\bpp?\.|\bibid|\bcf\.|\bop\.\s*cit|\bi\.?e\.|\bsee\b|\breading\b|\bomit|\bliterally\b|Koran|Yakut|Ibn-"
NOTE_LINES, NOTE_WORDS, BARE_NOTE_WORDS = 4, 90, 25
# Words of a chain of names, after which a hyphen at a line's end is real.
CHAIN = ("ibn", "abu", "abi", "abd", "umm", "bint", "banu", "bani", "al", "an", "ar", "as", "at", "az", "ad", "ash", "ath", "dhu", "bin")
# A page's head, with a number before or after its title; a year may follow.
HEAD_FIRST, HEAD_LAST, YEAR = r"^\s*(\d{1,4})\s{2,}([A-Z][A-Z0-9 .,'’-]{3,})\s*$", r"^\s*([A-Z][A-Z0-9 .,'’-]{3,}?)\s{2,}(\d{1,4})\s*$", r"(?i)\bA\.?\s?H\.?\s*(\d{1,4})\b"
# Arabic numerals of years spelt out.
NUMERALS = {
    "إحدى": 1, "احدى": 1, "واحدة": 1, "اثنتين": 2, "ثنتين": 2, "اثنين": 2, "ثنتان": 2, "ثلاث": 3, "أربع": 4, "اربع": 4, "خمس": 5, "ست": 6, "سبع": 7, "ثمان": 8, "ثماني": 8, "تسع": 9,
    "عشرة": 10, "عشر": 10, "عشرين": 20, "ثلاثين": 30, "أربعين": 40, "اربعين": 40, "خمسين": 50, "ستين": 60, "سبعين": 70, "ثمانين": 80, "تسعين": 90,
    "مائة": 100, "مئة": 100, "مائتين": 200, "مئتين": 200, "ثلاثمائة": 300, "ثلثمائة": 300, "أربعمائة": 400, "اربعمائة": 400,
}
# English numerals that ordinals are made of.
_ONES, _TEENS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH".split(), "TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH".split()
_TENS = "TWENT THIRT FORT FIFT SIXT SEVENT EIGHT NINET".split()


def ordinals(most: int = 99) -> dict[str, int]:
    """English ordinals in capitals with their numbers, made from their parts."""
    out = dict(zip(_ONES + _TEENS, range(1, 20), strict=True))
    for ten, stem in enumerate(_TENS, 2):
        out |= {f"{stem}IETH": 10 * ten} | {f"{stem}Y-{one}": 10 * ten + k for k, one in enumerate(_ONES, 1)}
    return {w: n for w, n in out.items() if n <= most}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_head(c: Column | str, title: str | None = None) -> Column:
    """A line of at most eight words whose letters, three or more, are capitals by four fifths, or one that holds the title pattern."""
    line = F.trim(_c(c))
    letters, capitals = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    capital = (letters >= 3) & (capitals >= 0.8 * letters) & (t.word_count(line) <= 8)
    return F.coalesce((line != "") & (capital | line.rlike(title) if title else capital), F.lit(False))


def is_page_number(c: Column | str) -> Column:
    """A line of at most eight characters that is a number, a Roman one, or what scans make of one."""
    line = F.trim(_c(c))
    arabic = line.rlike(PAGE_NUMBER) & (line.rlike(r"\d") | F.lower(line).isin(*MISREAD))
    return F.coalesce((line != "") & (F.length(line) <= 8) & (line.rlike(ROMAN) | arabic), F.lit(False))


def is_note(lines: Column | str) -> Column:
    """A block, as an array of lines, that opens like a footnote and is short or cites something."""
    block = _c(lines)
    joined = F.array_join(block, " ")
    n = t.word_count(joined)
    short = F.size(block).between(1, NOTE_LINES) & (n <= NOTE_WORDS)
    return F.coalesce(short & F.get(block, F.lit(0)).rlike(NOTE_START) & (joined.rlike(CITATION) | (n <= BARE_NOTE_WORDS)), F.lit(False))


def page_head(c: Column | str) -> Column:
    """struct(page, year, title) of a page's head; null for any other line."""
    line = _c(c)
    first, last = F.regexp_extract(line, HEAD_FIRST, 1), F.regexp_extract(line, HEAD_LAST, 2)
    title = F.when(first != "", F.regexp_extract(line, HEAD_FIRST, 2)).otherwise(F.regexp_extract(line, HEAD_LAST, 1))
    year = F.regexp_extract(title, YEAR, 1)
    made = F.struct(F.when(first != "", first).otherwise(last).cast("int").alias("page"), F.when(year != "", year.cast("int")).alias("year"), F.trim(F.regexp_replace(F.regexp_replace(title, YEAR, " "), r"[ .]+", " ")).alias("title"))
    return F.when((first != "") | (last != ""), made)


def dehyphenate_names(c: Column | str) -> Column:
    """Words broken at a line's end joined; the hyphen stays after a part of a chain of names if a capital follows."""
    chain = "|".join(CHAIN)
    kept = F.regexp_replace(_c(c), rf"(?i)((?:^|[\s-])(?:{chain}))-[ \t]*\r?\n[ \t]*(?-i)(?=\p{{Lu}})", "$1-")
    return F.regexp_replace(kept, r"(?<=\S)-[ \t]*\r?\n[ \t]*(?=\S)", "")


def run_in_heading(c: Column | str, most: int = 8, least_body: int = 25) -> Column:
    """struct(heading, body): a short sentence before a capital, without a colon or words of report, that leaves a long body; else heading is null."""
    text = F.trim(_c(c))
    pattern = r"(?s)^([^.?!]{4,70}[.?])\s+([A-Z'\"(\[].*)$"
    head, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    apart = (head != "") & (t.word_count(head) <= most) & (t.word_count(rest) >= least_body) & ~head.rlike(r"(?i):|\b(from|said|says)\b")
    return F.struct(F.when(apart, F.trim(head)).alias("heading"), F.when(apart, F.trim(rest)).otherwise(_c(c)).alias("body"))


def chain_head(c: Column | str, window: int = 400, words: int = 18) -> Column:
    """The chain of tellers at the head of a paragraph: up to a colon and dash within a window, else its first words."""
    text = _c(c)
    place = F.regexp_instr(F.substring(text, 1, window), F.lit(r":\s*[—–-]{1,2}"))
    return F.when(place > 0, F.substring(text, F.lit(1), place - 1)).otherwise(F.array_join(F.slice(t.words(text), 1, words), " "))


def ebook_body(c: Column | str) -> Column:
    """The text between an ebook's start and end marks; the whole where either is missing."""
    text = _c(c)
    start, end = r"(?i)\*\*\* ?START OF (?:THE|THIS) [^*]*\*\*\*", r"(?i)\*\*\* ?END OF (?:THE|THIS) [^*]*\*\*\*"
    inner = F.regexp_extract(text, f"(?s){start}(.*?){end}", 1)
    return F.when(text.rlike(f"(?s){start}.*?{end}"), inner).otherwise(text)


def english_ordinal(c: Column | str, after: str = "THE", before: str = "ASSEMBLY") -> Column:
    """The number of a heading like THE TWENTY-FIRST ASSEMBLY."""
    numbers = ordinals()
    word = F.upper(F.regexp_replace(F.regexp_extract(_c(c), rf"(?i)\b{after}\s+([A-Z]+(?:[- ][A-Z]+)?)\s+{before}\b", 1), " ", "-"))
    return F.create_map(*(F.lit(x) for kv in numbers.items() for x in kv))[word]


def arabic_year(c: Column | str) -> Column:
    """A year spelt out after its word: the numerals that follow, added up to the first other word after them."""
    text = _c(c)
    after = F.regexp_extract(text, "(?s)سنة(.{0,67})", 1)
    words = F.regexp_extract_all(after, F.lit("([؀-ۿ]+)"), 1)
    table = F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv))
    value = lambda w: F.coalesce(table[w], F.when(w.startswith("و"), table[F.substring(w, 2, 99)]))
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("seen"), F.lit(False).alias("over"))

    def step(s: Column, w: Column) -> Column:
        n = value(w)
        return F.struct((s["sum"] + F.when(~s["over"], F.coalesce(n, F.lit(0))).otherwise(0)).alias("sum"), (s["seen"] | n.isNotNull()).alias("seen"), (s["over"] | (s["seen"] & n.isNull())).alias("over"))

    return F.aggregate(words, start, step, lambda s: F.when(s["seen"], s["sum"]))


def blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, first, lines): runs of lines(key, at, line) without a blank one, with the state of their first line if page, year and title were carried()."""
    w = Window.partitionBy(key).orderBy("at")
    blank = F.trim("line") == ""
    state = [c for c in ("page", "year", "title") if c in lines.columns]
    marked = lines.withColumn("_b", F.sum(blank.cast("int")).over(w)).where(~blank)
    firsts = [F.min_by(c, "at").alias(c) for c in state]
    made = marked.groupBy(key, "_b").agg(F.min("at").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"), *firsts)
    return made.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("first"))).select(key, "block", "first", "lines", *state)


def carried(lines: DataFrame, key: str) -> DataFrame:
    """lines(key, at, line) with page, year and title of the last page head before them; the heads themselves become blank lines."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    headed = lines.withColumn("_h", page_head("line"))
    state = {"page": F.col("_h.page"), "year": F.col("_h.year"), "title": F.when(F.col("_h.title") != "", F.col("_h.title"))}
    out = headed.withColumns({c: F.last(v, ignorenulls=True).over(w) for c, v in state.items()})
    return out.withColumn("line", F.when(F.col("_h").isNotNull(), "").otherwise(F.col("line"))).drop("_h")


def joined_blocks(made: DataFrame, key: str) -> DataFrame:
    """(key, paragraph, text, ...): blocks that aren't footnotes, joined where the one before doesn't end a sentence or the next goes on in a small letter; the state is the first's."""
    body = made.where(~is_note("lines")).withColumn("text", t.squeeze(F.array_join("lines", "\n"))).where("text <> ''")
    w = Window.partitionBy(key).orderBy("block")
    before = F.lag("text").over(w)
    opens = before.isNull() | (before.rlike(r"[.!?][\"'”’)\]]?$") & ~F.col("text").rlike(r"^\p{Ll}"))
    state = [c for c in ("page", "year", "title") if c in made.columns]
    numbered = body.withColumn("_o", opens.cast("int")).withColumn("paragraph", F.sum("_o").over(w))
    return numbered.groupBy(key, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), " ").alias("text"), *(F.min_by(c, "block").alias(c) for c in state))


def year_blocks(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, year, first, paragraphs, words): the paragraphs that page heads assign to each year, years once each in the order in which they first appear."""
    return paragraphs.where("year is not null").groupBy(key, "year").agg(F.min("paragraph").alias("first"), F.count("*").alias("paragraphs"), F.sum(t.word_count("text")).alias("words"))


def sections(lines: DataFrame, key: str, pattern: str, group: int = 1) -> DataFrame:
    """(key, section, heading, number, body): lines(key, at, line) cut at lines that match a heading pattern; number is the pattern's group, lines before the first heading are left out."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("line").rlike(pattern)
    cut = lines.withColumn("_h", heading).withColumn("section", F.sum(heading.cast("int")).over(w)).where("section > 0")
    made = cut.groupBy(key, "section").agg(F.max(F.when(F.col("_h"), F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("at", "line")))).alias("_l"))
    return made.select(key, "section", "heading", F.regexp_extract("heading", pattern, group).alias("number"), t.squeeze(F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("body"))


def numbered_sections(made: DataFrame, key: str) -> DataFrame:
    """Sections from the one numbered 1 to the last before number 1 comes again; section counts anew."""
    n = F.expr("try_cast(number as int)")
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    ones = made.withColumn("_n", n).where("_n is not null").withColumn("_ones", F.sum((F.col("_n") == 1).cast("int")).over(w)).where("_ones = 1")
    return ones.withColumn("section", F.row_number().over(Window.partitionBy(key).orderBy("section"))).drop("_n", "_ones")


def first_of_each(made: DataFrame, key: str, by: str) -> DataFrame:
    """Sections whose value of a column wasn't there before in the same key; null values are left out."""
    w = Window.partitionBy(key, by).orderBy("section")
    return made.where(F.col(by).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def margin_numbers(lines: DataFrame, key: str, most_step: int = 6, least: int = 20) -> DataFrame:
    """lines(key, at, line) without the numbers of another edition's pages that a scan left at line ends.

    They are the longest rising run of such numbers with small steps; a text with fewer than least of them isn't
    touched. Only lines that end in a number go to the search.
    """
    pattern = r"^(.*\S)\s+(\d{2,3})\s*$"
    found = lines.where(F.col("line").rlike(pattern)).select(key, "at", F.regexp_extract("line", pattern, 2).cast("int").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        chosen = stepped_run(pdf.n.tolist(), most_step)
        return pdf.iloc[chosen if len(chosen) >= least else []][[key, "at"]]

    off = found.groupBy(key).applyInPandas(run, lines.select(key, "at").schema).withColumn("_off", F.lit(True))
    return lines.join(off, [key, "at"], "left").withColumn("line", F.when(F.col("_off"), F.regexp_extract("line", pattern, 1)).otherwise(F.col("line"))).drop("_off")


def stepped_run(values: list[int], most_step: int) -> list[int]:
    """Places of the longest run of values that rise by at most so much from one to the next; of equal ones the first.

    The best run that ends in each value is remembered, so a value looks at most_step others.
    """
    best: dict[int, tuple[int, int]] = {}
    back: list[int] = []
    length: list[int] = []
    for i, v in enumerate(values):
        n, j = max(((*best[v - step][:1], -best[v - step][1]) for step in range(1, most_step + 1) if v - step in best), default=(0, 1))
        length.append(n + 1)
        back.append(-j if n else -1)
        if v not in best or n + 1 > best[v][0]:
            best[v] = n + 1, i
    i = max(range(len(values)), key=lambda k: (length[k], -k), default=-1)
    out = []
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]

"""Problem 2: sentence units in every language.

Statistics are learnt per language from all paragraphs, without labels: abbreviations by the log-likelihood
ratio of a type's occurrences with and without a final period (weighted by length and inner periods), pairs of
an abbreviation and the word after it (collocations), words that start units after safe boundaries (sentence
starters), the abbreviations that can end a unit, and, for paragraphs without closing marks, the phrases that
open the next statement (by the log-likelihood ratio of their use in such paragraphs and in marked ones). A scan
of each text lists every place where a unit might end; the model is joined to these places by language and word,
so it needn't fit into memory anywhere.

Defined results: null, empty and blank texts have no unit; repeated rows of one id give one set of units; a text
without any mark is one unit; an unclosed quotation is read as text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.llm._chars import LOOKALIKES
from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

# Marks that close a sentence, quotation marks, and closers that stay with the unit.
TERMINALS = ".!?؟۔。！？…‼⁇⁈⁉।｡"
FULL_STOPS = ".…"
WIDE = "。！？｡"
OPENERS = {"«": "»", "“": "”", "「": "」", "『": "』", "‘": "’"}
CLOSERS = "\"”»’)]）】」』"
STRAIGHT = "\"＂"
_QUOTE = re.compile("[" + re.escape(STRAIGHT + "".join(OPENERS) + "".join(OPENERS.values())) + "]")
#: Letters of a word that are looked at before a mark: no abbreviation is longer, and scripts without spaces have no short words.
LONGEST_WORD = 64
#: Least log-likelihood ratio of a collocation, a sentence starter and an opening phrase (public values of the method).
COLLOCATION, STARTER, OPENING, ABBREVIATION = 7.88, 30.0, 15.0, 0.3
#: Least share of an opening phrase among the words and word pairs of unmarked texts.
OPENING_SHARE = 0.002
#: An abbreviation can end a unit only where the unit has more words than this.
LEAST_WORDS = 3

_LOOK = str.maketrans(LOOKALIKES)
_LATIN = re.compile("[A-Za-z]")
_WORD = re.compile(r"[^\s]+")
_INVISIBLE = "­؜​‌‍‎‏⁠﻿"


def quoted(text: str) -> list[tuple[int, int]]:
    """(start, end) of outermost quotations, marks included; unclosed ones are left out. One pass over the marks."""
    marks = [(m.start(), m.group()) for m in _QUOTE.finditer(text)]
    close: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    straight = [i for i, c in marks if c in STRAIGHT]
    close.update(zip(straight, straight[1:], strict=False))
    for i, c in marks:
        if c in OPENERS:
            stacks.setdefault(OPENERS[c], []).append(i)
        elif stacks.get(c):
            close[stacks[c].pop()] = i
    spans: list[tuple[int, int]] = []
    end = 0
    for i, c in marks:
        if i >= end and i in close and not (c == "‘" and i and text[i - 1].isalnum()):
            end = close[i] + 1
            spans.append((i, end))
    return spans


def _kind(char: str) -> str:
    if not char:
        return "none"
    if char.islower():
        return "lower"
    if char.isupper():
        return "upper"
    if char.isdigit():
        return "digit"
    if char in "\"＂" or char in OPENERS:
        return "quote"
    return "other" if char.isalpha() else "mark"


def _clean(word: str) -> str:
    return word if word.isascii() else "".join(c for c in word if c not in _INVISIBLE).translate(_LOOK)


def _glued(word: str, following: str) -> bool:
    """Whether a period without space after it may still close a sentence."""
    if len(word.replace(".", "")) < 2:
        return False
    return word[-2:].isalpha() if "." not in word else following[1:2].islower()


def places(text: str) -> tuple[list[tuple[int, str, str, str, str, int, bool]], bool]:
    """Places where a unit may end: (end, kind, word, next word, next kind, words before, line end), and whether the text is marked.

    Kinds: sure (always an end), dot (to be judged), line (an end if the text is unmarked), word (an end before this word if it opens), final.
    """
    spans = quoted(text)
    starts = [a for a, _ in spans]

    def span_of(i: int) -> tuple[int, int] | None:
        k = bisect_right(starts, i) - 1
        return spans[k] if k >= 0 and spans[k][0] <= i < spans[k][1] else None

    out: list[tuple[int, str, str, str, str, int, bool]] = []
    marked, last_mark, i, n = False, 0, 0, len(text)
    last = len(text.rstrip())
    word_at = [m.start() for m in _WORD.finditer(text)]
    newline_at = [m.start() for m in re.finditer("\n", text)]

    def after(j: int, chars: str = "") -> int:
        """The first place from j on that isn't white space or one of the characters."""
        while j < n and (text[j].isspace() or text[j] in chars):
            j += 1
        return j

    def before(j: int, chars: str = "", low: int = 0) -> int:
        """The end of what stands before j without white space or such characters at its end."""
        while j > low and (text[j - 1].isspace() or text[j - 1] in chars):
            j -= 1
        return j

    def words_in(low: int, high: int) -> int:
        """Words between two places."""
        return bisect_left(word_at, high) - bisect_right(word_at, low) + (low < high and not text[low].isspace()) if low < high else 0

    def breaks(low: int, high: int) -> bool:
        """Whether there is a line break between two places."""
        k = bisect_left(newline_at, low)
        return k < len(newline_at) and newline_at[k] < high

    opened_unit = 0  # end of the last sure boundary
    while i < n:
        c = text[i]
        span = span_of(i)
        if span and span[1] < n + 1 and i == span[0]:
            # a whole quotation; it may end the unit if a mark stands before its closing
            inner = before(span[1] - 1, _INVISIBLE, span[0] + 1)
            end = span[1]
            while end < n and text[end] in CLOSERS:
                end += 1
            head = before(span[0], _INVISIBLE)
            introduced = head > 0 and text[head - 1] not in TERMINALS + CLOSERS and not breaks(head, span[0])
            ends = inner > span[0] + 1 and text[inner - 1] in TERMINALS
            rest = after(end)
            seen = rest
            while seen < n and text[seen] in _INVISIBLE:
                seen += 1
            kind = _kind(text[seen : seen + 1])
            if rest < n and breaks(end, rest) and not ends:
                out.append((end, "line", "", "", "none", 0, True))
            elif rest < n and ends and text[rest] not in TERMINALS + ",،؛;:" and kind != "lower" and (introduced or kind in ("upper", "digit", "quote")):
                out.append((end, "sure", "", "", kind, 0, False))
                opened_unit = last_mark = end
            i = end
            continue
        if c not in TERMINALS:
            if c == "\n":
                head = before(i, low=opened_unit)
                if head > opened_unit and i < last:
                    out.append((head, "line", "", "", "none", 0, True))
            i += 1
            continue
        j = i
        while j < n and text[j] in TERMINALS:
            j += 1
        end = j
        while end < n and text[end] in CLOSERS and not (text[end] == '"' and span_of(end) and span_of(end)[0] == end):
            end += 1
        run = text[i:j]
        rest = after(end)
        seen = rest
        while seen < n and text[seen] in _INVISIBLE:
            seen += 1
        kind = _kind(text[seen : seen + 1])
        w = bisect_left(word_at, i) - 1
        k = word_at[w] if w >= 0 and i and not text[i - 1].isspace() else i
        word = "" if i and text[i - 1] in CLOSERS else _clean(text[max(k, i - LONGEST_WORD) : i]).lstrip("\"“«‘([（")
        line_end = breaks(end, rest)
        i = max(end, i + 1)
        if rest >= n:
            marked = True
            continue
        dot = run == "." and c == "."
        if dot:
            digits = word.isdigit()
            if rest == end and (kind in ("digit", "lower", "mark") or (kind in ("upper", "other") and not _glued(word, text[seen : seen + 2]))):
                continue  # decimals, inner periods, commas after an abbreviation
            head = before(k)
            if digits and before(k, _INVISIBLE, opened_unit) <= opened_unit:
                continue  # a list number opens its sentence
            if digits and (not head or text[head - 1] in TERMINALS + CLOSERS or breaks(head, k)):
                continue
            if kind == "mark" and text[seen : seen + 1] in ",;:،؛)":
                continue
            words = words_in(max(opened_unit, last_mark), k) + 1
            following = _WORD.match(text, seen, seen + LONGEST_WORD)
            out.append((end, "dot", word.lower(), _clean(following.group(0)).strip("\"“«().,;:!?؟").lower() if following else "", kind, words, line_end))
            marked = True
            last_mark = end if len(word.replace(".", "")) > 2 else last_mark
            continue
        marked = True
        if any(x in WIDE for x in run):
            out.append((end, "sure", "", "", kind, 0, line_end))
        elif set(run) <= set(FULL_STOPS):
            if kind in ("upper", "quote", "digit") or line_end:
                out.append((end, "sure", "", "", kind, 0, line_end))
            else:
                continue
        elif kind == "lower" or (seen < n and text[seen] in ",;،؛"):
            continue
        else:
            following = _WORD.match(text, seen, seen + LONGEST_WORD)
            out.append((end, "sure", word.lower(), following.group(0).strip("\"“«().,;:!?؟").lower() if following else "", kind, 0, line_end))
        opened_unit = last_mark = end
    if last:
        out.append((last, "final", _clean(text[max(word_at[-1], last - LONGEST_WORD) : last]).rstrip(CLOSERS).lower(), "", "none", 0, True))
    return out, marked


_PLACES = T.StructType([
    T.StructField("marked", T.BooleanType()),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("word", T.StringType()), T.StructField("next", T.StringType()),
        T.StructField("next_kind", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("line_end", T.BooleanType()),
    ]))),
])


@F.pandas_udf(_PLACES)
def _scan(texts: pd.Series) -> pd.DataFrame:
    found = [places(t) if isinstance(t, str) else ([], False) for t in texts]
    return pd.DataFrame({"marked": [m for _, m in found], "places": [[dict(zip(("end", "kind", "word", "next", "next_kind", "words", "line_end"), p, strict=True)) for p in ps] for ps, _ in found]})


_TOKENS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("token", T.StringType())]))


@F.pandas_udf(_TOKENS)
def _tokens(texts: pd.Series) -> pd.Series:
    """Words with the offset of their start and of the end of the word before."""

    def cut(text: str) -> list[dict]:
        out, before = [], 0
        for at, m in enumerate(_WORD.finditer(text)):
            out.append({"at": at, "start": m.start(), "before": before, "token": _clean(m.group(0)).lower()})
            before = m.end()
        return out

    return texts.map(lambda t: cut(t) if isinstance(t, str) else [])


def _log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio for k1 of n1 against k2 of n2; both n must be positive."""

    def log_l(k: Column, n: Column, p: Column) -> Column:
        safe = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.log(safe) + (n - k) * F.log1p(-safe)

    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    return 2 * (log_l(k1, n1, p1) + log_l(k2, n2, p2) - log_l(k1, n1, p) - log_l(k2, n2, p))


_EDGE_LEFT, _EDGE_RIGHT = "\"“«‘([", "\"”»’)],;:!?،؛؟"


def type_counts(learnt: DataFrame) -> DataFrame:
    """(language, kind, word, n) over learnt(language, text, marked): kind 0 words without and 1 with a final period;
    in texts without Latin letters also 2 words and word pairs of texts without closing marks and line ends, 3 of marked ones.

    Each task counts what it reads, so only sums are shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], Counter] = {}

        def frame() -> pd.DataFrame:
            return pd.DataFrame([(la, kind, w, n) for (la, kind), c in seen.items() for w, n in c.items()], columns=["language", "kind", "word", "n"])

        for pdf in batches:
            for language, text, marked in zip(pdf.language, pdf.text, pdf.marked, strict=True):
                words = (text.lower() if text.isascii() else _clean(text).lower()).split()
                bare = [w.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT) for w in words]
                dotted = [w[:-1] for w in bare if w.endswith(".")]
                seen.setdefault((language, 0), Counter()).update(w for w in bare if w and w[-1] != ".")
                seen.setdefault((language, 1), Counter()).update(w for w in dotted if w)
                if _LATIN.search(text) is None and (marked or "\n" not in text.rstrip()):
                    c = seen.setdefault((language, 3 if marked else 2), Counter())
                    c.update(words)
                    c.update(map(" ".join, zip(words, words[1:], strict=False)))
            if sum(map(len, seen.values())) > 500_000:
                yield frame()
                seen = {}
        yield frame()

    return learnt.select("language", "text", "marked").mapInPandas(count, "language string, kind int, word string, n bigint").groupBy("language", "kind", "word").agg(F.sum("n").alias("n"))


def abbreviations(words: DataFrame, scanned: DataFrame) -> DataFrame:
    """(language, word, can_end): types whose final period doesn't close a sentence."""
    counts = words.groupBy("language", "word").agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("rest"))
    totals = counts.groupBy("language").agg(F.sum("k").alias("dots"), F.sum(F.col("k") + F.col("rest")).alias("all"))
    c = counts.where((F.col("k") > 0) & ~F.col("word").rlike(r"[\p{N}»”\"]")).join(totals, "language")
    n, k = F.col("k") + F.col("rest"), F.col("k")
    p = F.greatest(F.col("dots") / F.col("all"), F.lit(1e-12))
    null, other = k * F.log(p) + (n - k) * F.log1p(-p), k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01))
    letters = F.length(F.regexp_replace("word", r"[.]", ""))
    inner = F.length("word") - letters
    score = 2 * (other - null) * F.exp(-letters.cast("double")) * (inner + 1) * F.exp(-(F.col("rest") / k))
    found = c.where(score >= ABBREVIATION)
    ends = scanned.where("place.kind in ('dot', 'final')").select("language", F.regexp_replace("place.word", r"\.$", "").alias("word"), (F.col("place.kind") == "final").cast("long").alias("final"))
    closing = ends.groupBy("language", "word").agg(F.avg("final").alias("final_rate"), F.sum("final").alias("finals"))
    return found.select("language", "word").join(closing, ["language", "word"], "left").select("language", "word", F.coalesce((F.col("final_rate") > 0.01) & (F.col("finals") > 0), F.lit(False)).alias("can_end"))


def collocations(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """(language, word, next): pairs across a period that occur together far more often than apart."""
    pairs = scanned.where("place.kind = 'dot' and place.next <> ''").groupBy("language", F.col("place.word").alias("word"), F.col("place.next").alias("next")).agg(F.count("*").alias("both"))
    first = pairs.groupBy("language", "word").agg(F.sum("both").alias("n_first"))
    types = words.groupBy("language", F.col("word").alias("next")).agg(F.sum("n").alias("n_next"))
    total = types.groupBy("language").agg(F.sum("n_next").alias("all"))
    joined = pairs.join(first, ["language", "word"]).join(types, ["language", "next"]).join(total, "language")
    k1, n1 = F.col("both"), F.col("n_first")
    k2, n2 = F.greatest(F.col("n_next") - F.col("both"), F.lit(0)), F.greatest(F.col("all") - F.col("n_first"), F.lit(1))
    score = _log_likelihood(k1, n1, F.least(k2, n2), n2)
    return joined.where((score >= COLLOCATION) & (k1 / n1 > k2 / n2) & (k1 > 1)).select("language", "word", "next")


def starters(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """(language, next): words that follow safe boundaries far more often than other words."""
    sure = scanned.where("place.kind = 'sure' and place.next <> ''").groupBy("language", F.col("place.next").alias("next")).agg(F.count("*").alias("k"))
    types = words.groupBy("language", F.col("word").alias("next")).agg(F.sum("n").alias("n_next"))
    total = types.groupBy("language").agg(F.sum("n_next").alias("all"))
    bounds = sure.groupBy("language").agg(F.sum("k").alias("bounds"))
    joined = sure.join(types, ["language", "next"]).join(total, "language").join(bounds, "language")
    k, n = F.least(F.col("k"), F.col("n_next")), F.col("n_next")
    rest_n = F.greatest(F.col("all") - n, F.lit(1))
    rest_k = F.least(F.greatest(F.col("bounds") - k, F.lit(0)), rest_n)
    score = _log_likelihood(k, n, rest_k, rest_n)
    return joined.where((score >= STARTER) & (k / n > rest_k / rest_n)).select("language", "next")


def openings(counts: DataFrame) -> DataFrame:
    """(language, phrase): words and pairs of words that open statements where nothing marks their ends."""
    inside = counts.where("kind = 2").select("language", F.col("word").alias("phrase"), F.col("n").alias("k"))
    outside = counts.where("kind = 3").select("language", F.col("word").alias("phrase"), F.col("n").alias("m"))
    n_in = inside.groupBy("language").agg(F.sum("k").alias("n_in"))
    n_out = outside.groupBy("language").agg(F.sum("m").alias("n_out"))
    # rare phrases can't open statements, so they needn't meet the other side
    joined = inside.join(n_in, "language").where((F.col("k") > 2) & (F.col("k") / F.col("n_in") >= OPENING_SHARE)).join(outside, ["language", "phrase"], "left").join(n_out, "language", "left").na.fill({"m": 0, "n_out": 1})
    score = _log_likelihood(F.col("k"), F.col("n_in"), F.col("m"), F.greatest(F.col("n_out"), F.col("m")))
    return joined.where((score >= OPENING) & (F.col("k") / F.col("n_in") > 8 * F.col("m") / F.col("n_out"))).select("language", "phrase")


def sentence_units(paragraphs: DataFrame, learn_from: DataFrame | None = None, within: bool = False) -> DataFrame:
    """(paragraph_id, end_offset) of paragraphs(id, language, text); statistics from learn_from, else from the same rows.

    within says that learn_from holds the paragraphs too, so that each text is scanned once.
    """
    rows = paragraphs.select("id", F.coalesce("language", F.lit("und")).alias("language"), "text").where("id is not null and trim(text) <> ''")
    # of different texts of one id the least counts
    once = lambda df: df.groupBy("id").agg(F.min(F.struct("language", "text")).alias("r")).select("id", "r.*")
    rows = once(rows)
    base = rows if learn_from is None else once(learn_from.select("id", F.coalesce("language", F.lit("und")).alias("language"), "text").where("id is not null and trim(text) <> ''"))
    scan_of = lambda df: df.withColumn("scan", _scan("text")).select("id", "language", "text", "scan.marked", "scan.places")
    learnt = cut_lineage(scan_of(base))
    seen = learnt.select("language", F.explode("places").alias("place"))
    counts = cut_lineage(type_counts(learnt))
    types = counts.where("kind < 2").select("language", "word", (F.col("kind") == 1).alias("period"), "n")
    opening = cut_lineage(openings(counts))
    abbr = abbreviations(types, seen)
    colloc = collocations(seen, types)
    start = starters(seen, types)

    scanned = learnt if learn_from is None else learnt.join(rows.select("id"), "id", "left_semi") if within else scan_of(rows)
    cand = scanned.select("id", "language", "marked", F.explode("places").alias("p")).select("id", "language", "marked", "p.*")
    sure = cand.where("kind in ('sure', 'final') or (kind = 'line' and not marked)").select("id", F.col("end").alias("end_offset"))
    dots = cand.where("kind = 'dot'")
    judged = (
        dots.join(abbr.withColumn("abbr", F.lit(True)), ["language", "word"], "left")
        .join(colloc.withColumn("together", F.lit(True)), ["language", "word", "next"], "left")
        .join(start.withColumn("starts", F.lit(True)), ["language", "next"], "left")
    )
    initial = F.col("word").rlike(r"^\p{L}$")
    is_abbr = F.coalesce("abbr", F.lit(False)) | initial
    able = F.coalesce("can_end", F.lit(False)) & (F.col("words") > LEAST_WORDS)
    # where letters have no case, a collocation keeps its pair in one unit unless the second word starts sentences
    apart = (F.col("next_kind") != "other") | ~F.coalesce("together", F.lit(False)) | F.coalesce("starts", F.lit(False))
    ends = F.when(is_abbr, able & (F.col("next_kind") != "lower") & apart).otherwise((F.col("next_kind") != "lower") | F.col("line_end"))
    judged = judged.where(ends).select("id", F.col("end").alias("end_offset"))

    w = Window.partitionBy("id").orderBy("at")
    words = (
        scanned.where(~F.col("marked") & ~F.regexp_replace("text", r"\s+$", "").contains("\n") & ~F.col("text").rlike("[A-Za-z]"))
        .select("id", "language", F.explode(_tokens("text")).alias("t"))
        .select("id", "language", "t.*")
        .withColumn("pair", F.concat_ws(" ", "token", F.lead("token").over(w)))
    )
    keyed = (
        words.join(opening.select("language", F.col("phrase").alias("token"), F.lit(True).alias("k1")), ["language", "token"], "left")
        .join(opening.select("language", F.col("phrase").alias("pair"), F.lit(True).alias("k2")), ["language", "pair"], "left")
        .withColumn("k1", F.coalesce("k1", F.lit(False)))
        .withColumn("k2", F.coalesce("k2", F.lit(False)))
        .withColumn("inside", F.coalesce(F.lag("k1").over(w), F.lit(False)) | F.coalesce(F.lag("k2").over(w), F.lit(False)))
    )
    opened = keyed.where("(k1 or k2) and not inside and at > 0").select("id", F.col("before").alias("end_offset"))
    return sure.unionByName(judged).unionByName(opened).select(F.col("id").alias("paragraph_id"), F.col("end_offset").cast("bigint").alias("end_offset")).distinct()


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = table(spark, d, "paragraphs", "id", "language", "text")
    split = table(spark, d, "sentences", "paragraph_id").select(F.col("paragraph_id").alias("id")).distinct()
    return sentence_units(paragraphs.join(split, "id", "left_anti"), paragraphs, within=True)

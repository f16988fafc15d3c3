"""Problem 10: keyword-stuffed and link-list pages.

Per page the rank-frequency curve of its adjacent word pairs is fitted with SQL windows (ties share their middle
rank); its slope, height and residual are compared with those of pages in the same script at comparable lengths, by the
median over all documents. Divergence from prose is the share of head words, the words that a quarter of all pages of
the script contain, against the same median; links and product tags weigh against it. A page is stuffed if it lacks
head words and either its curve is extremely steep or links and tags fill it. Pages in between (chains of tellers lack
head words and repeat themselves too) and pages whose curve alone is extreme, whatever their words, are decided by the
mean log-likelihood ratio of their words under the words of the pages decided so far, stuffed against prose; a word
that no stuffed page contains can't speak for stuffing.

What prose is can't be defined by a hot group: equal texts count once in head words, medians and likelihoods, and pages
that repeat their pairs or hold links have no say in head words and medians, so neither copies of a stuffed page nor a
source that varies the same keywords make them common.

Head words are at most four times the mean number of distinct words of a page, so their broadcast is bounded.
Defined results: null and empty texts, and texts of fewer than LEAST_TERMS words, links and tags, aren't stuffed;
repeated rows give one row; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.llm._chars import remover
from twinscript.llm._registry import query
from twinscript.sources.tables import table

#: Share of a script's pages that contain a head word; least number of words, links and tags of a page to judge.
HEAD_SHARE, LEAST_TERMS = 0.25, 8
#: A page has a say in what prose is if so great a share of the pairs in its first words are distinct.
DISTINCT_PAIRS, FIRST_WORDS = 0.7, 128
#: Fewest pages of a length class that are compared among themselves.
LEAST_PAGES = 30
#: Bounds on the ratio of head words to prose, slope below comparable pages, share of links and tags: surely, steeply, to be judged by words.
BARE, BARE_SLOPE, BARE_LINKS = 0.2, 0.08, 0.06
THIN, THIN_SLOPE, THIN_LINKS = 0.3, 0.2, 0.15
OPEN, OPEN_SLOPE, OPEN_LINKS = 0.8, 0.1, 0.05
LINKED = 0.6
#: A curve so much steeper, or fitted so much worse, than comparable pages opens a page by itself.
EXTREME_SLOPE, EXTREME_RESIDUAL = 0.3, 0.15
#: A few keywords repeated equally often have a flat curve, but a high one: so much mean log frequency above comparable pages counts as a slope of one below them.
LEVEL = 5.0

_LINK = re.compile(r"(?:https?:)?//[^\s'\"<>)]+|www\.[^\s'\"<>)]+|\b[a-z0-9-]{3,}\.[a-z]{3,}\b(?:/[^\s'\"<>)]*)?")
_TAG = re.compile(r"#\w+|[$€£]\s?\d[\d.,]*|\b[A-Z]{2,}\d{2,}\b")
_MARKUP = re.compile(r"<[^>]*>")
_JOINED = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))
_DOTTED = re.compile(r"\.[a-z]{3}")
_ARABIC = re.compile("[\u0620-\u064a\u066e-\u06d3]+")
_bare = remover("Mn", "Cf", also="ـ")


def page(text: str) -> tuple[str, list[str], int, int]:
    """(script, words, links, tags) of one text."""
    links = tags = 0
    if "//" in text or "www." in text or _DOTTED.search(text):
        text, links = _LINK.subn(" ", text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "#" in text or "$" in text or "€" in text or "£" in text:
        tags = len(_TAG.findall(text))
        text = _JOINED.sub(" ", text)
    if text.isascii():
        return "latin", list(filter(str.isalpha, text.translate(_ASCII).split())), links, tags
    folded = _bare(unicodedata.normalize("NFC", text)).lower()
    words = list(filter(str.isalpha, _WORD.findall(folded)))
    arabic = len(_ARABIC.findall(folded))
    script = "arabic" if arabic > 0.75 * len(words) else "latin" if arabic < 0.25 * len(words) else "mixed"
    return script, words, links, tags


def plain(words: list[str], links: int, tags: int) -> bool:
    """Whether a page has a say in what prose is: it neither repeats itself nor is filled with links and tags."""
    first = words[:FIRST_WORDS]
    return bool(words) and links + tags <= OPEN_LINKS * (links + tags + len(words)) and len(set(zip(first, first[1:], strict=False))) >= DISTINCT_PAIRS * (len(first) - 1)


def weighed(documents: DataFrame) -> DataFrame:
    """The documents that have a text as (doc_id, text, key, weight); the weights of equal texts add up to one."""
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("key")).where("text is not null and text <> ''")
    copies = texts.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").persist()
    copies.count()  # with its size known, a small table is broadcast and the texts stay where they are
    return texts.join(copies, "key", "left").select("doc_id", "text", "key", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(script, word, n, plain): weighed pages, and weighed plain pages, of a script that contain a word; the word '' counts the pages."""

    def frame(seen: dict[tuple[str, bool], dict[str, float]]) -> pd.DataFrame:
        return pd.DataFrame([(s, w, n, n if p else 0.0) for (s, p), c in seen.items() for w, n in c.items()], columns=["script", "word", "n", "plain"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, bool], Counter] = {}
        for pdf in batches:
            for text, weight in zip(pdf.text, pdf.weight, strict=True):
                script, words, links, tags = page(text)
                c = seen.setdefault((script, plain(words, links, tags)), Counter())
                mine = {*words, ""}
                c.update(mine if weight == 1 else dict.fromkeys(mine, weight))
            if sum(map(len, seen.values())) > 500_000:
                yield frame(seen)
                seen = {}
        yield frame(seen)

    return texts.select("text", "weight").mapInPandas(count, "script string, word string, n double, plain double").groupBy("script", "word").agg(F.round(F.sum("n"), 6).alias("n"), F.round(F.sum("plain"), 6).alias("plain"))


def head_words(counts: DataFrame) -> dict[str, frozenset[str]]:
    """The words that HEAD_SHARE of a script's plain pages contain, by script; of all pages where few are plain."""
    pages = counts.where("word = ''").select(F.col("script").alias("of"), F.col("n").alias("pages"), F.col("plain").alias("plain_pages"))
    enough = F.col("plain_pages") >= LEAST_PAGES
    frequent = counts.where("word <> ''").join(pages, F.col("script") == F.col("of")).where(F.when(enough, F.col("plain")).otherwise(F.col("n")) >= HEAD_SHARE * F.when(enough, F.col("plain_pages")).otherwise(F.col("pages")))
    heads: dict[str, set[str]] = {}
    for script, word in frequent.select("script", "word").collect():
        heads.setdefault(script, set()).add(word)
    return {s: frozenset(w) for s, w in heads.items()}


def page_features(texts: DataFrame, heads: dict[str, frozenset[str]]) -> DataFrame:
    """(doc_id, key, weight, script, words, links, tags, head, plain, curve) of weighed texts; curve lists (frequency, how many pairs have it)."""
    sent = texts.sparkSession.sparkContext.broadcast(heads)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for pdf in batches:
            rows = []
            for doc, text, key, weight in zip(pdf.doc_id, pdf.text, pdf.key, pdf.weight, strict=True):
                script, words, links, tags = page(text)
                mine = known.get(script, frozenset())
                curve = Counter(Counter(zip(words, words[1:], strict=False)).values())
                rows.append((doc, key, weight, script, len(words), links, tags, sum(map(mine.__contains__, words)), plain(words, links, tags), [{"frequency": f, "pairs": m} for f, m in curve.items()]))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "weight", "script", "words", "links", "tags", "head", "plain", "curve"])

    schema = "doc_id bigint, key bigint, weight double, script string, words int, links int, tags int, head int, plain boolean, curve array<struct<frequency int, pairs int>>"
    return texts.where("doc_id is not null").mapInPandas(measure, schema)


def curves(features: DataFrame) -> DataFrame:
    """features with slope, residual and their comparison with pages of the same script and length class."""
    base = features.withColumn("page", F.struct("doc_id", "key", "weight", "words", "links", "tags", "head", "plain"))
    points = base.select("page", "script", F.explode_outer("curve").alias("p")).select("page", "script", "p.frequency", "p.pairs")
    down = Window.partitionBy("page").orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = points.withColumn("rank", F.coalesce(F.sum("pairs").over(down), F.lit(0)) + (F.col("pairs") + 1) / 2)
    w, x, y = F.col("pairs"), F.log("rank"), F.log("frequency")
    sums = ranked.groupBy("page").agg(
        F.first("script").alias("script"), F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy")
    )
    spread = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 1e-9, (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / spread).otherwise(0.0)
    fitted = sums.withColumn("slope", slope).withColumn("intercept", (F.col("y") - F.col("slope") * F.col("x")) / F.col("w"))
    square = (F.col("yy") - F.col("intercept") * F.col("y") - F.col("slope") * F.col("xy")) / F.col("w")
    level = F.coalesce(F.col("y") / F.col("w"), F.lit(0.0))
    return fitted.select("page.*", "script", level.alias("level"), F.coalesce("slope", F.lit(0.0)).alias("slope"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("residual"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, stuffed, ratio, slope, residual, linked) of every text that isn't empty."""
    texts = weighed(documents)
    counts = word_counts(texts).persist()
    f = curves(page_features(texts, head_words(counts))).persist()
    linked = (F.col("links") + F.col("tags")) / F.greatest(F.col("links") + F.col("tags") + F.col("words"), F.lit(1))
    share = F.col("head") / F.greatest(F.col("words") + 2 * (F.col("links") + F.col("tags")), F.lit(1))
    f = f.withColumn("linked", linked).withColumn("share", share).withColumn("length", F.floor(F.log2(F.col("words") + 1)))
    once = f.dropDuplicates(["key"])
    median = lambda c, few: F.percentile_approx(F.when(F.col("plain") | few, F.col(c)), 0.5, 1000)
    medians = lambda of, few: [median(c, few).alias(f"{of}_{c}") for c in ("share", "slope", "level", "residual")]
    few = once.groupBy("script").agg((F.count_if("plain") < LEAST_PAGES).alias("few"))
    by_script = once.join(few, "script").groupBy("script").agg(*medians("script", F.col("few")))
    # a length class of few plain pages, or without head words, is compared with all pages of its script
    by_length = once.groupBy("script", "length").agg(*medians("length", F.lit(False)), F.count_if("plain").alias("pages")).where(F.col("pages") >= LEAST_PAGES).drop("pages")
    f = f.join(by_script, "script").join(by_length, ["script", "length"], "left").withColumn("prose_share", F.when(F.col("length_share") > 0, F.col("length_share")).otherwise(F.col("script_share")))
    f = f.withColumns({f"prose_{c}": F.coalesce(f"length_{c}", f"script_{c}") for c in ("slope", "level", "residual")})
    ratio = F.when(F.col("prose_share") > 0, F.col("share") / F.col("prose_share")).otherwise(1.0)
    f = f.withColumn("ratio", ratio).withColumn("steeper", F.greatest(F.col("prose_slope") - F.col("slope"), (F.col("level") - F.col("prose_level")) / LEVEL))
    enough = F.col("words") + F.col("links") + F.col("tags") >= LEAST_TERMS
    sure = (F.col("ratio") < BARE) & ((F.col("steeper") > BARE_SLOPE) | (F.col("linked") > BARE_LINKS))
    sure |= (F.col("ratio") < THIN) & ((F.col("steeper") > THIN_SLOPE) | (F.col("linked") > THIN_LINKS))
    sure |= (F.col("ratio") < LINKED) & (F.col("linked") > 0.3)
    maybe = (F.col("ratio") < OPEN) & ((F.col("steeper") > OPEN_SLOPE) | (F.col("linked") > OPEN_LINKS))
    maybe |= (F.col("steeper") > EXTREME_SLOPE) | (F.col("residual") - F.col("prose_residual") > EXTREME_RESIDUAL)
    decided = f.withColumn("verdict", F.when(~enough, "prose").when(sure, "stuffed").when(maybe, "open").otherwise("prose")).persist()
    rest = _by_words(texts, decided.select("doc_id", "verdict", "weight"), counts)
    out = decided.join(rest, "doc_id", "left")
    return out.select("doc_id", ((F.col("verdict") == "stuffed") | ((F.col("verdict") == "open") & (F.coalesce("llr", F.lit(-1.0)) > 0))).alias("stuffed"), "verdict", "ratio", "slope", "residual", "linked", "llr")


def _by_words(texts: DataFrame, verdicts: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, llr) of the open pages: mean log-likelihood ratio of their words, stuffed against all others."""
    few = texts.select("doc_id", "text").join(verdicts.where("verdict <> 'prose'"), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, v, g, w, k) for d, v, g, t in zip(pdf.doc_id, pdf.verdict, pdf.weight, pdf.text, strict=True) for w, k in Counter(page(t)[1]).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "verdict", "weight", "word", "k"])

    words = few.mapInPandas(cut, "doc_id bigint, verdict string, weight double, word string, k bigint").persist()
    stuffed = words.where("verdict = 'stuffed'").groupBy("word").agg(F.sum("weight").alias("s"))
    every = counts.groupBy("word").agg(F.sum("n").alias("n"))
    sizes = verdicts.agg(F.sum(F.when(F.col("verdict") == "stuffed", F.col("weight")).otherwise(0.0)).alias("ns"), F.sum("weight").alias("na")).withColumn("one", F.lit(1))
    known = words.where("verdict = 'open'").join(every, "word").join(stuffed, "word", "left").na.fill(0.0, ["s"]).withColumn("one", F.lit(1)).join(sizes, "one")
    llr = F.log((F.col("s") + 0.5) / (F.col("ns") + 1)) - F.log((F.greatest(F.col("n") - F.col("s"), F.lit(0)) + 0.5) / (F.col("na") - F.col("ns") + 1))
    llr = F.when(F.col("s") > 0, llr).otherwise(F.least(llr, F.lit(0.0)))
    bound = F.lit(math.log(50))
    return known.groupBy("doc_id").agg((F.sum(F.col("k") * F.greatest(F.least(llr, bound), -bound)) / F.sum("k")).alias("llr"))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "documents", "doc_id", "text")).where("stuffed").select("doc_id").distinct()

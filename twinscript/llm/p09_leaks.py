"""Problem 9: documents that hold wording of held-out items.

The items' normalised word 5-grams form a hash set that goes to every executor; its size is checked, and items
beyond the bound are scanned in several slices, each with a set of bounded size. Documents are scanned once for
each slice, whole: words are normalised like the items' (case, accents, vowel marks, elongation, look-alikes,
layout), Arabic and other words are separate streams (bilingual pages interleave them), and every window of five
known words is looked up. Hits near each other are verified word by word along their diagonals: a word counts if
it agrees and at least three of the five words around it do, so changed words cost only themselves. 5-grams that
several items share (stock formulas) neither open nor support a case; they are counted over all items, so the result
is the same with any number of slices. A case names the characters of the document it takes up, and either these
spans or the whole documents can be removed.

Defined results: null and empty texts hold nothing; a short item side needs a quarter of its
words, five at least, so one of fewer than five words is never found; repeated
rows give one case; ids may repeat with other texts, each text is scanned.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript.llm._chars import LOOKALIKES, remover
from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

#: Words in an n-gram, least share of an item's words and least number of words for a case (a quarter of a short item's), words between two hits of one passage.
N, LEAST_SHARE, LEAST_WORDS, GAP = 5, 0.23, 8, 60
#: Most characters of item text whose n-grams one slice sends to the executors.
SLICE_CHARS = 20_000_000

_bare = remover("Mn", "Cf", also="ـ")
_LOOKS = re.compile("[" + "".join(LOOKALIKES) + "]")
_LOOK = str.maketrans(LOOKALIKES)
_WORDS = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def folded(text: str) -> str:
    """Lower case without accents, marks and invisible characters, look-alikes replaced."""
    text = _bare(unicodedata.normalize("NFKD", text))
    return (text.translate(_LOOK) if _LOOKS.search(text) else text).lower()


def words_of(text: str) -> list[str]:
    """Normalised words."""
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("-", text)
    if text.isascii():
        return _WORDS.findall(text.lower())
    return _WORDS.findall(folded(text))


_ARABIC = re.compile("[\u0620-\u064a\u0660-\u0669\u066e-\u06d3]+")
_OTHER = re.compile("[^\\W_\u0600-\u06ff]+")


def streams_of(text: str) -> list[list[str]]:
    """The words of a text, Arabic and other ones apart if there are both."""
    if text.isascii():
        return [words_of(text)]
    if "-" in text and "\n" in text:
        text = _BROKEN.sub("-", text)
    plain = folded(text)
    return [x for x in (_ARABIC.findall(plain), _OTHER.findall(plain)) if x]


def places_of(text: str) -> list[list[tuple[int, int]]]:
    """Where the words of each of streams_of(text) stand: (start, end) of the run of characters without white space that holds a word."""
    both: tuple[list, list] = [], []
    for m in re.finditer(r"\S+", text):
        plain = folded(m.group())
        if text.isascii():
            both[1].extend([m.span()] * len(_WORDS.findall(plain)))
        else:
            both[0].extend([m.span()] * len(_ARABIC.findall(plain)))
            both[1].extend([m.span()] * len(_OTHER.findall(plain)))
    return [both[1]] if text.isascii() else [x for x in both if x]


def gram(words: list[str]) -> int:
    """A hash of an n-gram that is the same in every process."""
    return int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


class Index:
    """The items' words and n-grams; shared holds gram() of those that several items have, if it isn't to be told from the items themselves."""

    def __init__(self, items: list[tuple[str, str | None, str | None]], shared: set[int] | None = None) -> None:
        self.words: dict[str, int] = {}
        self.sides: list[tuple[str, np.ndarray]] = []
        formulas: list[np.ndarray] = []
        for item, *texts in items:
            for text in texts:
                words = words_of(text) if text else []
                if len(words) >= N:
                    self.sides.append((item, np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64)))
                    formulas.append(np.array([shared is not None and gram(words[k : k + N]) in shared for k in range(len(words) - N + 1)]))
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for side, (_, ids) in enumerate(self.sides):
            for k, h in enumerate(self.hashes(ids)):
                at[int(h)].append((side, k))
        self.formula = [np.zeros(len(ids), bool) for _, ids in self.sides]
        self.at: dict[int, list[tuple[int, int]]] = {}
        for h, places in at.items():
            if len({self.sides[s][0] for s, _ in places}) > 1 or any(formulas[s][k] for s, k in places):
                for s, k in places:
                    self.formula[s][k : k + N] = True
            else:
                self.at[h] = places
        self.known = np.array(sorted(self.at), np.int64)

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        if len(ids) < N:
            return np.zeros(0, np.int64)
        h = np.zeros(len(ids) - N + 1, np.uint64)
        for j in range(N):
            h = h * np.uint64(1_000_003) + ids[j : len(ids) - N + 1 + j].astype(np.uint64)
            h ^= h >> np.uint64(29)
        return h.astype(np.int64)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(side, place in the item, place in the stream)."""
        if len(ids) < N or not len(self.known):
            return []
        h = self.hashes(ids)
        k = np.searchsorted(self.known, h)
        k[k == len(self.known)] = 0
        out = []
        for p in np.flatnonzero(self.known[k] == h):
            out += [(s, q, int(p)) for s, q in self.at[int(h[p])] if np.array_equal(self.sides[s][1][q : q + N], ids[p : p + N])]
        return out

    def verify(self, ids: np.ndarray, hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(side, words that agree, first place, end) of each passage that makes a case."""
        by_side: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, q, p in hits:
            by_side[s].append((p, q))
        for s, places in by_side.items():
            item, own = self.sides[s][1], ~self.formula[s]
            least = max(min(LEAST_WORDS, max(N, math.ceil(len(item) / 4))), LEAST_SHARE * len(item))
            places.sort()
            cluster: list[tuple[int, int]] = []
            for place in [*places, None]:
                if place is not None and (not cluster or place[0] - cluster[-1][0] <= GAP):
                    cluster.append(place)
                    continue
                agree = np.zeros(len(item), bool)
                low_end, high_end = len(ids), 0
                lines: list[tuple[int, np.ndarray]] = []
                bound = 0
                for diagonal in {p - q for p, q in cluster}:
                    low, high = max(0, -diagonal), min(len(item), len(ids) - diagonal)
                    same = np.zeros(len(item), bool)
                    np.equal(item[low:high], ids[low + diagonal : high + diagonal], out=same[low:high])
                    lines.append((diagonal, same))
                    bound += np.count_nonzero(same)
                if bound < least:  # all words that agree on any diagonal are too few
                    cluster = [place] if place is not None else []
                    continue
                for diagonal, same in lines:
                    near = np.convolve(same, np.ones(5, int), "same") >= 3
                    # only what hangs together with a hit of this diagonal: gaps of up to two changed words
                    at = np.flatnonzero(same & near)
                    if len(at):
                        part = np.cumsum(np.diff(at, prepend=at[0]) > 3)
                        held = np.unique(part[np.isin(at, [q for p, q in cluster if p - q == diagonal])])
                        taken = at[np.isin(part, held)]
                        agree[taken] = True
                        if len(taken):
                            low_end, high_end = min(low_end, int(taken[0]) + diagonal), max(high_end, int(taken[-1]) + diagonal + 1)
                n = int((agree & own).sum())
                if n >= least:
                    yield s, n, low_end, high_end
                cluster = [place] if place is not None else []


def _slices(items: DataFrame, chars: int) -> Iterator[Broadcast]:
    """Items(id, arabic, reference_english) slice by slice on their way to the executors."""
    context = items.sparkSession.sparkContext
    kept = items.select("id", "arabic", "reference_english").where("id is not null").distinct()
    size = kept.agg(F.sum(F.coalesce(F.length("arabic"), F.lit(0)) + F.coalesce(F.length("reference_english"), F.lit(0)))).first()[0] or 0
    slices = -(-size // chars) or 1

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, *texts in zip(pdf.id, pdf.arabic, pdf.reference_english, strict=True):
                for words in (words_of(x) for x in texts if isinstance(x, str)):
                    rows += [(item, gram(words[k : k + N])) for k in range(len(words) - N + 1)]
            yield pd.DataFrame(rows, columns=["id", "gram"])

    shared = None
    if slices > 1:
        every = kept.mapInPandas(grams, "id string, gram bigint").distinct()
        shared = cut_lineage(every.join(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "gram", "left_semi"))
    for k in range(slices):
        here = F.pmod(F.xxhash64("id"), F.lit(slices)) == k
        rows = [tuple(r) for r in kept.where(here).orderBy("id").collect()]
        # of the shared n-grams only those of this slice's items, so their number is bounded too
        yield context.broadcast((rows, None if shared is None else {r["gram"] for r in shared.where(here).select("gram").distinct().collect()}))


def _cases(index: Index, text: str, spans: bool) -> list[tuple[str, int, float, int, int]]:
    """(item, words, share, start, end) of every passage of a text that makes a case; start and end are characters, 0 unless spans are wanted."""
    out, places = [], None
    for k, stream in enumerate(streams_of(text)):
        ids = np.fromiter(map(index.words.get, stream, repeat(0)), np.int64, len(stream))
        if hits := index.hits(ids):
            for s, n, first, end in index.verify(ids, hits):
                places = places or (places_of(text) if spans else None)
                out.append((index.sides[s][0], n, n / len(index.sides[s][1]), places[k][first][0] if places else 0, places[k][end - 1][1] if places else 0))
    return out


def leaks(documents: DataFrame, items: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, words, share) for every document(doc_id, text) that holds wording of items(id, arabic, reference_english)."""
    out = None
    for sent in _slices(items, slice_chars):

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(*sent.value)
            for pdf in batches:
                found = [(doc, *case[:3]) for doc, text in zip(pdf.doc_id, pdf.text, strict=True) if isinstance(text, str) and text for case in _cases(index, text, False)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "words", "share"])

        part = documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(scan, "doc_id bigint, item_id string, words bigint, share double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("share").alias("share"))


def without_spans(documents: DataFrame, items: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents, all columns, with the passages that make cases cut out of their text (a space stays); cut counts the characters taken.

    Passages are found and cut in one pass, so no text is shuffled.
    """
    out = documents.withColumn("cut", F.lit(0).cast("bigint"))
    for sent in _slices(items, slice_chars):

        def clean(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(*sent.value)
            for pdf in batches:
                texts, cuts = pdf.text.tolist(), pdf.cut.tolist()
                for row, text in enumerate(texts):
                    if not isinstance(text, str) or not text:
                        continue
                    for start, end in reversed(_united([case[3:] for case in _cases(index, text, True)])):
                        texts[row] = texts[row][:start] + " " + texts[row][end:]
                        cuts[row] += end - start
                yield pdf.assign(text=pd.Series(texts, pdf.index, object), cut=cuts)

        out = out.mapInPandas(clean, out.schema)
    return out


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of which none touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no wording of the items, all columns."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "id", "arabic", "reference_english"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@query("p9_leaked_items")
def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that hold it and the greatest share found in one of them."""
    items = table(spark, d, "eval_items", "id").withColumnRenamed("id", "item_id").distinct()
    found = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("most"))
    return items.join(found, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most", F.lit(0.0)).alias("most"))


@query("p9_cleaned")
def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents that lose passages, with what is left of their text."""
    rows = table(spark, d, "documents", "doc_id", "text")
    return without_spans(rows, table(spark, d, "eval_items", "id", "arabic", "reference_english")).where("cut > 0")

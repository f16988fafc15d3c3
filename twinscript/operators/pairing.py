"""Units of two sides paired by order, by names, or by length between names; passages cut out of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import names
from twinscript.functions import text as t
from twinscript.operators.alignment import length_partition, proportional
from twinscript.session import cut_lineage

#: Least letters of names that make a pair certain.
LEAST_MASS = 3


def variants(skeleton: Column) -> Column:
    """A name's skeleton with the other spellings of two sounds."""
    return F.array_distinct(F.array(skeleton, F.replace(skeleton, F.lit("dh"), F.lit("z")), F.replace(skeleton, F.lit("dh"), F.lit("d")), F.replace(skeleton, F.lit("th"), F.lit("t"))))


def telling_names(c: Column | str) -> Column:
    """Skeletons of three letters or more of words that are long or hold a sound that only names have: capitals alone tell little."""
    words = F.transform(t.words(c), lambda w: F.regexp_replace(w, "^[.,;:!?\"“”]+|[.,;:!?\"“”]+$", ""))
    usable = F.filter(words, lambda w: (F.length(w) >= 7) | F.lower(w).rlike("dh|kh|gh|qā|ibn"))
    return names.name_skeletons(F.array_join(usable, " "), 3)


def name_mass(english: Column | str, arabic: Column | str) -> Column:
    """Letters of the English text's telling names that the Arabic one holds, each name once for each time it is written."""
    h, w = t.arabic_skeleton(arabic, "h"), t.arabic_skeleton(arabic, "t")
    best = lambda s: F.array_max(F.transform(variants(s), lambda v: F.when((F.length(v) >= LEAST_MASS) & (F.contains(h, v) | F.contains(w, v)), F.length(v)).otherwise(0)))
    return F.coalesce(F.aggregate(telling_names(english), F.lit(0), lambda n, s: n + best(s)), F.lit(0))


def in_order(a: DataFrame, b: DataFrame, by: str, at: str) -> DataFrame:
    """a and b paired by their running numbers within each key; what one side has more is left out. Columns of a get the prefix a_, of b the prefix b_."""
    ranked = lambda df, p: df.select(by, F.row_number().over(Window.partitionBy(by).orderBy(at)).alias("pair"), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != by))
    return ranked(a, "a").join(ranked(b, "b"), [by, "pair"])


def rising_anchors(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, x, y, mass): places of a(by, at, title) and b(by, at, title) that share names, rising on both sides; of each place of a the heaviest of b after the last one taken, ties to the first.

    What is measured of each pair is found by joining a's names to b's, so only pairs that share some go to the walk.
    """
    # names and skeletons are made once for each unit; a pair meets where a name's first three letters are in the other's text
    left = a.select(by, F.col("at").alias("x"), t.arabic_skeleton("title", "h").alias("h"), t.arabic_skeleton("title", "t").alias("w"))
    right = b.select(by, F.col("at").alias("y"), F.transform(telling_names("title"), lambda s: F.filter(variants(s), lambda v: F.length(v) >= LEAST_MASS)).alias("called"))
    left, right = cut_lineage(left), cut_lineage(right.where("size(called) > 0"))
    threes = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(3)))
    offered = left.select(by, "x", F.explode(F.array_union(threes("h"), threes("w"))).alias("three"))
    wanted = right.select(by, "y", F.explode(F.array_distinct(F.transform(F.flatten("called"), lambda v: F.substring(v, 1, 3)))).alias("three"))
    met = offered.join(wanted, [by, "three"]).select(by, "x", "y").distinct()
    best = lambda some: F.coalesce(F.array_max(F.transform(F.filter(some, lambda v: F.contains("h", v) | F.contains("w", v)), lambda v: F.length(v))), F.lit(0))
    heavy = met.join(left, [by, "x"]).join(right, [by, "y"]).select(by, "x", "y", F.aggregate("called", F.lit(0), lambda n, some: n + best(some)).alias("mass")).where(F.col("mass") >= LEAST_MASS)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, cursor = [], -1
        for _, some in pdf.sort_values(["x", "mass", "y"], ascending=[True, False, True], kind="stable").groupby("x", sort=True):
            ahead = some[some.y > cursor]
            if len(ahead):
                out.append(ahead.iloc[0])
                cursor = int(out[-1].y)
        return pd.DataFrame(out, columns=pdf.columns)

    return heavy.groupBy(by).applyInPandas(walk, heavy.schema)


def cover(source: list[float], target: list[float]) -> list[tuple[int, int]]:
    """Range of source units for each target unit: by length where there are enough, else in proportion."""
    n, m = len(target), len(source)
    if not n or not m:
        return [(0, 0)] * n
    if n == 1:
        return [(0, m)]
    if m == 1:
        return [(0, 1)] * n
    if m >= n:
        return length_partition([max(1, x) for x in target], [max(1, x) for x in source], 1, max(8, -(-(m + n) // n)))
    return [(i, max(k, i + 1) if i < m else i) for i, k in proportional(n, m)]


def zip_units(source: list[float], target: list[float], anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Range of target units for each source unit, by lengths between anchors (source place, target place) that hold on both sides."""
    locks = [(0, 0)]
    for x, y in [*sorted(anchors), (len(source), len(target))]:
        if x >= locks[-1][0] and y >= locks[-1][1] and (x, y) != locks[-1]:
            locks.append((x, y))
    out: list[tuple[int, int] | None] = [None] * len(source)
    for (x, y), (x2, y2) in zip(locks, locks[1:], strict=False):
        for k, (i, j) in enumerate(cover(source[x:x2], target[y:y2])):
            for at in range(x + i, min(x + j, x2)):
                first, last = out[at] or (y + k, y + k)
                out[at] = min(first, y + k), max(last, y + k + 1)
    return [r or (0, 0) for r in out]


def zipped(units: DataFrame, by: str, anchors: DataFrame) -> DataFrame:
    """(by, at, first, last): the target units, last excluded, of each source unit of units(by, side 'a' or 'b', at, words); anchors(by, x, y) are places."""
    marked = units.select(by, "side", "at", F.col("words").cast("double").alias("words"), F.lit(None).cast("int").alias("to")).unionByName(anchors.select(by, F.lit("z").alias("side"), F.col("x").alias("at"), F.lit(None).cast("double").alias("words"), F.col("y").cast("int").alias("to")))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, z = (pdf[pdf.side == s].sort_values("at", kind="stable") for s in "abz")
        place = {s: {v: k for k, v in enumerate(side["at"])} for s, side in (("a", a), ("b", b))}
        fixed = [(place["a"][x], place["b"][int(y)]) for x, y in zip(z["at"], z["to"], strict=True) if x in place["a"] and int(y) in place["b"]]
        made = zip_units(a.words.tolist(), b.words.tolist(), fixed)
        return pd.DataFrame([(key[0], at, *r) for at, r in zip(a["at"], made, strict=True)], columns=[by, "at", "first", "last"])

    return marked.groupBy(by).applyInPandas(work, f"{by} string, at int, first int, last int")


def range_hit(start: Column | str, end: Column | str, gold_start: Column | str, gold_end: Column | str, window: int = 0) -> Column:
    """Whether a range, widened on both sides, meets another."""
    a, b, x, y = (F.col(c) if isinstance(c, str) else c for c in (start, end, gold_start, gold_end))
    return (a - window < y) & (b + window > x)


def passages(ranges: DataFrame, units: DataFrame, by: str, side: str, first: str, last: str) -> DataFrame:
    """ranges with the text and words of the units(by, at, text) they span; a range without units has an empty text. The ranges are spread over their places, so they meet units by equality."""
    spread = ranges.withColumn("_id", F.xxhash64(*ranges.columns))
    places = spread.where(F.col(last) > F.col(first)).select("_id", by, F.explode(F.sequence(F.col(first), F.col(last) - 1)).alias("at"))
    joined = places.join(units.select(by, "at", "text"), [by, "at"]).groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias(side))
    return spread.join(joined, "_id", "left").withColumn(side, F.coalesce(side, F.lit(""))).withColumn(f"{side}_words", t.word_count(side)).drop("_id")


def shared_cuts(sizes: DataFrame, by: str, passages_words: int) -> DataFrame:
    """(by, cut, first, last): consecutive units(by, at, words) in cuts of about so many words: a unit belongs to the cut that its first word falls into."""
    before = F.coalesce(F.sum("words").over(Window.partitionBy(by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("cut", F.floor(before / passages_words)).groupBy(by, "cut").agg(F.min("at").alias("first"), (F.max("at") + 1).alias("last"), F.sum("words").alias("words"))

"""Sequential kernels of alignment, one group at a time, and the relations around them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscript.functions import names
from twinscript.functions import text as t

# Sentences of both sides that one link may join; what skipping one costs; words of the target for each of the source.
MOVES = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1), (1, 0), (0, 1))
SKIP, RATIO = 2.4, 1.55
# Weights of names, numbers, length, and of names and length together (at most one), and what each further sentence costs.
WEIGHTS, FATTER = (0.2, 0.1, 0.1, 0.6), 0.05
# Bounds of the confidence, and those from which a link is within no or one place of the truth.
CONFIDENCE, CLOSE = (0.12, 0.97), (0.9, 0.75)
#: Most cells of a table that are kept at once.
MOST_CELLS = 500_000

#: gains(first, last, a, e): an array with a row for each source place of first to last - 1 and the score of its span of a with every span of e.
Gains = Callable[[int, int, int, int], np.ndarray]


class SpanScores:
    """Scores of spans of two lists of sentences by what is measured of each: words, numbers, and names against skeletons."""

    def __init__(self, source: pd.DataFrame, target: pd.DataFrame) -> None:
        self.n, self.m = len(source), len(target)
        self.words = [np.concatenate([[0], np.cumsum(side.words.to_numpy(np.int64))]) for side in (source, target)]
        self.numbers = [[frozenset(x) for x in side.numbers] for side in (source, target)]
        self.skeletons = [source.with_h.tolist(), source.with_t.tolist()]
        self.names = [list(x) for x in target.names]
        self.in_target: dict[str, dict[int, int]] = {}
        for j, some in enumerate(self.names):
            for name in some:
                self.in_target.setdefault(name, {}).setdefault(j, 0)
                self.in_target[name][j] += 1
        self.with_number = [j for j, x in enumerate(self.numbers[1]) if x]
        self.any_number = any(self.numbers[0]) and bool(self.with_number)

    def _named(self, first: int, last: int, a: int, e: int) -> np.ndarray:
        """Share of each target span's names that each source span holds."""
        columns = self.m - e + 1
        found, every = np.zeros((last - first, columns)), np.zeros(columns)
        blobs = [["".join(c for k, c in enumerate(x) if k == 0 or c != x[k - 1]) if a > 1 else x for x in ("".join(side[i : i + a]) for i in range(first, last))] for side in self.skeletons]
        for name, places in self.in_target.items():
            here = np.zeros(self.m + 1)
            here[list(places)] = list(places.values())
            sums = np.concatenate([[0.0], np.cumsum(here)])
            count = sums[e : e + columns] - sums[:columns]
            every += count
            rows = [i for i, (h, w) in enumerate(zip(*blobs, strict=True)) if name in h or name in w]
            if rows:
                at = np.flatnonzero(count)
                found[np.ix_(rows, at)] += count[at]
        return np.divide(found, every, out=np.zeros_like(found), where=every > 0)

    def _numbered(self, first: int, last: int, a: int, e: int) -> np.ndarray:
        """Numbers in common of all numbers, for spans that have some."""
        out = np.zeros((last - first, self.m - e + 1))
        if not self.any_number:
            return out
        columns = sorted({k for j in self.with_number for k in range(max(0, j - e + 1), min(j, self.m - e) + 1)})
        theirs = [frozenset().union(*self.numbers[1][j : j + e]) for j in columns]
        for i in range(first, last):
            mine = frozenset().union(*self.numbers[0][i : i + a])
            if mine:
                out[i - first, columns] = [len(mine & x) / len(mine | x) for x in theirs]
        return out

    def __call__(self, first: int, last: int, a: int, e: int) -> np.ndarray:
        w, v = self.words[0][first + a : last + a] - self.words[0][first:last], self.words[1][e:] - self.words[1][: self.m + 1 - e]
        length = np.exp(-np.abs(np.log(np.maximum(1, v)[None, :] / np.maximum(1.0, RATIO * np.maximum(1, w))[:, None])))
        named = self._named(first, last, a, e)
        by_name, by_number, by_length, by_both = WEIGHTS
        score = by_name * named + by_number * self._numbered(first, last, a, e) + by_length * length + by_both * np.minimum(1.0, named + length)
        return np.where((w == 0)[:, None] | (v == 0)[None, :], -SKIP, score)


def best_path(n: int, m: int, gains: Gains, skip: float = SKIP, moves=MOVES) -> list[tuple[int, int, int, int, float]]:
    """Best monotone path of spans (source start, end, target start, end, score); ends exclusive, of equal paths the first.

    A row of the table is filled at once: its links from the rows before, its skips by a running maximum. Of a table
    beyond MOST_CELLS only some rows are kept, and the rows between two of them are filled again on the way back, so
    the path is that of the whole table in bounded memory.
    """
    pairs = sorted(((a, e) for a, e in moves if a and e), reverse=True)
    steps = [*pairs, (1, 0), (0, 1)]
    deep = max((a for a, _ in pairs), default=1)
    slope = skip * np.arange(m + 1)

    def fill(before: list[np.ndarray], first: int, last: int, keep: bool) -> tuple[list[np.ndarray], np.ndarray, dict]:
        """The last rows before last, the step into each cell of rows first to last - 1, and the scores of the links into them by move, with the source place of their first row."""
        came = np.zeros((last - first if keep else 0, m + 1), np.int8)
        made = {}
        for a, e in pairs:
            low, high = max(first - a, 0), last - a
            if high > low and e <= m:
                made[a, e] = low, gains(low, high, a, e) - FATTER * (a + e - 2)
        for i in range(first, last):
            row, step = np.full(m + 1, -np.inf), np.zeros(m + 1, np.int8)
            if i == 0:
                row[0] = 0.0
            for k, (a, e) in enumerate(pairs):
                if a <= i and e <= m:
                    low, table = made[a, e]
                    value = before[-a][: m + 1 - e] + table[i - a - low]
                    better = value > row[e:]
                    row[e:][better], step[e:][better] = value[better], k
            if i:
                value = before[-1] - skip
                better = value > row
                row[better], step[better] = value[better], len(pairs)
            best = np.maximum.accumulate(row + slope)
            skipped = best > row + slope
            row = np.where(skipped, best - slope, row)
            step[skipped] = len(pairs) + 1
            before = [*before, row][-deep:]
            if keep:
                came[i - first] = step
        return before, came, made

    size = max(deep, MOST_CELLS // (m + 1))
    starts, kept, before = range(0, n + 1, size), [], []
    for first in starts:
        kept.append(before)
        if first != starts[-1]:
            before, _, _ = fill(before, first, first + size, False)
    out, i, j = [], n, m
    for first in reversed(starts):
        _, came, made = fill(kept.pop(), first, min(first + size, n + 1), True)
        while i >= first and (i, j) != (0, 0):
            a, e = steps[came[i - first, j]]
            score = -skip
            if a and e:
                low, table = made[a, e]
                score = float(table[i - a - low, j - e])
            out.append((i - a, i, j - e, j, score))
            i, j = i - a, j - e
    return out[::-1]


def _linked(unit: str, n: int, m: int, path: list[tuple[int, int, int, int, float]]) -> Iterator[tuple]:
    """A row for each link; of a unit with one side only, each sentence is an addition or an omission."""
    for i, k, j, x, score in path:
        skips = k == i or x == j
        if not n or not m:
            yield unit, i, k, j, x, f"{k - i}-{x - j}", score, 0.15, 3, ["arabic_omission" if n else "english_addition"]
            continue
        confidence = min(CONFIDENCE[1], max(CONFIDENCE[0], 0.5 + score / 4))
        radius = sum(confidence < c for c in CLOSE)
        yield unit, i, k, j, x, f"{k - i}-{x - j}", round(score, 6), round(confidence, 6), 2 if skips else radius, ["skip"] if skips else []


LINKS = "unit string, a_start int, a_end int, b_start int, b_end int, operation string, score double, confidence double, radius int, flags array<string>"


def align_groups(units: DataFrame) -> DataFrame:
    """units(unit, side 'a' or 'b', seq, text) as links (unit, a_start, a_end, b_start, b_end, operation, score, confidence, radius, flags).

    What scores need of a text is measured before the shuffle, which then carries skeletons instead of texts.
    """
    source = F.col("side") == "a"
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    measured = units.select(
        "unit", "side", "seq", t.word_count("text").alias("words"), F.array_distinct(F.regexp_extract_all(t.western_digits(text), F.lit("([0-9]+)"), 1)).alias("numbers"),
        F.when(source, t.arabic_skeleton(text, "h")).otherwise("").alias("with_h"), F.when(source, t.arabic_skeleton(text, "t")).otherwise("").alias("with_t"), F.when(source, none).otherwise(names.name_skeletons(text)).alias("names"),
    )

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        a, b = (pdf[pdf.side == s] for s in "ab")
        return pd.DataFrame(_linked(key[0], len(a), len(b), best_path(len(a), len(b), SpanScores(a, b))), columns=[c.split()[0] for c in LINKS.split(", ")])

    # the work is in the groups, not in their bytes, by which partitions would be put together
    spread = measured.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    return spread.groupBy("unit").applyInPandas(work, LINKS)


def length_partition(units: list[float], fragments: list[float], least: int = 1, most: int | None = None) -> list[tuple[int, int]]:
    """Consecutive fragments for each unit so that lengths are in proportion: least sum of squared log ratios."""
    n, m = len(units), len(fragments)
    most = most or m
    if not n * least <= m <= n * most:
        raise ValueError(f"{m} fragments can't be shared among {n} units of {least} to {most}")
    scale = (sum(fragments) or 1) / (sum(units) or 1)
    prefix = np.concatenate([[0.0], np.cumsum(fragments)])
    # only places from which the rest can still be shared out: low[i] to high[i]
    low, high = [max(i * least, m - (n - i) * most) for i in range(n + 1)], [min(i * most, m - (n - i) * least) for i in range(n + 1)]

    def fill(row: np.ndarray, first: int, last: int, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """The costs of unit last, and the fragments each place of units first + 1 to last takes."""
        takes = []
        for i in range(first + 1, last + 1):
            here, take = np.full(high[i] - low[i] + 1, np.inf), np.zeros(high[i] - low[i] + 1, np.int32)
            for k in range(least, most + 1):
                start, end = max(low[i], low[i - 1] + k), min(high[i], high[i - 1] + k)
                if start > end:
                    continue
                j = slice(start, end + 1)
                length = prefix[j] - prefix[start - k : end - k + 1]
                c = row[start - k - low[i - 1] : end - k - low[i - 1] + 1] + np.log((length + 1) / (units[i - 1] * scale + 1)) ** 2
                at = slice(start - low[i], end - low[i] + 1)
                better = c < here[at]
                here[at][better], take[at][better] = c[better], k
            row = here
            if keep:
                takes.append(take)
        return row, takes

    # of a table beyond MOST_CELLS only every so many rows are kept, the others are filled again on the way back
    size = max(1, MOST_CELLS // (max(h - x for h, x in zip(high, low, strict=True)) + 1))
    starts, kept, row = range(0, n, size), [], np.zeros(1)
    for first in starts:
        kept.append(row)
        if first != starts[-1]:
            row, _ = fill(row, first, first + size, False)
    out, j = [], m
    for first in reversed(starts):
        takes = fill(kept.pop(), first, min(first + size, n), True)[1]
        for i in range(min(first + size, n), first, -1):
            k = int(takes[i - first - 1][j - low[i]])
            out.append((j - k, j))
            j -= k
    return out[::-1]


def monotone_chain(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The heaviest chain that rises in both coordinates."""
    pts = sorted(points)
    best, back = [p[2] for p in pts], [-1] * len(pts)
    for i, (x, y, w) in enumerate(pts):
        for j in range(i):
            if pts[j][0] < x and pts[j][1] < y and best[j] + w > best[i]:
                best[i], back[i] = best[j] + w, j
    i = max(range(len(pts)), key=best.__getitem__, default=-1)
    out = []
    while i >= 0:
        out.append(pts[i])
        i = back[i]
    return out[::-1]


def rising_run(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def proportional(n: int, m: int) -> list[tuple[int, int]]:
    """n ranges that share m places in proportion."""
    return [(i * m // n, (i + 1) * m // n) for i in range(n)]


def gold_metrics(links: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gold pairs(work_id, x, y) that links(work_id, x_start, x_end, y_start, y_end) hit exactly, within one and two, or not at all.

    Links are spread over the places they cover, so places meet by equality however many links a work has.
    """
    covered = links.where("x_end > x_start").select("work_id", F.explode(F.sequence("x_start", F.col("x_end") - 1)).alias("x"), "y_start", "y_end").distinct()
    j = gold.join(covered, ["work_id", "x"], "left")
    away = F.when(F.col("y_start").isNull(), None).when(F.col("y") < F.col("y_start"), F.col("y_start") - F.col("y")).when(F.col("y") >= F.col("y_end"), F.col("y") - F.col("y_end") + 1).otherwise(0)
    per = j.withColumn("away", away).groupBy("work_id", "x", "y").agg(F.min("away").alias("away"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return per.agg(F.count("*").alias("gold"), share(F.col("away") == 0).alias("exact"), share(F.col("away") <= 1).alias("within_1"), share(F.col("away") <= 2).alias("within_2"), share(F.col("away").isNull() | (F.col("away") > 2)).alias("missed"))


def coverage(ids: DataFrame, covered: DataFrame, key: str, *by: str) -> DataFrame:
    """Share of ids that are covered."""
    c = covered.select(key).distinct().withColumn("_c", F.lit(1))
    return ids.join(c, key, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count("_c").alias("covered"), F.round(F.count("_c") / F.count("*"), 6).alias("coverage"))


def buffer_hits(links: DataFrame, gold: DataFrame, window: int) -> DataFrame:
    """gold(work_id, x, y) with hit: y lies in the target span, widened by the window, of a link that covers x."""
    covered = links.where("x_end > x_start").select("work_id", F.explode(F.sequence("x_start", F.col("x_end") - 1)).alias("x"), "y_start", "y_end")
    inside = (F.col("y") >= F.col("y_start") - window) & (F.col("y") < F.col("y_end") + window)
    return gold.join(covered, ["work_id", "x"], "left").groupBy("work_id", "x", "y").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("hit"))


def range_overlaps(links: DataFrame) -> DataFrame:
    """Pairs of links of one work whose source ranges overlap, by a window over starts instead of a pairwise join."""
    w = Window.partitionBy("work_id").orderBy("arabic_start", "arabic_end").rowsBetween(Window.unboundedPreceding, -1)
    return links.withColumn("before", F.max("arabic_end").over(w)).where(F.col("arabic_start") < F.col("before"))

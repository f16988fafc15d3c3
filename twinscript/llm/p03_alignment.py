"""Problem 3: sentences that translate each other, by geometric bitext correspondence.

A lexicon of word translations is learnt from the proposals in dp_links (noise averages out); words it lacks are
compared by their consonants, numbers by value. Both languages' sentences become lists of concepts. The proposals and
structural links give each stretch of a work a local offset and spread by medians, so wrong ones don't count; in works
where they leave a stretch with few points, concepts that occur once on each side are anchors too, and a stretch that
still has none lies between its neighbours, with a rectangle that widens with the distance to them. In the rectangle
around the expected place points of correspondence are searched: sentence pairs whose shared concepts weigh enough in
the lighter sentence. Per stretch (of bounded size, with margins) the heaviest chain of slope-consistent points is
kept, noisy points go, and what remains unmatched on both sides is paired where an inversion explains it. Points with a
common sentence make blocks of several sentences.

Nothing is gathered by work: points are searched in tiles of STRETCH Arabic and CELL English sentences, chains in
stretches. Defined results: null or empty sentences match nothing; repeated rows count once, of several texts of one
place the one with the lowest hashes; a work with one language only has no pairs; ties go to the earlier place; missing
dp_links or structural_links only cost anchors; links that point to no sentence are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscript.llm._chars import LOOKALIKES, without_marks
from twinscript.llm._names import bones, roman
from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

#: Arabic sentences to a stretch, its margin, English sentences to a tile, least and further half width of a rectangle for each sentence of spread.
STRETCH, MARGIN, CELL, HALF, SPREAD = 256, 32, 512, 24, 3.0
#: Fewest points that tell where a stretch lies, and half width for each sentence of distance to a stretch that has them.
LEAST_POINTS, DRIFT = 5, 0.1
#: Proposals of more sentences are read as a diagonal instead of as all their pairs.
WIDE = 4
#: Least share of the lighter sentence's weight that a pair shares, and for an inversion of both sentences; farthest inversion.
LEAST_SHARED, LEAST_INVERTED, FARTHEST = 0.55, 0.6, 40
#: Words in more sentences than this share of a language carry no content; least support of a translation.
COMMON, LEAST_SUPPORT, LEAST_GIVEN, LEAST_LIFT = 0.1, 2, 0.3, 4.0
#: Most tokens whose words a task remembers (it forgets them all beyond), most words whose concepts are sent to the executors.
REMEMBERED, MOST_SENT = 200_000, 1_000_000

_WORD = re.compile(r"[^\W_]+")
_LOOK = str.maketrans(LOOKALIKES | {chr(0x660 + k): str(k) for k in range(10)} | {chr(0x6F0 + k): str(k) for k in range(10)})


def words(text: str, arabic: bool) -> list[str]:
    """Normalised words: articles and joined prepositions off in Arabic, plural endings in English."""
    t = text if text.isascii() else without_marks(unicodedata.normalize("NFKD", text)).translate(_LOOK)
    t = t.lower().replace("لـ", " ").replace("ـ", "")
    out = []
    for w in _WORD.findall(t):
        if arabic:
            for head in ("وال", "بال", "لل", "ال"):
                if w.startswith(head) and len(w) > len(head) + 1:
                    w = w[len(head) :]
                    break
        elif len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
            w = w[:-2] if w.endswith(("xes", "ches", "shes", "sses", "zes")) else w[:-1]
        out.append(w)
    return list(dict.fromkeys(out))


def _hash(kind: str, word: str) -> int:
    return int.from_bytes(blake2b((kind + word).encode(), digest_size=8).digest(), "little", signed=True)


def hashed(word: str, arabic: bool) -> tuple[int, int]:
    """Hashes of a word and of its consonants, 0 where there are too few; the first is odd for numbers only."""
    number = word.isdigit()
    b = "" if number else bones(word if arabic else roman(word))
    return _hash("=", word) & ~1 | number, _hash("~", b) if len(b) > 1 else 0


class _Memory(dict):
    """Values made by a function when first asked for; all are forgotten beyond REMEMBERED."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str):
        if len(self) > REMEMBERED:
            self.clear()
        self[key] = value = self.make(key)
        return value


def _memory(arabic: bool) -> _Memory:
    """The hashed words of each token; words and tokens repeat, so each is made once."""
    of_word = _Memory(lambda w: hashed(w, arabic))
    return _Memory(lambda token: [of_word[w] for w in words(token, arabic)])


def _sentences(sentences: DataFrame) -> DataFrame:
    """(work, language, at, t): a row for each sentence; t lists its words, each once, as hashes w of the word and b of its consonants."""
    s = sentences.where("language in ('ar', 'en') and id is not null and global_sequence is not null and text is not null")
    s = s.select(F.xxhash64("work_id").alias("work"), "language", F.col("global_sequence").alias("at"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = {"ar": _memory(True), "en": _memory(False)}
        for batch in batches:
            ends, flat_w, flat_b = [0], [], []
            for text, language in zip(batch["text"].to_pylist(), batch["language"].to_pylist(), strict=True):
                of = memory[language]
                found = dict(pair for token in text.split() for pair in of[token])
                flat_w += found
                flat_b += found.values()
                ends.append(len(flat_w))
            structs = pa.StructArray.from_arrays([pa.array(flat_w, pa.int64()), pa.array(flat_b, pa.int64())], ["w", "b"])
            yield pa.RecordBatch.from_arrays([batch["work"], batch["language"], batch["at"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], ["work", "language", "at", "t"])

    made = cut_lineage(s.mapInArrow(cut, "work bigint, language string, at int, t array<struct<w:bigint,b:bigint>>"))
    # places with several rows are few: only they are gathered, if there are any
    place = ["work", "language", "at"]
    twice = cut_lineage(made.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if twice.isEmpty():
        return made
    return made.join(twice, place, "left_anti").unionByName(made.join(twice, place, "left_semi").groupBy(*place).agg(F.min("t").alias("t")))


def _proposals(dp_links: DataFrame) -> DataFrame:
    """(work, x, y): places that an earlier run linked, one row for each pair; of wide proposals the places about their diagonal."""
    good = dp_links.where("arabic_start >= 0 and english_start >= 0 and arabic_end > arabic_start and english_end > english_start")
    x = good.select(F.xxhash64("work_id").alias("work"), "arabic_start", "arabic_end", "english_start", "english_end", F.explode(F.sequence("arabic_start", F.col("arabic_end") - 1)).alias("x"))
    n, m = F.col("arabic_end") - F.col("arabic_start"), F.col("english_end") - F.col("english_start")
    low = F.floor((F.col("x") - F.col("arabic_start")) * m / n).cast("int")
    high = F.ceil((F.col("x") - F.col("arabic_start") + 1) * m / n).cast("int") - 1
    wide = F.greatest(n, m) > WIDE
    ys = F.sequence(F.col("english_start") + F.when(wide, low).otherwise(0), F.col("english_start") + F.when(wide, F.greatest(low, high)).otherwise(m - 1))
    return x.select("work", "x", F.explode(ys).alias("y")).distinct()


def vocabulary(s: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """(language, w, b, n): in how many sentences each word is; the number of sentences; the words in more than the share COMMON of a language's.

    At most mean words / COMMON words of a language can be that common, so their list is bounded and may go to the driver.
    """
    counts = cut_lineage(s.select("language", F.explode("t").alias("t")).groupBy("language", "t.w", "t.b").agg(F.count("*").alias("n")))
    sizes = {r["language"]: r["n"] for r in s.groupBy("language").agg(F.count("*").alias("n")).collect()}
    least = F.when(F.col("language") == "ar", sizes.get("ar", 0) * COMMON).otherwise(sizes.get("en", 0) * COMMON)
    return counts, sum(sizes.values()), sorted({r["w"] for r in counts.where(F.col("n") > least).select("w").collect()})


def lexicon(s: DataFrame, proposals: DataFrame, common: list[int]) -> DataFrame:
    """(e, a): the Arabic word that each English word stands for, as hashes."""
    ar = s.where("language = 'ar'").select("work", F.col("at").alias("x"), F.col("t").alias("ta"))
    en = s.where("language = 'en'").select("work", F.col("at").alias("y"), F.col("t").alias("te"))
    both = proposals.join(ar, ["work", "x"]).join(en, ["work", "y"]).select("ta", "te")
    word = lambda c: (F.col(c).bitwiseAND(F.lit(1)) == 0) & ~F.col(c).isin(common)
    # a word 0 in every Arabic sentence counts the pairs that each English word is in
    pair = F.array(F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("b")))
    each = both.select("ta", F.explode("te").alias("e")).where(word("e.w")).select("e.w", "e.b", F.explode(F.concat("ta", pair)).alias("a")).where(word("a.w"))
    named = ((F.col("a.b") == F.col("b")) & (F.col("b") != 0)).cast("tinyint")
    together = cut_lineage(each.select(F.col("w").alias("e"), F.col("a.w").alias("a"), named.alias("named")).groupBy("e", "a").agg(F.count("*").cast("int").alias("n"), F.max("named").alias("named")))
    met = together.where("a <> 0")
    of_e = together.groupBy("e").agg(F.sum(F.when(F.col("a") != 0, F.col("n"))).alias("ne"), F.sum(F.when(F.col("a") == 0, F.col("n"))).alias("ce"))
    total = met.agg(F.sum("n").alias("all")).first()["all"] or 0
    lift = F.col("n") / F.col("ne") / (F.col("na") / F.lit(float(total)))
    scored = met.where(F.col("n") >= LEAST_SUPPORT).join(of_e, "e").where(F.col("n") / F.col("ce") >= LEAST_GIVEN).join(met.groupBy("a").agg(F.sum("n").alias("na")), "a")
    # a word whose consonants are those of its partner is a name, and that outweighs any other partner
    best = scored.withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT).groupBy("e").agg(F.max_by("a", F.struct("named", F.col("n") * F.log("lift"), -F.col("a"))).alias("a"))
    return cut_lineage(best)


_SPOKEN = "work bigint, language string, at int, whole float, c array<bigint>, bit array<int>, weight array<float>"


def terms(words: DataFrame, lex: DataFrame, n: int, common: list[int]) -> DataFrame:
    """(language, w, c1, w1, m1, c2, w2, m2): the concepts each word of vocabulary() stands for, their weight among n sentences, and whether they occur in both languages.

    A word may be met by its translation or, as a name, by its consonants: an Arabic word has both concepts, an
    English one its translation if the lexicon has it.
    """
    to = lex.select(F.lit("en").alias("language"), F.col("e").alias("w"), F.col("a").alias("to")).unionByName(lex.select(F.lit("ar").alias("language"), F.col("a").alias("w"), F.col("a").alias("to")).distinct())
    number, arabic = F.col("w").bitwiseAND(F.lit(1)) == 1, F.col("language") == "ar"
    name = F.when(~number & (F.col("b") != 0), F.col("b"))
    first = F.when(number, F.col("w")).when(F.col("to").isNotNull(), F.col("to")).when(~arabic, name)
    known = words.where(~F.col("w").isin(common)).join(to, ["language", "w"], "left").select("language", "w", "n", first.alias("c1"), F.when(arabic, name).alias("c2")).where("c1 is not null or c2 is not null")
    has = lambda la: F.max((F.col("language") == la).cast("int"))
    df = known.select("language", "n", F.explode(F.array("c1", "c2")).alias("c")).where("c is not null").groupBy("c").agg(F.log(1 + F.lit(n) / F.sum("n")).cast("float").alias("w"), (has("ar") + has("en") > 1).alias("m"))
    side = lambda k: df.select(F.col("c").alias(f"c{k}"), F.col("w").alias(f"w{k}"), F.col("m").alias(f"m{k}"))
    return cut_lineage(known.drop("n").join(side(1), "c1", "left").join(side(2), "c2", "left").select("language", "w", "c1", "w1", "m1", "c2", "w2", "m2"))


def concepts(s: DataFrame, known: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """What each sentence speaks of, in terms() both languages share: (work, language, at, whole, c, bit, weight).

    c lists the concepts that occur in both languages, with bit, the word's place in its sentence, and weight. whole is
    the sentence's weight, where a word counts once, and half if its concept occurs in one language only. Terms of at
    most so many words are sent to the executors, where the sentences stay; more are joined. Both give the same.
    """
    # no concept is 0 here: a column with nulls would lose digits on its way
    sent = known.na.fill(0).na.fill(False).limit(most + 1).toPandas()
    if len(sent) > most:
        return _joined(s, known)
    tables = {}
    for language in ("ar", "en"):
        of = sent[sent.language == language].sort_values("w")
        kept = [(of[f"c{k}"].to_numpy(np.int64), of[f"w{k}"].to_numpy(np.float32), of[f"m{k}"].to_numpy(bool)) for k in (1, 2)]
        own = np.maximum(*(np.where(m, w, w * 0.5) for _, w, m in kept))
        tables[language] = of["w"].to_numpy(np.int64), own, *kept
    shared = s.sparkSession.sparkContext.broadcast(tables)

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            languages = whole_batch["language"].to_numpy(zero_copy_only=False)
            for language, (keys, own, first, second) in shared.value.items():
                if not len(keys) or not (languages == language).any():
                    continue
                batch = whole_batch.filter(pa.array(languages == language))
                lists = batch["t"]
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                w = lists.flatten().field(0).to_numpy()
                at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
                there = keys[at] == w
                bit = np.arange(len(w)) - np.repeat(ends[:-1], np.diff(ends))
                whole = np.diff(np.concatenate([[0.0], np.cumsum(np.where(there, own[at], 0.0))])[ends])
                use = np.stack([there & first[2][at], there & second[2][at]], 1).ravel()
                flat = lambda a, b: np.stack([a, b], 1).ravel()[use]  # noqa: B023, E731
                edges = pa.array(np.concatenate([[0], np.cumsum(use)])[2 * ends].astype(np.int32))
                made = [pa.ListArray.from_arrays(edges, pa.array(flat(*x))) for x in ((first[0][at], second[0][at]), (bit.astype(np.int32),) * 2, (first[1][at], second[1][at]))]
                spoken = np.diff(np.concatenate([[0], np.cumsum(there)])[ends]) > 0
                yield pa.RecordBatch.from_arrays([batch["work"], batch["language"], batch["at"], pa.array(whole.astype(np.float32)), *made], ["work", "language", "at", "whole", "c", "bit", "weight"]).filter(pa.array(spoken))

    return cut_lineage(s.mapInArrow(speak, _SPOKEN))


def _joined(s: DataFrame, known: DataFrame) -> DataFrame:
    """concepts() by a join of the words and one row gathered for each sentence."""
    weighed = s.select("work", "language", "at", F.posexplode("t").alias("bit", "x")).select("work", "language", "at", "bit", "x.w").join(known, ["language", "w"])
    own = lambda k: F.coalesce(F.when(F.col(f"m{k}"), F.col(f"w{k}")).otherwise(F.col(f"w{k}") * 0.5), F.lit(0.0))
    met = F.filter(F.array(*(F.when(F.col(f"m{k}"), F.struct("bit", F.lit(k).alias("k"), F.col(f"c{k}").alias("c"), F.col(f"w{k}").alias("weight"))) for k in (1, 2))), lambda x: x.isNotNull())
    spoken = weighed.groupBy("work", "language", "at").agg(F.sum(F.greatest(own(1), own(2))).cast("float").alias("whole"), F.array_sort(F.flatten(F.collect_list(met))).alias("m"))
    return cut_lineage(spoken.select("work", "language", "at", "whole", F.col("m.c").alias("c"), F.col("m.bit").alias("bit"), F.col("m.weight").alias("weight")))


def offsets(spoken: DataFrame, proposals: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(work, stretch, last_y, slope, shift, half): expected place y = x * slope + shift and half width of the rectangle, per stretch of Arabic."""
    last = lambda la: F.max(F.when(F.col("language") == la, F.col("at")))
    sizes = cut_lineage(spoken.groupBy("work").agg(last("ar").alias("last_x"), last("en").alias("last_y")).where("last_x is not null and last_y is not null").withColumn("slope", (F.col("last_y") + 1) / (F.col("last_x") + 1)))
    stretches = sizes.select("work", "slope", "last_y", F.explode(F.sequence(F.lit(0), F.floor(F.col("last_x") / STRETCH).cast("int"))).alias("stretch"))
    given = proposals if links is None else proposals.unionByName(links)
    # each point speaks for its own stretch and both neighbours
    around = lambda df: df.withColumn("stretch", F.explode(F.array(*(F.floor(F.col("x") / STRETCH).cast("int") + k for k in (-1, 0, 1)))))
    told = around(given.select("work", "x")).groupBy("work", "stretch").agg(F.count("*").alias("n"))
    thin = stretches.join(told, ["work", "stretch"], "left").where(F.coalesce("n", F.lit(0)) < LEAST_POINTS).select("work").distinct()
    some = spoken.join(thin, "work", "left_semi").select("work", "language", "at", F.explode("c").alias("c"))
    once = some.groupBy("work", "c").agg(F.count_if(F.col("language") == "ar").alias("na"), F.count_if(F.col("language") == "en").alias("ne"), last("ar").alias("x"), last("en").alias("y"))
    points = once.where("na = 1 and ne = 1").select("work", "x", "y").unionByName(given)
    near = around(points.join(sizes, "work").select("work", "x", (F.col("y") - F.col("x") * F.col("slope")).alias("d")))
    local = near.groupBy("work", "stretch").agg(F.percentile_approx("d", F.array(*map(F.lit, (0.1, 0.5, 0.9))), 1000).alias("q"), F.count("*").alias("points")).where(F.col("points") >= LEAST_POINTS)
    known = stretches.join(local.select("work", "stretch", F.col("q")[1].alias("own"), ((F.col("q")[2] - F.col("q")[0]) / 2).alias("spread")), ["work", "stretch"], "left")
    # between known stretches, or a known one and an end of the work, the shift changes evenly
    w = Window.partitionBy("work").orderBy("stretch")
    mark = F.when(F.col("own").isNotNull(), F.struct("stretch", "own", "spread"))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = known.withColumn("before", before).withColumn("after", after).withColumn("end", F.max("stretch").over(Window.partitionBy("work")) + 1)
    a, b = F.coalesce("before.stretch", F.lit(-1)), F.coalesce("after.stretch", "end")
    left, right = F.coalesce("before.own", F.lit(0.0)), F.coalesce("after.own", F.lit(0.0))
    part = F.when(b > a, (F.col("stretch") - a) / (b - a)).otherwise(0.0)
    far = F.least(F.col("stretch") - a, b - F.col("stretch")) * STRETCH
    spread = F.greatest(F.coalesce("before.spread", F.lit(0.0)), F.coalesce("after.spread", F.lit(0.0)))
    half = F.least(F.ceil(HALF + SPREAD * spread + DRIFT * far), F.col("last_y") + 1).cast("int")
    return cut_lineage(between.select("work", "stretch", "last_y", "slope", (left + part * (right - left)).alias("shift"), half.alias("half")))


def _ors(pair_starts: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The sets of places of each run of matches as the bytes of a whole number, whatever its length."""
    out = [0] * len(pair_starts)
    for k in range(int(bits.max(initial=0)) // 62 + 1):
        part = np.where(bits // 62 == k, np.left_shift(1, bits % 62), 0)
        some = np.bitwise_or.reduceat(part, pair_starts).tolist() if len(pair_starts) else []
        out = [o | x << 62 * k for o, x in zip(out, some, strict=True)] if k else some
    return [o.to_bytes((o.bit_length() + 7) // 8, "little") for o in out]


_POINTS = "work bigint, x int, y int, shared double, of_ar double, of_en double, ar_bits binary, en_bits binary"


def _meet(tile: pa.Table) -> pa.Table:
    """The points of one tile: sentence pairs in the rectangle with enough in common."""
    order = np.argsort(tile["at"].to_numpy(), kind="stable")
    arabic = tile["arabic"].to_numpy()[order]

    def side(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        t = tile.take(rows)
        lists = t["c"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        return t["at"].to_numpy(), t["whole"].to_numpy(), np.repeat(np.arange(len(rows)), sizes), lists.flatten().to_numpy(), t["bit"].combine_chunks().flatten().to_numpy(), t["weight"].combine_chunks().flatten().to_numpy()

    mine, theirs = order[arabic], order[~arabic]
    x, x_whole, ax, ac, abit, _ = side(mine)
    y, y_whole, ey, ec, ebit, eweight = side(theirs)
    center, half = tile["center"].to_numpy()[mine], tile["half"].to_numpy()[mine]
    by = np.argsort(ec, kind="stable")
    low, high = np.searchsorted(ec[by], ac, "left"), np.searchsorted(ec[by], ac, "right")
    n = high - low
    i = np.repeat(np.arange(len(ac)), n)
    j = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i]]
    inside = np.abs(y[ey[j]] - center[ax[i]]) <= half[ax[i]]
    i, j = i[inside], j[inside]
    pair = ax[i] * len(y) + ey[j]
    by = np.argsort(pair, kind="stable")
    i, j, pair = i[by], j[by], pair[by]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    shared = np.add.reduceat(eweight[j].astype(float), starts) if len(starts) else np.zeros(0)
    px, py = pair[starts] // max(len(y), 1), pair[starts] % max(len(y), 1)
    of_ar, of_en = (np.minimum(shared / np.maximum(whole[p], 1e-6), 1.0) for whole, p in ((x_whole, px), (y_whole, py)))
    good = (shared > 2) & (np.maximum(of_ar, of_en) >= LEAST_SHARED)
    # the places of those matches only
    keep = np.repeat(good, np.diff(np.append(starts, len(pair))))
    i, j = i[keep], j[keep]
    starts = np.flatnonzero(np.diff(pair[keep], prepend=-1))
    made = [np.full(len(starts), tile["work"][0].as_py()), x[px[good]], y[py[good]], shared[good], of_ar[good], of_en[good], _ors(starts, abit[i].astype(np.int64)), _ors(starts, ebit[j].astype(np.int64))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], ["work", "x", "y", "shared", "of_ar", "of_en", "ar_bits", "en_bits"])


def points(spoken: DataFrame, where: DataFrame) -> DataFrame:
    """(work, x, y, shared, of_ar, of_en, ar_bits, en_bits): sentence pairs in the rectangles with enough in common.

    A tile is the part of a stretch's rectangle in one cell of English; a sentence goes to the tiles its own rectangle meets.
    """
    first = F.col("stretch") * STRETCH * F.col("slope") + F.col("shift") - F.col("half")
    final = ((F.col("stretch") + 1) * STRETCH - 1) * F.col("slope") + F.col("shift") + F.col("half")
    spans = where.withColumn("low", F.least(F.greatest(F.floor(first), F.lit(0)), F.col("last_y")).cast("int")).withColumn("high", F.least(F.greatest(F.ceil(final), F.lit(0)), F.col("last_y")).cast("int"))
    tiles = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL).cast("int"), F.floor(F.col("high") / CELL).cast("int"))))
    center = F.col("at") * F.col("slope") + F.col("shift")
    columns = ["work", "stretch", "cell", "at", "whole", "c", "bit", "weight"]
    a = spoken.where("language = 'ar'").withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("int")).withColumn("weight", F.array().cast("array<float>")).join(tiles, ["work", "stretch"]).withColumn("center", center)
    a = a.where((F.col("center") + F.col("half") >= F.col("cell") * CELL) & (F.col("center") - F.col("half") < (F.col("cell") + 1) * CELL)).select(*columns, F.lit(True).alias("arabic"), "center", "half")
    e = spoken.where("language = 'en'").withColumn("cell", F.floor(F.col("at") / CELL).cast("int")).join(tiles, ["work", "cell"]).where("at between low and high").select(*columns, F.lit(False).alias("arabic"), F.lit(0.0).alias("center"), F.lit(0).alias("half"))
    return a.unionByName(e).groupBy("work", "stretch", "cell").applyInArrow(_meet, _POINTS)


def chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the heaviest chain of distinct points that falls in neither coordinate; of equal chains the earlier."""
    order = np.lexsort((y, x))
    ys, off, best = y[order], (y - x)[order].astype(float), weight[order].astype(float)
    back = [-1] * len(order)
    for i in range(1, len(order)):
        # a gap in one coordinate only costs a little: slope-consistent points are preferred
        value = best[:i] - np.abs(off[:i] - off[i]) * 0.01
        value[ys[:i] > ys[i]] = -1.0
        j = int(value.argmax())
        if value[j] > 0:
            best[i] += value[j]
            back[i] = j
    out, i = [], int(best.argmax()) if len(best) else -1
    while i >= 0:
        out.append(order[i])
        i = back[i]
    return np.array(out[::-1], int)


def _most(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value of each key, for each place."""
    names, at = np.unique(key, return_inverse=True)
    out = np.full(len(names), -np.inf)
    np.maximum.at(out, at, value)
    return out[at]


def blocks(x: np.ndarray, y: np.ndarray, shared: np.ndarray, of_ar: np.ndarray, of_en: np.ndarray, ar_bits: list[int], en_bits: list[int]) -> list[int]:
    """Indices of the points of one stretch, sorted by place, that hold: the chain, further members of its blocks, inversions."""
    fit = np.sqrt(np.maximum(of_ar, 0.05) * np.maximum(of_en, 0.05))
    weight = fit * np.log1p(shared)
    # noise: points that are weak in the heavier sentence and beaten clearly in their row and in their column
    idx = np.flatnonzero((fit >= 0.7 * _most(x, fit)) | (fit >= 0.7 * _most(y, fit)))
    kept = idx[chain(x[idx], y[idx], weight[idx])]
    # of several points in one row or column only those that add content stay
    seen_x: dict[int, int] = {}
    seen_y: dict[int, int] = {}
    xs, ys = x.tolist(), y.tolist()
    taken: list[int] = []

    def take(some: np.ndarray, distance: np.ndarray) -> None:
        for i in some[np.lexsort((distance, -fit[some].round(1)))].tolist():
            a, e, at, to = ar_bits[i], en_bits[i], xs[i], ys[i]
            had_a, had_e = seen_x.get(at, 0), seen_y.get(to, 0)
            if 2 * (a & ~had_a).bit_count() >= a.bit_count() and 2 * (e & ~had_e).bit_count() >= e.bit_count():
                seen_x[at], seen_y[to] = had_a | a, had_e | e
                taken.append(i)

    if len(kept):
        # the line through the chain, smoothed, since single points of it may be repetitions
        shift = y[kept] - x[kept]
        line = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(shift, 2, mode="edge"), 5), axis=1)
        off = lambda some: np.abs(y[some] - x[some] - np.interp(x[some], x[kept], line))
        take(kept, off(kept))
        rest = np.setdiff1d(np.arange(len(x)), kept)
        far = off(rest)
        strong = (far <= FARTHEST) & (np.minimum(of_ar[rest], of_en[rest]) >= LEAST_INVERTED)
        take(rest[strong], far[strong])
        near = (far <= 4) & ~strong
        take(rest[near], far[near])
    return sorted(taken)


def _hold(key: tuple, found: pa.Table) -> pa.Table:
    """The points of one stretch that hold, those of its margins seen but left to their own stretch."""
    x, y = found["x"].to_numpy(), found["y"].to_numpy()
    order = np.lexsort((y, x))
    column = lambda c: found[c].to_numpy()[order]
    bits = lambda c: [int.from_bytes(b, "little") for b in found[c].take(order).to_pylist()]
    held = np.array(blocks(x[order], y[order], *(column(c) for c in ("shared", "of_ar", "of_en")), bits("ar_bits"), bits("en_bits")), int)
    held = held[x[order][held] // STRETCH == key[1].as_py()]
    return found.select(["work", "x", "y", "of_ar", "of_en"]).take(order[held])


def align(sentences: DataFrame, dp_links: DataFrame, structural_links: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """(arabic_sentence_id, english_sentence_id, of_ar, of_en)."""
    rows = sentences.select("id", "paragraph_id", "work_id", "language", "global_sequence", "text")
    s = _sentences(rows)
    words, n, common = vocabulary(s)
    proposals = cut_lineage(_proposals(dp_links.select("work_id", "arabic_start", "arabic_end", "english_start", "english_end")))
    spoken = concepts(s, terms(words, lexicon(s, proposals, common), n, common))
    links = None if structural_links is None or paragraphs is None else _starts(structural_links, paragraphs, rows)
    found = points(spoken, offsets(spoken, proposals, links))
    reach = F.array_distinct(F.array(F.floor((F.col("x") - MARGIN) / STRETCH), F.floor(F.col("x") / STRETCH), F.floor((F.col("x") + MARGIN) / STRETCH)))
    spread = found.withColumn("stretch", F.explode(reach))
    kept = spread.groupBy("work", "stretch").applyInArrow(_hold, "work bigint, x int, y int, of_ar double, of_en double")
    named = rows.where("language in ('ar', 'en') and id is not null and text is not null").select(F.xxhash64("work_id").alias("work"), "language", F.col("global_sequence").alias("at"), "id").distinct()
    of = lambda la, at, to: named.where(F.col("language") == la).select("work", F.col("at").alias(at), F.col("id").alias(to))
    out = kept.join(of("ar", "x", "arabic_sentence_id"), ["work", "x"]).join(of("en", "y", "english_sentence_id"), ["work", "y"])
    return out.select("arabic_sentence_id", "english_sentence_id", "of_ar", "of_en")


def _starts(structural_links: DataFrame, paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """(work, x, y): first places of linked structures."""
    first = paragraphs.select(F.col("id").alias("paragraph_id"), "structure_id").join(sentences.select("paragraph_id", "global_sequence"), "paragraph_id").groupBy("structure_id").agg(F.min("global_sequence").alias("at"))
    both = structural_links.where("size(arabic_structure_ids) > 0 and size(english_structure_ids) > 0").select(F.xxhash64("work_id").alias("work"), F.col("arabic_structure_ids")[0].alias("sa"), F.col("english_structure_ids")[0].alias("se"))
    return both.join(first.select(F.col("structure_id").alias("sa"), F.col("at").alias("x")), "sa").join(first.select(F.col("structure_id").alias("se"), F.col("at").alias("y")), "se").select("work", "x", "y")


def _align(spark: SparkSession, d: str) -> DataFrame:
    return align(table(spark, d, "sentences"), table(spark, d, "dp_links"), table(spark, d, "structural_links"), table(spark, d, "paragraphs"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _align(spark, d).select("arabic_sentence_id", "english_sentence_id")

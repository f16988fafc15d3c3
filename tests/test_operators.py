from __future__ import annotations

import math
import random
from functools import lru_cache

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinscript import schemas, sinks
from twinscript.functions import names, text
from twinscript.operators import alignment, catalog, documents, factory, harness, sampling, segment, timeline
from twinscript.streaming import events


def test_reassembly_names_what_is_missing(spark):
    items = spark.createDataFrame([("a", "x. " * 50 + "y"), ("b", None), ("c", " ")], "id string, arabic string")
    blocks = segment.blockify(items, most=20)
    results = blocks.select(F.col("id").alias("item_id"), F.col("arabic").alias("translation"), F.lit(None).cast("string").alias("error"))
    whole = segment.reassemble(results, segment.expected_counts(blocks)).collect()
    assert [(r.parent_id, r.error) for r in whole] == [("a", None)]
    assert whole[0].translation == ("x. " * 50 + "y")
    cut = segment.reassemble(results.where("item_id <> 'a#b0002'"), segment.expected_counts(blocks)).first()
    assert cut.translation is None and "2" in cut.error


def test_ids_are_reconciled(spark):
    sent = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    back = spark.createDataFrame([("a", "x", None), ("b", "x", None), ("b", "y", None), ("c", "", None), ("z", "x", None)], "id string, english string, error string")
    got = {r.id: r.status for r in harness.reconcile(sent, back).collect()}
    assert got == {"a": "ok", "b": "duplicate", "c": "error", "d": "missing", "z": "unexpected"}
    assert harness.loss(harness.reconcile(sent, back)).first().preserved == 0.25


def test_chrf_of_equal_and_of_different_texts(spark):
    df = spark.createDataFrame([(1, "abc def", "abc def"), (2, "", "x"), (3, None, "x")], "id int, hyp string, ref string")
    assert harness.chrf(df).first().chrf == pytest.approx(100)
    other = spark.createDataFrame([(1, "aaaa", "bbbb")], "id int, hyp string, ref string")
    assert harness.chrf(other).first().chrf == 0


def test_splits_are_disjoint_and_repeatable(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("g"))
    a = sampling.split(rows, ["g"], {"test": 5, "dev": 3}, 1, "id").groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in a if r.split} == {(g, s): n for g in range(3) for s, n in (("test", 5), ("dev", 3))}
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "grp string, n long")
    assert {r.grp: r.allotted for r in sampling.allocate(sizes, 7).collect()} == {"a": 4, "b": 2, "c": 1}


def test_intervals_and_as_of(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2), (2, 0, 1)], "k int, a int, b int")
    got = sorted(tuple(r) for r in timeline.interval_union(rows, ["k"], "a", "b").collect())
    assert got == [(1, 0, 7), (1, 9, 10), (2, 0, 1)]
    left = spark.createDataFrame([(1, 3, "x"), (1, 0, "y"), (2, 9, "z")], "k int, at int, name string")
    right = spark.createDataFrame([(1, 1, 10.0), (1, 3, 30.0)], "k int, at int, v double")
    assert {r.name: r.v for r in timeline.as_of(left, right, "k", "at", "v").collect()} == {"x": 30.0, "y": None, "z": None}


def test_marked_texts(spark):
    lines = ["#META# title :: Diwan", "#META# author :: NODATA", "### | One", "# first ms01", "~~ goes on", "# second", "### | Two", "# third PageV01P002"]
    rows = spark.createDataFrame([("u", i, x) for i, x in enumerate(lines)], "uri string, at int, line string")
    got = [(r.heading, r.paragraph, r.text) for r in documents.marked_paragraphs(rows, "uri").orderBy("section", "paragraph").collect()]
    assert got == [("One", 1, "first goes on"), ("One", 2, "second"), ("Two", 1, "third")]
    assert {r.name: r.value for r in documents.meta_values(rows, "uri").collect()} == {"title": "Diwan", "author": None}


def test_glossary_terms_in_words_and_alone(spark):
    g = spark.createDataFrame([("1", "كتاب", None, None), ("2", "من", None, None), ("3", "دار", "rejected", None), ("4", "بيت كبير", None, None)], "entry_id string, arabic string, status string, book string")
    p = spark.createDataFrame([("a", "والكتاب في منزل", None), ("b", "من دار", None), ("c", "بيت كبير", None), ("d", None, None)], "id string, text string, book string")
    assert sorted((r.id, r.entry_id) for r in factory.retrieve(p, g).collect()) == [("a", "1"), ("b", "2"), ("c", "4")]


def test_token_join_equals_brute_force(spark):
    rng = random.Random(1)
    usual, rarer = "sharh risala tarikh masail".split(), [f"{a}{b}{c}" for a in "bdf" for b in "aeo" for c in "lmns"]
    works = [(f"{i:03d}", " ".join(rng.sample(usual, rng.randint(0, 4)) + rng.sample(rarer, rng.randint(0, 2)))) for i in range(70)]
    titles = [(i, " ".join(rng.sample(usual, rng.randint(0, 4)) + rng.sample(rarer, rng.randint(0, 4)))) for i in range(80)]
    index = spark.createDataFrame([(u, w) for u, x in works for w in set(x.split())], "uri string, token string")
    hits = spark.createDataFrame([(i, x, None) for i, x in titles] + [(99, None, None)], "id int, title string, authors string")
    of = {w: [u for u, x in works if w in x.split()] for w in usual + rarer}
    want = {}
    for i, x in titles:
        scores, rare = {}, set()
        for w in x.split():
            for u in of[w]:
                scores[u] = scores.get(u, 0) + 1 / len(of[w])
                rare |= {u} if len(of[w]) <= 2 else set()
        best = min(((-round(s, 9), u) for u, s in scores.items()), default=None)
        if best and best[1] in rare and best[0] <= -0.5:
            want[i] = (best[1], -best[0])
    joined = catalog.token_join(hits, index)
    assert {r.id: (r.uri, r.score) for r in joined.collect()} == want and 5 < len(want) < 80
    assert {r.id for r in catalog.unmatched(hits, joined).collect()} == {99, *(i for i, _ in titles)} - set(want)


def test_terms_are_found_alike_by_automaton_and_by_heads(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ابتد") for _ in range(n))
    g = spark.createDataFrame([(f"{i}", word(rng.randint(1, 5)), rng.choice([None, "ok", "rejected"]), rng.choice([None, "x", "y"])) for i in range(60)] + [("n", None, None, None)], "entry_id string, arabic string, status string, book string")
    p = spark.createDataFrame([(i, " ".join(word(rng.randint(1, 6)) for _ in range(8)), rng.choice([None, "x"])) for i in range(30)] + [(90, None, None), (91, "", None)], "id int, text string, book string")
    got = [sorted((r.id, r.entry_id) for r in factory.retrieve(p, g, most).collect()) for most in (1000, 0)]
    entries, rows = [r for r in g.collect() if r.arabic and r.status != "rejected"], [r for r in p.collect() if r.text]
    alone = lambda term, text: any(text[k : k + len(term)] == term and not (text[k - 1 : k].strip() if k else "") and not text[k + len(term) : k + len(term) + 1].strip() for k in range(len(text)))
    want = sorted((r.id, e.entry_id) for r in rows for e in entries if (not e.book or not r.book or e.book == r.book) and (e.arabic in r.text if len(e.arabic) > 2 else alone(e.arabic, r.text)))
    assert got[0] == want and got[1] == want


def test_policies_of_known_pairs(spark):
    s = "row_id string, item_id string, system_id string, hint string, ok boolean, fails array<string>"
    rows = [("1", "clean", "lite", None, True, []), ("2", "clean", "strong", None, False, ["X"]), ("3", "mended", "lite", None, False, ["X"]), ("4", "mended", "strong", None, True, []), ("5", "human", "lite", None, False, ["X"]), ("6", "verse", "strong", "Verse", True, []), ("7", "other", "tuned", None, True, [])]
    made = factory.simulate(factory.paired(spark.createDataFrame(rows, s), "lite", "strong"))
    assert {r.item_id: (r.system, r.queue, r.chosen) for r in made.collect()} == {"clean": ("lite", "auto", "lite"), "mended": ("strong", "auto", "strong"), "human": ("lite", "human", "lite"), "verse": ("strong", "auto", "strong")}
    assert {r.policy: (r.publishable, r.escaped_rate) for r in factory.policy_rates(made).collect()} == {"all_strong": (2, 0.5), "all_lite": (1, 0.75), "known_lite_else_strong": (3, 0.25), "source_gate_only": (2, 0.5), "checks_keep_both": (4, 0.0), "checks_overwrite": (3, 0.25)}


def test_aliases_come_before_tokens(spark):
    works = spark.createDataFrame([("0300Tabari.Tarikh", "Tabari", "Tarikh"), ("1400Hadith.Nazariya", "Hadith", "Nazariya"), ("0200Salim.Diwan", None, None)], "uri string, author string, title string")
    hits = spark.createDataFrame([(1, "The Gift of Symbols", "Tabari"), (2, "Nazariya", "Hadith"), (3, "On Salim", None), (4, "Nothing", None)], "id int, title string, authors string")
    got = {r.id: (r.uri, r.reason) for r in catalog.join_hits(hits, works, [(("gift", "symbols"), "1400Hadith.Nazariya"), (("nothing",), "absent")], "title", "authors").collect()}
    assert got == {1: ("1400Hadith.Nazariya", "alias"), 3: ("0200Salim.Diwan", "tokens")}


def _single(s):
    return "".join(c for k, c in enumerate(s) if not k or c != s[k - 1])


def _score(source, target):
    """Plain score of two spans of (words, numbers, skeleton, names)."""
    w, v = sum(x[0] for x in source), sum(x[0] for x in target)
    if not w or not v:
        return -alignment.SKIP
    skeleton = _single("".join(x[2] for x in source))
    called = [n for x in target for n in x[3]]
    named = sum(n in skeleton for n in called) / len(called) if called else 0.0
    mine, theirs = {n for x in source for n in x[1]}, {n for x in target for n in x[1]}
    length = math.exp(-abs(math.log(v / (1.55 * w))))
    return 0.2 * named + (0.1 * len(mine & theirs) / len(mine | theirs) if mine and theirs else 0.0) + 0.1 * length + 0.6 * min(1.0, named + length)


def _best(source, target):
    """Score of the best path by trying all."""

    @lru_cache(None)
    def rest(i, j):
        if (i, j) == (len(source), len(target)):
            return 0.0
        options = [-2.4 + rest(i + 1, j)] if i < len(source) else []
        options += [-2.4 + rest(i, j + 1)] if j < len(target) else []
        for a, e in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)):
            if i + a <= len(source) and j + e <= len(target):
                options.append(_score(source[i : i + a], target[j : j + e]) - 0.05 * (a + e - 2) + rest(i + a, j + e))
        return max(options)

    return rest(0, 0)


def _sides(rng, n):
    return [(rng.randint(0, 6), rng.sample(["1", "7", "12"], rng.randint(0, 2)), "".join(rng.choice("bdr") for _ in range(rng.randint(0, 5))), rng.choices(["bd", "rb", "db"], k=rng.randint(0, 2))) for _ in range(n)]


def _frame(side):
    skeletons = [_single(x[2]) for x in side]
    return pd.DataFrame({"words": [x[0] for x in side], "numbers": [x[1] for x in side], "with_h": skeletons, "with_t": skeletons, "names": [x[3] for x in side]})


def test_alignment_is_the_best_of_all_paths(monkeypatch):
    rng = random.Random(2)
    for cells in (500_000, 10):
        monkeypatch.setattr(alignment, "MOST_CELLS", cells)
        for _ in range(40):
            source, target = _sides(rng, rng.randint(0, 8)), _sides(rng, rng.randint(0, 8))
            path = alignment.best_path(len(source), len(target), alignment.SpanScores(_frame(source), _frame(target)))
            assert sum(s for *_, s in path) == pytest.approx(_best(tuple(map(_hashable, source)), tuple(map(_hashable, target))))
            assert [x for a, b, _, _, _ in path for x in range(a, b)] == list(range(len(source))) and [x for _, _, a, b, _ in path for x in range(a, b)] == list(range(len(target)))


def _hashable(x):
    return x[0], tuple(x[1]), _single(x[2]), tuple(x[3])


def test_links_carry_operations_and_flags(spark):
    s = "unit string, side string, seq int, text string"
    rows = [("u", "a", 0, "قال سليم بن كريم في عام ١٢"), ("u", "b", 0, "Salim ibn Karim said in the year 12"), ("one", "a", 0, "نص"), ("two", "b", 0, "text"), ("gap", "a", 0, "نص نص نص"), ("gap", "b", 0, None), ("gap", "b", 1, "text text text text text")]
    got = {(r.unit, r.operation): r for r in alignment.align_groups(spark.createDataFrame(rows, s)).collect()}
    assert got["u", "1-1"].score == pytest.approx(0.2 + 0.1 + 0.1 * math.exp(-abs(math.log(8 / (1.55 * 7)))) + 0.6) and got["u", "1-1"].flags == []
    assert (got["one", "1-0"].confidence, got["one", "1-0"].radius, got["one", "1-0"].flags) == (0.15, 3, ["arabic_omission"])
    assert got["two", "0-1"].flags == ["english_addition"]
    assert alignment.align_groups(spark.createDataFrame(rows, s).limit(0)).count() == 0


def test_names_are_found_by_their_consonants(spark):
    df = spark.createDataFrame([("Qasim ibn Malik said to AL-jANDAL and the Prophet, then Zayd left", "قال قاسم بن مالك في دومة الجندل"), (None, None), ("no names", "")], "en string, ar string")
    got = df.select(names.evidence(names.name_skeletons("en"), text.arabic_skeleton("ar", "h"), text.arabic_skeleton("ar", "t")).alias("e"), names.search_blob("ar").alias("blob"), text.arabic_token_skeletons("ar").alias("tokens")).collect()
    assert (got[0].e.matched, got[0].e.missed) == (["mlk", "jndl"], ["qsm", "zd"]) and got[0].e.score == 0.5 and got[0].e.mass == 7
    assert got[0].e.first_offset == got[0].blob.index("mlk")
    assert got[0].blob.split("|")[0].replace("h", "t") == got[0].blob.split("|")[1].replace("h", "t") and got[0].tokens[1] == "ksm"
    assert got[2].e.score == 0 and got[2].e.first_offset == -1


def test_block_ids_stay_apart_beyond_four_digits(spark):
    got = spark.range(9999, 10002).select(text.block_id(F.lit("a"), F.col("id")).alias("b")).collect()
    assert [r.b for r in got] == ["a#b9999", "a#b10000", "a#b10001"]


def test_large_units_are_aligned_whole(spark, tmp_path):
    from twinscript.plans import bitext

    n, m = 2000, 2001
    spark.createDataFrame([("w", 0, ["a"], ["b"])], "work_id string, structural_link_index int, arabic_structure_ids array<string>, english_structure_ids array<string>").write.parquet(str(tmp_path / "structural_links.parquet"))
    spark.createDataFrame([("pa", "a"), ("pb", "b")], "id string, structure_id string").write.parquet(str(tmp_path / "paragraphs.parquet"))
    words = lambda k: " ".join(["word"] * (k % 7 + 2))
    rows = [("pa", i, words(i)) for i in range(n)] + [("pb", j, words(j if j < 1200 else j - 1)) for j in range(m)]
    spark.createDataFrame(rows, "paragraph_id string, global_sequence int, text string").write.parquet(str(tmp_path / "sentences.parquet"))
    shared = sorted((r.seq, r.first, r.last) for r in bitext.length_partition(spark, str(tmp_path)).collect())
    assert [s for s, _, _ in shared] == list(range(n)) and [x for _, a, b in shared for x in range(a, b + 1)] == list(range(m))
    links = sorted((r.a_start, r.a_end, r.b_start, r.b_end) for r in bitext.dp_align_units(spark, str(tmp_path)).collect())
    assert [x for a, b, _, _ in links for x in range(a, b)] == list(range(n)) and [x for _, _, a, b in links for x in range(a, b)] == list(range(m))


def test_divided_tables_give_the_same_shares(monkeypatch):
    rng = random.Random(2)
    sizes = [([rng.randint(0, 90) for _ in range(5)], [rng.randint(0, 50) for _ in range(rng.randint(5, 20))]) for _ in range(30)]
    whole = [alignment.length_partition(u, f) for u, f in sizes]
    monkeypatch.setattr(alignment, "MOST_CELLS", 10)
    assert whole == [alignment.length_partition(u, f) for u, f in sizes]
    assert alignment.length_partition([5.0, 1.0, 9.0], [5.0, 9.0], 0, 2) == [(0, 1), (1, 1), (1, 2)]


def test_closed_schemas(spark):
    df = spark.createDataFrame([("u", "a")], "uri string, author string")
    assert schemas.enforce(df, "work").columns == schemas.schema("work").fieldNames()
    with pytest.raises(ValueError, match="extra"):
        schemas.enforce(df.withColumn("extra", F.lit(1)), "work")
    bad = spark.createDataFrame([("a", 0), ("a", 0), (None, 2)], "id string, sequence int")
    assert {r.rule for r in schemas.violations(bad, ["id"], {"low": F.col("sequence") < 2}).collect()} == {"key is null", "key is repeated", "low"}


def test_bundles_repeat_byte_for_byte(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "b int, a string").coalesce(1)
    one, two = sinks.write_bundle({"m": df}, str(tmp_path / "1.zip")), sinks.write_bundle({"m": df}, str(tmp_path / "2.zip"))
    assert one == two and (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    assert sinks.verify_bundle(str(tmp_path / "1.zip"))["bundle_id"] == one
    with pytest.raises(FileExistsError):
        sinks.write_bundle({"m": df}, str(tmp_path / "1.zip"))
    with pytest.raises(ValueError, match="holds text"):
        sinks.require_textless(spark.createDataFrame([("نص",)], "a string"))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, f"2025-01-01 00:{i:02d}:00", "a", 1.0) for i in range(20)], "event_id int, t string, kind string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "kind", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    events.run_once(events.distinct_events(stream, "event_id", late="30 days"), str(tmp_path / "c"), events.partition_writer(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 == events.distinct_events(df, "event_id").count()

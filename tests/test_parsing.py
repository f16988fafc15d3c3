"""Scanned editions, pairing by names, catalogues and features on constructed cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscript.functions import names, text
from twinscript.operators import features, pairing, records, scans, timeline
from twinscript.sources import catalogs


def lines(spark, texts):
    return spark.createDataFrame([("k", i, x) for i, x in enumerate(texts)], "k string, at int, line string")


def test_paragraphs_over_a_page_turn(spark):
    page = ["395   THE TRAVELS", "He went to the har-", "bour and", "", "1. See Koran, vol. 2", "", "THE TRAVELS  A.H. 310   396", "slept there. ", "", "Then he rose."]
    made = scans.joined_blocks(scans.blocks(scans.carried(lines(spark, page), "k"), "k"), "k")
    got = [(r.text, r.page, r.year) for r in made.orderBy("paragraph").collect()]
    assert got == [("He went to the har- bour and slept there.", 395, None), ("Then he rose.", 396, 310)]
    years = scans.year_blocks(made, "k").collect()
    assert [(r.year, r.paragraphs, r.words) for r in years] == [(310, 1, 3)]
    assert scans.blocks(scans.carried(lines(spark, page).limit(0), "k"), "k").count() == 0


def test_kinds_of_lines(spark):
    df = spark.createDataFrame([(x,) for x in ("XIV", "j6", "$j", "12", "12 men", "ORIGINS OF THE STATE", "He went", "", None)], "c string")
    got = [tuple(r) for r in df.select(scans.is_page_number("c"), scans.is_head("c")).collect()]
    assert got == [(True, True), (True, False), (True, False), (True, False), (False, False), (False, True), (False, False), (False, False), (False, False)]


def test_margin_numbers_go_and_others_stay(spark):
    texts = [f"word {'500' if i == 7 else 10 + 2 * i}" for i in range(12)] + ["gave him 99"]
    got = [r.line for r in scans.margin_numbers(lines(spark, texts), "k", least=5).orderBy("at").collect()]
    assert got == ["word 500" if i == 7 else "word" for i in range(12)] + ["gave him 99"]
    assert [r.line for r in scans.margin_numbers(lines(spark, texts), "k").orderBy("at").collect()] == texts
    rng = random.Random(1)
    for _ in range(60):
        v = [rng.randint(1, 15) for _ in range(rng.randint(0, 12))]
        best = 0
        for mask in range(1 << len(v)):
            some = [x for i, x in enumerate(v) if mask >> i & 1]
            if all(0 < b - a <= 3 for a, b in zip(some, some[1:], strict=False)):
                best = max(best, len(some))
        run = scans.stepped_run(v, 3)
        assert len(run) == best and all(0 < v[b] - v[a] <= 3 and a < b for a, b in zip(run, run[1:], strict=False))


def test_heads_of_paragraphs_and_numbers_in_words(spark):
    one = lambda value, expr: spark.createDataFrame([(value,)], "c string").select(expr.alias("x")).first().x
    assert one("The Seat of Rule. " + "He went on and on to the city " * 5, scans.run_in_heading("c")).heading == "The Seat of Rule."
    assert one("He said this. " + "word " * 40, scans.run_in_heading("c")).heading is None
    assert one("Zaid from Bakr: — He went", scans.chain_head("c")) == "Zaid from Bakr" and one("a b", scans.chain_head("c")) == "a b"
    assert one("ex-\npelled ibn-al-\nKhattab", scans.dehyphenate_names("c")) == "expelled ibn-al-Khattab"
    assert one("THE FORTY-FIRST ASSEMBLY", scans.english_ordinal("c")) == 41 and one("x", scans.english_ordinal("c")) is None
    assert scans.ordinals()["TWENTIETH"] == 20 and scans.ordinals()["FORTY-SECOND"] == 42 and len(scans.ordinals()) == 99
    assert one("ودخلت سنة خمس وتسعين ومائتين", scans.arabic_year("c")) == 295
    assert one("سنة خمس وثلاثين فيها كان", scans.arabic_year("c")) == 35 and one("سنة", scans.arabic_year("c")) is None
    assert one("x *** START OF THE BOOK Y *** body *** END OF THE BOOK Y *** z", scans.ebook_body("c")).strip() == "body" and one("plain", scans.ebook_body("c")) == "plain"


def test_sections_by_number(spark):
    texts = ["before", "3. Third", "a", "1. One", "b", "c", "2. Two", "1. One again", "d"]
    made = scans.sections(lines(spark, texts), "k", r"^(\d+)\. .*$")
    assert [(r.number, r.body) for r in made.orderBy("section").collect()] == [("3", "a"), ("1", "b c"), ("2", ""), ("1", "d")]
    assert [(r.section, r.number) for r in scans.numbered_sections(made, "k").orderBy("section").collect()] == [(1, "1"), (2, "2")]
    assert sorted(r.number for r in scans.first_of_each(made, "k", "number").collect()) == ["1", "2", "3"]


def test_units_zipped_between_anchors(spark):
    assert pairing.zip_units([5, 5, 5, 5], [10, 10], []) == [(0, 1), (0, 1), (1, 2), (1, 2)]
    assert pairing.zip_units([5, 5, 5], [5, 5], [(2, 1)]) == [(0, 1), (0, 1), (1, 2)]
    assert pairing.zip_units([], [1], []) == [] and pairing.zip_units([1, 1], [], []) == [(0, 0), (0, 0)]
    a = spark.createDataFrame([("w", 0, "قال سليمان بن داود"), ("w", 1, "ثم ذهب"), ("w", 2, "خرج عبدالملك"), ("v", 0, None)], "work_id string, at int, title string")
    b = spark.createDataFrame([("w", 0, "Sulayman went"), ("w", 1, "Then came Abdalmalik"), ("w", 2, "Sulayman again"), ("v", 0, "Sulayman")], "work_id string, at int, title string")
    assert sorted((r.x, r.y) for r in pairing.rising_anchors(a, b, "work_id").collect()) == [(0, 0), (2, 1)]
    units = a.select("work_id", F.lit("a").alias("side"), "at", F.lit(3).alias("words")).unionByName(b.select("work_id", F.lit("b").alias("side"), "at", F.lit(3).alias("words")))
    got = {(r.work_id, r.at): (r.first, r.last) for r in pairing.zipped(units, "work_id", pairing.rising_anchors(a, b, "work_id").select("work_id", "x", "y")).collect()}
    assert got == {("w", 0): (0, 1), ("w", 1): (0, 1), ("w", 2): (1, 3), ("v", 0): (0, 1)}
    assert spark.createDataFrame([("Abdalmalik", "عبدالملك")], "e string, a string").select(pairing.name_mass("e", "a").alias("m"), names.anchor_score("e", "a").alias("s")).first() == (6, 1.0)


def test_catalogue_answers(spark):
    dump = "\t".join(["id1", "a", "pd"] + ["x"] * 8 + ["A Title", "imprint"] + ["y"] * 5 + ["eng,ara", "z"] + ["q"] * 5 + ["An Author"])
    rows = catalogs.dump_rows(spark.createDataFrame([("htid\tx",), (dump,), ("too\tshort",), (None,)], "value string"))
    assert [(r.htid, r.title, r.author) for r in rows.collect()] == [("id1", "A Title", "An Author")]
    assert catalogs.candidates(rows, ["author"], ("pd",)).count() == 1 and catalogs.candidates(rows, ["none"], ("pd",)).count() == 0
    answers = spark.createDataFrame([('{"query": {"categorymembers": [{"ns": 0, "title": "A"}, {"ns": 14, "title": "B"}]}}',), ("broken",)], "value string")
    assert [r.title for r in catalogs.category_hits(answers, "s").collect()] == ["A"]
    found = spark.createDataFrame([('{"items": [{"identifier": "i", "date": "1890-01-01"}, {"title": "no id"}]}',)], "value string")
    assert [(r.source_id, r.year) for r in catalogs.archive_hits(found).collect()] == [("i", "1890")]
    document = '{"work_id": "w", "language": "ar", "structures": [{"id": "s", "sequence": 0, "paragraphs": [{"id": "p0", "sequence": 0, "text": "x", "source_hash": "bad"}, {"id": "p1", "sequence": 5, "text": "y"}]}]}'
    got = catalogs.document_paragraphs(spark.createDataFrame([(document,)], "value string"))
    assert [(r.id, r.problem) for r in got.orderBy("id").collect()] == [("p0", "hash"), ("p1", "sequence")]


def test_works_with_null_tags_and_empty_names(spark):
    bodies = {"a": '{"tags": [null], "author_en": "", "title_en": ""}', "b": '{"tags": ["x", null, "y"], "author_en": "", "author_ar": "A"}', "c": '{"tags": [""]}', "d": '{"tags": []}', "e": "not found"}
    works = catalogs.work_rows(spark.createDataFrame([(u, 1) for u in bodies], "uri string, rank int"), catalogs.metadata(spark.createDataFrame(list(bodies.items()), "uri string, body string"), "uri", "body"))
    got = {r.uri: (r.genre, r.author, r.title) for r in works.collect()}
    assert got == {"a": (None, "", None), "b": ("x;y", "A", None), "c": ("", None, None), "d": (None, None, None), "e": (None, None, None)}


def test_a_classifier_learns_what_can_be_learnt(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] > 0).astype(int)
    assert (features.predict(features.fit(x, y), x) == y).mean() > 0.97
    assert features.predict(features.fit(x, np.ones(300, int)), x).tolist() == [1] * 300
    rows = spark.createDataFrame([(f"r{i}", "abc"[i % 3], float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id string, g string, a double, b double, label int")
    judged = features.leave_one_group_out(rows, "id", "g", "label", ("a", "b")).toPandas()
    assert len(judged) == 300 and (judged.label == judged.predicted).mean() > 0.95
    one = features.leave_one_group_out(rows.where("g = 'a'"), "id", "g", "label", ("a", "b")).toPandas()
    assert set(one.predicted) == {0}


def test_tokens_of_names_and_uris(spark):
    df = spark.createDataFrame([("0300Tabari.TarikhRusul", "Tārīkh al-Rusul, ʿAjāʾib & The Book")], "uri string, title string")
    r = df.select(text.uri_tokens("uri").alias("u"), text.title_tokens("title").alias("t")).first()
    assert sorted(r.u) == ["rusul", "tabari", "tarikh"] and sorted(r.t) == ["ajaib", "rusul", "tarikh"]


@pytest.mark.parametrize("value", [None, "", "   "])
def test_empty_texts_have_defined_results(spark, value):
    df = spark.createDataFrame([(value,)], "c string")
    r = df.select(names.name_skeletons(F.coalesce("c", F.lit(""))).alias("n"), scans.arabic_year("c").alias("y"), scans.page_head("c").alias("h"), scans.run_in_heading("c")["heading"].alias("r")).first()
    assert (r.n, r.y, r.h, r.r) == ([], None, None, None)


def test_records_of_runs(spark):
    raw = spark.createDataFrame([("a", "x", 3, 0.5, None), ("b", None, None, None, None), (None, "y", 1, 0.1, None), ("c", None, None, None, "boom")], "id string, english string, output_tokens int, latency_s double, error string")
    made = records.run_rows(raw, run_id="r", adapter="batch")
    assert [(r.item_id, r.translation, r.error) for r in made.collect()] == [("a", "x", None), ("b", "", "neither output nor error"), (None, "y", "no id"), ("c", "", "boom")]
    assert tuple(records.run_summary(made).first()) == ("r", 4, 3, 4, 0.6)
    old = spark.createDataFrame([("a", "x"), ("c", "z"), ("d", "w")], "item_id string, translation string")
    got = {r.field: tuple(r)[1:] for r in records.compare_runs(made, old, "item_id", ["translation"]).collect()}
    assert got == {"translation": (2, 1, 2, 1)}
    one = spark.createDataFrame([("maker/gemma-27b-it", "2025-01-02 03:04:05")], "m string, at string").select(records.run_id(F.col("at").cast("timestamp"), "m", "batch").alias("x")).first().x
    assert one == "20250102T030405Z-batch-gemma_27b"


def test_pools_and_sheets(spark):
    long = "word " * 30
    pairs = spark.createDataFrame([("b", "1", long, "test"), ("a", "2", long, "test"), ("a", "3", "short", "test"), ("a", "4", long + "x", "train"), ("a", "5", None, None)], "source string, source_native_id string, arabic string, source_split string")
    pool = records.candidate_pool(pairs, F.col("source_split") == "test")
    assert [(r.source, r.source_native_id, r.band) for r in pool.collect()] == [("a", "2", "20-80")]
    items = spark.createDataFrame([("i", "a b", "s", None, "x"), ("j", None, None, None, None)], "id string, arabic string, source string, genre string, band string")
    outputs = spark.createDataFrame([("i", "one", "a b c", None)], "item_id string, system_id string, translation string, error string")
    sheet = records.grading_rows(items, outputs, [("one", "A"), ("two", "B")], "b").orderBy("row_id").collect()
    assert [(r.row_id, r.item_id, r.system_id, r.length_ratio) for r in sheet] == [("b-0001", "i", "one", "1.500"), ("b-0002", "i", "two", "0.000"), ("b-0003", "j", "one", ""), ("b-0004", "j", "two", "")]


def test_spans_of_words(spark):
    words = spark.createDataFrame([("k", i, w) for i, w in enumerate("a b a b c a".split())] + [("l", 0, "c")], "key string, at int, token string")
    patterns = spark.createDataFrame([("p", ["a", "b"]), ("q", ["c"]), ("r", ["c", "b"]), ("s", []), ("t", ["b", "c", "a"])], "name string, tokens array<string>")
    spans = timeline.find_spans(words, patterns, "key", "name")
    assert sorted(map(tuple, spans.collect())) == [("p", "k", 0, 2), ("p", "k", 2, 4), ("q", "k", 4, 5), ("q", "l", 0, 1), ("t", "k", 3, 6)]
    assert sorted(map(tuple, timeline.first_spans(spans, "name", "key").where("name = 'p'").collect())) == [("p", "k", 0, 2)]
    bounds = spark.createDataFrame([("k", 1, 4)], "key string, low int, high int")
    assert sorted((r.name, r.start, r.end, r.outside) for r in timeline.clamped(spans, bounds, "key").collect()) == [("p", 1, 2, True), ("p", 2, 4, False), ("t", 3, 4, True)]

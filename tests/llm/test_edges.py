"""Nulls in any column, clashing further columns, repeated rows, very long texts: the operators' defined results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinscript.llm import p01_forms, p02_sentences, p03_alignment, p04_entities, p05_consensus, p06_variants, p07_truncation, p08_packing, p09_leaks, p10_stuffed

D = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHING = "key t w b c at n word words text_1 canonical marked places scan place title rule bones family given p item labeller label posterior person chars bytes odds limit body tokens container offset share doc item_1 curve links tags weight slope stuffed _g _r part piece".split()


def tables(spark, *names):
    return [spark.read.parquet(f"{D}/{name}.parquet") for name in names]


def widened(df):
    """df with a row of nulls, every row twice, and further columns of clashing names."""
    nulls = df.sparkSession.createDataFrame([[None] * len(df.columns)], df.schema)
    out = df.unionByName(df).unionByName(nulls)
    return out.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


OPERATORS = {
    "p1": (("sentences",), p01_forms.lookalike_sentences),
    "p1 terms": (("glossary", "ledger_words"), p01_forms.lookalike_terms),
    "p2": (("paragraphs",), p02_sentences.sentence_units),
    "p3": (("sentences", "dp_links", "structural_links", "paragraphs"), lambda *t: p03_alignment.align(*t).select("arabic_sentence_id", "english_sentence_id")),
    "p4": (("translations", "works"), lambda *t: p04_entities.editions(*t).select("translation_id", "uri")),
    "p5": (("consensus_rows", "annotations"), lambda *t: p05_consensus.consensus(*t)[0].select("row_id", "publishable")),
    "p6": (("translations",), lambda t: p06_variants.variant_pairs(p06_variants.name_rows(t))),
    "p7": (("run_rows",), lambda t: p07_truncation.truncated(t).where("cut").select("run_id", "item_id")),
    "p9": (("documents", "eval_items"), lambda *t: p09_leaks.leaks(*t).select("doc_id", "item_id")),
    "p10": (("documents",), lambda t: p10_stuffed.judged(t).where("stuffed").select("doc_id").distinct()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns_change_nothing(spark, name):
    names, operator = OPERATORS[name]
    plain = tables(spark, *names)
    got, want = set(rows(operator(*map(widened, plain)))), set(rows(operator(*plain)))
    # statistics weigh repeated rows alike, except where one row among a few decides
    assert len(got ^ want) <= 0.02 * len(want) + 1, (sorted(got - want, key=str)[:3], sorted(want - got, key=str)[:3])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    names, operator = OPERATORS[name]
    assert operator(*(t.limit(0) for t in tables(spark, *names))).count() == 0


def test_very_long_texts(spark):
    long = "The cook saw the king in the hall. " * 6000 + "كتب " * 6000 + "word" * 20000
    docs = spark.createDataFrame([(1, "s", long), (2, "s", "short"), (3, None, None)], "doc_id bigint, source string, text string")
    items = spark.createDataFrame([("q", "The cook saw the king in the hall. " * 3, None)], "id string, arabic string, reference_english string")
    assert {r.doc_id for r in p09_leaks.leaks(docs, items).collect()} == {1}
    assert p09_leaks.without_spans(docs, items).where("doc_id = 1").first().cut > 200_000
    assert p10_stuffed.judged(docs).count() == 2
    packed = p08_packing.pack(p08_packing.token_counts(docs.withColumnRenamed("doc_id", "id")))
    assert packed.where("id = 1").agg(F.max("tokens")).first()[0] == p08_packing.CAPACITY
    nouns = "cook king hall mule poet widow".split()
    varied = " ".join(f"The {nouns[k % 6]} saw the {nouns[k % 5]} in the {nouns[k // 7 % 6]}." for k in range(6000))
    paragraphs = spark.createDataFrame([("p", "en", varied)], "id string, language string, text string")
    assert p02_sentences.sentence_units(paragraphs).count() == 6000
    runs = spark.createDataFrame([("r", "i", "m", "a", long, 9), ("r", "j", "m", "a", "word" * 8000, 9)], "run_id string, item_id string, model string, adapter string, translation string, output_tokens int").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    assert p07_truncation.truncated(runs).count() == 2

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinscript.functions import checks, inject
from twinscript.functions import text as t
from twinscript.operators import alignment, segment


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_words_and_bands(spark):
    assert col(spark, [None, "", " a  b c ", "x"], t.word_count("x")) == [0, 0, 3, 1]
    assert col(spark, [19, 20, 80, 81, 99, 100, 250, 251, 600, 601], t.length_band("x"), "int") == [None, "20-80", "20-80", None, None, "100-250", "100-250", "250-600", "250-600", None]
    assert col(spark, ["٣٤ and 034, 7", None, "none"], t.numbers("x")) == [[7, 34], None, []]
    assert col(spark, ["A b. C! D? e", ""], F.size(t.sentences("x"))) == [4, 0]


def test_ids_and_flags(spark):
    assert col(spark, ["a#b0003", "a", "a#bx"], t.block_parent("x")) == ["a", None, None]
    assert col(spark, ["entity;TERM, nope", None, "OK"], t.pipe_flags("x")) == ["ENTITY|TERM", "OK", "OK"]
    assert col(spark, ["```json\n[{\"id\": \"b0\", \"english\": \"x\"}]\n```", "no", None], F.size(t.response_blocks("x"))) == [1, None, None]
    assert col(spark, ["kitabb", "Shaykh"], t.latin_skeleton("x")) == ["ktb", "shkh"]


def test_checks_tell_not_applicable_from_passed(spark):
    df = spark.createDataFrame([("لا ٣", "not 3"), ("لا ٣", "4"), ("abc", ""), (None, None)], "s string, o string")
    rows = df.select(checks.number_coverage("s", "o").alias("n"), checks.negation_parity("s", "o").alias("g")).collect()
    assert [(r.n.applicable, r.n.passed) for r in rows] == [(True, True), (True, False), (False, None), (False, None)]
    assert [r.g.passed for r in rows] == [True, False, True, True]


def test_injections_change_the_text_or_are_absent(spark):
    texts = ["He did not go in year 12. Ali ibn Umar came from Basra! The mosque is 3:4.", "", None, "plain"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x_text string")
    rows = inject.inject(df, "x_text").select("id", "x_text", "x.injector", "x.corrupted").collect()
    assert all(r.corrupted != r.x_text for r in rows)
    names = {r.injector for r in rows if r.id == 0}
    assert {"delete_negation", "change_number", "remove_clause", "mistranslate_term", "alter_date", "alter_citation"} <= names
    assert not {r.injector for r in rows if r.id == 2}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?،:", max_size=300), st.integers(1, 9))
def test_blocks_lose_no_word(text, most):
    blocks = segment.blocks_of(text, most)
    assert " ".join(blocks) == " ".join(text.split())
    assert all(0 < len(b.split()) <= most for b in blocks)


def test_kernels():
    assert alignment.rising_run([3, 1, 2, 5, 4, 6]) == [1, 2, 4, 5]
    assert alignment.rising_run([]) == []
    assert alignment.monotone_chain([(1, 1, 1.0), (2, 2, 1.0), (1, 3, 1.5)]) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert alignment.length_partition([1, 2], [1, 1, 1]) == [(0, 1), (1, 3)]
    assert [x[:4] for x in alignment.best_path(2, 2, lambda first, last, a, e: np.eye(3)[first:last, : 3 - e])] == [(0, 1, 0, 1), (1, 2, 1, 2)]
    assert alignment.best_path(0, 0, lambda *_: np.zeros((0, 0))) == []

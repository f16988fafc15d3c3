"""The operators for training data: hard cases, brute force on small inputs, exact round trips."""

from __future__ import annotations

import random
import timeit

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscript.llm import _names as names
from twinscript.llm import p01_forms, p02_sentences, p03_alignment, p04_entities, p05_consensus, p06_variants, p07_truncation, p08_packing, p09_leaks, p10_stuffed
from twinscript.llm._chars import fold, is_plain


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1 -----------------------------------------------------------------------------------------------------------------


def test_lookalikes_agree_with_brute_force(spark):
    texts = ["the pen", "thе pen", "the pen", "th​e pen", "thé pen", "The pen", "ｔhe pen", " the  pen", "كتاب", "ﻛﺘﺎب", "کتاب", "كتابـ", "كِتاب", "", "​", "the pen"]
    df = spark.createDataFrame([(f"s{i:02d}", "w", "en", t, "extra") for i, t in enumerate(texts)] + [("n", "w", "en", None, ""), ("o", "v", "en", "the pen", "")], "id string, work_id string, language string, text string, canonical string")
    want = sorted((f"s{i:02d}", f"s{j:02d}") for i, j in p01_forms.brute_force(texts))
    assert rows(p01_forms.lookalike_sentences(df)) == want
    assert rows(p01_forms.lookalike_sentences(df.unionByName(df))) == want
    assert rows(p01_forms.lookalike_sentences(df.limit(0))) == []


def test_glossary_terms_among_words(spark):
    g = spark.createDataFrame([("g1", "كتاب", "x"), ("g2", None, "x")], "entry_id string, arabic string, text string")
    w = spark.createDataFrame([("1", "كتاب"), ("2", "ﻛﺘﺎب"), ("2", "ﻛﺘﺎب"), ("3", "كتابي"), ("4", None), ("5", ""), ("6", "كتاب‏")], "id string, text string")
    assert rows(p01_forms.lookalike_terms(g, w)) == [("g1", "2"), ("g1", "6")]


def test_trie_prefers_cheap_then_frequent():
    trie = p01_forms.Trie()
    for w, n in (("علي", 2), ("على", 5), ("علم", 9)):
        trie.add(w, n)
    assert [m[2] for m in trie.matches("علی")] == ["على", "علي"]
    assert {m[2]: m[0] for m in trie.matches("علي", 1)} == {"علي": 0, "على": 1, "علم": 1}
    assert [m[:3] for m in trie.matches("ع\u200dل\u200cم")] == [(0, -9, "علم")]
    assert {m[2]: m[0] for m in trie.matches("ع\u200dلم", 1)} == {"علم": 0, "علي": 1, "على": 1}
    assert fold("Сat") == "Cat" and is_plain("Cat") and not is_plain("Сat")


# --- 2 -----------------------------------------------------------------------------------------------------------------

PLAIN = ["The cook saw the king.", "A king met the cook in the hall!", "Who took the pen in the hall?", "The pen fell at noon.", "In the hall the cook slept.", "He slept in the hall of the king.", "The pen fell from the hall."]


def units(spark, texts, language="en"):
    background = [" ".join(random.Random(i).sample(PLAIN, 5)) for i in range(60)] + [f"Dr. Smith saw Mr. Jones at {i} p.m. The cook slept. The king rode at {i} p.m." for i in range(2, 30)]
    learn = spark.createDataFrame([(f"b{i}", language, t) for i, t in enumerate(background)], "id string, language string, text string")
    df = spark.createDataFrame([(f"t{i}", language, t) for i, t in enumerate(texts)], "id string, language string, text string")
    got: dict[int, list[int]] = {}
    for r in p02_sentences.sentence_units(df, learn.unionByName(df)).collect():
        got.setdefault(int(r.paragraph_id[1:]), []).append(r.end_offset)
    return [sorted(got.get(i, [])) for i in range(len(texts))]


def cut(text, ends):
    return [text[a:b].strip() for a, b in zip([0, *ends], ends, strict=False)]


def test_sentence_units(spark):
    texts = ["Dr. Smith met Mr. Jones. The cook slept. ", '"The king! Is it so?" asked Jones. The pen fell.', "It cost 3.50 in all. 4. The pen fell.", None, "", "  ", "no mark", "The king slept.The cook saw him at 5 p.m. The pen fell.", 'He said: "The pen." The cook slept.']
    ends = units(spark, texts)
    assert cut(texts[0], ends[0]) == ["Dr. Smith met Mr. Jones.", "The cook slept."]
    assert cut(texts[1], ends[1]) == ['"The king! Is it so?" asked Jones.', "The pen fell."]
    assert cut(texts[2], ends[2]) == ["It cost 3.50 in all.", "4. The pen fell."]
    assert ends[3:7] == [[], [], [], [7]]
    assert cut(texts[7], ends[7]) == ["The king slept.", "The cook saw him at 5 p.m.", "The pen fell."]
    assert cut(texts[8], ends[8]) == ['He said: "The pen."', "The cook slept."]


def test_chinese_units():
    text = "水手说：“诗人卖了3.5斤石榴。” “诗人买了书！”商人喊道。学生来了。"
    ends = [p[0] for p in p02_sentences.places(text)[0] if p[1] in ("sure", "final")]
    assert cut(text, ends) == ["水手说：“诗人卖了3.5斤石榴。”", "“诗人买了书！”商人喊道。", "学生来了。"]


def test_quotations_nest_and_may_stay_open():
    assert p02_sentences.quoted('a "b" «c «d» e» “f') == [(2, 5), (6, 15)]
    assert p02_sentences.quoted("«« a » b") == [(1, 6)] and p02_sentences.quoted("x‘y’ ‘z’") == [(5, 8)]
    assert p02_sentences.quoted('"') == [] and p02_sentences.quoted("") == []


@pytest.mark.parametrize("unit", ["He said: «so. ", "水手卖了石榴", "a. b. 3.5 \n", '"Who?" asked he. ', "word \u200b "])
def test_places_take_linear_time(unit):
    def seconds(n):
        text = unit * n
        return min(timeit.repeat(lambda: p02_sentences.places(text), number=1, repeat=3))

    assert seconds(8000) < 3 * seconds(4000) + 0.05


# --- 3 -----------------------------------------------------------------------------------------------------------------


def test_alignment_of_a_made_up_pair(spark):
    rng = random.Random(1)
    pairs = {"".join(rng.sample("بتجدرسفكمنهلو", 4)): "".join(rng.sample("abcdefghijklmnopqrtuv", 6)) for _ in range(150)}
    keys = list(pairs)
    sides, links, want = [], [], set()
    for k in range(120):
        some = rng.sample(keys, 4)
        sides.append((f"a{k}", "p", "w", "ar", 0, k, " ".join(some)))
        if k % 10 != 7:  # untranslated sentences
            y = sum(1 for x in sides if x[3] == "en")
            sides.append((f"e{k}", "p", "w", "en", 0, y, " ".join(pairs[s] for s in some)))
            want.add((f"a{k}", f"e{k}"))
            links.append(("w", k, k + 1, y, y + 1))
    s = spark.createDataFrame(sides + [("n", "p", "w", "ar", 0, 500, None)], "id string, paragraph_id string, work_id string, language string, sequence int, global_sequence int, text string")
    dp = spark.createDataFrame(links, "work_id string, arabic_start int, arabic_end int, english_start int, english_end int")
    got = {(r[0], r[1]) for r in p03_alignment.align(s.unionByName(s.limit(5)), dp).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert p03_alignment.align(s.limit(0), dp.limit(0)).count() == 0


def _work(spark, sides):
    return spark.createDataFrame([("w", la, at, text) for la, at, text in sides], "work_id string, language string, global_sequence int, text string").withColumn("id", F.concat("language", F.col("global_sequence").cast("string")))


def test_concepts_are_the_same_sent_or_joined(spark):
    rng = random.Random(8)
    names, numbers = ["salim", "karim", "badr", "فرج", "كريم", "سليم"], ["12", "١٢", "7"]
    sides = [(la, at, " ".join(rng.choices(names + numbers + [f"word{k}" for k in range(20)], k=rng.randint(0, 9)))) for la in ("ar", "en") for at in range(40)]
    s = p03_alignment._sentences(_work(spark, sides))
    e, a = p03_alignment._hash("=", "word1") & ~1, p03_alignment._hash("=", "word2") & ~1
    lex = spark.createDataFrame([(e, a)], "e bigint, a bigint")
    known = p03_alignment.terms(p03_alignment.vocabulary(s)[0], lex, 80, [p03_alignment._hash("=", "word7") & ~1])
    sent, joined = ({(r.language, r.at): (r.whole, sorted(zip(r.c, r.bit, r.weight, strict=True))) for r in p03_alignment.concepts(s, known, most).collect()} for most in (100, 0))
    assert {k: c for k, (_, c) in sent.items()} == {k: c for k, (_, c) in joined.items()} and any(c for _, c in sent.values())
    assert {k: n for k, (n, _) in sent.items()} == pytest.approx({k: n for k, (n, _) in joined.items()}, rel=1e-5)


def test_proposals_of_any_width_and_sentences_of_any_length(spark):
    dp = spark.createDataFrame([("w", 0, 2, 5, 7), ("w", 10, 30, 100, 160), ("w", 5, 5, 1, 2), ("w", None, 2, 1, 2)], "work_id string, arabic_start int, arabic_end int, english_start int, english_end int")
    got = {(r.x, r.y) for r in p03_alignment._proposals(dp).collect()}
    assert {p for p in got if p[0] < 3} == {(0, 5), (0, 6), (1, 5), (1, 6)}
    assert {p for p in got if p[0] >= 10} == {(x, 100 + 3 * (x - 10) + k) for x in range(10, 30) for k in range(3)}
    starts = np.array([0, 2])
    assert [int.from_bytes(b, "little") for b in p03_alignment._ors(starts, np.array([3, 200, 63, 0]))] == [1 << 3 | 1 << 200, 1 << 63 | 1]


def test_chain_is_monotone_and_heaviest():
    rng = np.random.default_rng(0)
    x, y = (np.array(v) for v in zip(*random.Random(0).sample([(i, j) for i in range(12) for j in range(12)], 40), strict=True))
    w = rng.random(40)
    got = p03_alignment.chain(x, y, w)
    best = {}
    for i in sorted(range(40), key=lambda i: (x[i], y[i])):
        best[i] = w[i] + max([best[j] - 0.01 * abs(y[i] - y[j] - x[i] + x[j]) for j in best if x[j] <= x[i] and y[j] <= y[i]] + [0])
    assert abs(sum(w[i] for i in got) - sum(0.01 * abs(y[b] - y[a] - x[b] + x[a]) for a, b in zip(got, got[1:], strict=False)) - max(best.values())) < 1e-9
    assert all(x[a] <= x[b] and y[a] <= y[b] for a, b in zip(got, got[1:], strict=False))
    assert len(p03_alignment.chain(x[:0], y[:0], w[:0])) == 0


# --- 4, 6 --------------------------------------------------------------------------------------------------------------


def test_names_in_their_parts(spark):
    for n in ("Schafidsch Ibn Saqisch AlYitwili", "YITWILI (SHAFIDJ B. SAKISH)", "al Yitweelee, Shafij ibn Saqish", "Shāfij bin Saqīsh, called al-Yitwīlī (d. 106 AH)"):
        p = names.parse_author(n)
        assert (p["family"], p["given"], p["father"]) == ("yitwili", "shafij", "sakish"), n
    for n in (None, "", "n.a.", "Anonymous", "[unknown]", "Various hands"):
        assert names.parse_author(n)["family"] is None and names.parse_translator(n)["family"] is None
    some = ["abcd", "abdc", "abc", "abcde", "bacd", "axcd", "abcc", "", "dcba", "abdce"]
    pairs = spark.createDataFrame([(x, y) for x in some for y in some], "a string, b string")
    assert {(r.a, r.b) for r in pairs.where(names.one_edit("a", "b")).collect()} == {(x, y) for x in some for y in some if names.edits(x, y) == 1}
    assert names.edits("abcd", "abdc") == 1 and names.edits("abc", "abd") == 1 and names.edits("a", "abcd") == 3


def test_variants_are_linked_and_relatives_kept_apart(spark):
    t = ["Victoria B. Orvoneville"] * 3 + ["Orvoneville, Vicky", "V. B. Orvoneville", "ORVONEVILLE (Victoria)", "Victoria Orvonevlile", "Robert Orvoneville", "Orvoneville, Robt.", "Anonymous", None, ""]
    df = spark.createDataFrame([("translator", x) for x in t], "role string, name string")
    got = {frozenset((r.name_a, r.name_b)) for r in p06_variants.variant_pairs(df).collect()}
    victoria, robert = {"Victoria B. Orvoneville", "Orvoneville, Vicky", "V. B. Orvoneville", "ORVONEVILLE (Victoria)", "Victoria Orvonevlile"}, {"Robert Orvoneville", "Orvoneville, Robt."}
    assert got == {frozenset((a, b)) for g in (victoria, robert) for a in g for b in g if a != b}
    assert p06_variants.variant_pairs(df.limit(0)).count() == 0


def test_editions_by_rules(spark):
    w = spark.createDataFrame([("0106ShafijYitwili.TuhfatRumuzFiRuya", "Ibn Saqish Yitwili", "Tuhfat Rumuz fi Ruya")] * 2 + [("0107JasjanYitwili.TuhfatRumuzFiRuya", None, None), ("0200QaghikhThuzwuqi.Diwan", None, None)], "uri string, author string, title string")
    s = "id bigint, openiti_uri string, work_arabic_title string, work_english_title string, author string, extra string"
    t = spark.createDataFrame(
        [(i, None, None, "Tuhfat al-Rumuz fi l-Ruya (The Gift of Symbols concerning Visions)", "x, y", "") for i in range(100, 104)]
        + [(1, None, None, "Gift of Symbols concerning Visions", "Schafidsch al-Yitwili", ""), (2, None, None, "The Gift of Symbls concerning Visions, vol. 1", "Jasjan al-Yitwili", ""), (3, None, None, "Gift of Symbols concerning Visions", "al-Yitwili", ""), (4, None, None, None, None, ""), (5, None, "ديوان", "Diwan", "Qaghikh al-Thuzwuqi", ""), (6, None, None, "Diwan", "Someone Else", "")],
        s,
    )
    got = {r.translation_id: r.uri[:4] for r in p04_entities.editions(t, w).collect()}
    assert got == {1: "0106", 2: "0107", 5: "0200"}


def test_editions_plans_stay_small(spark, monkeypatch):
    # the driver holds every plan: matches are one table, and passes don't run each other's anti-joins again
    scans, antijoins = [], []

    def count(df):
        plan = df._jdf.queryExecution().optimizedPlan()
        scans.append(plan.collectLeaves().size())
        antijoins.append(plan.toString().count("Join LeftAnti"))
        return df

    cut = p04_entities.cut_lineage
    monkeypatch.setattr(p04_entities, "cut_lineage", lambda df: cut(count(df)))
    count(p04_entities.editions(*(spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("translations", "works"))))
    assert scans[-1] <= 4 and max(scans) <= len(p04_entities.RULES) and sum(scans) <= 130
    assert len(p04_entities.RULES) - 1 <= sum(antijoins) <= 20, antijoins


# --- 5 -----------------------------------------------------------------------------------------------------------------


def test_consensus_finds_truth_and_spammers(spark):
    rng = random.Random(3)
    truth = {f"r{i}": rng.random() < 0.6 for i in range(200)}
    labels = []
    for a, skill in (("good1", 0.95), ("good2", 0.9), ("fair", 0.7), ("spam", 0.0)):
        for r, v in truth.items():
            said = v if rng.random() < skill else (rng.random() < (0.95 if a == "spam" else 0.5))
            labels.append((r, a, rng.choice([" Y", "yes"]) if said else rng.choice(["n", "No"]), "high", None))
    schema = "row_id string, first_publishable string, second_publishable string, first_confidence string, second_confidence string"
    c = spark.createDataFrame([(r, "?", None, "high", "low") for r in truth] + [("empty", None, "", None, None)], schema)
    a = spark.createDataFrame(labels + labels[:10] + [("nobody", "good1", "Y", "high", None)], "row_id string, annotator_id string, publishable string, confidence string, labelled_at timestamp")
    items, people = p05_consensus.consensus(c, a)
    got = {r.row_id: r.publishable for r in items.collect()}
    assert set(got) == {*truth, "empty"}
    assert sum((got[r] == "Y") == v for r, v in truth.items()) >= 185
    parts = {r.row_id: (r.labels, r.agreement) for r in items.collect()}
    for r in truth:
        said = {w: x[2].strip().upper()[:1] for x in labels if (w := x[1]) and x[0] == r}
        yes = sum(v == "Y" for v in said.values())
        assert parts[r] == (4, pytest.approx((yes * (yes - 1) + (4 - yes) * (3 - yes)) / 12))
    assert parts["empty"] == (0, None)
    skill = {r.labeller: r.competence for r in people.collect()}
    assert skill["spam"] < 0.2 < 0.5 < skill["fair"] < skill["good2"]


def test_long_chains_of_misspellings_reach_their_end(spark):
    given = ["abcdefghijkl"]
    for k in range(11):
        given.append(given[-1][:k] + "z" + given[-1][k + 1 :])
    schema = "role string, name string, n bigint, family string, given string, father string, kunya string, death int, bones string, given_bones string, father_bones string"
    df = spark.createDataFrame([("translator", f"{g} x", 2**k, "familyname", g, None, None, None, "b", "g", None) for k, g in enumerate(given)], schema)
    assert {r.person for r in p06_variants.persons(df)[0].collect()} == {f"familyname|{given[-1]}"}


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_limits_and_endings(spark):
    rng = np.random.default_rng(0)
    n = np.minimum(rng.lognormal(5, 0.5, 2000).astype(int) + 1, 300)
    v, k = np.unique(n, return_counts=True)
    assert [x[0] for x in p07_truncation.limits_of(v, k)][-1] == 300 and p07_truncation.limits_of(v[v < 300], k[v < 300]) == []
    nouns, verbs, places = "cook king boy baker poet widow merchant traveller".split(), "saw met followed remembered forgot".split(), "garden river house market tower hospital".split()
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} in the {rng.choice(places)}."
    texts = [" ".join(sentence() for _ in range(rng.integers(1, 12))) for _ in range(400)]
    runs = [("r", f"i{i}", "m", "a", t, None) for i, t in enumerate(texts)] + [("r", "cut", "m", "a", "The cook saw the king in the gard", None), ("r", "half", "m", "a", "The cook saw the �", None), ("r", "bare", "m", "a", "The cook saw the king in the garden", None), ("r", "null", "m", "a", None, None), ("r", "json", "m", "a", '[{"id": "b0", "english": "The co', None), ("r", "whole", "m", "a", '[{"id": "b0", "english": "The cook"}]', None)]
    df = spark.createDataFrame(runs, "run_id string, item_id string, model string, adapter string, translation string, output_tokens int").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    cut_ones = {r.item_id for r in p07_truncation.truncated(df.unionByName(df)).where("cut").collect()}
    assert cut_ones == {"cut", "half", "json"}
    assert p07_truncation.truncated(df.limit(0)).count() == 0


def test_beginnings_of_longer_words_are_counted_as_by_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))): rng.randint(1, 5) for _ in range(120)} | {"a" * 3000: 2}
    ends = [w for w in words if rng.random() < 0.5]
    got = {r.word: r.longer for r in p07_truncation._longer(spark.createDataFrame([(w,) for w in ends], "word string"), spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {e: sum(n for w, n in words.items() if w.startswith(e) and w != e) for e in ends}
    assert got == {e: n for e, n in want.items() if n}


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice(["a", "a", "b", None]), rng.choice([0, rng.randint(1, 60), rng.randint(50, 350)])) for i in range(800)] + [(900, "b", None)]
    df = spark.createDataFrame(sizes, "id bigint, source string, tokens bigint")
    packed = p08_packing.pack(df, capacity=100, window=8, containers=50).toPandas()
    whole = packed.groupby("id").tokens.sum()
    assert {i: int(whole[i]) for i, _, _ in sizes} == {i: n or 0 for i, _, n in sizes}
    filled = packed.groupby("container").tokens.sum()
    assert filled.max() <= 100 and filled.sum() / (100 * len(filled)) > 0.9
    for _, g in packed.sort_values(["container", "offset", "tokens"]).groupby("container"):
        assert (g.offset.to_numpy()[1:] >= (g.offset + g.tokens).to_numpy()[:-1]).all()
    assert packed[packed.id.isin([i for i, _, n in sizes if n and n <= 100])].groupby("id").size().max() == 1
    assert p08_packing.pack(df.limit(0), capacity=100).count() == 0


def test_windows_keep_to_the_mix_over_partitions(spark):
    rng = random.Random(6)
    # sources come in long runs of ids, the hash spreads them; one source holds half of all
    sizes = [(i, "a" if i < 3000 else "b" if i < 4800 else "c", rng.randint(1, 60)) for i in range(6000)]
    df = spark.createDataFrame(sizes, "id bigint, source string, tokens bigint")
    packed = p08_packing.pack(df, capacity=100, window=16, containers=200).persist()
    report = {r.source: r for r in p08_packing.mix_report(packed, 16).collect()}
    assert set(report) == {"a", "b", "c"} and sum(r.share for r in report.values()) == pytest.approx(1)
    assert all(r.deviation < 0.03 and r.worst < 0.1 for r in report.values()), report
    # a target beyond the supply holds while every source lasts
    skewed = p08_packing.pack(df.where("source <> 'c'"), capacity=100, window=16, containers=10000, proportions={"a": 0.5, "b": 0.5}).toPandas()
    skewed["window"] = skewed.container.str.split("-").str[1].astype(int) // 16
    share = skewed[skewed.source == "b"].groupby("window").tokens.sum() / skewed.groupby("window").tokens.sum()
    assert (share.iloc[:30] - 0.5).abs().mean() < 0.05 and skewed.tokens.sum() == sum(n for _, s, n in sizes if s != "c")


def round_robin(pieces, capacity, quantum, window):
    """Deficit round-robin and best fit, visit by visit."""
    order = sorted(quantum)
    queues = {s: [i for i, p in enumerate(pieces) if p[0] == s] for s in order}
    credit = dict.fromkeys(order, 0)
    at, arrived, base, out = 0, True, 0, []
    while any(queues.values()):
        chosen, size, bins, back = [], 0, [], []
        while any(queues.values()) and size < capacity * window:
            s = order[at]
            credit[s] += quantum[s] if arrived else 0
            arrived = False
            while queues[s] and pieces[queues[s][0]][1] <= credit[s] and size < capacity * window:
                chosen.append(queues[s].pop(0))
                credit[s] -= pieces[chosen[-1]][1]
                size += pieces[chosen[-1]][1]
            if size < capacity * window:
                at, arrived = (at + 1) % len(order), True
        for i in sorted(chosen, key=lambda i: (-pieces[i][1], i)):
            n = pieces[i][1]
            fits = min((b for b in bins if b[0] >= n), default=None)
            if fits is None and len(bins) < window:
                bins.append(fits := [capacity, base + len(bins)])
            if fits is None:
                back.append(i)
                continue
            out.append((i, fits[1], capacity - fits[0]))
            fits[0] -= n
        for i in sorted(back, reverse=True):
            queues[pieces[i][0]].insert(0, i)
            credit[pieces[i][0]] += pieces[i][1]
        base += len(bins)
    return out


def test_packing_is_deficit_round_robin():
    rng = random.Random(7)
    shares = {"a": 0.5, "b": 0.25, "c": 0.125, "d": 0.125}
    for window in (1, 2, 4) * 40:
        pieces = [(s, 1) for s in "abcd"] + [(rng.choice("aabcd"), rng.choice([0, rng.randint(1, 64), rng.randint(1, 12)])) for _ in range(rng.randint(0, 150))]
        assert p08_packing.fill(pieces, 64, shares, window) == round_robin(pieces, 64, {s: 64 * v for s, v in shares.items()}, window)
    # a source without a share waits for all others, however small its texts and however far theirs are from being paid
    pieces = [("a", 90)] * 20 + [("z", 1)] * 20
    placed = p08_packing.fill(pieces, 100, {"a": 1.0, "z": 0.0}, 4)
    assert sorted(i for i, _, _ in placed) == list(range(40))
    assert [i for i, c, _ in placed if c < 16 and i >= 20] == [] and max(c for _, c, _ in placed) == 19
    assert p08_packing.fill([("a", 5), ("z", 0), ("z", 7)], 10, {}, 2) == [(2, 0, 0), (0, 1, 0), (1, 0, 7)]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "s", "hello world"), (2, "s", ""), (3, None, None)], "id bigint, source string, text string")
    assert rows(p08_packing.token_counts(df).select("id", "tokens")) == [(1, 2), (2, 0), (3, 0)]


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_leaks_however_typed(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    item = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(3)]
    formula = "it is told by those whom all men trust that once "
    items = spark.createDataFrame([(f"q{i}", None, formula + t) for i, t in enumerate(item)], "id string, arabic string, reference_english string")
    w = item[0].split()
    changed = [x if k % 9 else "zzz" for k, x in enumerate(w)]
    noise = " ".join(rng.choice(vocabulary) for _ in range(300))
    docs = [(1, noise + " " + item[0].upper() + "!"), (2, noise + " " + "\n".join(changed[:30])), (3, noise + " " + " ".join(w[5:11]) + " " + noise), (4, formula + noise), (5, None), (6, ""), (7, item[1] + " " + item[2])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, share string")
    assert rows(p09_leaks.leaks(df.unionByName(df), items).select("doc_id", "item_id")) == [(1, "q0"), (2, "q0"), (7, "q1"), (7, "q2")]
    assert {r.doc_id for r in p09_leaks.without_leaks(df, items).collect()} == {3, 4, 5, 6}
    assert p09_leaks.leaks(df, items.limit(0)).count() == 0
    for chars in (10**6, 400):
        left = {r.doc_id: (r.text, r.cut) for r in p09_leaks.without_spans(df, items, chars).collect()}
        assert left[1] == (noise + "  !", len(item[0])) or left[1][0].strip() == noise
        assert left[3] == (docs[2][1], 0) and left[4] == (docs[3][1], 0) and left[5] == (None, 0)
        assert left[2][0].startswith(noise) and left[2][1] > 60 and left[7][1] >= len(docs[6][1]) - 1


def test_leaks_are_the_same_in_any_number_of_slices(spark):
    rng = random.Random(9)
    formula = " ".join(f"formula{k}" for k in range(12))
    items = spark.createDataFrame([(f"q{i}", f"{formula} " + " ".join(f"w{rng.randint(0, 400)}" for _ in range(25)), None) for i in range(8)], "id string, arabic string, reference_english string")
    texts = [r.arabic for r in items.collect()]
    df = spark.createDataFrame([(1, "x " * 9 + formula), (2, texts[3]), (3, f"{formula} {texts[5][-90:]} y")], "doc_id bigint, text string")
    got = [rows(p09_leaks.leaks(df, items, n)) for n in (10**6, 700, 150)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {2, 3}


def test_invisible_letters_of_every_plane_are_seen_through():
    assert p09_leaks.words_of("hel\U000e0061lo w\U000e0100ord") == ["hello", "word"] == p03_alignment.words("hel\U000e0061lo w\U000e0100ord", False)
    assert fold("w\U000e0100ord") == "word"


def test_a_quarter_of_a_short_item_leaks(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items = spark.createDataFrame([("q", " ".join(words[:26]), None), ("s", " ".join(words[30:35]), None)], "id string, arabic string, reference_english string")
    noise = " ".join(words[60:120])
    docs = [(1, f"{noise} {' '.join(words[4:11])} {noise}"), (2, f"{noise} {' '.join(words[4:10])} {noise}"), (3, f"{noise} {' '.join(words[30:35])} {noise}"), (4, f"{noise} {' '.join(words[30:34])} {noise}")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(p09_leaks.leaks(df, items).select("doc_id", "item_id")) == [(1, "q"), (3, "s")]


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_stuffed_pages(spark):
    rng = random.Random(4)
    nouns, places = "cook king pen boy mule baker poet widow".split(), "garden river house mill market tower".split()
    prose = [" ".join(f"The {rng.choice(nouns)} saw the {rng.choice(nouns)} in the {rng.choice(places)} and went to a {rng.choice(places)}." for _ in range(rng.randint(2, 9))) for _ in range(150)]
    spam = ["buy books online " * 30, "free ebook | cheap novels | " * 15, "http://a.test/x http://b.test/y " * 8, "#FreeBooks #CheapNovels " * 15]
    verse = ["\n".join("The king is gone to the river and the mill," for _ in range(12))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*prose, *spam, *verse, "", None, "short"])], "doc_id bigint, text string, words int")
    got = {r.doc_id for r in p10_stuffed.judged(df).where("stuffed").collect()}
    assert got == {150, 151, 152, 153}
    assert p10_stuffed.judged(df.limit(0)).count() == 0


def _plain_and_stuffed(rng):
    """150 pages of prose of which half the words are common, six of keywords."""
    rare = ["".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(600)]
    prose = [" ".join(f"The {rng.choice(rare)} {rng.choice(rare)} saw the {rng.choice(rare)} in the {rng.choice(rare)}." for _ in range(rng.randint(4, 12))) for _ in range(150)]
    keywords = "buy cheap books online free novels ebooks download the".split()
    return prose, [" ".join(rng.sample(keywords, 9)) + " " + " ".join(keywords[i % 8 : i % 8 + 1] + keywords) * 10 for i in range(6)]


def test_stuffed_pages_with_common_words(spark):
    prose, spam = _plain_and_stuffed(random.Random(6))
    mixed, verse = "the books the novels " * 25, "\n".join("the king saw the mill in the rain" for _ in range(20))
    df = spark.createDataFrame(list(enumerate([*prose, *spam, mixed, verse])), "doc_id bigint, text string")
    got = {r.doc_id: r for r in p10_stuffed.judged(df).collect()}
    assert got[156].ratio > 0.8 and got[156].stuffed
    assert {i for i, r in got.items() if r.stuffed} == set(range(150, 157))


@pytest.mark.parametrize("alike", [True, False])
def test_a_hot_group_of_stuffed_pages_defines_nothing(spark, alike):
    rng = random.Random(7)
    prose, spam = _plain_and_stuffed(rng)
    hot = "old poetry cheap maqamat arabic pdf".split()
    pages = [" ".join(hot * 8)] * 100 if alike else [" ".join(" ".join(rng.sample(hot, 6)) + " old poetry cheap" * 9 for _ in range(3)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate([*prose, *spam, *pages])), "doc_id bigint, text string")
    assert {r.doc_id for r in p10_stuffed.judged(df).where("stuffed").collect()} == set(range(150, 256))


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_packed", "p9_found", "p10_found"])
def test_queries_run_on_the_smallest_tables(spark, name):
    from twinscript.llm import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

"""Glossary retrieval, routing between systems, consensus of two sittings, policy simulation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.functions import text as t


def retrieve(passages: DataFrame, glossary: DataFrame, most: int = 100_000) -> DataFrame:
    """(id, entry_id): glossary entries whose term occurs in passages(id, text, book).

    Terms of one or two characters must not touch Arabic letters; books must agree where both are given; rejected
    entries and blank terms don't count, null texts hold nothing. Up to so many terms go to the executors, where one
    automaton finds all of them in one pass over a text, whatever its length; more are cut to the letters they begin
    with, which a text offers once for each place, and compared there.
    """
    g = glossary.where("coalesce(status, '') <> 'rejected' and trim(arabic) <> ''").select("entry_id", "arabic", F.col("book").alias("g_book"))
    p = passages.where("text is not null").select("id", "text", F.col("book").alias("p_book"))
    terms = [r["arabic"] for r in g.select("arabic").distinct().limit(most + 1).collect()]
    found = _by_automaton(p, sorted(terms)) if len(terms) <= most else _by_head(p, g)
    return found.join(g, "arabic").where(F.col("g_book").isNull() | F.col("p_book").isNull() | (F.col("g_book") == F.col("p_book"))).select("id", "entry_id").distinct()


def _alone(before: str, after: str) -> bool:
    return not ("\u0600" <= before <= "\u06ff" or "\u0600" <= after <= "\u06ff")


def _by_automaton(p: DataFrame, terms: list[str]) -> DataFrame:
    """(id, p_book, arabic) by an automaton over all terms."""
    sent = p.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in sent.value:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for pdf in batches:
            rows = []
            for key, text, book in zip(pdf.id, pdf.text, pdf.p_book, strict=True):
                seen = {term for end, term in (automaton.iter(text) if len(sent.value) else ()) if len(term) > 2 or _alone(text[end - len(term) : end - len(term) + 1] if end >= len(term) else "", text[end + 1 : end + 2])}
                rows += [(key, book, term) for term in seen]
            yield pd.DataFrame(rows, columns=["id", "p_book", "arabic"])

    return p.mapInPandas(scan, T.StructType([p.schema["id"], p.schema["p_book"], T.StructField("arabic", T.StringType())]))


def _by_head(p: DataFrame, g: DataFrame, head: int = 3) -> DataFrame:
    """(id, p_book, arabic) by the letters that terms begin with: a text offers each of its places once."""
    begins = F.substring("arabic", 1, head)
    padded = F.concat(F.lit(" "), "text", F.lit(" " * head))
    places = p.select("id", "p_book", padded.alias("text"), F.explode(F.sequence(F.lit(2), F.length("text") + 1)).alias("at"))
    offered = places.select("*", F.explode(F.sequence(F.lit(1), F.lit(head))).alias("n")).withColumn("begin", F.expr("substring(text, at, n)"))
    keyed = g.select("arabic").distinct().withColumn("begin", begins).withColumn("n", F.length("begin"))
    same = offered.join(keyed, ["begin", "n"]).where(F.expr("substring(text, at, length(arabic)) = arabic"))
    letter = "[\\u0600-\\u06FF]"
    free = (F.length("arabic") > 2) | ~(F.expr("substring(text, at - 1, 1)").rlike(letter) | F.expr("substring(text, at + length(arabic), 1)").rlike(letter))
    return same.where(free).select("id", "p_book", "arabic").distinct()


def wrong_keys(c: Column | str) -> Column:
    """Spans of a wrong rendering that are telling: of each part between bars, without a leading bracket, the part before the first bracket, comma or semicolon, and the whole; of four characters or more."""
    parts = F.transform(F.split(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"\|"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\([^)]*\)\s*", "")))
    spans = F.flatten(F.transform(parts, lambda x: F.array(F.trim(F.regexp_replace(x, r"(?s)\s*[(,;].*$", "")), F.trim(F.regexp_replace(x, r"^[() ]+|[() ]+$", "")))))
    return F.array_distinct(F.filter(spans, lambda x: F.length(x) >= 4))


def right_key(c: Column | str) -> Column:
    """The first eight characters of a right rendering before any bracket."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"(?s)\(.*$", "")), 1, 8)


def contradictions(hits: DataFrame, outputs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, entry_id) of retrieved entries whose wrong rendering is in the output and whose right one, if any is known, isn't."""
    g = glossary.select("entry_id", wrong_keys("en_wrong").alias("wrong"), right_key("en_should").alias("right"))
    o = outputs.select("id", F.lower(F.coalesce("english", F.lit(""))).alias("english"))
    lacks = (F.col("right") == "") | ~F.contains("english", "right")
    return hits.join(g.where("size(wrong) > 0"), "entry_id").join(o, "id").where(F.exists("wrong", lambda x: F.contains("english", x)) & lacks).select("id", "entry_id")


def merge_glossary(existing: DataFrame, extra: DataFrame) -> DataFrame:
    """existing and those of extra whose (arabic, en_should, book) it lacks, once each."""
    key = ["arabic", "en_should", "book"]
    new = extra.dropDuplicates(key)
    same = [new[k].eqNullSafe(existing[k]) for k in key]
    on = same[0] & same[1] & same[2]
    return existing.unionByName(new.join(existing.select(*key), on, "left_anti"))


def mined_entries(rows: DataFrame) -> DataFrame:
    """Pipe-joined cells as one row for each position; a shorter cell repeats its last value."""
    cells = {c: F.split(F.coalesce(c, F.lit("")), r"\|") for c in ("arabic", "en_should", "en_wrong")}
    n = F.greatest(*(F.size(x) for x in cells.values()))
    at = lambda x, i: F.trim(F.element_at(x, F.least(i, F.size(x))))
    each = rows.select("book", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(*(at(x, i).alias(c) for c, x in cells.items())))).alias("e")).select("e.*", "book")
    return each.where("arabic <> ''").dropDuplicates(["arabic", "en_should", "book"])


def source_route(hint: Column) -> Column:
    """'strong' for verse and rhymed prose, else 'lite'."""
    h = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    return F.when(h.isin("verse", "poetry", "saj", "rhymed_prose", "metalinguistic") | F.contains(h, F.lit("verse")) | F.contains(h, F.lit("maqama")), "strong").otherwise("lite")


def cascade(hint: Column, lite_fails: Column) -> Column:
    """struct(primary, escalate, reason): lite output with a failed check is kept and the strong system asked too."""
    route, failed = source_route(hint), F.size(lite_fails) > 0
    return F.struct(
        route.alias("primary"), ((route == "lite") & failed).alias("escalate"), F.when(route == "strong", "verse or rhymed prose").when(failed, "a check of the lite output failed; both are kept").otherwise("the lite output is clean").alias("reason")
    )


def pick(decision: Column, strong_fails: Column) -> Column:
    """struct(system, queue) without looking at labels."""
    strong_clean = F.size(F.coalesce(strong_fails, F.array().cast("array<string>"))) == 0
    system = F.when((decision["primary"] == "strong") & ~decision["escalate"], "strong").when(~decision["escalate"], "lite").when(strong_clean, "strong").otherwise("lite")
    return F.struct(system.alias("system"), F.when(decision["escalate"] & ~strong_clean, "human").otherwise("auto").alias("queue"))


def classify_sittings(rows: DataFrame) -> DataFrame:
    """rows with agreement, consensus_label_status and future_human_priority of two sittings."""
    yn = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    p1, p2 = yn("first_publishable"), yn("second_publishable")
    f1, f2 = t.flag_set("first_blocking_flags"), t.flag_set("second_blocking_flags")
    notes = F.lower(F.coalesce("notes", F.lit("")))
    flip = p1 != p2
    apart = (p1 == "N") & (p2 == "N") & (F.size(f1) > 0) & (F.size(f2) > 0) & ~F.arrays_overlap(f1, f2)
    disputed = flip | apart | F.contains(notes, F.lit("corrupt")) | F.contains(notes, F.lit("specialist"))
    high = (F.lower(F.trim("first_confidence")) == "high") & (F.lower(F.trim("second_confidence")) == "high")
    clean = F.coalesce(high, F.lit(False)) & (f1 == f2) & ~F.contains(notes, F.lit("obscure")) & ~F.contains(notes, F.lit("ambig"))
    return rows.select(
        "row_id", F.when(~flip & p1.isin("Y", "N"), "Y").otherwise("N").alias("agreement"), F.when(disputed, "disputed").when(clean, "silver_consensus_high").otherwise("silver_consensus_med").alias("status"),
        F.when(disputed, "P1").when(clean, "P3").otherwise("P2").alias("priority"), F.when(disputed, "").otherwise(p2).alias("publishable"), F.when(disputed, "").otherwise(t.pipe_flags("second_blocking_flags")).alias("flags"),
    )


def prf(rows: DataFrame, predicted: Column, gold: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; 0 where undefined."""
    n = lambda c, a: F.count_if(c).alias(a)
    c = rows.groupBy(*by).agg(n(predicted & gold, "tp"), n(predicted & ~gold, "fp"), n(~predicted & gold, "fn"), n(~predicted & ~gold, "tn"))
    div = lambda a, b: F.when(b > 0, F.round(a / b, 3)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn)).withColumn("f1", div(2 * tp, 2 * tp + fp + fn))


def graded_errors(sent: DataFrame, graded: DataFrame) -> DataFrame:
    """(row_id, problem): rows that are missing, extra, or whose verdict and flags disagree."""
    both = sent.select("row_id", F.lit(1).alias("s")).join(graded.select("row_id", "publishable", "blocking_flags", F.lit(1).alias("g")), "row_id", "full_outer")
    yes = F.upper(F.trim("publishable")) == "Y"
    problem = F.when(F.col("g").isNull(), "missing").when(F.col("s").isNull(), "extra").when(yes & (F.size(t.flag_set("blocking_flags")) > 0), "publishable with a blocking flag").when(~F.coalesce(yes, F.lit(False)) & (F.size(t.flag_set("blocking_flags")) == 0), "unpublishable without a flag")
    return both.select("row_id", problem.alias("problem")).where("problem is not null")


def merge_rounds(rounds: list[DataFrame], key: str = "row_id") -> DataFrame:
    """All rounds' rows with round, a running number, and repeated, whether their key occurs in more than one row."""
    every = rounds[0].withColumn("round", F.lit(1))
    for k, rows in enumerate(rounds[1:], 2):
        every = every.unionByName(rows.withColumn("round", F.lit(k)))
    twice = every.groupBy(key).agg((F.count("*") > 1).alias("repeated"))
    return every.join(twice, every[key].eqNullSafe(twice[key])).drop(twice[key])


def term_candidates(rows: DataFrame, label: str) -> DataFrame:
    """Glossary candidates of graded rows(row_id, item_id, source, blocking_flags, term_ar, term_en_should, term_en_wrong) with the flag TERM; the first row of each term, rendering and book."""
    word = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = rows.where(F.array_contains(t.flag_set("blocking_flags"), "TERM")).select("row_id", "item_id", word("source").alias("book"), word("term_ar").alias("arabic"), word("term_en_should").alias("en_should"), word("term_en_wrong").alias("en_wrong"))
    first = named.where("length(arabic) >= 2 and en_should <> ''").groupBy("arabic", "en_should", "book").agg(F.min_by(F.struct("en_wrong", "item_id"), "row_id").alias("r"))
    return first.select("arabic", "en_should", "book", F.col("r.en_wrong").alias("en_wrong"), F.coalesce("r.item_id", F.lit("")).alias("item_ids"), F.lit("term").alias("kind"), F.lit("candidate").alias("status"), F.lit(label).alias("source_label"), F.lit("false").alias("train_eligible"))


def accepted(decision: Column, lite_ok: Column, strong_ok: Column) -> Column:
    """The system one would choose knowing which outputs are publishable."""
    either = F.when(~lite_ok & strong_ok, "strong").when(lite_ok, "lite").when(strong_ok, "strong").otherwise("lite")
    return F.when((decision["primary"] == "strong") & ~decision["escalate"], "strong").when(~decision["escalate"], "lite").otherwise(either)


def paired(rows: DataFrame, lite: str, strong: str) -> DataFrame:
    """(item_id, hint, lite_ok, strong_ok, lite_fails, strong_fails): both systems' rows(item_id, system_id, hint, ok, fails) side by side; a system without a row isn't ok."""
    side = lambda name, c: F.max(F.when(F.col("system_id") == name, F.struct("row_id", c)))[c]
    got = rows.where(F.col("system_id").isin(lite, strong)).groupBy("item_id").agg(
        F.max("hint").alias("hint"), *(side(name, c).alias(f"{as_}_{c}") for name, as_ in ((lite, "lite"), (strong, "strong")) for c in ("ok", "fails"))
    )
    return got.select("item_id", "hint", *(F.coalesce(f"{s}_ok", F.lit(False)).alias(f"{s}_ok") for s in ("lite", "strong")), *(F.coalesce(f"{s}_fails", F.array(F.lit("MISSING"))).alias(f"{s}_fails") for s in ("lite", "strong")))


POLICIES = ("all_strong", "all_lite", "known_lite_else_strong", "source_gate_only", "checks_keep_both", "checks_overwrite")


def simulate(pairs: DataFrame) -> DataFrame:
    """pairs with decision, system, queue, chosen (knowing the labels) and, for each policy, whether what it ships is publishable; what goes to a human counts as caught."""
    d = pairs.withColumn("decision", cascade(F.col("hint"), F.col("lite_fails"))).withColumn("picked", pick(F.col("decision"), F.col("strong_fails")))
    strong, lite = F.col("strong_ok"), F.col("lite_ok")
    gate = F.col("decision.primary") == "strong"
    out = d.withColumns({"system": F.col("picked.system"), "queue": F.col("picked.queue"), "chosen": accepted(F.col("decision"), lite, strong)})
    shipped = {
        "all_strong": strong, "all_lite": lite, "known_lite_else_strong": lite | strong, "source_gate_only": F.when(gate, strong).otherwise(lite),
        "checks_keep_both": (F.col("queue") == "human") | F.when(F.col("system") == "strong", strong).otherwise(lite), "checks_overwrite": F.when(gate | F.col("decision.escalate"), strong).otherwise(lite),
    }
    return out.withColumns(shipped).drop("picked")


def policy_rates(simulated: DataFrame) -> DataFrame:
    """(policy, passages, publishable, escaped, escaped_rate)"""
    each = simulated.select(F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("ok")) for p in POLICIES))).alias("x")).select("x.*")
    n, ok = F.count("*"), F.count_if("ok")
    return each.groupBy("policy").agg(n.alias("passages"), ok.alias("publishable"), (n - ok).alias("escaped"), F.round((n - ok) / n, 3).alias("escaped_rate"))

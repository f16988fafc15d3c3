"""Problem 1: one form for text that looks the same.

Canonical spellings come from the corpus itself: strings made of ordinary characters only. They are kept in
tries, one trie for each bucket of a key that look-alikes share, so that no trie is broadcast or grows with the
data. An unusual string walks its bucket's trie with a weighted edit automaton: look-alikes, presentation forms
and ignorable characters cost nothing, everything visible costs one. The cheapest spelling within the budget
(0: nothing visible may differ) with the highest count wins; a string without a match gets the table form.

Defined results: null gives null, empty or all-invisible text gives the empty string, repeated rows give the
same form, ties in count go to the spelling first in code-point order, further columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.llm._chars import AMBIGUOUS, LOOKALIKES, PLAIN_CLASS, SPACE_CLASS, compatible, fold, ignorable, is_plain, route
from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table


class Trie:
    """Spellings with counts; matches() runs the automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for c in spelling:
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def matches(self, text: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -count, spelling) of every spelling within the budget."""
        # an ignorable character may be passed over at no cost, a look-alike may be read as what it looks like
        units = [("",) if ignorable(c) else (c, *AMBIGUOUS.get(c, (LOOKALIKES.get(c, c),))) for c in compatible(text)]
        states = {(0, ""): (0, self.root)}  # position in the text and path in the trie -> cost and node
        found: list[tuple[int, int, str]] = []
        frontier = [(0, "", 0, self.root)]
        while frontier:
            at, path, cost, node = frontier.pop()
            if at == len(units) and "" in node:
                found.append((cost, -node[""], path))
            options = units[at] if at < len(units) else ()
            steps = [(at + 1, path + o, cost, node[o] if o else node) for o in dict.fromkeys(options) if not o or o in node]
            if cost < budget:
                steps += [(at, path + c, cost + 1, child) for c, child in node.items() if c]
                if at < len(units):
                    steps.append((at + 1, path, cost + 1, node))
                    steps += [(at + 1, path + c, cost + 1, child) for c, child in node.items() if c and c not in options]
            for step in steps:
                key = step[:2]
                if key not in states or step[2] < states[key][0]:
                    states[key] = (step[2], step[3])
                    frontier.append(step)
        best: dict[str, tuple[int, int, str]] = {}
        for x in found:
            best[x[2]] = min(best.get(x[2], x), x)
        return sorted(best.values())


def _suspicious(c: Column | str) -> Column:
    return F.rlike(c, F.lit(f"[^{PLAIN_CLASS} ]"))


@F.pandas_udf(T.StringType())
def _route(texts: pd.Series) -> pd.Series:
    return texts.map(route, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(is_plain).astype(bool)


def canonical_spellings(strings: DataFrame, budget: int = 0) -> DataFrame:
    """(text, canonical) for each distinct string of strings(text, n); n counts how often it occurs.

    Strings of ordinary characters are the vocabulary and map to themselves; only the others and the spellings
    that share a key with one of them are shuffled to a trie.
    """
    counted = strings.where("text is not null").groupBy("text").agg(F.sum("n").alias("n"))
    marked = cut_lineage(counted.withColumn("odd", _suspicious("text") | ~_plain("text")))
    odd = marked.where("odd").select("text", _route("text").alias("key"))
    words = marked.where(~F.col("odd") & (F.col("text") != "")).select("text", "n", _route("text").alias("key"))
    words = words.join(odd.select("key").distinct(), "key", "left_semi")
    buckets = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")

    def walk(key: tuple, odd_rows: pd.DataFrame, vocabulary: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for spelling, count in zip(vocabulary.text, vocabulary.n, strict=True):
            trie.add(spelling, int(count))
        out = [(t, m[0][2] if (m := trie.matches(t, budget)) else fold(t)) for t in odd_rows.odd_text]
        return pd.DataFrame(out, columns=["text", "canonical"])

    left = odd.select(F.col("text").alias("odd_text"), F.col("key").alias("odd_key")).withColumn("odd_bucket", F.pmod(F.xxhash64("odd_key"), F.lit(buckets)))
    right = words.select("text", "n", bucket)
    return cut_lineage(left.groupBy("odd_bucket").cogroup(right.groupBy("bucket")).applyInPandas(walk, "text string, canonical string"))


def canonical_texts(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """rows(key..., text) with one canonical text for each row of the key; key must identify a text.

    Only texts with an unusual character are cut into tokens, mapped and put together again.
    """
    # squeezed and looked at once for each text, which is written since three steps read it
    squeezed = rows.select(*key, F.col(text).alias("text")).withColumn("squeezed", F.trim(F.regexp_replace("text", f"[{SPACE_CLASS}]+", " ")))
    rows = cut_lineage(squeezed.withColumn("odd", F.coalesce(_suspicious("squeezed"), F.lit(False))).drop("squeezed"))
    odd = rows.where("odd").drop("odd")
    easy = rows.where("not odd").select(*key, "text", F.trim(F.regexp_replace("text", f"[{SPACE_CLASS}]+", " ")).alias("canonical"))
    tokens = F.filter(F.split("text", f"[{SPACE_CLASS}]+"), lambda x: x != "")
    counts = rows.select(F.explode(tokens).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    spelt = canonical_spellings(counts)
    exploded = odd.select(*key, "text", F.posexplode_outer(tokens).alias("at", "token"))
    mapped = exploded.join(spelt.withColumnRenamed("text", "token"), "token", "left").withColumn("form", F.coalesce("canonical", "token"))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "form"))), lambda x: x["form"]), " ")
    # a token of invisible characters only leaves an empty form
    tidy = F.trim(F.regexp_replace(put, " +", " "))
    hard = mapped.groupBy(*key, "text").agg(tidy.alias("canonical"))
    return easy.unionByName(hard)


def lookalike_sentences(sentences: DataFrame) -> DataFrame:
    """(first_id, second_id): rows of one work and language that look the same but aren't equal."""
    rows = sentences.select("id", "work_id", "language", "text").where("id is not null and text is not null").dropDuplicates(["id", "text"])
    forms = cut_lineage(canonical_texts(rows, ["id", "work_id", "language"]))
    where = ["work_id", "language", "canonical"]
    mixed = forms.groupBy(*where).agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select(*where)
    members = forms.join(mixed, where, "left_semi")
    a, b = members.alias("a"), members.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c != "canonical" else F.col("a.canonical") == F.col("b.canonical") for c in where]
    pairs = a.join(b, [*same, F.col("a.id") < F.col("b.id"), F.col("a.text") != F.col("b.text")])
    return pairs.select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id")).distinct()


def lookalike_terms(glossary: DataFrame, words: DataFrame) -> DataFrame:
    """(first_id, second_id): glossary entries and the words that look like their term but aren't equal to it."""
    terms = glossary.select("entry_id", F.col("arabic").alias("term")).where("entry_id is not null and term is not null").distinct()
    rows = words.select("id", "text").where("id is not null and text is not null")
    counts = rows.groupBy("text").agg(F.count("*").alias("n"))
    all_counts = counts.unionByName(terms.groupBy(F.col("term").alias("text")).agg(F.count("*").alias("n")))
    spelt = canonical_spellings(all_counts)
    form = lambda df, c: df.join(spelt.withColumnRenamed("text", c), c, "left").withColumn("form", F.coalesce("canonical", c)).drop("canonical")
    texts = form(counts.select("text"), "text").join(form(terms, "term"), "form").where(F.col("text") != F.col("term")).select("text", "entry_id")
    return rows.join(texts, "text").select(F.col("entry_id").alias("first_id"), F.col("id").alias("second_id")).distinct()


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sentences = lookalike_sentences(table(spark, d, "sentences"))
    words = lookalike_terms(table(spark, d, "glossary"), table(spark, d, "ledger_words"))
    return sentences.select(F.lit("sentences").alias("relation"), "*").unionByName(words.select(F.lit("ledger_words").alias("relation"), "*"))


@query("p1_canonical_sentences")
def p1_canonical_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentences", "id", "text").where("id is not null").dropDuplicates(["id", "text"])
    return canonical_texts(rows, ["id"]).select("id", "canonical")


def brute_force(texts: list[str]) -> Iterator[tuple[int, int]]:
    """All look-alike pairs of a small list, for tests."""
    forms = [fold(t) for t in texts]
    for i, a in enumerate(forms):
        for j in range(i + 1, len(forms)):
            if a == forms[j] and texts[i] != texts[j]:
                yield i, j

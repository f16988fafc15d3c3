"""Problem 4: editions of catalogued works, matched without a common key.

Titles come in transliteration, in English and in Arabic script. A lexicon learnt from rows that hold two of them
(aligned word by word, or phrase by phrase where lengths differ) takes every title to the words of the catalogue's
own transliteration; misspelt words go to the known word at one edit. Then a cascade of exact joins on weaker and
weaker attribute combinations, one pass for each rule: the rows and works that have the rule's attributes are joined
on them, a row whose combination points to a single work is resolved, and an anti-join takes it out of the passes that
follow, so that the weaker rules see few rows. A rule's confidence is its precision among its matches that carry an
openiti_uri, with LABELS added as prior counts. Rules on the stated uri can't be labelled by that uri: their precision
is how often a stated uri is right, against how often a wrong one agrees in the rule's other attributes by chance,
both counted on the rows that rules without the uri have resolved. A title alone is labelled by the authors of the rows
it meets. Rules below LEAST_CONFIDENCE give no matches.

Defined results: rows without any usable title and without an agreeing openiti_uri don't match; repeated rows of
works count once; a translation matches one work at most; ties can't occur, an ambiguous combination matches
nothing and is left to later rules; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinscript.llm._names import author_parts, bones, deletions, one_edit, roman
from twinscript.llm._registry import query
from twinscript.session import cut_lineage
from twinscript.sources.tables import table

#: Prior counts (right, wrong) of a rule's precision; least confidence of a rule; least share of a word's translation.
LABELS, LEAST_CONFIDENCE, LEAST_SHARE = (3.0, 2.0), 0.5, 0.4
# Words that carry no content in titles.
_STOP = set("the of and a an concerning from on in with upon about to for al el l wal wa w fi min fil ila ala li".split())
_TAIL = re.compile(r"(,\s*vol\.?\s*\w*|\s*[:;/]|\s+vol\.?\s*\d+).*$", re.I | re.S)


def title_words(text: str | None) -> tuple[list[str], list[str]]:
    """Content words of a title and of what stands in its parentheses."""
    if not isinstance(text, str):
        return [], []
    t = unicodedata.normalize("NFKC", text)
    inner = re.search(r"\(([^)]*)\)", t)
    main = _TAIL.sub("", t[: inner.start()] if inner else t)

    def cut(s: str) -> list[str]:
        out = []
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c) and c != "ـ")):
            if "؀" <= w[0] <= "ۿ":
                w = re.sub("^وال|^ال", "", w) if len(w) > 4 else w
                if w not in ("في", "من", "و", "عن", "الى"):
                    out.append(w)
            elif w not in _STOP:
                out.append(w)
        return out

    return cut(main), cut(inner.group(1)) if inner else []


_TITLE = T.StructType([T.StructField("main", T.ArrayType(T.StringType())), T.StructField("inner", T.ArrayType(T.StringType()))])


@F.pandas_udf(_TITLE)
def _title(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([title_words(t) for t in texts], columns=["main", "inner"])


_URI = T.StructType([T.StructField("death", T.IntegerType()), *(T.StructField(f, T.StringType()) for f in ("given", "family", "given_bones", "bones")), T.StructField("words", T.ArrayType(T.StringType()))])


@F.pandas_udf(_URI)
def _uri(uris: pd.Series) -> pd.DataFrame:
    """Parts of a work's uri: death year, author's names, title words."""
    rows = []
    for u in uris:
        m = re.match(r"^(\d{4})([^.]*)\.(.+)$", u) if isinstance(u, str) else None
        if not m:
            rows.append((None, None, None, None, None, []))
            continue
        names = re.findall(r"[A-Z][^A-Z]*", m.group(2)) or [m.group(2)]
        given, family = (roman(names[0]) if len(names) > 1 else None), roman(names[-1])
        words = [w.lower() for w in re.findall(r"[A-Z][^A-Z]*", m.group(3).split(".")[0])]
        rows.append((int(m.group(1)), given, family, bones(given) if given else None, bones(family), [w for w in words if w not in _STOP]))
    df = pd.DataFrame(rows, columns=["death", "given", "family", "given_bones", "bones", "words"])
    df["death"] = df["death"].astype("Int32")
    return df


def _key(words: Column) -> Column:
    return F.array_join(words, " ")


def lexicon(works: DataFrame, titles: DataFrame) -> DataFrame:
    """(word, known): words and phrases of titles with the catalogue's words for them."""
    known = cut_lineage(works.select(F.explode("words").alias("k")).distinct())
    sides = F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("main", "inner"), ("arabic", "main"), ("arabic", "inner"))))
    both = titles.select(F.explode(sides).alias("z")).select("z.a", "z.b").unionByName(works.select(F.col("title_words").alias("a"), F.col("words").alias("b"))).where((F.size("a") > 0) & (F.size("b") > 0))
    even = F.when(F.size("a") == F.size("b"), F.arrays_zip("a", "b"))
    odd = even.when((F.size("a") == 1) | (F.size("b") == 1), F.array(F.struct(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b"))))
    either = both.select(odd.alias("z")).select(F.explode(F.concat("z", F.transform("z", lambda z: F.struct(z["b"].alias("a"), z["a"].alias("b"))))).alias("z")).select("z.a", "z.b")
    seen = either.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    seen = cut_lineage(seen)
    w = Window.partitionBy("word")
    ranked = lambda df: df.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "known"))).where((F.col("r") == 1) & (F.col("share") >= LEAST_SHARE)).select("word", "known", "n")
    direct = cut_lineage(ranked(seen.join(known.withColumnRenamed("k", "b"), "b").select(F.col("a").alias("word"), F.col("b").alias("known"), "n").join(known.withColumnRenamed("k", "word"), "word", "left_anti")))
    # words never seen beside a catalogue word go through a word that was
    middle = direct.select(F.col("word").alias("b"), "known")
    through = seen.join(middle, "b").select(F.col("a").alias("word"), "known", "n").groupBy("word", "known").agg(F.sum("n").alias("n")).join(direct, "word", "left_anti").join(known.withColumnRenamed("k", "word"), "word", "left_anti")
    itself = known.select(F.col("k").alias("word"), F.col("k").alias("known"), F.lit(1_000_000).cast("bigint").alias("n"))
    return cut_lineage(itself.unionByName(direct).unionByName(ranked(through)))


def _titles(translations: DataFrame) -> DataFrame:
    columns = ["openiti_uri", "work_arabic_title", "work_english_title", "author"]
    # of different rows of one id the least counts
    t = translations.where("id is not null").groupBy("id").agg(F.min(F.struct(*columns)).alias("r")).select("id", "r.*")
    t = t.withColumn("e", _title("work_english_title")).withColumn("ar", _title("work_arabic_title")).withColumn("p", author_parts("author"))
    return t.select("id", "openiti_uri", F.col("e.main").alias("main"), F.col("e.inner").alias("inner"), F.col("ar.main").alias("arabic"), "p.family", "p.given", "p.father", "p.father_bones", "p.bones", "p.given_bones", "p.kunya", F.col("p.death").alias("death"))


def title_keys(titles: DataFrame, words: DataFrame) -> DataFrame:
    """(id, title): every title of a row whose words the lexicon takes to the catalogue's."""
    forms = titles.select("id", F.explode(F.array("main", "inner", "arabic")).alias("ws")).where(F.size("ws") > 0).distinct().withColumn("form", F.xxhash64("id", "ws"))
    parts = forms.select("id", "form", F.size("ws").alias("size"), F.posexplode("ws").alias("at", "word"))
    wanted = parts.select("word").distinct()
    hit = wanted.join(words, "word").select("word", "known")
    lost = wanted.join(words, "word", "left_anti").where(F.length("word") >= 4)
    near = lost.withColumn("cut", F.explode(deletions("word"))).join(words.where(F.length("word") >= 4).select(F.col("word").alias("right"), "known", "n", F.explode(deletions("word")).alias("cut")), "cut")
    near = near.where(one_edit("word", "right")).groupBy("word").agg(F.max_by("known", F.struct("n", "known")).alias("known"))
    mapped = cut_lineage(hit.unionByName(near))
    whole = parts.join(mapped, "word").groupBy("id", "form", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "known"))), lambda x: x["known"]), " ").alias("title"), F.count("*").alias("found")).where("found = size")
    phrases = forms.select("id", _key(F.col("ws")).alias("word")).join(words, "word").select("id", F.col("known").alias("title"))
    return whole.select("id", "title").unionByName(phrases).distinct()


#: Attribute combinations of the cascade: name, attributes that agree, attributes the translation must lack. Rules on the stated
#: uri come late, since its agreement is what the other rules' precision is measured by.
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("title, family and given name", ("title", "family", "given"), ()),
    ("title, family and father's name", ("title", "family", "father"), ("given",)),
    ("title, family and year of death", ("title", "family", "death"), ("given",)),
    ("title, consonants of family and given name", ("title", "bones", "given_bones"), ()),
    ("title, consonants of family and father's name", ("title", "bones", "father_bones"), ("given_bones",)),
    ("title and family name", ("title", "family"), ("given", "father")),
    ("title, given name and misspelt family", ("title", "given", "family_cut"), ()),
    ("title and misspelt family", ("title", "family_cut"), ("given",)),
    ("title, family and misspelt given name", ("title", "family", "given_cut"), ()),
    ("topics, family and given name", ("topics", "family", "given"), ()),
    ("title and stated uri", ("title", "uri"), ()),
    ("stated uri, family and given name", ("uri", "family", "given"), ("title",)),
    ("stated uri and family", ("uri", "family"), ("title",)),
    ("title alone", ("title",), ("family", "uri")),
)


def _keys(fields: tuple[str, ...], missing: tuple[str, ...]) -> Column:
    """Keys of a row by a rule's attributes; none if one is missing or one is there that mustn't be."""
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    plain = [f for f in fields if not f.endswith("_cut")]
    cut = next((F.filter(F.col(f), lambda x: x != "") for f in fields if f.endswith("_cut")), F.array(F.lit("")))
    whole = F.lit(True)
    for f in plain:
        whole &= text(f) != ""
    for m in missing:
        whole &= F.col(m).isNull()
    head = F.concat_ws("|", *map(text, plain))
    return F.when(whole, F.transform(cut, lambda x: F.concat_ws("|", head, x))).otherwise(F.array().cast("array<string>"))


def _agree(name: str, fields: tuple[str, ...]) -> Column:
    """What besides the key must not contradict a match of rows a_ and works b_."""
    both = lambda c, near: F.col(f"a_{c}_bones" if c == "given" else "a_bones").isNull() | (F.col(f"a_{c}_bones" if c == "given" else "a_bones") == F.col(f"b_{c}_bones" if c == "given" else "b_bones")) | near
    agree = F.col("a_death").isNull() | F.col("b_death").isNull() | (F.col("a_death") == F.col("b_death"))
    if not {"given", "given_cut", "given_bones"} & set(fields):
        agree &= F.col("b_given_bones").isNull() | both("given", F.levenshtein("a_given", "b_given") <= 2)
    if name == "title and stated uri":
        agree &= both("family", F.levenshtein("a_family", "b_family") <= 2)
    if "bones" in fields:
        agree &= F.col("a_family").startswith("؟") | (F.levenshtein("a_family", "b_family") <= 3)
    return F.coalesce(agree, F.lit(False))


ATTRIBUTES = ("given", "death", "family", "given_bones", "bones")


def cascade(rows: DataFrame, works: DataFrame) -> DataFrame:
    """(id, rule, uri, openiti_uri): each row with its first rule that points to one work, by a join and an anti-join for each rule."""
    passes: list[DataFrame] = []
    whole = rest = rows
    for number, (name, fields, missing) in enumerate(RULES):
        a = rest.select("id", "openiti_uri", *(F.col(c).alias(f"a_{c}") for c in ATTRIBUTES), F.explode(_keys(fields, missing)).alias("key"))
        b = works.select("uri", *(F.col(c).alias(f"b_{c}") for c in ATTRIBUTES), F.explode(_keys(fields, ())).alias("key"))
        if fields == ("title",):
            # a title without an author only counts where it is one work's, so that no common title is ever paired with all its works
            b = b.join(b.groupBy("key").agg(F.min("uri").alias("low"), F.max("uri").alias("high")).where("low = high").select("key"), "key", "left_semi")
        pairs = a.join(b, "key").where(_agree(name, fields))
        one = pairs.groupBy("id").agg(F.first("openiti_uri", ignorenulls=True).alias("openiti_uri"), F.min("uri").alias("low"), F.max("uri").alias("uri")).where("low = uri")
        passes.append(cut_lineage(one.select("id", F.lit(number).alias("rule"), "uri", "openiti_uri")))
        # one anti-join with all that is resolved since rest was last written: nested ones would run again in every pass
        rest = whole.join(reduce(DataFrame.unionByName, passes[number // 4 * 4 :]).select("id"), "id", "left_anti")
        if number % 4 == 3:
            whole = rest = cut_lineage(rest)
    # one table: a union would be planned anew, scan by scan, wherever the matches are used
    return cut_lineage(reduce(DataFrame.unionByName, passes))


def confidences(found: DataFrame, rows: DataFrame, works: DataFrame) -> DataFrame:
    """(rule, confidence) of the cascade's matches."""
    yes, no = LABELS
    smoothed = lambda right, wrong: (F.coalesce(right, F.lit(0)) + yes) / (F.coalesce(right, F.lit(0)) + F.coalesce(wrong, F.lit(0)) + yes + no)
    by_uri = {n: tuple(f for f in fields if f != "uri") for n, (_, fields, _) in enumerate(RULES) if "uri" in fields}
    alone = next(n for n, (_, fields, _) in enumerate(RULES) if fields == ("title",))
    labelled = F.coalesce(F.trim("openiti_uri") != "", F.lit(False))
    right = F.trim("openiti_uri") == F.col("uri")
    # those of by_uri and alone are replaced below
    trust = found.groupBy("rule").agg(smoothed(F.count_if(labelled & right), F.count_if(labelled & ~right)).alias("confidence"))
    plain = found.where(labelled & ~F.col("rule").isin(*by_uri, alone)).withColumn("stated", F.trim("openiti_uri")).withColumn("right", right)
    # wrong uris whose work agrees with the row all the same, attribute by attribute
    own = rows.groupBy("id").agg(F.collect_set("title").alias("titles"), *(F.max(c).alias(c) for c in ("family", "given")))
    theirs = works.select(F.col("uri").alias("stated"), *(F.col(c).alias(f"their_{c}") for c in ("title", "family", "given"))).dropDuplicates(["stated"])
    wrong = plain.join(own, "id").join(theirs, "stated", "left")
    same = {"title": F.array_contains("titles", F.col("their_title")), "family": F.col("family") == F.col("their_family"), "given": F.col("given") == F.col("their_given")}

    def chance(fields: tuple[str, ...]) -> Column:
        both = ~F.col("right")
        for f in fields:
            both &= F.coalesce(same[f], F.lit(False))
        return F.count_if(both)

    measured = wrong.agg(F.count_if("right").alias("ok"), *(chance(fields).alias(f"bad_{n}") for n, fields in by_uri.items()))
    stated = measured.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), smoothed(F.col("ok"), F.col(f"bad_{n}")).alias("by_chance")) for n in by_uri))).alias("x")).select("x.*")
    # a title alone carries no label; its precision is that of its match among the rows that do name an author
    single = works.groupBy("title").agg(F.min("uri").alias("low"), F.max("uri").alias("high"), F.max("bones").alias("right_bones")).where("low = high")
    named = rows.where("family is not null and title is not null").join(single, "title").agg(F.count_if(F.col("bones") == F.col("right_bones")).alias("ok"), F.count("*").alias("n"))
    by_author = named.select(F.lit(alone).alias("rule"), smoothed(F.col("ok"), F.col("n") - F.col("ok")).alias("by_chance"))
    return trust.join(stated.unionByName(by_author), "rule", "left").select("rule", F.coalesce("by_chance", "confidence").alias("confidence"))


def editions(translations: DataFrame, works: DataFrame) -> DataFrame:
    """(translation_id, uri, rule, confidence)."""
    w = works.where("uri is not null").groupBy("uri").agg(F.max("author").alias("author"), F.max("title").alias("title"))
    w = w.withColumn("u", _uri("uri")).withColumn("p", author_parts("author")).withColumn("t", _title("title"))
    w = cut_lineage(w.select("uri", F.col("u.words").alias("words"), F.col("t.main").alias("title_words"), "u.family", "u.given", "u.bones", "u.given_bones", F.col("u.death").alias("death"), F.col("p.father").alias("father"), F.col("p.father_bones").alias("father_bones")))
    # a father's name from any work of the same author serves all of them
    w = w.withColumn("father", F.max("father").over(Window.partitionBy("family", "given", "death"))).withColumn("father_bones", F.max("father_bones").over(Window.partitionBy("family", "given", "death")))
    titles = cut_lineage(_titles(translations))
    keys = title_keys(titles, lexicon(w, titles))
    rows = titles.drop("main", "inner", "arabic").join(keys, "id", "left").withColumn("uri", F.when(F.trim("openiti_uri") != "", F.trim("openiti_uri")))
    # a surname alone written in Arabic script has no comparable letters
    rows = rows.withColumn("family_cut", deletions(F.coalesce("family", F.lit("")))).withColumn("given_cut", deletions(F.coalesce("given", F.lit(""))))
    right = w.withColumn("title", _key(F.col("words"))).withColumn("topics", _key(F.expr("slice(words, 2, greatest(size(words), 1))"))).withColumn("family_cut", deletions("family")).withColumn("given_cut", deletions(F.coalesce("given", F.lit("")))).drop("words", "title_words")
    rows = cut_lineage(rows.withColumn("topics", F.when(F.contains("title", F.lit(" ")), F.regexp_replace("title", "^[^ ]+ ", ""))))
    right = cut_lineage(right.withColumn("topics", F.when(F.col("topics") != "", F.col("topics"))))
    found = cascade(rows, right)
    names = F.create_map(*(x for n, (name, _, _) in enumerate(RULES) for x in (F.lit(n), F.lit(name))))
    trusted = found.join(cut_lineage(confidences(found, rows, right)), "rule").where(F.col("confidence") >= LEAST_CONFIDENCE)
    return trusted.select(F.col("id").alias("translation_id"), "uri", names[F.col("rule")].alias("rule"), "confidence")


def _run(spark: SparkSession, d: str) -> DataFrame:
    return editions(table(spark, d, "translations"), table(spark, d, "works"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).select("uri", F.col("translation_id").cast("bigint").alias("translation_id"))


@query("p4_editions")
def p4_editions(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)

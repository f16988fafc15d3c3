"""Name evidence: which proper names of an English text occur in an Arabic one, by consonants. JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript.functions import text as t

# English words that name no one though a chain of names may capitalise them.
FUNCTION_WORDS = (
    "a an the and or of on in to us by from with for said says say related reported transmitted communicated authority tradition similar same ibn bin ben abu abi abd umm bint banu bani banul who whom which that "
    "was were is are has have had following certain men learned one his her their my me our we they he she it its also according quoted quoting version account another added addition further al el as at"
)
# Titles, epithets and times that are capitalised without being names.
TITLE_WORDS = (
    "allah god prophet messenger apostle caliph caliphate commander believers moslem moslems muslim muslims islam islamic jew jews jewish christian christians koran quran ansar emigrants companions lord day night year years "
    "month monday tuesday wednesday thursday friday saturday sunday only now thus then when whenever therefore however hence"
)
# Skeletons of chain words, which are no evidence.
CHAIN_SKELETONS = ("", "b", "bn", "l", "n", "d", "t", "s", "m", "h", "f", "r", "k", "bd", "mm", "bnt", "mwl", "thn")
LATIN_WORD, QUOTES, STRONG = "([A-Za-z][A-Za-z'’ʿʻ-]*)", "^['’ʿʻ]+|['’ʿʻ]+$", 3


def name_cased(word: Column) -> Column:
    """Whether a word is written like a name: a capital at its head, or mostly capitals."""
    capitals = F.length(F.regexp_replace(word, r"[^\p{Lu}]", ""))
    return word.rlike(r"^\p{Lu}") | ((F.length(word) >= 3) & (capitals * 2 >= F.length(word)))


def name_skeletons(c: Column | str, least: int = 2) -> Column:
    """Consonants of the names of an English text, in order, repeats kept."""
    parts = F.flatten(F.transform(F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(LATIN_WORD), 1), lambda w: F.split(w, "-")))
    words = F.transform(parts, lambda w: F.regexp_replace(w, QUOTES, ""))
    named = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*(FUNCTION_WORDS + " " + TITLE_WORDS).split()) & name_cased(w))
    return F.filter(F.transform(named, lambda w: t.latin_skeleton(w)), lambda s: (F.length(s) >= least) & ~s.isin(*CHAIN_SKELETONS))


def search_blob(c: Column | str) -> Column:
    """The skeleton of an Arabic text with both sounds of its final ta, to be searched for names."""
    return F.concat(t.arabic_skeleton(c, "h"), F.lit("|"), t.arabic_skeleton(c, "t"))


def evidence(names: Column, with_h: Column, with_t: Column) -> Column:
    """struct(matched, missed, first_offset, blob_length, score, mass, strong_matches) of name skeletons in a text's two skeletons.

    score is the share of the names that are found, 0 without names; mass counts the letters of those long enough to be
    evidence; first_offset is the place of the earliest found name, -1 if none is.
    """
    place = lambda s: F.least(*(F.nullif(F.instr(blob, s), F.lit(0)) for blob in (with_h, with_t)))
    found = lambda s: F.contains(with_h, s) | F.contains(with_t, s)
    matched, missed = F.filter(names, found), F.filter(names, lambda s: ~found(s))
    strong = F.filter(matched, lambda s: F.length(s) >= STRONG)
    return F.struct(
        matched.alias("matched"), missed.alias("missed"), F.coalesce(F.array_min(F.transform(matched, place)) - 1, F.lit(-1)).alias("first_offset"), F.length(with_h).alias("blob_length"),
        F.when(F.size(names) > 0, F.size(matched) / F.size(names)).otherwise(0.0).alias("score"),
        F.aggregate(strong, F.lit(0), lambda n, s: n + F.length(s)).alias("mass"), F.size(strong).alias("strong_matches"),
    )


def anchor_score(english: Column | str, arabic: Column | str, least: int = 2) -> Column:
    """Share of the English text's names that the Arabic one holds; 0 where there are no names."""
    return evidence(name_skeletons(english, least), t.arabic_skeleton(arabic, "h"), t.arabic_skeleton(arabic, "t"))["score"]

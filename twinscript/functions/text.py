"""Text Columns: words, sentences, numbers, bands, ids, skeletons. All JVM-side unless a name says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that Python's str.split knows, for Java and for DuckDB.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
# Length bands in words, first match wins; 81 to 99 has none.
BANDS = (("20-80", 20, 80), ("100-250", 100, 250), ("250-600", 250, 600))
HARD, SOFT = ".!?؟؛۔", "،,:"
BLOCK_SEPARATOR, BLOCK_WORDS = "#b", 60
MAJOR_FLAGS = ("ENTITY", "NUMBER", "ROLE", "TERM", "OMISSION", "ADDITION", "MISSING")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Whitespace words; null for null, empty for blank."""
    return F.filter(F.split(_c(c), SPACE + "+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Number of words as bigint; 0 for null."""
    return F.when(_c(c).isNull(), F.lit(0)).otherwise(F.size(words(c))).cast("bigint")


def squeeze(c: Column | str) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), SPACE + "+", " "))


def fold(c: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return squeeze(F.lower(_c(c)))


def western_digits(c: Column | str) -> Column:
    return F.translate(_c(c), DIGITS_FROM, DIGITS_TO)


def numbers(c: Column | str) -> Column:
    """Distinct integers written in the text, leading zeros off; up to 18 digits each."""
    found = F.regexp_extract_all(western_digits(c), F.lit("([0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: F.length(x) <= 18), lambda x: x.cast("bigint"))))


def sentences(c: Column | str) -> Column:
    """Units that end in . ! or ? before white space."""
    return F.filter(F.split(F.regexp_replace(F.trim(_c(c)), r"([.!?])" + SPACE + "+", "$1␞"), "␞"), lambda x: F.trim(x) != "")


def length_band(n: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(BANDS):
        out = F.when(_c(n).between(low, high), name).otherwise(out)
    return out


def sha(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def hash_order(seed: int | str, *parts: Column | str) -> Column:
    """A reproducible random order, the same in any engine with SHA-256."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(_c(p).cast("string") for p in parts)), 256)


def block_id(item: Column | str, index: Column | str) -> Column:
    """item#bNNNN; an id that holds the separator is refused."""
    bad = F.raise_error(F.concat(F.lit("id holds the block separator: "), _c(item)))
    digits = _c(index).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.when(_c(item).contains(BLOCK_SEPARATOR), bad).otherwise(F.concat(_c(item), F.lit(BLOCK_SEPARATOR), padded))


def block_parent(c: Column | str) -> Column:
    return F.when(is_block_id(c), F.regexp_extract(_c(c), r"^(.*)#b(\d+)$", 1))


def block_index(c: Column | str) -> Column:
    return F.when(is_block_id(c), F.regexp_extract(_c(c), r"^(.*)#b(\d+)$", 2).cast("int"))


def is_block_id(c: Column | str) -> Column:
    return _c(c).rlike(r"(?s)^.*#b[0-9]+$")


def length_ratio(source: Column | str, output: Column | str) -> Column:
    """Words of the output for each word of the source; null if the source has none."""
    n = word_count(source)
    return F.when(n > 0, word_count(output) / n)


def ratio_flagged(ratio: Column | str) -> Column:
    """Outside 0.4 to 3.0; false for null."""
    return F.coalesce((_c(ratio) < 0.4) | (_c(ratio) > 3.0), F.lit(False))


def has_arabic(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(ARABIC), F.lit(False))


def flag_set(c: Column | str) -> Column:
    """Known flags of a list separated by | ; or , in canonical order."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), "[|;,]"), lambda x: F.upper(F.trim(x)))
    return F.filter(F.array(*map(F.lit, MAJOR_FLAGS)), lambda f: F.array_contains(parts, f))


def pipe_flags(c: Column | str) -> Column:
    flags = flag_set(c)
    return F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, "|"))


def latin_skeleton(c: Column | str) -> Column:
    """Consonants of a Latin word: lower case, vowels, w and y off, doubles once."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^b-df-hj-np-tvxz]", ""), r"(.)\1+", "$1")


# Arabic letters and their consonants in Latin; weak letters and marks have none.
SKELETON = {
    "ب": "b", "پ": "b", "ت": "t", "ث": "th", "ج": "j", "چ": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "ژ": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "غ": "gh", "ف": "f", "ق": "k", "ك": "k", "گ": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h",
}
VOWEL_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
_SINGLE = {k: v for k, v in SKELETON.items() if len(v) == 1}


def arabic_skeleton(c: Column | str, ta_marbuta: str = "h") -> Column:
    """Consonants of Arabic text in Latin letters, words run together, doubles once."""
    bare = F.regexp_replace(_c(c), VOWEL_MARKS, "")
    # everything but the letters of the table goes first, so one translation does the single ones
    known = F.regexp_replace(bare, "[^ة" + "".join(SKELETON) + "]", "")
    out = F.translate(known, "ة" + "".join(_SINGLE), ta_marbuta + "".join(_SINGLE.values()))
    for letter, latin in SKELETON.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def arabic_token_skeletons(c: Column | str) -> Column:
    """The skeleton of each Arabic word."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(_c(c), VOWEL_MARKS, ""), F.lit(r"([\x{0600}-\x{06FF}]+)"), 1), lambda w: arabic_skeleton(w))


@F.pandas_udf(T.StringType())
def bare(texts: pd.Series) -> pd.Series:
    """Lower case without accents and marks (Unicode decomposition has no built-in)."""

    def one(t: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).lower()

    return texts.map(one, na_action="ignore")


def _accented() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(a, b) for a, b in pairs if a != b and len(b) == 1 and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTED, BASE = _accented()
# Words that tell no title or name from another.
STOP_TOKENS = ("ibn", "bin", "bint", "abu", "abi", "the", "and", "book", "history", "volume", "vol", "part", "anonymous", "author", "translated", "translation", "trans", "diwan", "kitab", "sir", "selected")


def plain_latin(c: Column | str) -> Column:
    """Lower case ASCII letters and digits, marks and half rings off, anything else one space."""
    bare = F.lower(F.regexp_replace(F.translate(_c(c), ACCENTED, BASE), r"[\p{M}ʿʾ]", ""))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def title_tokens(c: Column | str) -> Column:
    """Distinct plain tokens of three letters or more, common words off; empty for null."""
    words = F.array_distinct(F.filter(F.split(plain_latin(F.coalesce(_c(c), F.lit(""))), " "), lambda x: F.length(x) >= 3))
    return F.array_except(words, F.array(*map(F.lit, STOP_TOKENS)))


def camel_tokens(c: Column | str) -> Column:
    """Parts of a name in camel case: a capital and its small letters, small letters, or capitals."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit("([A-Z]?[a-z]+|[A-Z]+(?![a-z]))"), 1), lambda x: F.lower(x))


def uri_tokens(c: Column | str) -> Column:
    """Title tokens of the author and work parts of a uri, whose leading year doesn't count."""
    tail = F.regexp_replace(F.regexp_extract(_c(c), "([^/]*)$", 1), "^[0-9]+", "")
    return title_tokens(F.array_join(camel_tokens(tail), " "))


def unwrapped(c: Column | str) -> Column:
    """A structured response without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


RESPONSE = "array<struct<id:string,english:string>>"


def response_blocks(c: Column | str) -> Column:
    """The (id, english) elements of a structured response; null if it isn't a well-formed list of them."""
    return F.when(unwrapped(c).rlike(r"(?s)^\[.*\]$"), F.from_json(unwrapped(c), RESPONSE, {"mode": "PERMISSIVE"}))

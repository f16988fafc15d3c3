"""Deterministic quality checks of an output against its source. Not applicable is not a pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript.functions import text as t

# Negation words of both sides.
EN_NEGATION = r"(?i)(?U)\b(?:not|no|never|neither|nor|none|cannot|without|nothing|nobody|nowhere)\b|n['’]t\b"
AR_NEGATION = r"(?U)(?:\bلا\b|\bما\b|\bلم\b|\bلن\b|\bليس|\bغير\b|\bبلا\b|\bدون\b)"
QUOTES = "[\"“”«»‘’']"
WORD = r"(?U)\b[\w'’-]+\b"
CORE = ("negation_parity", "number_coverage", "length_ratio", "untranslated_arabic", "repetition", "quotation_coverage", "sentence_ratio")
CHECK_FLAGS = {
    "negation_parity": "NEGATION", "number_coverage": "NUMBER", "length_ratio": "LENGTH", "untranslated_arabic": "UNTRANSLATED", "repetition": "REPETITION", "quotation_coverage": "QUOTE", "sentence_ratio": "OMISSION",
}


def finding(check: str, applicable: Column, passed: Column, severity: Column | str, value: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    ok = F.coalesce(applicable, F.lit(False))
    return F.struct(
        F.lit(check).alias("check"), ok.alias("applicable"), F.when(ok, F.coalesce(passed, F.lit(False))).alias("passed"), sev.alias("severity"), F.when(ok, value.cast("double")).alias("value")
    )


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def negation_parity(source: str, output: str) -> Column:
    ar, en = F.regexp_count(_s(source), F.lit(AR_NEGATION)), F.regexp_count(_s(output), F.lit(EN_NEGATION))
    ratio = F.try_divide(en, ar)
    return finding("negation_parity", F.lit(True), (ar == 0) | ratio.between(0.5, 2.5), "critical", F.when(ar > 0, ratio))


def number_coverage(source: str, output: str) -> Column:
    want, have = t.numbers(_s(source)), t.numbers(_s(output))
    missing = F.array_except(want, have)
    return finding("number_coverage", F.size(want) > 0, F.size(missing) == 0, "major", 1 - F.try_divide(F.size(missing), F.size(want)))


def length_ratio(source: str, output: str) -> Column:
    a, b = F.regexp_count(_s(source), F.lit(WORD)), F.regexp_count(_s(output), F.lit(WORD))
    ratio = F.try_divide(b, a)
    return finding("length_ratio", a > 0, ratio.between(0.5, 3.0), F.when(ratio > 3.0, "moderate").otherwise("major"), ratio)


def untranslated_arabic(source: str, output: str) -> Column:
    n = F.regexp_count(_s(output), F.lit(t.ARABIC))
    return finding("untranslated_arabic", F.lit(True), n == 0, "major", n)


def repetition(source: str, output: str, min_length: int = 25) -> Column:
    units = F.filter(F.transform(t.sentences(_s(output)), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= min_length)
    doubled = F.size(units) - F.size(F.array_distinct(units))
    return finding("repetition", F.size(units) >= 2, doubled == 0, "major", doubled)


def quotation_coverage(source: str, output: str) -> Column:
    a, b = F.regexp_count(_s(source), F.lit(QUOTES)), F.regexp_count(_s(output), F.lit(QUOTES))
    return finding("quotation_coverage", a > 0, b > 0, "critical", b)


def sentence_ratio(source: str, output: str, low: float = 0.5) -> Column:
    a, b = F.size(t.sentences(F.translate(_s(source), "؟۔", "?."))), F.size(t.sentences(_s(output)))
    return finding("sentence_ratio", a >= 2, F.try_divide(b, a) >= low, "major", F.try_divide(b, a))


def entity_coverage(expected: Column, output: str) -> Column:
    """expected: array of entity names; all must be in the output, case folded."""
    folded = t.fold(_s(output))
    missing = F.filter(expected, lambda e: ~F.contains(folded, t.fold(e)))
    return finding("entity_coverage", F.size(F.coalesce(expected, F.array())) > 0, F.size(missing) == 0, "critical", 1 - F.try_divide(F.size(missing), F.size(expected)))


def terminology(pairs: Column, output: str) -> Column:
    """pairs: array of struct(wrong, should); a violation has the wrong term and lacks the right one, as whole words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(_s(output)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    held = lambda w: F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
    bad = F.filter(pairs, lambda p: held(p["wrong"]) & ~held(p["should"]))
    return finding("terminology", F.size(F.coalesce(pairs, F.array())) > 0, F.size(bad) == 0, "major", F.size(bad))


def findings(source: str, output: str) -> Column:
    """The seven checks that need nothing but the pair, as an array."""
    return F.array(
        negation_parity(source, output), number_coverage(source, output), length_ratio(source, output), untranslated_arabic(source, output), repetition(source, output), quotation_coverage(source, output), sentence_ratio(source, output)
    )


def is_missing(output: str) -> Column:
    return F.trim(F.lower(_s(output))).isin("", "nan", "none", "null", "n/a")


def failed_flags(source: str, output: str) -> Column:
    """Flags of failed checks, MISSING first."""
    labels = F.create_map(*(F.lit(x) for kv in CHECK_FLAGS.items() for x in kv))
    fails = F.transform(F.filter(findings(source, output), lambda f: f["applicable"] & ~f["passed"]), lambda f: labels[f["check"]])
    return F.concat(F.when(is_missing(output), F.array(F.lit("MISSING"))).otherwise(F.array().cast("array<string>")), fails)

"""Characters that look alike or can't be seen, and the plain table normalisation built on them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

# Look-alike letters and digits of other scripts, each with the letter it looks like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o",
    "ک": "ك", "ی": "ي", "ہ": "ه", "ھ": "ه",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
}
# Letters whose look depends on the position, with every letter they may stand for.
AMBIGUOUS = {"ی": ("ي", "ى")}
# Invisible characters that Unicode doesn't class as format characters.
INVISIBLE = {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ"}
# Strings of these characters alone are their own canonical form (Java and Python regex class).
PLAIN_CLASS = r"!-~«»À-ıĴ-ľŁ-ňŊ-ž،؛؟ء-ي٠-٩٪-٭۔Ḁ-ẙẠ-ỿ‐‒-―‘-‟、-〃〈-】一-鿿"
# White space as Python's str.split sees it, spelt out for Java.
SPACE_CLASS = r"\u0009-\u000D\u001C- \u0085   -     　"
_RUN = re.compile(f"[{SPACE_CLASS}]+")
_PLAIN = re.compile(f"[{PLAIN_CLASS} ]*")
_LOOK = str.maketrans(LOOKALIKES)


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and unicodedata.is_normalized("NFKC", text)


def ignorable(char: str) -> bool:
    """Format characters, fillers and variation selectors of every plane."""
    return unicodedata.category(char) == "Cf" or char in INVISIBLE or "︀" <= char <= "️" or "\U000e0100" <= char <= "\U000e01ef"


def remover(*categories: str, also: str = "") -> Callable[[str], str]:
    """A function that takes the characters of the categories beyond ASCII out of a text, in all planes that hold any.

    Characters beyond the first plane are looked for only in texts that have some, since one class for all is slow.
    """
    planes = []
    for codes in (range(0x80, 0x10000), [*range(0x10000, 0x20000), *range(0xE0000, 0xE0201)]):
        inside = {c for c, kind in zip(codes, map(unicodedata.category, map(chr, codes)), strict=True) if kind in categories} | {ord(c) for c in also if ord(c) in codes}
        spans: list[list[int]] = []
        for c in sorted(inside):
            if spans and c == spans[-1][1] + 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        planes.append(re.compile("[" + "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in spans) + "]+"))
    first, rest = planes

    def remove(text: str) -> str:
        text = first.sub("", text)
        return rest.sub("", text) if _BEYOND.search(text) else text

    return remove


_BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: Takes combining marks and format characters out of a text.
without_marks = remover("Mn", "Cf")


def compatible(text: str) -> str:
    """Compatibility form, ignorable characters kept, runs of white space as one space."""
    return _RUN.sub(" ", unicodedata.normalize("NFKC", text)).strip(" ")


def visible(text: str) -> str:
    """Compatibility form without invisible characters, runs of white space as one space."""
    kept = "".join(c for c in text if not ignorable(c))
    return _RUN.sub(" ", unicodedata.normalize("NFKC", kept)).strip(" ")


def fold(text: str) -> str:
    """The table normalisation: visible() with look-alikes replaced."""
    return unicodedata.normalize("NFC", visible(text).translate(_LOOK))


def route(text: str) -> str:
    """A key that every pair of look-alike strings shares; coarser than looking alike."""
    out = fold(text)
    for given, options in AMBIGUOUS.items():
        for option in options:
            out = out.replace(option, LOOKALIKES[given])
    return out

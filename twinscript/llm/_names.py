"""Parts of personal names in their common form, for the operators on authors, translators and works."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that name no one.
PLACEHOLDERS = {"", "na", "nd", "none", "null", "unknown", "anon", "anonymous", "various", "various hands", "various authors", "various translators", "not known", "unidentified", "author unknown", "several hands", "multiple"}
# Short and pet forms of given names.
SHORT_FORMS = {
    "alexander": "alec alex sandy alick sasha", "anne": "ann annie nancy", "benjamin": "ben benj", "catherine": "cathy", "charles": "chas charlie charley chuck", "christopher": "chris kit",
    "daniel": "dan danl danny", "david": "dave davy", "dorothea": "thea dora dorothy dolly dot", "edward": "edw ned ted eddie teddy", "elizabeth": "eliza beth lizzie betty bess liz elsie lisa", "frances": "fanny",
    "francis": "frank", "frederick": "fred fredk freddy fritz", "george": "geo georgie", "gilbert": "gil", "harold": "hal", "henry": "harry hal hen", "isabella": "isa bella ella isabel", "james": "jas jim jimmy jamie",
    "johann": "hans joh jo", "john": "jno jack johnny", "joseph": "jos joe", "katherine": "kate kitty kathy kath katie", "laurence": "larry laurie lawrence lawrie", "margaret": "maggie peggy meg madge greta margt",
    "mary": "molly polly", "michael": "mike", "nathaniel": "nat nathl nate", "nicholas": "nick", "oliver": "ollie noll nolly", "patrick": "pat", "peter": "pete", "philippe": "phil philip pip", "richard": "rich dick richd rick",
    "robert": "rob robt bob bobby bert", "samuel": "sam saml", "stephen": "steve", "susannah": "sue sukey susan suky susie", "theodore": "theo", "thomas": "thos tom tommy", "ursula": "ulla ursie", "victoria": "vicky vic tori",
    "walter": "walt wat", "william": "wm will bill willy billy", "zachary": "zack zach zak",
}
_PET = {short: full for full, shorts in SHORT_FORMS.items() for short in shorts.split()}
# Titles and degrees beside a name.
_TITLES = re.compile(r"\b(rev|prof|dr|sir|mr|mrs|miss|ms|lady|lord|capt|col|fr)\b\.?\s+|^\s*(tr|trans|translated|ed)\.?\s+by\s+|,?\s*\b(m\.?a|b\.?a|ph\.?d|d\.?d|esq)\b\.?", re.I)
# Letters of scholarly transliteration.
_SCHOLARLY = str.maketrans({"š": "sh", "ǧ": "j", "ġ": "gh", "ḫ": "kh", "ṯ": "th", "ḏ": "dh", "ž": "z", "č": "ch", "ʿ": "", "ʾ": "", "’": "", "‘": "", "'": "", "`": ""})
# The sounds of Arabic letters in that spelling.
_ARABIC = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ء": "", "ؤ": "", "ئ": "", "ب": "b", "ت": "t", "ث": "T", "ج": "j", "ح": "h", "خ": "K", "د": "d", "ذ": "D", "ر": "r", "ز": "z", "س": "s", "ش": "S", "ص": "s",
    "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "G", "ف": "f", "ق": "k", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "", "و": "w", "ي": "y", "ى": "a",
}
_DIGRAPHS = (("sh", "S"), ("kh", "K"), ("gh", "G"), ("th", "T"), ("dh", "D"))
_YEAR = re.compile(r"\(?\s*(?:d\.?|died)\s*(\d{2,4})\s*(?:a\.?h\.?)?\s*\)?|\(\s*\d{3,4}\s*\)", re.I)
_FIELDS = ("family", "given", "father", "kunya", "death", "initials", "bones", "given_bones", "father_bones")


def roman(word: str) -> str:
    """One spelling for the usual romanisations of a word."""
    w = unicodedata.normalize("NFC", word.lower()).translate(_SCHOLARLY)
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if c.isascii() and c.isalpha())
    for given, kept in (("dsch", "j"), ("sch", "sh"), ("dj", "j"), ("tch", "tkh"), ("oo", "u"), ("ou", "u"), ("ee", "i")):
        w = w.replace(given, kept)
    w = re.sub(r"ch", "kh", w).replace("q", "k")
    w = re.sub(r"iy[iy]*$", "i", w)
    return re.sub(r"(.)\1+", r"\1", w)


def bones(word: str) -> str:
    """Consonants without half vowels; digraphs count as one. Also of words in Arabic script."""
    if word and "؀" <= word[0] <= "ۿ":
        w = "".join(_ARABIC.get(c, "") for c in unicodedata.normalize("NFKC", word) if unicodedata.category(c) != "Mn")
    else:
        w = word
        for given, kept in _DIGRAPHS:
            w = w.replace(given, kept)
    w = "".join(c for c in w if c not in "aeiouwy")
    return re.sub(r"(.)\1+", r"\1", w)


def _article(words: list[str], text_case: str = "") -> str:
    """The last word without the article, which may be attached."""
    w = words[-1]
    m = re.match(r"^(?:al|el)[-\s]?(.+)$", w, re.I)
    if m and (w[2:3] in "- " or (w[2:3].isupper() and not w.isupper()) or (w.isupper() and len(w) > 6)):
        w = m.group(1)
    return w


def parse_author(name: str | None) -> dict:
    """Parts of an Arabic author's name; family is null where no one is named."""
    out: dict = dict.fromkeys(_FIELDS)
    if not isinstance(name, str):
        return out
    text = unicodedata.normalize("NFKC", name).strip().strip("[]").strip()
    if re.sub(r"[^\w\s]", "", text).strip().lower() in PLACEHOLDERS:
        return out
    if m := _YEAR.search(text):
        out["death"] = int(m.group(1)) if m.group(1) else None
        text = (text[: m.start()] + text[m.end() :]).strip(" ,")
    arabic = any("؀" <= c <= "ۿ" for c in text)
    if arabic:
        words = text.split()
        fam = words[-1].removeprefix("ال")
        rest = words[:-1]
    else:
        text = re.sub(r"\bAbu'?l-", "Abu ", text, flags=re.I)
        if m := re.match(r"^(.*?),?\s+called\s+(.+)$", text, re.I):
            given, fam = m.group(1), m.group(2)
        elif m := re.match(r"^([^(]+?)\s*\(([^)]*)\)\s*$", text):
            fam, given = m.group(1), m.group(2)
        elif "," in text:
            fam, _, given = text.partition(",")
        else:
            words = text.split()
            k = len(words) - 1
            if k and words[k - 1].lower() in ("al", "el"):
                fam, given = " ".join(words[k - 1 :]), " ".join(words[: k - 1])
            else:
                fam, given = words[k], " ".join(words[:k])
        fam = re.sub(r"^(al|el)\s+", "", fam.strip(), flags=re.I)
        fam = _article(fam.split() or [""])
        rest = given.replace(".", " ").split()
    i, isms = 0, []
    while i < len(rest):
        low = rest[i].lower().strip(",")
        if low in ("ibn", "bin", "ben", "b", "بن", "ابن") and i + 1 < len(rest):
            father = [rest[i + 1]]
            if father[0].lower() in ("abu", "abū", "أبو") and i + 2 < len(rest):
                father.append(rest[i + 2])
                i += 1
            if out["father"] is None:
                out["father"] = " ".join(father)
            i += 2
            continue
        if low in ("abu", "abū", "أبو", "abû") and i + 1 < len(rest):
            out["kunya"] = rest[i + 1]
            i += 2
            continue
        isms.append(rest[i].strip(",'\""))
        i += 1
    given = isms[0] if isms else None
    out["bones"] = bones(fam if arabic else roman(fam)) or None
    out["given_bones"] = bones(given if arabic else roman(given)) if given else None
    out["father_bones"] = bones(out["father"] if arabic else roman(out["father"])) if out["father"] else None
    if arabic:
        out["family"] = "؟" + (out["bones"] or "")  # not comparable letter by letter
        out["given"] = out["father"] = out["kunya"] = None
    else:
        out["family"] = roman(fam) or None
        out["given"] = roman(given) or None if given else None
        out["father"] = roman(out["father"]) if out["father"] else None
        out["kunya"] = roman(out["kunya"]) if out["kunya"] else None
    return out


def parse_translator(name: str | None) -> dict:
    """Parts of a European name: family, given name in full, further initials (given null if only an initial is there)."""
    out: dict = dict.fromkeys(_FIELDS)
    if not isinstance(name, str):
        return out
    text = unicodedata.normalize("NFKC", name).strip().strip("[]").strip()
    text = _YEAR.sub("", text)
    text = _TITLES.sub(" ", _TITLES.sub(" ", text)).strip(" ,.")
    if re.sub(r"[^\w\s]", "", text).strip().lower() in PLACEHOLDERS:
        return out
    if m := re.match(r"^([^(]+?)\s*\(([^)]*)\)\s*$", text):
        fam, given = m.group(1), m.group(2)
    elif "," in text:
        fam, _, given = text.partition(",")
    else:
        words = text.split()
        fam, given = words[-1], " ".join(words[:-1])
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if c.isalpha() and not unicodedata.combining(c))
    parts = [plain(w) for w in re.split(r"[\s.]+", given) if plain(w)]
    out["family"] = plain(fam) or None
    out["bones"] = out["family"]
    if parts:
        out["initials"] = parts[0][0] if len(parts[0]) == 1 else _PET.get(parts[0], parts[0])[0]
        if len(parts[0]) > 1:
            out["given"] = _PET.get(parts[0], parts[0])
        second = next((p for p in parts[1:] if p), None)
        out["father"] = second[0] if second else None
    return out


PARTS = T.StructType([T.StructField(f, T.IntegerType() if f == "death" else T.StringType()) for f in _FIELDS])


def _frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=list(_FIELDS))
    df["death"] = df["death"].astype("Int32")
    return df


@F.pandas_udf(PARTS)
def author_parts(names: pd.Series) -> pd.DataFrame:
    return _frame([parse_author(n) for n in names])


@F.pandas_udf(PARTS)
def translator_parts(names: pd.Series) -> pd.DataFrame:
    return _frame([parse_translator(n) for n in names])


def deletions(c: Column | str) -> Column:
    """The word and every word with one letter less: two words at one edit share an element."""
    word = F.col(c) if isinstance(c, str) else c
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(word.isNull() | (F.length(word) == 0), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(word), cut)))


def one_edit(a: Column | str, b: Column | str) -> Column:
    """Whether two words differ by one insertion, deletion, substitution or swap of neighbours."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    part = lambda c, start, n: F.substring(c, start, n)
    swapped = lambda i: F.concat(part(x, F.lit(1), i - 1), part(x, i + 1, F.lit(1)), part(x, i, F.lit(1)), part(x, i + 2, F.length(x))) == y
    near = F.levenshtein(x, y, 2)
    swap = (near == 2) & (F.length(x) == F.length(y)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), swapped)
    return (near == 1) | swap


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; more than most counts as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return min(last[-1], most + 1)

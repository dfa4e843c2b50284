"""Text analysis for search: words, positions, stop words, stems, query parsing.

Words are runs of letters, marks, digits and underscores; ' ’ . : join letters and . , join digits
within a word. This follows Unicode's word boundaries but for scripts without spaces. A word loses
a possessive 's and what is no letter or digit, is lower-cased, and is dropped if shorter than two
bytes or a stop word; every word, dropped or not, has a position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.:]\p{L}[\p{L}\p{M}\p{N}_]*|[.,]\p{N}[\p{L}\p{M}\p{N}_]*)*"
#: The 33 English stop words of the usual search libraries.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def words(text: Column) -> Column:
    """Array of (pos, term) of the terms that remain; stems are not taken."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    plain = F.transform(found, lambda w, i: F.struct(i.alias("pos"), F.lower(F.regexp_replace(F.regexp_replace(w, "['’]s$", ""), r"[^\p{L}\p{N}]", "")).alias("term")))
    return F.filter(plain, lambda t: (F.octet_length(t["term"]) >= 2) & ~t["term"].isin(STOPWORDS))


_PY_WORD = re.compile(r"[^\W]+(?:['’.:][^\W\d_]\w*|[.,]\d\w*)*")


def plain_terms(text: str) -> list[tuple[int, str]]:
    """(position, term) of a text, on the driver."""
    out = []
    for i, m in enumerate(_PY_WORD.finditer(text)):
        term = "".join(c for c in re.sub("['’]s$", "", m[0]) if c.isalnum()).lower()
        if len(term.encode()) >= 2 and term not in STOPWORDS:
            out.append((i, term))
    return out


@dataclass
class Query:
    """A parsed query: terms in order without repeats, and phrases of two terms or more."""

    terms: list[str]
    phrases: list[list[str]] = field(default_factory=list)


def parse_query(text: str, stem: bool = False) -> Query:
    """Phrases stand in double quotes; one of a single term is a term, and an unmatched quote ends nothing."""
    take = (lambda w: porter(w)) if stem else (lambda w: w)
    terms, phrases = [], []
    parts = text.split('"')
    if len(parts) % 2 == 0:
        parts[-2:] = [parts[-2] + " " + parts[-1]] if len(parts) > 2 else [" ".join(parts)]
    for i, part in enumerate(parts):
        found = [take(t) for _, t in plain_terms(part)]
        terms += found
        if i % 2 and len(found) > 1:
            phrases.append(found)
    return Query(list(dict.fromkeys(terms)), phrases)


# The Porter stemmer, written from the published description of the algorithm (1980).

_VOWEL = "aeiou"


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in _VOWEL or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _twin_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


#: Endings and replacements of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            root = word[: -len(end)]
            return root + table[end] if _measure(root) > least else word
    return word


def porter(word: str) -> str:
    """The stem; words of two letters or fewer, or with other than ASCII characters, stay."""
    if len(word) <= 2 or not word.isascii():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                root = w[: -len(end)]
                if "v" in _shape(root):
                    if root.endswith(("at", "bl", "iz")):
                        root += "e"
                    elif _twin_end(root) and root[-1] not in "lsz":
                        root = root[:-1]
                    elif _measure(root) == 1 and _short_end(root):
                        root += "e"
                    w = root
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP2, 0)
    w = _replace(w, STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        root = w[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short_end(root)):
            w = root
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w

"""Tokens for full text search: words without diacritics, reduced to their stem.

The stemmer follows Porter's published algorithm (An algorithm for suffix stripping, 1980).
"""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
# The suffix tables of the published algorithm.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("bli", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _forms(word: str) -> str:
    """The word as c (consonants) and v (vowels); y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[k - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _forms(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return _forms(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table, least: int) -> str:
    best = max((p for p in table if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    if best and _measure(word[: -len(best[0])]) > least:
        return word[: -len(best[0])] + best[1]
    return word


def porter(word: str) -> str:
    """Stem of a lower-case word; words of two letters or less and others than a-z stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix):
                if "v" in _forms(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _ends_cvc(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _forms(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP_2, 0)
    word = _swap(word, STEP_3, 0)
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    parts = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(ch for ch in parts if unicodedata.category(ch) != "Mn")).lower()


class Analyzer:
    """Text -> tokens; stems are remembered for up to ``limit`` words."""

    def __init__(self, stem: bool = True, limit: int = 1 << 18):
        self.stem, self.limit, self.known = stem, limit, {}

    def __call__(self, text: str | None) -> list[str]:
        found = _WORD.findall(fold(text)) if text else []
        if not self.stem:
            return found
        known, out = self.known, []
        for word in found:
            stem = known.get(word)
            if stem is None:
                if len(known) >= self.limit:
                    known.clear()
                stem = known[word] = porter(word)
            out.append(stem)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, token) in the text itself."""
        return [(m.start(), m.end(), "".join(self(m.group()))) for m in _WORD.finditer(text)]

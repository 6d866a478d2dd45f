"""Word folding for the text index: diacritics removed, then Porter's 1980 stemmer.

Applied to the distinct words of a collection, inside Arrow batches.
"""

from __future__ import annotations

import unicodedata

_VOWELS = "aeiou"

# Published suffix rules (Porter 1980): (suffix, replacement), longest first.
_STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"),
    ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
)


def _consonant(word: str, i: int) -> bool:
    letter = word[i]
    if letter in _VOWELS:
        return False
    if letter == "y":
        return i == 0 or not _consonant(word, i - 1)
    return True


def _measure(stem: str) -> int:
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(1 for a, b in zip(kinds, kinds[1:]) if a == "v" and b == "c")


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _cvc(word: str) -> bool:
    n = len(word)
    return (
        n >= 3 and _consonant(word, n - 1) and not _consonant(word, n - 2)
        and _consonant(word, n - 3) and word[-1] not in "wxy"
    )


def porter(word: str) -> str:
    """Stem of a lower-case ASCII word."""
    if len(word) <= 2:
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
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"

    for rules in (_STEP2, _STEP3):
        for suffix, replacement in rules:
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + replacement
                break
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold_and_stem(word: str) -> str:
    plain = "".join(
        c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)
    )
    return porter(plain) if plain.isascii() and plain.isalpha() else plain

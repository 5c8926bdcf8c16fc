"""Porter's suffix stripping (1980) with the common extensions for irregular and short words.

A small helper for the Arrow function in `operators.text_scores`; words are cached per worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# Words with an irregular stem.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix and replacement, tried in this order; the first suffix found decides.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
ENDINGS = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
)
DROPPED = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """One letter per character: v for vowels, c for consonants (y after a consonant is a vowel)."""
    shape = ""
    for char in word:
        vowel = char in "aeiou" or (char == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant-vowel-consonant (not w, x, y), or is just vowel-consonant."""
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _swap(word: str, table, allowed: Callable[[str, str], bool]) -> str:
    for suffix, replacement in table:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + replacement if allowed(base, suffix) else word
    return word


def _participle(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(base):
            break
    else:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _doubled(base):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _measure(base) == 1 and _short(base) else base


def _derived(word: str) -> str:
    while word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    return _swap(
        word, DERIVED, lambda base, suffix: _measure(word[:-3] if suffix == "logi" else base) > 0
    )


def _droppable(base: str, suffix: str) -> bool:
    return _measure(base) > 1 and (suffix != "ion" or base[-1] in "st")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = _swap(word, PLURALS, lambda base, suffix: True)
    word = _participle(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _derived(word)
    word = _swap(word, ENDINGS, lambda base, suffix: _measure(base) > 0)
    word = _swap(word, [(suffix, "") for suffix in DROPPED], _droppable)
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word

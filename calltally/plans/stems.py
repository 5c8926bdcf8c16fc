"""Porter's suffix stripping as SQL steps over distinct words, for the twins of stemmed scores.

Written from the published steps, one CTE each; it shares no code with the stemmer of the tasks.
"""

from __future__ import annotations


def _shape(word: str) -> str:
    """V for vowels, C for consonants; y is a vowel after a consonant. Words are lower case."""
    out = f"regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    for _ in range(3):
        out = f"regexp_replace(regexp_replace({out}, '(^|V)y', '\\1C', 'g'), 'Cy', 'CV', 'g')"
    return out


def _choice(pairs: list[tuple[str, str]]) -> str:
    """Length of the first suffix found and what replaces it."""
    return ("CASE " + " ".join(
        f"WHEN ends_with(w, '{suffix}') THEN {{'n': {len(suffix)}, 'r': '{new}'}}" for suffix, new in pairs
    ) + " END")


def _step(name: str, source: str, pairs: list[tuple[str, str]], allowed: str) -> str:
    """A step that swaps the first suffix found, if `allowed` holds of its base (b, with shape s)."""
    return f"""{name}_found AS (SELECT word, w, {_choice(pairs)} AS f FROM {source}),
{name}_base AS (SELECT *, CASE WHEN f IS NOT NULL THEN left(w, len(w) - f.n) END AS b FROM {name}_found),
{name}_shaped AS (SELECT *, {_shape('b')} AS s FROM {name}_base),
{name} AS (SELECT word, CASE WHEN b IS NOT NULL AND ({allowed}) THEN b || f.r ELSE w END AS w FROM {name}_shaped)"""


_SHORT = "(s = 'VC' OR (ends_with(s, 'CVC') AND right(b, 1) NOT IN ('w', 'x', 'y')))"
_DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
]
_ENDINGS = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_DROPPED = [(x, "") for x in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)]
# Words with an irregular stem.
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def stem_ctes(words: str) -> str:
    """CTEs up to `stems` (word, stem) for the words over three letters of the table `words` (word)."""
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _IRREGULAR.items())
    return f"""plural AS (SELECT word, CASE WHEN ends_with(word, 'ies') AND len(word) = 4 THEN left(word, 3)
    WHEN ends_with(word, 'sses') THEN left(word, len(word) - 2) WHEN ends_with(word, 'ies') THEN left(word, len(word) - 2)
    WHEN ends_with(word, 'ss') THEN word WHEN ends_with(word, 's') THEN left(word, len(word) - 1) ELSE word END AS w
  FROM (SELECT DISTINCT word FROM {words} WHERE len(word) > 3)),
past_found AS (SELECT word, w, CASE WHEN ends_with(w, 'ied') THEN 'ied' WHEN ends_with(w, 'eed') THEN 'eed'
    WHEN ends_with(w, 'ed') THEN 'ed' WHEN ends_with(w, 'ing') THEN 'ing' ELSE '' END AS f FROM plural),
past_base AS (SELECT *, left(w, len(w) - len(f)) AS b FROM past_found),
past_shaped AS (SELECT *, {_shape('b')} AS s FROM past_base),
past AS (SELECT word, CASE f WHEN '' THEN w
    WHEN 'ied' THEN CASE WHEN len(w) = 4 THEN left(w, 3) ELSE left(w, len(w) - 2) END
    WHEN 'eed' THEN CASE WHEN contains(s, 'VC') THEN left(w, len(w) - 1) ELSE w END
    ELSE CASE WHEN NOT contains(s, 'V') THEN w
      WHEN ends_with(b, 'at') OR ends_with(b, 'bl') OR ends_with(b, 'iz') THEN b || 'e'
      WHEN len(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND ends_with(s, 'C')
        THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, len(b) - 1) END
      WHEN regexp_matches(s, '^[^V]*V+C+V*$') AND {_SHORT} THEN b || 'e' ELSE b END END AS w FROM past_shaped),
ypsilon AS (SELECT word, CASE WHEN ends_with(w, 'y') AND len(w) > 2
    AND right({_shape('left(w, len(w) - 1)')}, 1) = 'C' THEN left(w, len(w) - 1) || 'i' ELSE w END AS w FROM past),
alli AS (SELECT word, CASE WHEN ends_with(w, 'alli') AND contains({_shape('left(w, len(w) - 4)')}, 'VC')
    THEN left(w, len(w) - 2) ELSE w END AS w FROM ypsilon),
{_step('derived', 'alli', _DERIVED, "contains(CASE WHEN f.r = 'log' THEN " + _shape('left(w, len(w) - 3)') + " ELSE s END, 'VC')")},
{_step('ending', 'derived', _ENDINGS, "contains(s, 'VC')")},
{_step('dropped', 'ending', _DROPPED, "regexp_matches(s, 'VC.*VC') AND (NOT ends_with(w, 'ion') OR right(b, 1) IN ('s', 't'))")},
final_e AS (SELECT word, w, CASE WHEN ends_with(w, 'e') THEN left(w, len(w) - 1) END AS b FROM dropped),
final_shaped AS (SELECT *, {_shape('b')} AS s FROM final_e),
without_e AS (SELECT word, CASE WHEN b IS NOT NULL AND (regexp_matches(s, 'VC.*VC') OR (contains(s, 'VC') AND NOT {_SHORT}))
    THEN b ELSE w END AS w FROM final_shaped),
stems AS (SELECT word, CASE word {irregular}
    ELSE CASE WHEN ends_with(w, 'll') AND regexp_matches({_shape('left(w, len(w) - 1)')}, 'VC.*VC')
      THEN left(w, len(w) - 1) ELSE w END END AS stem FROM without_e)"""

"""Porter's suffix-stripping algorithm (M. F. Porter, 1980), for single lower-case words.

``porter_stem`` stems a query word in Python. ``stem_column`` stems document words inside a plan: the
same rules as a chain of regular expressions that both the JVM's and RE2's dialect understand, so
checking SQL can use it as well (``stem_expression``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_C = "[^aeiou](?:[^aeiouy]*)"
_V = "[aeiouy][aeiou]*"
_M_POS = re.compile(f"^(?:{_C})?{_V}{_C}")                      # measure > 0
_M_ONE = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")            # measure = 1
_M_TWO = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")              # measure > 1
_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")

# Suffix rules of steps two, three and four.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _mapped(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _M_POS.match(stem) else word
    return word


def porter_stem(word: str) -> str:
    """The stem of a word; words with anything but a-z, or very short ones, are left alone."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.startswith("y"):  # a leading y is a consonant
        return _stem_from("Y" + word[1:]).lower()
    return _stem_from(word)


def _stem_from(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((x for x in ("ed", "ing") if w.endswith(x)), None)
    if w.endswith("eed"):
        if _M_POS.match(w[:-3]):
            w = w[:-1]
    elif cut and _VOWEL.match(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _M_ONE.match(w) and _CVC.match(w):
            w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _mapped(_mapped(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _M_TWO.match(stem) and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _M_TWO.match(stem) or (_M_ONE.match(stem) and not _CVC.match(stem)):
            w = stem
    if w.endswith("ll") and _M_TWO.match(w):
        w = w[:-1]
    return w


# --- the same as a chain of expressions ----------------------------------------------------------

# "~" marks the suffix that a step looks at; classes leave it out, so that a rule fires once at most.
_CC = "[^aeiou~][^aeiouy~]*"
_POSITIVE = f"(?:{_CC})?{_V}[^aeiou~][^~]*"            # measure > 0
_SEVERAL = f"(?:{_CC})?{_V}{_CC}{_V}[^aeiou~][^~]*"    # measure > 1
_SHORT = f"{_CC}[aeiouy][^aeiouwxy~]"                  # consonant, vowel, consonant
_DOUBLED = ["bcdfghjkm", "npqrtvwxY"]


def _any(suffixes) -> str:
    return "|".join(sorted(suffixes, key=len, reverse=True))


#: (pattern, replacement) one after the other; ``{1}`` is the first group.
STEPS: tuple[tuple[str, str], ...] = (
    ("^y", "Y"),
    ("(ss|i)es$", "{1}"), ("([^s])s$", "{1}"),
    ("(eed|ed|ing)$", "~{1}"), (f"^({_POSITIVE})~eed$", "{1}ee"), ("~eed$", "eed"),
    (f"^((?:{_CC})?[aeiouy][^~]*)~(?:ed|ing)$", "{1}~"), ("~(ed|ing)$", "{1}"), ("(at|bl|iz)~$", "{1}e"),
    *(("(?:" + "|".join(f"({c}){c}" for c in part) + ")~$", "".join(f"{{{k + 1}}}" for k in range(len(part))))
      for part in _DOUBLED),
    (f"^({_SHORT})~$", "{1}e"), ("~$", ""),
    (f"^((?:{_CC})?[aeiouy][^~]*)y$", "{1}i"),
    (f"({_any(_STEP2)})$", "~{1}"),
    (f"^({_POSITIVE})~(tion|al|ent|e|ous|ive|ful|ize|log)(?:al|li|ism|ness|iti|i|r)$", "{1}{2}"),
    (f"^({_POSITIVE})~(enc|anc|at|iz|iv|bl)(?:ional|ation|ion|iti|or|i)$", "{1}{2}e"),
    (f"^({_POSITIVE})~biliti$", "{1}ble"), ("~", ""),
    (f"({_any(_STEP3)})$", "~{1}"), (f"^({_POSITIVE})~(ic|al)(?:ate|ize|iti|al)$", "{1}{2}"),
    (f"^({_POSITIVE})~(?:ative|ful|ness)$", "{1}"), ("~", ""),
    (f"({_any(_STEP4)})$", "~{1}"), ("([^st~])~ion$", "{1}ion"), (f"^({_SEVERAL})~[a-z]+$", "{1}"), ("~", ""),
    ("e$", "~e"), (f"^({_SEVERAL})~e$", "{1}"), (f"^({_SHORT})~e$", "{1}e"),
    (f"^((?:{_CC})?{_V}{_CC}(?:{_V})?)~e$", "{1}"), ("~", ""),
    (f"^((?:{_CC})?{_V}{_CC}{_V}(?:[^aeiou~][^~]*)?l)l$", "{1}"),
    ("^Y", "y"),
)
STEMMED = "^[a-z]{3,}$"  # other words are left alone


def _replacement(text: str, mark: str) -> str:
    return re.sub(r"\{(\d)\}", lambda m: mark + m[1], text)


def stem_column(word: Column) -> Column:
    """The stem of a word, as an expression."""
    out = word
    for pattern, new in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(_replacement(new, "$")))
    return F.when(F.regexp_like(word, F.lit(STEMMED)), out).otherwise(word)


def stem_expression(word: str, quote: Callable[[str], str]) -> str:
    """The stem of a word, as SQL whose ``regexp_replace`` knows RE2."""
    out = word
    for pattern, new in STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(_replacement(new, chr(92)))})"
    return f"CASE WHEN regexp_matches({word}, {quote(STEMMED)}) THEN {out} ELSE {word} END"


def common_start(stem: str) -> str:
    """What all words with this stem begin with: stemming changes at most the last letter that it
    keeps, or two in ``-ble`` (``-biliti``)."""
    return stem[:-2] if stem.endswith("ble") else stem[:-1]

r"""Render the neutral pattern dialect of :mod:`postgrain.rules` for the JVM regex engine.

Two JVM habits would change results: ``\b`` treats accented letters as word characters on some
Java releases, and ``\s`` knows ASCII blanks only. Both are spelled out instead.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Every character that counts as white space: ASCII blanks, no-break space, the Unicode space
# separators, line/paragraph separators and the byte-order mark.
SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_SPACE_CLASS = (
    r"\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
SPACE = f"[{_SPACE_CLASS}]"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _firsts(pattern: str) -> str:
    """What every match of a pattern that begins with a literal, or with a group of such, can begin with.

    Empty where that is not plain to see.
    """
    plain = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", lambda m: "_" * len(m[0]), pattern)
    group = re.match(r"\((?:\?:)?", plain)
    at = group.end() if group else 0
    heads, depth = [plain[at:at + 2]], 0
    while group and at < len(plain) and depth >= 0:
        depth += {"(": 1, ")": -1}.get(plain[at], 0)
        if plain[at] == "|" and not depth:
            heads.append(plain[at + 1:at + 3])
        at += 1
    optional = group and plain[at:at + 1] in ("?", "*", "{")
    if optional or not all(re.fullmatch("[A-Za-z0-9][^?*{]?", h) for h in heads):
        return ""
    return "".join(sorted({h[0] for h in heads}))


@lru_cache(maxsize=None)
def jvm(pattern: str, ignore_case: bool = False) -> str:
    r"""The JVM spelling of a neutral pattern."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(_SPACE_CLASS if in_class else SPACE)
            i += 2
        elif two == r"\b" and not in_class:
            before, after = pattern[i - 1] if i else "(", pattern[i + 2:i + 3]
            if before in "(|:" and after not in ("", ")", "|"):
                # every pattern continues with a word character here; the look-ahead rejects most places
                first = _firsts(pattern[i + 2:])
                out.append((f"(?=[{first}])" if first else "") + f"(?<!{_WORD})")
            elif before.isalnum() and after in ("", ")", "|"):
                out.append(f"(?!{_WORD})")
            else:
                out.append(_BOUNDARY)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def any_of(patterns, ignore_case: bool = False) -> str:
    """One pattern that matches where any of ``patterns`` does."""
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{jvm(p)})" for p in patterns)


def escape(text: str) -> str:
    """Quote a literal for use inside a pattern."""
    return "".join(c if c.isalnum() or c in " -_" else "\\" + c for c in text)

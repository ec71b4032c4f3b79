"""Skill matching: one regex pass over the text, whatever the size of the lexicon.

At each word start the longest lexicon term is captured inside a look-ahead, so overlapping terms
are all seen. Every shorter term starting at the same place is a prefix of the captured one, so a
small map built with the pattern says which skills a captured term stands for.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from postgrain.functions.patterns import escape
from postgrain.functions.text import col_of, trim
from postgrain.rules.skills import SKILLS, entry_terms, prose_terms


def term_pattern(terms) -> str:
    """Pattern whose group 1 is the longest term at each word start."""
    by_first = defaultdict(list)
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        by_first[term[0]].append(escape(term[1:]))
    branches = "|".join(
        f"{escape(first)}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items())
    )
    # the class after the look-behind rejects most positions on their first character
    firsts = "".join(escape(c) for c in sorted(by_first))
    return f"(?<![a-z0-9])(?=[{firsts}])(?=({branches})(?![a-z0-9]))"


def implied_skills(terms: dict[str, str]) -> dict[str, list[str]]:
    """Term -> skills of every term that matches where it does, itself included."""

    def bounded_prefix(short: str, long: str) -> bool:
        rest = long[len(short):len(short) + 1]
        return long.startswith(short) and not (rest.isascii() and rest.isalnum())

    return {
        term: sorted({skill for other, skill in terms.items() if bounded_prefix(other, term)})
        for term in terms
    }


def match_skills(text: Column | str, skills=SKILLS) -> Column:
    """Sorted distinct skills whose terms occur in the text as whole words."""
    terms = prose_terms(skills)
    found = F.array_distinct(
        F.regexp_extract_all(F.lower(col_of(text)), F.lit(term_pattern(terms)), F.lit(1))
    )
    lookup = F.create_map(
        *[
            x
            for term, names in implied_skills(terms).items()
            for x in (F.lit(term), F.array(*[F.lit(n) for n in names]))
        ]
    )
    named = F.flatten(F.transform(found, lambda t: F.element_at(lookup, t)))
    return F.array_sort(F.array_distinct(named))


def match_skill_list(entries: Column | str, skills=SKILLS) -> Column:
    """Skills of a curated list: prose matches plus entries that are a term as a whole."""
    items = col_of(entries)
    lookup = F.create_map(*[F.lit(x) for pair in entry_terms(skills).items() for x in pair])
    exact = F.filter(
        F.transform(items, lambda e: F.element_at(lookup, F.lower(trim(e)))),
        lambda s: s.isNotNull(),
    )
    return F.array_sort(F.array_union(match_skills(F.array_join(items, "\n"), skills), exact))

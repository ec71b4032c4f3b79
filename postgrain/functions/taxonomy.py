"""Classification of titles, companies and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postgrain.functions.patterns import any_of, jvm
from postgrain.functions.text import bind, col_of, sha256, squash, trim
from postgrain.rules import titles as R
from postgrain.rules.constants import SENIORITY_LEVELS


def _like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def title_family(title: Column | str, families=R.FAMILY_PATTERNS) -> Column:
    """First family, in rule order, with a pattern in the title; null when none fits."""
    text = F.lower(col_of(title))
    manager = _like(text, jvm(R.MANAGER_PATTERN)) & ~_like(text, jvm(R.ENGINEER_PATTERN))
    out = F.when(manager, F.lit(None).cast("string"))
    for family, patterns in families:
        out = out.when(_like(text, any_of(patterns)), family)
    return out


def seniority(title: Column | str, description: Column | str) -> Column:
    """Level named by the title, else implied by the fewest years the description asks for."""
    text = F.lower(col_of(title))
    out = None
    for level, pattern in R.SENIORITY_PATTERNS:
        hit = _like(text, jvm(pattern))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    # in either case, as lower-casing a whole text that is not ASCII costs more than the search
    found = F.regexp_extract_all(
        col_of(description), F.lit(jvm(R.YEARS_PATTERN, ignore_case=True)), F.lit(1)
    )
    years = F.array_min(
        F.filter(
            F.transform(found, lambda y: y.cast("int")), lambda y: (y > 0) & (y < R.YEARS_LIMIT)
        )
    )

    def stated(years: Column) -> Column:
        named = F.when(years.isNull(), F.lit(None).cast("string"))
        for floor, level in R.YEARS_LEVELS:
            named = named.when(years >= floor, level)
        return named.otherwise("junior")

    return out.otherwise(bind(years, stated))


def seniority_rank(level: Column | str) -> Column:
    """Position on the ladder, 0 for the lowest; null for an unknown level."""
    ladder = F.array(*[F.lit(x) for x in SENIORITY_LEVELS])
    return F.nullif(F.array_position(ladder, col_of(level)), F.lit(0)) - 1


def variant_markers(title: Column | str) -> Column:
    """Sorted marker words present in the title."""
    text = F.lower(col_of(title))
    return F.filter(
        F.array(*[F.when(_like(text, jvm(rf"\b{m}\b")), m) for m in sorted(R.VARIANT_MARKERS)]),
        lambda m: m.isNotNull(),
    )


def company_key(name: Column | str) -> Column:
    """Company name folded for matching: lower case, punctuation and legal suffixes dropped."""
    text = F.translate(F.lower(col_of(name)), ",.", "  ")
    text = F.regexp_replace(text, jvm(rf"\b({'|'.join(R.COMPANY_SUFFIXES)})\b"), " ")
    return squash(F.regexp_replace(text, jvm(r"[^a-z0-9&\s-]"), " "))


def location_key(location: Column | str, remote: Column | str) -> Column:
    """Location folded for matching; remote roles are keyed by the region they are open to."""
    cleaned = squash(
        F.regexp_replace(
            F.lower(F.coalesce(col_of(location), F.lit(""))), jvm(r"[^a-z0-9\s]"), " "
        )
    )

    def keyed(place: Column) -> Column:
        scope = squash(F.regexp_replace(place, jvm(r"\bremote\b"), ""))
        folded = trim(F.regexp_replace(scope, jvm(r"\b(?:united states|usa)\b"), "us"))
        region = F.coalesce(F.nullif(folded, F.lit("")), F.lit("any"))
        return F.when(col_of(remote), F.concat(F.lit("remote:"), region)).otherwise(place)

    return bind(cleaned, keyed)


def resolve_remote(
    stated: Column | str, location: Column | str, description: Column | str
) -> Column:
    """What the feed states, else what the location or description text reveals."""
    where = _like(col_of(location), jvm(R.REMOTE_LOCATION_PATTERN, ignore_case=True))
    told = _like(col_of(description), jvm(R.REMOTE_DESCRIPTION_PATTERN, ignore_case=True))
    return F.coalesce(col_of(stated), F.coalesce(where, F.lit(False)) | told)


def title_tokens(title: Column | str) -> Column:
    """Distinct title words longer than one character."""
    text = F.regexp_replace(F.lower(col_of(title)), jvm(r"[^a-z0-9\s]"), " ")
    return F.array_distinct(F.filter(F.split(text, jvm(r"\s+")), lambda t: F.length(t) > 1))


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets; 0 when either is empty."""
    both = F.size(left) + F.size(right)
    score = bind(F.size(F.array_intersect(left, right)), lambda shared: shared / (both - shared))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), score).otherwise(F.lit(0.0))


def title_similarity(left: Column | str, right: Column | str) -> Column:
    pair = F.struct(title_tokens(left).alias("a"), title_tokens(right).alias("b"))
    return bind(pair, lambda p: token_similarity(p["a"], p["b"]))


def fingerprint(company: Column, family: Column, location: Column, markers: Column) -> Column:
    """Hash of the blocking key of a role. The title itself is not part of it."""
    return sha256(
        F.concat(
            company, F.lit("|"), F.coalesce(family, F.lit("")), F.lit("|"), location, F.lit("|"),
            F.array_join(F.array_sort(markers), "+"),
        )
    )

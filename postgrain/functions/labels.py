"""Display labels, application stages and score clamping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postgrain.functions.money_time import round_half_up
from postgrain.functions.patterns import jvm
from postgrain.functions.text import col_of, trim
from postgrain.rules.constants import (
    APPLICATION_PROGRESS, DIMENSIONS, FAIR_SCORE, STRONG_SCORE,
)


def _progress(status: Column | str, index: int) -> Column:
    value = col_of(status)
    out = F.when(value.isNull(), APPLICATION_PROGRESS[None][index])
    for name, parts in APPLICATION_PROGRESS.items():
        if name is not None:
            out = out.when(value == name, parts[index])
    return out


def application_stage(status: Column | str) -> Column:
    return _progress(status, 0)


def next_action(status: Column | str) -> Column:
    return _progress(status, 1)


def whole_days(earlier: Column | str, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(col_of(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def posted_age_label(posted_at: Column | str, now: Column) -> Column:
    days = whole_days(posted_at, now)
    return (
        F.when(col_of(posted_at).isNull(), F.lit("date unknown"))
        .when(days <= 0, F.lit("today"))
        .when(days == 1, F.lit("1 day ago"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def days_since(at: Column | str, now: Column) -> Column:
    return F.greatest(F.lit(0), whole_days(at, now))


def score_tone(score: Column | str) -> Column:
    value = col_of(score)
    return F.when(value >= STRONG_SCORE, "strong").when(value >= FAIR_SCORE, "fair").otherwise("weak")


def score_label(score: Column | str) -> Column:
    value = col_of(score)
    return F.coalesce(round_half_up(value).cast("string"), F.lit("—"))


def salary_label(text: Column | str) -> Column:
    value = col_of(text)
    return F.when(F.coalesce(trim(value), F.lit("")) == "", F.lit("no comp stated")).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    # least and greatest skip nulls, so a missing value has to be kept missing
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def clamp_overall(value: Column | str) -> Column:
    """0..100, rounded half up."""
    return round_half_up(clamp(col_of(value).cast("double"), 0.0, 100.0)).cast("double")


def clamp_dimensions(dimensions: Column | str) -> Column:
    """Each dimension to 0..10 with at most three evidence strings."""
    value = col_of(dimensions)
    return F.when(
        value.isNotNull(),
        F.struct(
            *[
                F.struct(
                    clamp(value[name]["score"], 0.0, 10.0).alias("score"),
                    F.slice(value[name]["evidence"], 1, 3).alias("evidence"),
                    value[name]["note"].alias("note"),
                ).alias(name)
                for name, _ in DIMENSIONS
            ]
        ),
    )


def token_candidates(name: Column | str, domain: Column | str) -> Column:
    """Board tokens a company is likely to use, best guesses first."""
    words = F.filter(
        F.split(F.regexp_replace(F.lower(col_of(name)), "[^a-z0-9]+", " "), " "), lambda w: w != ""
    )
    plain = F.filter(words, lambda w: ~w.isin("ai", "and", "inc"))
    host = F.regexp_replace(F.lower(col_of(domain)), r"^www\.", "")
    guesses = F.array(
        F.array_join(words, ""), F.array_join(words, "-"),
        F.array_join(plain, ""), F.array_join(plain, "-"),
        F.substring_index(host, ".", 1), host,
        F.coalesce(F.get(words, 0), F.lit("")),
    )
    return F.array_distinct(F.filter(guesses, lambda t: F.length(t) >= 2))


def formula_guard(value: Column | str) -> Column:
    """Prefix an apostrophe to text a spreadsheet would run as a formula."""
    text = col_of(value).cast("string")
    risky = F.regexp_like(text, F.lit(r"^[=+\-@\t\r]"))
    number = F.regexp_like(trim(text), F.lit(jvm(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")))
    return F.when(risky & ~number, F.concat(F.lit("'"), text)).otherwise(text)

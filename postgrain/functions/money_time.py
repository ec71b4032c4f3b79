"""Salary texts and timestamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postgrain.functions.patterns import SPACES
from postgrain.functions.text import bind, col_of, text_or_empty, trim


def grouped(number: Column) -> Column:
    """Thousands separators, at most three decimals."""
    return F.call_function("format_number", number, F.lit("#,##0.###"))


def round_half_up(number: Column) -> Column:
    return F.floor(number + 0.5)


def _positive(amount: Column | str) -> Column:
    value = col_of(amount).cast("double")
    usable = (value > 0) & ~F.isnan(value) & (value < float("inf"))
    return F.when(usable, round_half_up(value))


def usd_range(low: Column | str, high: Column | str) -> Column:
    """Dollar range for display; a missing, non-finite or non-positive end is absent."""

    def shown(p: Column) -> Column:
        low_text, high_text = (
            F.concat(F.lit("$"), F.format_number(p[x], 0)) for x in ("low", "high")
        )
        return (
            F.when(p["low"] == p["high"], low_text)
            .when(p["low"].isNotNull() & p["high"].isNotNull(),
                  F.concat(low_text, F.lit("–"), high_text))
            .when(p["low"].isNotNull(), F.concat(low_text, F.lit("+")))
            .when(p["high"].isNotNull(), F.concat(F.lit("up to "), high_text))
        )

    return bind(F.struct(_positive(low).alias("low"), _positive(high).alias("high")), shown)


def open_range(low: Column, high: Column, show, dash: str) -> Column:
    """`low<dash>high`, `low+`, `up to high` or null."""
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(show(low), F.lit(dash), show(high)))
        .when(low.isNotNull(), F.concat(show(low), F.lit("+")))
        .when(high.isNotNull(), F.concat(F.lit("up to "), show(high)))
    )


def join_parts(separator: str, *parts: Column) -> Column:
    """Join the parts that are not empty."""
    return F.array_join(
        F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator
    )


def plain_number(number: Column) -> Column:
    """A number without grouping; whole numbers show no decimals."""
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )


def plain_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """`USD 100-200 yearly`: raw digits, blank-separated."""
    span = open_range(low, high, plain_number, "-")
    return F.when(
        span.isNotNull(),
        join_parts(" ", text_or_empty(currency), span, text_or_empty(period)),
    )


def slashed_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """`1,000–2,000 USD/yearly`: grouped digits, en dash."""
    span = open_range(low, high, grouped, "–")
    suffix = join_parts("/", text_or_empty(currency), text_or_empty(period))
    return F.when(suffix != "", F.concat(span, F.lit(" "), suffix)).otherwise(span)


def spaced_salary(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """`USD 1,000 - 2,000 per-year`; both ends are needed."""
    span = F.concat(grouped(low), F.lit(" - "), grouped(high))
    return F.when(
        low.isNotNull() & high.isNotNull(),
        join_parts(" ", currency, span, interval),
    )


_ISO = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_SPACED = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?$"
_RFC822 = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) ?(?:GMT|UTC|UT|Z|([+-]\d{4}))$"


def timestamp_or_null(value: Column | str) -> Column:
    """Instant of an ISO or RFC-822 text; a missing zone means UTC; anything else is null."""
    text = F.trim(col_of(value), F.lit(SPACES))
    stamp = F.regexp_extract(text, _RFC822, 1)
    zone = F.regexp_extract(text, _RFC822, 2)
    mail = F.try_to_timestamp(
        F.concat(stamp, F.lit(" "), F.when(zone == "", F.lit("+0000")).otherwise(zone)),
        F.lit("d MMM yyyy HH:mm:ss xx"),
    )
    return (
        F.when(F.regexp_like(text, F.lit(_ISO)) | F.regexp_like(text, F.lit(_SPACED)),
               F.try_to_timestamp(text))
        .when(F.regexp_like(text, F.lit(_RFC822)), mail)
    )


def timestamp_from_seconds(value: Column | str) -> Column:
    return F.timestamp_seconds(col_of(value))


def timestamp_from_millis(value: Column | str) -> Column:
    return F.timestamp_millis(col_of(value).cast("bigint"))


def drop_fraction(value: Column | str) -> Column:
    """Remove a zone-less fractional second, so that the text reads as UTC."""
    return F.regexp_replace(col_of(value), r"(T\d{2}:\d{2}:\d{2})\.\d+$", "$1")


def iso_text(value: Column | str) -> Column:
    """ISO-8601 UTC text with milliseconds."""
    return F.date_format(col_of(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def first_salary(*texts: Column | str) -> Column:
    """First compensation text that is not blank."""
    return F.coalesce(*[F.when(trim(t) != "", trim(t)) for t in texts])

"""Text clean-up as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postgrain.functions.patterns import SPACE, SPACES

# Named entities and the text each stands for (names are case-sensitive).
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "ndash": "-", "mdash": "-", "hellip": "...",
}
_ENTITY = r"^((?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);)"
_BLANK = SPACE.replace(r"\n", "")
_RAGGED = rf"\n(?:(?={_BLANK})|(?<={_BLANK}\n))"
_REPLACEMENT = "�"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it.

    Without this every mention is another copy of the expression, and copies nest.
    """
    return F.get(F.transform(F.array(value), body), 0)


def trim(value: Column | str) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.trim(col_of(value), F.lit(SPACES))


def squash(value: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return trim(F.regexp_replace(col_of(value), SPACE + "+", " "))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(trim(value), F.lit(""))


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(trim(value), F.lit(""))


def first_text(*values: Column | str) -> Column:
    """The first value that is not blank, trimmed; null when all are."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def replace_each(value: Column, pattern: str, change) -> Column:
    """Replace every match by ``change(match)`` in one pass: output is never scanned again."""
    gaps = F.split(value, pattern, -1)
    hits = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), change)
    return F.array_join(
        F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), ""
    )


def _char_of(code: Column) -> Column:
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    good = F.when(bad, F.lit(None)).otherwise(code)
    return F.coalesce(
        F.decode(F.unhex(F.lpad(F.hex(good), 8, "0")), "UTF-32"), F.lit(_REPLACEMENT)
    )


def _decoded(entity: Column) -> Column:
    body = F.substring(entity, 2, F.length(entity) - 2)
    hex_digits = F.regexp_replace(F.substring(body, 3, 1 << 30), "^0+", "")
    # more than six significant hex digits is beyond the last code point
    from_hex = F.when(
        F.length(hex_digits) <= 6, F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).cast("bigint")
    )
    from_decimal = F.substring(body, 2, 1 << 30).try_cast("bigint")
    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])
    numeric = F.when(F.substring(body, 2, 1).isin("x", "X"), _char_of(from_hex)).otherwise(_char_of(from_decimal))
    return F.when(F.startswith(entity, F.lit("&#")), numeric).otherwise(F.coalesce(F.element_at(named, body), entity))


def decode_entities(value: Column | str) -> Column:
    """Decode HTML entities once; unknown names stay as they are."""

    def after(rest: Column) -> Column:
        entity = bind(F.regexp_extract(rest, _ENTITY, 1), lambda name: F.when(name != "", F.concat(
            _decoded(F.concat(F.lit("&"), name)), F.substring(rest, F.length(name) + 1, F.lit(1 << 30)))))
        return F.coalesce(entity, F.concat(F.lit("&"), rest))

    # an entity has no second "&" in it, so what follows each is looked at by itself
    return bind(
        col_of(value),
        lambda text: F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(
            F.split(text, "&", -1), lambda part, i: F.when(i > 0, after(part)).otherwise(part)), "")
        ).otherwise(text),
    )


def html_to_text(value: Column | str) -> Column:
    """Readable text of an HTML fragment: line breaks kept, tags dropped, entities decoded."""
    sp = SPACE
    text = F.regexp_replace(col_of(value), rf"(?i)<{sp}*br{sp}*/?{sp}*>", "\n")
    text = F.regexp_replace(text, rf"(?i)<{sp}*li[^>]*>", "- ")
    text = F.regexp_replace(
        text, rf"(?i)<{sp}*/{sp}*(?:p|div|li|ul|ol|h[1-6]|tr|section){sp}*>", "\n"
    )
    text = F.regexp_replace(text, "<[^>]*>", "")
    text = F.replace(decode_entities(text), F.lit("\r\n"), F.lit("\n"))
    # a single blank stays as it is
    text = F.regexp_replace(text, r"[ \t](?:[ \t]+|(?<=\t))", " ")
    # lines are trimmed one by one only where white space touches a line break
    text = bind(text, lambda t: F.when(F.regexp_like(t, F.lit(_RAGGED)), F.array_join(
        F.transform(F.split(t, "\n", -1), trim), "\n")).otherwise(t))
    return trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def sha256(value: Column | str) -> Column:
    return F.sha2(col_of(value), 256)


@lru_cache(maxsize=1)
def _accent_pairs() -> tuple[str, str]:
    """Letters that decompose into a base letter plus marks, and those base letters."""
    source, target = [], []
    for code in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold(value: Column | str) -> Column:
    """Lower-case and strip accents, the way full-text matching compares words."""
    source, target = _accent_pairs()

    def strip(lowered: Column) -> Column:
        plain = F.regexp_replace(F.translate(lowered, source, target), r"\p{Mn}+", "")
        return F.when(F.regexp_like(lowered, F.lit(r"[^\x00-\x7F]")), plain).otherwise(lowered)

    return bind(F.lower(col_of(value)), strip)


def index_tokens(value: Column | str) -> Column:
    """Full-text tokens: maximal runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(value), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))

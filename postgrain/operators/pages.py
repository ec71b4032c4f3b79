"""Mining raw web pages: board references, scripts and embedded JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.fanout import inline_rows, posexplode_rows
from postgrain.functions.labels import token_candidates
from postgrain.functions.text import col_of
from postgrain.functions.urls import origin_of, resolve_link
from postgrain.rules.boards import (
    ARRAY_KEYS, BOARD_NOISE, BOARDS, POSTING_KEYS, STATE_MARKERS, Board,
)

_SCRIPT = r"(?is)<script(?=[\s>/])([^>]*)>(.*?)</script"


def _reference(place: int, provider: str):
    return lambda token: F.struct(
        F.lit(place).alias("place"), F.lit(provider).alias("provider"), token.alias("token"))


def board_references(html: Column | str, catalog: tuple[Board, ...] = BOARDS) -> Column:
    """array<struct<place, provider, token>>: every reference found, repeats included.

    A provider's patterns run only on pages that contain its literal.
    """
    page = col_of(html)
    lowered = F.lower(page)
    groups = []
    for place, board in enumerate(catalog):
        prefix = "(?i)" if board.ignore_case else ""
        found = F.concat(*[
            F.regexp_extract_all(page, F.lit(prefix + p), F.lit(1)) for p in board.patterns
        ])
        marked = F.transform(found, _reference(place, board.provider))
        groups.append(F.when(F.contains(lowered, F.lit(board.literal)), marked).otherwise(
            F.array().cast("array<struct<place:int,provider:string,token:string>>")))
    return F.filter(F.concat(*groups), lambda h: ~F.lower(h["token"]).isin(*BOARD_NOISE))


def detect_boards(
    pages: DataFrame, key: str = "page_id", catalog: tuple[Board, ...] = BOARDS
) -> DataFrame:
    """(key, provider, token, occurrences, place) per page; only references leave the scan."""
    return (
        inline_rows(pages, board_references("html", catalog), key)
        .groupBy(key, "provider", "token")
        .agg(F.count("*").alias("occurrences"), F.min("place").alias("place"))
    )


def merge_hits(hits: DataFrame, site: str = "site") -> DataFrame:
    """Occurrences summed over the documents of a site."""
    return hits.groupBy(site, "provider", "token").agg(F.sum("occurrences").alias("occurrences"))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def scripts_of(html: Column | str) -> Column:
    """array<struct<id, type, src, text>> of the scripts of a page, in document order."""
    page = col_of(html)
    tags = F.regexp_extract_all(page, F.lit(_SCRIPT), F.lit(1))
    bodies = F.regexp_extract_all(page, F.lit(_SCRIPT), F.lit(2))
    return F.zip_with(tags, bodies, lambda tag, body: F.struct(
        _attribute(tag, "id").alias("id"), _attribute(tag, "type").alias("type"),
        _attribute(tag, "src").alias("src"), body.alias("text"),
    ))


def script_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, id, type, text) of every script."""
    return posexplode_rows(pages, scripts_of("html"), "position", "_s", key).select(
        key, "position", "_s.id", "_s.type", "_s.text"
    )


def script_sources(html: Column | str, base: Column | str) -> Column:
    """Distinct absolute sources of a page's scripts, in document order."""
    links = F.transform(
        F.filter(scripts_of(html), lambda s: s["src"] != ""),
        lambda s: resolve_link(s["src"], base),
    )
    return F.array_distinct(F.filter(links, lambda u: u.isNotNull()))


def bundle_sources(
    html: Column | str, base: Column | str, limit: int | None = None
) -> Column:
    """The scripts served from the page's own origin; with ``limit`` only the first so many."""
    own = F.filter(script_sources(html, base), lambda u: F.startswith(u, origin_of(base)))
    return own if limit is None else F.slice(own, 1, limit)


# What a script engine skips around JSON text.
_BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff")
_SHAPE = ("struct<kind:string,length:int,keys:array<string>,list_path:string,"
          "item_keys:array<string>>")


def _state_texts(html: Column | str) -> Column:
    """array<struct<rank, script, source, whole, text>>: where a page may hold JSON.

    Rank 0 is the named state script, 1 are scripts of JSON type, 2 is what follows the first
    ``=`` after a well-known name; a script may have several of those, in the order of the names.
    """
    def candidate(rank: int, at: Column, source: Column, text: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), at.alias("script"), source.alias("source"),
            F.lit(rank < 2).alias("whole"), text.alias("text"))

    def of_script(s: Column, at: Column) -> Column:
        named, typed = s["id"] == "__NEXT_DATA__", s["type"] == "application/json"
        label = F.when(s["id"] == "", "application/json").otherwise(F.concat(F.lit("#"), s["id"]))
        after = [
            F.when(F.contains(s["text"], F.lit(name)), candidate(
                2, at, F.lit(name),
                F.regexp_extract(s["text"], f"(?s){re.escape(name)}[^=]*=(.*)", 1)))
            for name in STATE_MARKERS
        ]
        return F.array(
            F.when(named, candidate(0, at, F.lit("__NEXT_DATA__"), s["text"])),
            F.when(~named & typed, candidate(1, at, label, s["text"])), *after)

    found = F.filter(F.flatten(F.transform(scripts_of(html), of_script)), lambda c: c.isNotNull())

    def ranked(rank: int) -> Column:
        return F.filter(found, lambda c: c["rank"] == rank)

    return F.concat(*map(ranked, range(3)))


def _refused(constant: str):
    raise ValueError(f"{constant} is not JSON")


_DECODER = json.JSONDecoder(parse_int=float, parse_constant=_refused)


def _names(record: dict) -> list[str]:
    """Keys as a script engine lists them: whole numbers first, then in order of appearance."""
    numbers = [k for k in record if re.fullmatch("0|[1-9][0-9]{0,9}", k) and int(k) < 2**32 - 1]
    return sorted(numbers, key=int) + [k for k in record if k not in set(numbers)]


def _storable(names: list[str]) -> list[str]:
    return [n.encode("utf-8", "replace").decode() for n in names]


def _shape(text: str, whole: bool, max_depth: int | None) -> dict | None:
    """Kind, size and keys of JSON text, and its first list of records in document order."""
    text = text.strip(_BLANKS)
    if not text or not (whole or text[0] in "[{"):
        return None
    try:
        value, stop = _DECODER.raw_decode(text)
    except (ValueError, RecursionError):
        return None
    if value is None or (whole and stop < len(text)):
        return None
    shape = {"kind": "scalar", "length": 0, "keys": [], "list_path": None, "item_keys": []}
    if isinstance(value, (list, dict)):
        shape.update(kind="list" if isinstance(value, list) else "object", length=len(value))
    if isinstance(value, dict):
        shape["keys"] = _storable(_names(value))
    # values still to visit, the next one last; a way is (way to the parent, key)
    ahead = [(value, None, 0)]
    while ahead:
        value, way, depth = ahead.pop()
        if isinstance(value, dict):
            if max_depth is None or depth < max_depth:
                ahead += [(value[k], (way, k), depth + 1) for k in reversed(_names(value))]
        elif isinstance(value, list):
            record = next((x for x in value if isinstance(x, dict)), None)
            if record is not None:
                steps = []
                while way is not None:
                    way, key = way
                    if key or steps:
                        steps.append(key)
                shape["list_path"] = _storable([".".join(reversed(steps))])[0]
                shape["item_keys"] = _storable(_names(record))
                break
    return shape


def embedded_json(
    pages: DataFrame, key: str = "page_id", max_roots: int | None = None,
    max_keys: int | None = None, max_depth: int | None = None,
) -> DataFrame:
    """(key, place, source, kind, length, keys, list_path, item_keys, posting_score).

    The scan picks and orders the texts that can be JSON; Python only describes each of them,
    since a variant forgets the order of keys. Everything is kept unless a limit is given: roots
    per page, keys per list, levels to the list. A null page has no roots. Text that is not strict
    JSON, or nests deeper than the decoder goes (some thousand levels), is no root.
    """
    @F.pandas_udf(f"array<{_SHAPE}>")
    def shapes(pages_of_texts: pd.Series) -> pd.Series:
        return pd.Series([
            [_shape(t["text"], t["whole"], max_depth) for t in texts] for texts in pages_of_texts])

    def limited(keys: Column) -> Column:
        return keys if max_keys is None else F.slice(keys, 1, max_keys)

    picked = pages.select(key, _state_texts("html").alias("_t")).where(F.size("_t") > 0)
    wanted = F.transform("_t", lambda t: F.struct(t["whole"].alias("whole"), t["text"].alias("text")))
    described = F.filter(
        F.zip_with(
            F.transform("_t", lambda t: t.dropFields("text", "whole")), shapes(wanted),
            lambda t, s: F.struct(t.alias("t"), s.alias("s"))),
        lambda r: r["s"].isNotNull())
    # of the names that one script assigns to, the first that holds JSON counts
    roots = F.filter("_r", lambda r, i: ~F.coalesce(
        (r["t"]["rank"] == 2) & (F.get("_r", i - 1)["t"]["rank"] == 2)
        & (F.get("_r", i - 1)["t"]["script"] == r["t"]["script"]), F.lit(False)))
    kept = picked.select(key, described.alias("_r")).select(key, roots.alias("_r"))
    if max_roots is not None:
        kept = kept.withColumn("_r", F.slice("_r", 1, max_roots))
    return posexplode_rows(kept, F.col("_r"), "place", "_r1", key).select(
        key, (F.col("place") + 1).alias("place"), "_r1.t.source", "_r1.s.kind", "_r1.s.length",
        limited(F.col("_r1.s.keys")).alias("keys"), "_r1.s.list_path",
        limited(F.col("_r1.s.item_keys")).alias("item_keys"),
    ).withColumn("posting_score", posting_like_score("item_keys"))


def posting_like_score(keys: Column | str) -> Column:
    """How many posting-like names are among the keys."""
    lowered = F.transform(col_of(keys), lambda k: F.lower(k))
    return F.size(F.array_intersect(F.array(*[F.lit(k) for k in POSTING_KEYS]), lowered))


def postings_array(body: Column | str) -> Column:
    """The postings of a board response: the body itself, else the first well-known array."""
    value = F.try_parse_json(col_of(body))
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        *[F.try_variant_get(value, f"$.{k}", "array<variant>") for k in ARRAY_KEYS],
    )


def page_targets(targets: DataFrame, hits: DataFrame) -> DataFrame:
    """(site, token): tokens seen on a site's pages and tokens guessed from its name and domain."""
    guessed = targets.select("site", F.explode(token_candidates("name", "domain")).alias("token"))
    return hits.select("site", "token").unionByName(guessed).distinct()

"""URL canonicalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postgrain.functions.hosts import ascii_host
from postgrain.functions.text import bind, col_of, replace_each, trim
from postgrain.rules.constants import SOURCE_HOME, TRACKING_PARAMS

_WEB_URL = r"^(?i)(https?):[/\\]*([^/?#\\]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_BAD_HOST = r"[\x00-\x20<>^|%\[\]{}\"`]|:[^0-9:]|^:"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _WEB_URL, group)


def is_web_url(value: Column | str) -> Column:
    """True for a parsable http(s) URL."""
    url = trim(value)
    host = F.regexp_replace(_part(url, 2), "^.*@", "")
    return F.coalesce(
        F.regexp_like(url, F.lit(_WEB_URL)) & ~F.regexp_like(host, F.lit(_BAD_HOST)), F.lit(False)
    )


def _encode_path(value: Column) -> Column:
    """Percent-encode what a browser would; leave existing escapes alone."""
    unsafe = r"[^\x21-\x7E]|[\"<>`{}^]"

    def encode(path: Column) -> Column:
        escaped = replace_each(
            path, unsafe, lambda ch: F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
        )
        return F.when(F.regexp_like(path, F.lit(unsafe)), escaped).otherwise(path)

    return bind(value, encode)


def _resolve_dots(value: Column) -> Column:
    """Remove `.` and `..` segments."""

    def step(acc: Column, seg: Column) -> Column:
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return (
            F.when(seg == ".", acc).when(seg == "..", popped)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    def resolve(path: Column) -> Column:
        walked = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
        closing = F.when(F.regexp_like(path, F.lit(r"/\.{1,2}$")), "/").otherwise("")
        resolved = F.concat(F.array_join(walked, "/"), closing)
        return F.when(F.regexp_like(path, F.lit(r"/\.{1,2}(/|$)")), resolved).otherwise(path)

    return bind(value, resolve)


def _decode_param(text: Column) -> Column:
    # a % that starts no escape stands for itself
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _clean_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    parsed = F.transform(
        pairs,
        lambda p: F.struct(
            _decode_param(F.substring_index(p, "=", 1)).alias("k"),
            _decode_param(
                F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
            ).alias("v"),
        ),
    )
    kept = F.filter(parsed, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
    # root collation: case and accents only decide between words that are equal without them
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(
        F.collate(p["k"], "UNICODE").alias("by_key"), F.collate(p["v"], "UNICODE").alias("by_value"),
        i.alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    return F.array_join(
        F.transform(ordered, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))),
        "&",
    )


def _authority(url: Column) -> Column:
    """Lower-case host and port without user info; international names in ASCII."""
    return ascii_host(F.lower(F.regexp_replace(_part(url, 2), "^.*@", "")))


def _without_default_port(parts: Column) -> Column:
    port = F.when(parts["scheme"] == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host = parts["host"]
    return F.when(
        F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))
    ).otherwise(F.regexp_replace(host, ":$", ""))


def canonicalize_url(value: Column | str) -> Column:
    """One spelling per page: host folded, tracking and fragment dropped, parameters sorted.

    Parameters sort by the root collation of Unicode (key, then value), as browsers compare text;
    equal ones keep their order. Anything that is no http(s) URL comes back trimmed.
    """

    def assemble(parts: Column) -> Column:
        host = F.regexp_replace(_without_default_port(parts), r"^www\.", "")
        path = bind(
            _encode_path(_resolve_dots(parts["path"])),
            lambda p: F.when(F.length(p) <= 1, F.lit("/")).otherwise(F.regexp_replace(p, "/+$", "")),
        )
        query = bind(
            F.when(parts["query"] != "", _clean_query(parts["query"])).otherwise(F.lit("")),
            lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(q),
        )
        return F.concat(parts["scheme"], F.lit("://"), host, path, query)

    def clean(url: Column) -> Column:
        parts = F.struct(
            F.lower(_part(url, 1)).alias("scheme"), _authority(url).alias("host"),
            F.replace(_part(url, 3), F.lit("\\"), F.lit("/")).alias("path"),
            _part(url, 4).alias("query"),
        )
        return F.when(is_web_url(url), bind(parts, assemble)).otherwise(url)

    return bind(trim(value), clean)


def safe_url(value: Column | str, source: Column | str) -> Column:
    """The trimmed link when it is http(s), else the home page of its feed."""
    homes = F.create_map(*[F.lit(x) for pair in SOURCE_HOME.items() for x in pair])
    return F.when(is_web_url(value), trim(value)).otherwise(F.element_at(homes, col_of(source)))


def host_of(value: Column | str) -> Column:
    """Host (with a non-default port) for display, or the word "link"."""

    def shown(url: Column) -> Column:
        parts = F.struct(F.lower(_part(url, 1)).alias("scheme"), _authority(url).alias("host"))
        return F.when(is_web_url(url), bind(parts, _without_default_port)).otherwise(F.lit("link"))

    return bind(trim(value), shown)


def resolve_link(link: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on a page."""
    ref, page = trim(link), trim(base)
    scheme, origin = _part(page, 1), F.concat(
        F.lower(_part(page, 1)), F.lit("://"), F.lower(_part(page, 2))
    )
    folder = F.regexp_replace(_part(page, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    rooted = F.when(F.startswith(ref, F.lit("/")), ref_path).otherwise(F.concat(folder, ref_path))
    host_path = F.regexp_replace(ref, r"^(?i)(https?://[^/?#]+)(?=$|[?#])", "$1/")
    return (
        F.when(F.regexp_like(ref, F.lit(r"^(?i)[a-z][a-z0-9+.-]*:")), host_path)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.lower(scheme), F.lit(":"), ref))
        .when(~is_web_url(page), F.lit(None))
        .otherwise(F.concat(origin, _encode_path(_resolve_dots(rooted)), ref_tail))
    )


def origin_of(value: Column | str) -> Column:
    url = trim(value)
    return F.when(
        is_web_url(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)))
    )

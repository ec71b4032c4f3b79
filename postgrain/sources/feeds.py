"""Landed feed payloads -> flat raw items.

Input is a table of landed responses: ``payload`` (the whole body as text) plus, where a feed has
boards, ``token`` and ``company``. Each reader explodes the body and returns one row per entry with
the :data:`postgrain.schemas.RAW_ITEM` columns and ``reject_reason``, which is null for good rows.
Bad entries and bad bodies become rejects and never fail the batch. Everything stays in one scan
stage: a body is parsed once into a VARIANT and fields are picked by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions import money_time as M
from postgrain.functions.fanout import posexplode_rows, settled
from postgrain.functions.patterns import SPACE
from postgrain.functions.text import bind, blank_to_null, decode_entities, html_to_text, squash, trim
from postgrain.schemas import RAW_ITEM

_COLUMNS = RAW_ITEM.fieldNames()


def _item() -> Column:
    return F.col("_item")


def _get(path: str, kind: str, of: Column | None = None) -> Column:
    return F.try_variant_get(_item() if of is None else of, f"$.{path}", kind)


def _is(path: str, kind: str, of: Column | None = None) -> Column:
    value = F.try_variant_get(_item() if of is None else of, f"$.{path}", "variant")
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def text(path: str, of: Column | None = None) -> Column:
    """Trimmed text of a string field; empty when missing or not a string."""
    return F.coalesce(F.when(_is(path, "STRING", of), trim(_get(path, "string", of))), F.lit(""))


def raw_text(path: str, of: Column | None = None) -> Column:
    """A string field as it is; null when missing or not a string."""
    return F.when(_is(path, "STRING", of), _get(path, "string", of))


def number(path: str, of: Column | None = None) -> Column:
    """A numeric field; null when missing or not a number."""
    kind = F.schema_of_variant(F.try_variant_get(_item() if of is None else of, f"$.{path}", "variant"))
    numeric = F.regexp_like(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    return F.when(numeric, _get(path, "double", of))


def number_id(path: str) -> Column:
    """A numeric id as text; empty when missing."""
    return F.coalesce(F.when(_is(path, "BIGINT"), _get(path, "string")), F.lit(""))


def flag(path: str) -> Column:
    return F.when(_is(path, "BOOLEAN"), _get(path, "boolean"))


def texts(path: str, field: str | None = None) -> Column:
    """Trimmed non-blank strings of an array field, or of one field of its objects."""
    values = F.coalesce(
        F.try_variant_get(_item(), f"$.{path}", "array<variant>"), F.array().cast("array<variant>")
    )
    inner = "$" if field is None else f"$.{field}"

    def one(v: Column) -> Column:
        return F.when(
            F.startswith(F.schema_of_variant(F.try_variant_get(v, inner, "variant")), F.lit("STRING")),
            trim(F.try_variant_get(v, inner, "string")),
        )

    return F.filter(F.transform(values, one), lambda t: t.isNotNull() & (t != ""))


def _null_if_blank(value: Column) -> Column:
    return F.when(value != "", value)


def _or(value: Column, other: Column) -> Column:
    return F.when(value != "", value).otherwise(other)


def explode_body(pages: DataFrame, path: str | None) -> DataFrame:
    """One row per entry of the array at ``path`` (None: the body itself is the array).

    A body without that array yields one row with a null entry, so that it can be reported.
    """
    body = F.try_parse_json(F.col("payload"))
    array = F.try_variant_get(body, "$" if path is None else f"$.{path}", "array<variant>")
    present = pages.withColumn("_array", array)
    marked = F.when(
        F.col("_array").isNull(), F.array(F.lit(None).cast("variant"))
    ).otherwise(F.col("_array"))
    return posexplode_rows(
        present.withColumn("_bad_body", F.col("_array").isNull()), marked, "_pos", "_item",
        *[c for c in pages.columns if c != "payload"], "_bad_body",
    )


def _finish(entries: DataFrame, source: str, fields: dict[str, Column], reason: Column,
            no_array: Column | None) -> DataFrame:
    body = F.lit(f"{source} returned no entries array") if no_array is None else no_array
    keep = [c for c in entries.columns if c not in ("_item", "_bad_body", "_pos", "company")]
    values = {
        "source": F.lit(source), "payload": F.to_json(_item()),
        "location": F.lit(None), "remote": F.lit(None), "salary_text": F.lit(None), **fields,
    }
    return entries.select(
        *[F.when(~F.col("_bad_body"), values[c]).cast(RAW_ITEM[c].dataType).alias(c)
          if c != "source" else values[c].alias(c) for c in _COLUMNS],
        *keep, F.col("_pos").alias("position"),
        F.when(F.col("_bad_body"), body).otherwise(reason).alias("reject_reason"),
    )


def good(feed: DataFrame) -> DataFrame:
    """The raw items of a flattened feed."""
    return feed.where("reject_reason IS NULL").select(*_COLUMNS)


def rejects(feed: DataFrame) -> DataFrame:
    """(source, source_native_id, reason) of everything that was set aside."""
    return feed.where("reject_reason IS NOT NULL").select(
        "source", _null_if_blank(F.col("source_native_id")).alias("source_native_id"),
        F.col("reject_reason").alias("reason"),
    )


def _missing(**parts: Column) -> Column:
    """`a and b` for the named fields that are empty."""
    return F.concat_ws(" and ", *[F.when(v == "", F.lit(k)) for k, v in parts.items()])


def _entry(value: Column, placeholder: str) -> Column:
    return F.when(value == "", F.lit(placeholder)).otherwise(value)


def _any_blank(*values: Column) -> Column:
    out = values[0] == ""
    for v in values[1:]:
        out = out | (v == "")
    return out


def _token_id(ident: Column) -> Column:
    return F.concat(F.col("token"), F.lit(":"), ident)


def read_remotive(pages: DataFrame) -> DataFrame:
    ident, title, company = number_id("id"), text("title"), text("company_name")
    return _finish(explode_body(pages, "jobs"), "remotive", {
        "source_native_id": ident,
        "url": F.coalesce(
            raw_text("url"), F.concat(F.lit("https://remotive.com/remote-jobs/"), ident)),
        "company": company, "title": title,
        "location": _null_if_blank(text("candidate_required_location")),
        "remote": F.lit(True),
        "description": html_to_text(F.coalesce(raw_text("description"), F.lit(""))),
        "salary_text": _null_if_blank(text("salary")),
        "posted_at": M.timestamp_or_null(raw_text("publication_date")),
    }, F.when(_any_blank(ident, title, company), F.concat(
        F.lit("remotive entry "), _entry(ident, "(no id)"), F.lit(" missing title or company"))), None)


def read_greenhouse(pages: DataFrame) -> DataFrame:
    ident, title = number_id("id"), text("title")
    return _finish(explode_body(pages, "jobs"), "greenhouse", {
        "source_native_id": _token_id(ident),
        "url": F.coalesce(raw_text("absolute_url"), F.concat(
            F.lit("https://job-boards.greenhouse.io/"), "token", F.lit("/jobs/"), ident)),
        "company": F.col("company"), "title": title,
        "location": _null_if_blank(text("location.name")),
        "description": html_to_text(
            decode_entities(F.coalesce(raw_text("content"), F.lit("")))),
        "posted_at": M.timestamp_or_null(raw_text("updated_at")),
    }, F.when(_any_blank(ident, title), F.concat(
        F.lit("greenhouse "), "token", F.lit(" entry "), _entry(ident, "(no id)"),
        F.lit(" has no title"))), None)


def _stated_arrangement(value: Column, remote: tuple, onsite: tuple, otherwise: Column) -> Column:
    word = F.lower(value)
    return F.when(word.isin(*remote), True).when(word.isin(*onsite), False).otherwise(otherwise)


def read_lever(pages: DataFrame) -> DataFrame:
    ident, title = text("id"), text("text")
    lists = F.coalesce(
        F.try_variant_get(_item(), "$.lists", "array<variant>"), F.array().cast("array<variant>"))

    def part(v: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))

    blocks = F.concat(
        F.array(F.coalesce(raw_text("description"), F.lit(""))),
        F.transform(lists, lambda v: F.concat(part(v, "text"), F.lit("\n"), part(v, "content"))),
        F.array(F.coalesce(raw_text("additional"), F.lit(""))),
    )
    return _finish(explode_body(pages, None), "lever", {
        "source_native_id": _token_id(ident),
        "url": F.coalesce(raw_text("hostedUrl"), F.concat(
            F.lit("https://jobs.lever.co/"), "token", F.lit("/"), ident)),
        "company": F.col("company"), "title": title,
        "location": _null_if_blank(text("categories.location")),
        "remote": _stated_arrangement(
            text("workplaceType"), ("remote",), ("hybrid", "on-site", "onsite"),
            F.lit(None).cast("boolean")),
        "description": html_to_text(
            F.array_join(F.filter(blocks, lambda b: trim(b) != ""), "\n\n")),
        "salary_text": M.spaced_salary(
            number("salaryRange.min"), number("salaryRange.max"),
            raw_text("salaryRange.currency"), raw_text("salaryRange.interval")),
        "posted_at": M.timestamp_from_millis(number("createdAt")),
    }, F.when(_any_blank(ident, title), F.concat(
        F.lit("lever "), "token", F.lit(' entry "'), _entry(title, "(untitled)"),
        F.lit('" has no id'))), None)


def _board_missing(source: str, ident: Column, title: Column, id_name: str) -> Column:
    return F.when(_any_blank(ident, title), F.concat(
        F.lit(f"{source} "), "token", F.lit(" entry "), _entry(ident, f"(no {id_name})"),
        F.lit(" is missing "), _missing(**{id_name: ident, "title": title})))


def _no_array(source: str, name: str) -> Column:
    return F.concat(F.lit(f"{source} board "), "token", F.lit(f" returned no {name} array"))


def read_ashby(pages: DataFrame) -> DataFrame:
    ident, title = text("id"), text("title")
    entries = explode_body(pages, "jobs")
    listed = F.col("_bad_body") | F.coalesce(flag("isListed"), F.lit(True))
    return _finish(entries.where(listed), "ashby", {
        "source_native_id": _token_id(ident),
        "url": _or(text("jobUrl"), F.concat(
            F.lit("https://jobs.ashbyhq.com/"), "token", F.lit("/"), ident)),
        "company": F.col("company"), "title": title,
        "location": _null_if_blank(text("location")),
        "remote": _stated_arrangement(
            text("workplaceType"), ("remote",), ("hybrid", "onsite"),
            F.when(flag("isRemote"), True)),
        "description": _or(
            text("descriptionPlain"), html_to_text(decode_entities(text("descriptionHtml")))),
        "salary_text": M.first_salary(
            text("compensation.compensationTierSummary"),
            text("compensation.scrapeableCompensationSalarySummary")),
        "posted_at": M.timestamp_or_null(raw_text("publishedAt")),
    }, _board_missing("ashby", ident, title, "id"), _no_array("ashby", "jobs"))


def read_workable(pages: DataFrame) -> DataFrame:
    ident, title = text("shortcode"), text("title")
    place = M.join_parts(", ", text("city"), text("state"), text("country"))
    return _finish(explode_body(pages, "jobs"), "workable", {
        "source_native_id": _token_id(ident),
        "url": _or(text("url"), _or(
            text("shortlink"), F.concat(F.lit("https://apply.workable.com/j/"), ident))),
        "company": F.col("company"), "title": title, "location": _null_if_blank(place),
        "remote": F.when(flag("telecommuting"), True),
        "description": html_to_text(decode_entities(text("description"))),
        "posted_at": M.timestamp_or_null(_or(text("published_on"), text("created_at"))),
    }, _board_missing("workable", ident, title, "shortcode"), _no_array("workable", "jobs"))


# Fixed value: a board token that is safe inside a host name.
HOST_TOKEN = r"^(?i)[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*$"


def read_teamtailor(pages: DataFrame) -> DataFrame:
    ident, title = text("id"), text("title")
    address = "_jobposting.jobLocation[0].address"
    place = M.join_parts(
        ", ", text(f"{address}.addressLocality"), text(f"{address}.addressRegion"),
        text(f"{address}.addressCountry"))
    valid = F.regexp_like("token", F.lit(HOST_TOKEN))
    checked = pages.withColumn("payload", F.when(valid, F.col("payload")))
    body = F.when(valid, _no_array("teamtailor", "items")).otherwise(F.concat(
        F.lit("teamtailor token "), "token", F.lit(" is not a valid hostname label")))
    return _finish(explode_body(checked, "items"), "teamtailor", {
        "source_native_id": _token_id(ident), "url": text("url"),
        "company": F.col("company"), "title": title, "location": _null_if_blank(place),
        "description": html_to_text(decode_entities(
            _or(text("_jobposting.description"), text("content_html")))),
        "posted_at": M.timestamp_or_null(
            _or(text("date_published"), text("_jobposting.datePosted"))),
    }, _board_missing("teamtailor", ident, title, "id"), body)


def read_themuse(pages: DataFrame) -> DataFrame:
    ident, title = number_id("id"), text("name")
    places = texts("locations", "name")
    return _finish(explode_body(pages, "results"), "themuse", {
        "source_native_id": ident,
        "url": _or(text("refs.landing_page"), F.concat(
            F.lit("https://www.themuse.com/jobs/"),
            F.coalesce(raw_text("company.short_name"), F.lit("")), F.lit("/"),
            F.coalesce(raw_text("short_name"), F.lit("")))),
        "company": text("company.name"), "title": title,
        "location": _null_if_blank(F.array_join(places, "; ")),
        "remote": F.when(F.exists(places, lambda p: F.contains(F.lower(p), F.lit("remote"))), True),
        "description": html_to_text(F.coalesce(raw_text("contents"), F.lit(""))),
        "posted_at": M.timestamp_or_null(raw_text("publication_date")),
    }, F.when(_any_blank(ident, title), F.concat(
        F.lit("themuse entry "), _entry(ident, "(no id)"), F.lit(" is missing "),
        _missing(id=ident, title=title))), F.lit("themuse page returned no results array"))


def read_arbeitnow(pages: DataFrame) -> DataFrame:
    ident, title, company = text("slug"), text("title"), text("company_name")
    return _finish(explode_body(pages, "data"), "arbeitnow", {
        "source_native_id": ident,
        "url": _or(text("url"), F.concat(
            F.lit("https://www.arbeitnow.com/jobs/companies/"), ident)),
        "company": company, "title": title, "location": _null_if_blank(text("location")),
        "remote": F.when(flag("remote"), True),
        "description": html_to_text(decode_entities(text("description"))),
        "posted_at": M.timestamp_from_seconds(number("created_at")),
    }, F.when(_any_blank(ident, title, company), F.concat(
        F.lit("arbeitnow entry "), _entry(ident, "(no slug)"), F.lit(" is missing "),
        _missing(slug=ident, title=title, company_name=company))),
        F.lit("arbeitnow returned no data array"))


def read_himalayas(pages: DataFrame) -> DataFrame:
    ident, title = text("guid"), text("title")
    return _finish(explode_body(pages, "jobs"), "himalayas", {
        "source_native_id": ident, "url": _or(text("applicationLink"), ident),
        "company": text("companyName"), "title": title,
        "location": _null_if_blank(F.array_join(texts("locationRestrictions"), "; ")),
        "remote": F.lit(True),
        "description": html_to_text(F.coalesce(raw_text("description"), F.lit(""))),
        "salary_text": M.plain_salary(
            number("minSalary"), number("maxSalary"), text("currency"), text("salaryPeriod")),
        "posted_at": M.timestamp_from_seconds(number("pubDate")),
    }, F.when(_any_blank(ident, title), F.concat(
        F.lit("himalayas entry "), _entry(ident, "(no guid)"), F.lit(" is missing "),
        _missing(guid=ident, title=title))), F.lit("himalayas page returned no jobs array"))


def read_jobicy(pages: DataFrame) -> DataFrame:
    ident, title, company = number_id("id"), text("jobTitle"), text("companyName")
    return _finish(explode_body(pages, "jobs"), "jobicy", {
        "source_native_id": ident,
        "url": _or(text("url"), F.concat(F.lit("https://jobicy.com/jobs/"), ident)),
        "company": company, "title": title, "location": _null_if_blank(text("jobGeo")),
        "remote": F.lit(True),
        "description": html_to_text(decode_entities(
            _or(text("jobDescription"), text("jobExcerpt")))),
        "salary_text": M.slashed_salary(
            number("salaryMin"), number("salaryMax"), text("salaryCurrency"),
            text("salaryPeriod")),
        "posted_at": M.timestamp_or_null(raw_text("pubDate")),
    }, F.when(_any_blank(ident, title, company), F.concat(
        F.lit("jobicy entry "), _entry(ident, "(no id)"), F.lit(" is missing "),
        _missing(id=ident, title=title, company=company))), F.lit("jobicy returned no jobs array"))


def read_usajobs(pages: DataFrame) -> DataFrame:
    ident, d = text("MatchedObjectId"), "MatchedObjectDescriptor"
    title = text(f"{d}.PositionTitle")
    company = _or(text(f"{d}.OrganizationName"), text(f"{d}.DepartmentName"))
    details, pay = f"{d}.UserArea.Details", f"{d}.PositionRemuneration[0]"
    duties = F.array_join(texts(f"{details}.MajorDuties"), "\n")
    blocks = M.join_parts(
        "\n\n", text(f"{details}.JobSummary"), duties, text(f"{details}.QualificationSummary"))
    span = M.usd_range(
        text(f"{pay}.MinimumRange").try_cast("double"), text(f"{pay}.MaximumRange").try_cast("double"))
    interval = _or(text(f"{pay}.Description"), text(f"{pay}.RateIntervalCode"))
    return _finish(explode_body(pages, "SearchResult.SearchResultItems"), "usajobs", {
        "source_native_id": ident,
        "url": _or(text(f"{d}.PositionURI"), F.concat(
            F.lit("https://www.usajobs.gov/job/"), ident)),
        "company": company, "title": title,
        "location": _null_if_blank(text(f"{d}.PositionLocationDisplay")),
        "remote": F.when(flag(f"{d}.PositionRemoteIndicator"), True),
        "description": html_to_text(decode_entities(blocks)),
        "salary_text": F.when(interval != "", F.concat(span, F.lit(" "), interval)).otherwise(span),
        "posted_at": M.timestamp_or_null(M.drop_fraction(raw_text(f"{d}.PublicationStartDate"))),
    }, F.when(_any_blank(ident, title, company), F.concat(
        F.lit("usajobs entry "), _entry(ident, "(no control number)"),
        F.lit(" is missing title or organization"))), F.lit("usajobs search returned no result items"))


def read_adzuna(pages: DataFrame) -> DataFrame:
    ident, title, company = text("id"), text("title"), text("company.display_name")
    span = M.usd_range(number("salary_min"), number("salary_max"))
    place = _or(text("location.display_name"), F.array_join(texts("location.area"), ", "))
    return _finish(explode_body(pages, "results"), "adzuna", {
        "source_native_id": ident,
        "url": _or(text("redirect_url"), F.concat(
            F.lit("https://www.adzuna.com/details/"), ident)),
        "company": company, "title": title, "location": _null_if_blank(place),
        "description": html_to_text(decode_entities(text("description"))),
        "salary_text": F.when(
            text("salary_is_predicted") == "1", F.concat(span, F.lit(" (Adzuna estimate)"))
        ).otherwise(span),
        "posted_at": M.timestamp_or_null(raw_text("created")),
    }, F.when(_any_blank(ident, title, company), F.concat(
        F.lit("adzuna entry "), _entry(ident, "(no id)"), F.lit(" is missing title or company"))),
        F.lit("adzuna search returned no results array"))


def read_weworkremotely(pages: DataFrame) -> DataFrame:
    """RSS bodies; ``category`` names the feed. The first element of a name wins in an item."""
    chunks = F.filter(
        F.slice(F.split("payload", "<item>", -1), F.lit(2), F.lit(1 << 30)),
        lambda c: F.contains(c, F.lit("</item>")),
    )
    items = pages.withColumn("_chunk", F.explode_outer(F.transform(
        chunks, lambda c, i: F.struct(i.alias("pos"), F.substring_index(c, "</item>", 1).alias("xml"))
    ))).where("_chunk IS NOT NULL")
    element = F.lit(r"(?s)<([a-zA-Z][\w-]*)>.*?</\1>")
    kept = [c for c in pages.columns if c not in ("payload", "company")]
    parsed = settled(items, *kept, "_chunk", F.regexp_extract_all("_chunk.xml", element, F.lit(0)).alias("_elements"))

    def field(name: str) -> Column:
        tag = f"<{name}>"
        found = F.get(F.filter("_elements", lambda e: F.startswith(e, F.lit(tag))), 0)
        value = F.substring(found, F.lit(len(tag) + 1), F.length(found) - 2 * len(tag) - 1)
        plain = bind(value, lambda v: F.when(F.contains(v, F.lit("<![CDATA[")), F.regexp_replace(
            v, rf"(?s)^{SPACE}*<!\[CDATA\[(.*?)\]\]>{SPACE}*$", "$1")).otherwise(v))
        return F.coalesce(trim(plain), F.lit(""))

    # one step each: every column below is used several times by the next one, and rows are filtered by some
    fields = settled(
        parsed, *kept, "_chunk", decode_entities(field("title")).alias("_heading"),
        trim(decode_entities(field("link"))).alias("_link"),
        trim(decode_entities(field("guid"))).alias("_guid"),
        trim(decode_entities(field("region"))).alias("_region"),
        field("description").alias("_body"), field("pubDate").alias("_date"),
    )
    headed = F.instr("_heading", ":") > 0
    named = settled(
        fields, *kept, "_chunk", "_link", "_region", "_body", "_date",
        _or(F.col("_guid"), F.col("_link")).alias("_guid"),
        F.when(headed, trim(F.substring_index("_heading", ":", 1))).otherwise("").alias("_company"),
        trim(F.regexp_replace("_heading", "^[^:]*:", "")).alias("_title"),
    )
    guid, link = F.col("_guid"), F.col("_link")
    reason = F.when(guid == "", F.concat(
        F.lit("weworkremotely "), "category", F.lit(" entry has no guid or link"))).when(
        _any_blank(F.col("_company"), F.col("_title")), F.concat(
            F.lit("weworkremotely entry "), guid, F.lit(' has no "Company: Title" heading')))
    return named.select(
        F.lit("weworkremotely").alias("source"), guid.alias("source_native_id"),
        F.col("_chunk.xml").alias("payload"), _or(link, guid).alias("url"),
        F.col("_company").alias("company"), F.col("_title").alias("title"),
        _null_if_blank(F.col("_region")).alias("location"), F.lit(True).alias("remote"),
        html_to_text(decode_entities("_body")).alias("description"),
        F.lit(None).cast("string").alias("salary_text"),
        M.timestamp_or_null("_date").alias("posted_at"),
        *kept, F.col("_chunk.pos").alias("position"), reason.alias("reject_reason"),
    )


def read_linkedin_cards(pages: DataFrame) -> DataFrame:
    """Search result pages -> one row per usable card; cards lacking a field are dropped."""
    cards = posexplode_rows(
        pages, F.slice(F.split("payload", "<li>", -1), F.lit(2), F.lit(1 << 30)), "position",
        "_card", *[c for c in pages.columns if c != "payload"],
    )

    def between(pattern: str) -> Column:
        raw = F.regexp_extract("_card", rf"(?s){pattern}[^>]*>([^<]*)<", 1)
        return _null_if_blank(squash(decode_entities(raw)))

    href = F.regexp_extract("_card", r'href="(https://[a-z.]*linkedin\.com/jobs/view/[^"]+)"', 1)
    path = F.substring_index(decode_entities(href), "?", 1)
    ident = F.regexp_extract(path, r"(\d{6,})$", 1)
    return settled(
        cards, *[c for c in cards.columns if c != "_card"],
        ident.alias("source_native_id"),
        F.concat(F.lit("https://www.linkedin.com/jobs/view/"), ident).alias("url"),
        between("base-search-card__title").alias("title"),
        between("base-search-card__subtitle.*?<a").alias("company"),
        between("job-search-card__location").alias("location"),
        M.timestamp_or_null(
            _null_if_blank(F.regexp_extract("_card", 'datetime="([^"]+)"', 1))).alias("posted_at"),
    ).where("source_native_id <> '' AND title IS NOT NULL AND company IS NOT NULL")


# What ends the description block of a detail page.
_DETAIL_ENDS = ("show-more-less-html__button", "description__job-criteria", "</section>")


def linkedin_description(html: Column | str) -> Column:
    """Description of a detail page, cut at the earliest end marker; empty when there is none.

    A marker inside a tag cuts at that tag's opening bracket.
    """
    page = F.col(html) if isinstance(html, str) else html
    body = F.regexp_extract(page, r"(?s)show-more-less-html__markup[^>]*>(.*)$", 1)
    kept = body
    for marker in _DETAIL_ENDS:
        kept = bind(kept, _cut_at(marker))
    return html_to_text(kept)


def _cut_at(marker: str):
    def cut(text: Column) -> Column:
        at = F.instr(text, marker)
        head = F.substring(text, F.lit(1), at - 1)
        if not marker.startswith("<"):
            # up to the last opening bracket, if there is one
            head = F.when(F.contains(head, F.lit("<")), F.regexp_replace(head, r"(?s)<[^<]*$", "")).otherwise(head)
        return F.when(at > 0, head).otherwise(text)

    return cut


def read_linkedin(cards: DataFrame, details: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """De-duplicated cards joined to their descriptions.

    ``details`` holds (source_native_id, payload) detail pages; ``stored`` holds descriptions kept
    from earlier runs, which win over the page.
    """
    pages = details.select("source_native_id", linkedin_description("payload").alias("_page"))
    joined = cards.join(pages, "source_native_id", "left")
    if stored is not None:
        joined = joined.join(
            stored.select("source_native_id", F.col("description").alias("_kept")),
            "source_native_id", "left")
    else:
        joined = joined.withColumn("_kept", F.lit(None).cast("string"))
    text_found = F.coalesce("_kept", "_page")
    reason = F.when(text_found.isNull(), F.concat(
        F.lit("linkedin job "), "source_native_id", F.lit(" detail failed"))).when(
        text_found == "", F.concat(
            F.lit("linkedin job "), "source_native_id", F.lit(" returned no description block")))
    return joined.select(
        F.lit("linkedin").alias("source"), "source_native_id",
        F.to_json(F.struct("source_native_id", "url", "title", "company", "location",
                           text_found.alias("description"))).alias("payload"),
        "url", "company", "title", "location", F.lit(True).alias("remote"),
        text_found.alias("description"), F.lit(None).cast("string").alias("salary_text"),
        "posted_at", reason.alias("reject_reason"),
    )


def choose_thread(searches: DataFrame) -> DataFrame:
    """First hit of each landed search that is the hiring thread: (thread_id)."""
    hits = F.try_variant_get(F.try_parse_json("payload"), "$.hits", "array<variant>")

    def wanted(v: Column) -> Column:
        name = F.lower(F.coalesce(F.try_variant_get(v, "$.title", "string"), F.lit("")))
        return (F.contains(name, F.lit("who is hiring")) & ~F.contains(name, F.lit("freelancer"))
                & ~F.contains(name, F.lit("wants to be hired")))

    first = F.get(F.filter(hits, wanted), 0)
    return searches.select(
        F.try_variant_get(first, "$.objectID", "string").alias("thread_id")
    ).where("thread_id IS NOT NULL")


def read_thread_comments(threads: DataFrame, limit: int | None = None) -> DataFrame:
    """Top-level comments with text of each landed thread: all, or the first ``limit``.

    Rows: thread_id, comment_id, position, text, created_at.
    """
    body = F.try_parse_json("payload")
    children = F.try_variant_get(body, "$.children", "array<variant>")
    spoken = F.filter(
        children,
        lambda v: F.coalesce(trim(F.try_variant_get(v, "$.text", "string")), F.lit("")) != "",
    )
    return posexplode_rows(
        threads, spoken if limit is None else F.slice(spoken, 1, limit), "position", "_item", "thread_id"
    ).select(
        "thread_id", _get("id", "string").alias("comment_id"), "position",
        html_to_text(_get("text", "string")).alias("text"),
        M.timestamp_or_null(_get("created_at", "string")).alias("created_at"),
    )


def read_hn(comments: DataFrame, extractions: DataFrame) -> DataFrame:
    """Comments joined to the postings extracted from them, as raw items.

    ``extractions``: (comment_id, postings). Postings without company or title are skipped; their
    index in the comment still counts.
    """
    rows = comments.join(extractions.select("comment_id", "postings"), "comment_id").select(
        "thread_id", "comment_id", "text", "created_at", F.posexplode("postings").alias("index", "p"))
    company, title = trim("p.company"), trim("p.title")
    return rows.where((company != "") & (title != "")).select(
        F.lit("hn").alias("source"),
        F.concat_ws(":", "thread_id", "comment_id", F.col("index").cast("string"))
        .alias("source_native_id"),
        F.to_json(F.struct("thread_id", "comment_id", F.col("p").alias("posting"))).alias("payload"),
        F.coalesce("p.url", F.concat(
            F.lit("https://news.ycombinator.com/item?id="), "comment_id")).alias("url"),
        company.alias("company"), title.alias("title"), F.col("p.location").alias("location"),
        F.when(F.col("p.remote"), True).alias("remote"),
        F.concat("p.summary", F.lit("\n\n"), "text").alias("description"),
        F.col("p.salaryText").alias("salary_text"), F.col("created_at").alias("posted_at"),
        F.lit(None).cast("string").alias("reject_reason"),
    )


READERS = {
    "remotive": read_remotive, "greenhouse": read_greenhouse, "lever": read_lever,
    "ashby": read_ashby, "workable": read_workable, "teamtailor": read_teamtailor,
    "weworkremotely": read_weworkremotely, "themuse": read_themuse, "arbeitnow": read_arbeitnow,
    "himalayas": read_himalayas, "jobicy": read_jobicy, "usajobs": read_usajobs,
    "adzuna": read_adzuna,
}

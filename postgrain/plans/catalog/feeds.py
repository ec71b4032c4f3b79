"""Feed readers over payloads that Spark builds from the documents table.

Every role becomes an entry of every feed's payload shape, twenty documents to a response body;
some entries lose their id or title on purpose. The checking SQL states the expected raw item
directly over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.functions.money_time import iso_text
from postgrain.operators.lifecycle import first_seen_dedupe
from postgrain.plans import bindings as B
from postgrain.plans import sqltext as S
from postgrain.plans.registry import query
from postgrain.schemas import THREAD_POSTING
from postgrain.session import read_table
from postgrain.sources import feeds as R
from postgrain.sources.tables import SEEDS
from postgrain.streaming.ingest import flatten_landed

_SHOWN = ("source_native_id", "url", "company", "title", "location", "remote", "salary_text")


def _escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _entries(spark, sf) -> DataFrame:
    d, i = F.col("doc_id"), F.col("id")
    html = F.concat(F.lit("<p>"), _escape(F.col("description")), F.lit("</p><br/>tail &ndash; end"))
    page = F.floor(d / 20)
    return B.raw_postings(spark, sf).withColumns({
        "page": page, "token": F.concat(F.lit("tok"), (page % 7).cast("string")),
        "name": F.when(i % 23 == 0, " ").otherwise(F.col("title")),
        "num": F.when(i % 29 != 0, i), "key": F.when(i % 29 != 0, F.concat(F.lit("k"), i.cast("string"))),
        "html": html, "encoded": _escape(html), "low": (d % 500) * 100 + 1000,
        "when": F.timestamp_seconds(F.lit(1704067200) + (d % 300) * 3600),
        "iso": F.date_format(F.timestamp_seconds(F.lit(1704067200) + (d % 300) * 3600), "yyyy-MM-dd'T'HH:mm:ss"),
        "epoch": F.lit(1704067200) + (d % 300) * 3600,
    })


def _pages(spark, sf, root: str | None, **fields: Column) -> DataFrame:
    """Response bodies of twenty documents each (sixty entries at most)."""
    bodies = _entries(spark, sf).select(
        "page", "token", "id", F.struct(*[c.alias(k) for k, c in fields.items()]).alias("e")
    ).groupBy("page", "token").agg(F.array_sort(F.collect_list(F.struct("id", F.to_json("e").alias("j")))).alias("x"))
    array = F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: v["j"]), ","), F.lit("]"))
    body = array
    for part in reversed(root.split(".") if root else []):
        body = F.concat(F.lit('{"' + part + '":'), body, F.lit("}"))
    return bodies.select(
        F.col("page").cast("int").alias("page"), "token", F.concat(F.lit("Board "), "token").alias("company"),
        body.alias("payload"))


def _shown(items: DataFrame) -> DataFrame:
    return items.select(
        *_SHOWN, F.sha2("description", 256).alias("description_hash"), iso_text("posted_at").alias("posted_at"))


def _esc(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_FEED = f"""feed AS (
  SELECT *, 'tok' || ((doc_id // 20) % 7) AS token, (doc_id % 500) * 100 + 1000 AS low, nullif(trim(location), '') AS place,
    '<p>' || {_esc('description')} || '</p><br/>tail &ndash; end' AS html, 'k' || id AS key,
    id % 29 <> 0 AS has_id, id % 23 <> 0 AS has_title,
    strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 300 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') AS at_iso
  FROM raw
)"""
_BASE = S.with_(S.RAW, _FEED)
_TEXT = S.html_text("html")
_BOARD = "'Board ' || token"


def _sql(ident: str, url: str, company: str = "company", location: str = "place", remote: str = "NULL",
         salary: str = "NULL", text: str = _TEXT, where: str = "has_id AND has_title",
         posted: str = "at_iso") -> str:
    return _BASE + f"""SELECT {ident} AS source_native_id, {url} AS url, {company} AS company, title,
  {location} AS location, {remote} AS remote, {salary} AS salary_text, sha256({text}) AS description_hash,
  {posted} AS posted_at FROM feed WHERE {where}"""


c = F.col


def _remotive(spark, sf):
    return R.read_remotive(_pages(
        spark, sf, "jobs", id=c("num"), title=c("name"), company_name=c("company"), url=F.when(c("doc_id") % 2 == 0, c("url")),
        candidate_required_location=c("location"), salary=F.when(c("doc_id") % 3 == 0, F.lit("  ")).otherwise("1k"),
        description=c("html"), publication_date=c("iso")))


@query("read_remotive", _sql(
    "CAST(id AS VARCHAR)", "CASE WHEN doc_id % 2 = 0 THEN url ELSE 'https://remotive.com/remote-jobs/' || id END",
    remote="true", salary="CASE WHEN doc_id % 3 <> 0 THEN '1k' END"))
def read_remotive(spark, sf):
    return _shown(R.good(_remotive(spark, sf)))


@query("read_greenhouse", _sql(
    "token || ':' || id", "'https://job-boards.greenhouse.io/' || token || '/jobs/' || id", _BOARD))
def read_greenhouse(spark, sf):
    return _shown(R.good(R.read_greenhouse(_pages(
        spark, sf, "jobs", id=c("num"), title=c("name"), updated_at=F.concat("iso", F.lit("Z")),
        location=F.struct(c("location").alias("name")), content=c("encoded")))))


_LEVER_HTML = "html || chr(10) || chr(10) || 'Perks' || chr(10) || '<ul><li>a</li></ul>'"


@query("read_lever", _sql(
    "token || ':' || key", "'https://jobs.lever.co/' || token || '/' || key", _BOARD,
    remote="CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END",
    salary="CASE WHEN doc_id % 3 <> 0 THEN 'USD ' || format('{:,}', low) || ' - ' || format('{:,}', low + 5) || ' per-year' END",
    text=S.html_text(_LEVER_HTML)))
def read_lever(spark, sf):
    return _shown(R.good(R.read_lever(_pages(
        spark, sf, None, id=c("key"), text=c("name"), categories=F.struct("location"), workplaceType=B.pick(("Remote", "hybrid", "On-Site", "other"), c("doc_id") % 4),
        description=c("html"), additional=F.lit("  "),
        lists=F.array(F.struct(F.lit("Perks").alias("text"), F.lit("<ul><li>a</li></ul>").alias("content"))),
        salaryRange=F.struct(c("low").alias("min"), F.when(c("doc_id") % 3 != 0, c("low") + 5).alias("max"),
                             F.lit("USD").alias("currency"), F.lit("per-year").alias("interval")),
        createdAt=c("epoch") * 1000))))


@query("read_ashby", _sql(
    "token || ':' || key", "url", _BOARD,
    remote="CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN doc_id % 3 = 0 THEN true END END",
    salary="CASE WHEN doc_id % 2 = 0 THEN '$' || low ELSE 'scraped' END",
    text=f"CASE WHEN doc_id % 2 = 0 THEN {S.trim('description')} ELSE {_TEXT} END",
    where="has_id AND has_title AND doc_id % 6 <> 5"))
def read_ashby(spark, sf):
    d = c("doc_id")
    return _shown(R.good(R.read_ashby(_pages(
        spark, sf, "jobs", id=c("key"), title=c("name"), jobUrl=c("url"), location=c("location"), isListed=d % 6 != 5,
        isRemote=d % 3 == 0, workplaceType=B.pick(("Remote", "Hybrid", "", "odd"), d % 4), publishedAt=c("iso"),
        descriptionPlain=F.when(d % 2 == 0, c("description")).otherwise(" "), descriptionHtml=c("encoded"),
        compensation=F.struct(
            F.when(d % 2 == 0, F.concat(F.lit("$"), c("low").cast("string"))).otherwise("  ").alias("compensationTierSummary"),
            F.lit("scraped").alias("scrapeableCompensationSalarySummary"))))))


@query("read_workable", _sql(
    "token || ':' || key", "CASE WHEN doc_id % 2 = 0 THEN url ELSE 'https://apply.workable.com/j/' || key END", _BOARD,
    location="coalesce(place || ', ', '') || 'France'", remote="CASE WHEN doc_id % 4 = 0 THEN true END",
    posted="CASE WHEN doc_id % 5 = 0 THEN at_iso ELSE '2024-02-03T00:00:00.000Z' END"))
def read_workable(spark, sf):
    d = c("doc_id")
    return _shown(R.good(R.read_workable(_pages(
        spark, sf, "jobs", shortcode=c("key"), title=c("name"), url=F.lit(" "),
        shortlink=F.when(d % 2 == 0, c("url")).otherwise(""), telecommuting=d % 4 == 0, city=c("location"),
        state=F.lit(""), country=F.lit("France"), description=c("encoded"),
        published_on=F.when(d % 5 == 0, "").otherwise("2024-02-03"), created_at=c("iso")))))


@query("read_teamtailor", _sql(
    "token || ':' || key", "url", _BOARD, location="CASE WHEN doc_id % 2 = 0 THEN coalesce(place || ', ', '') || 'SE' END"))
def read_teamtailor(spark, sf):
    posting = F.struct(
        c("encoded").alias("description"), c("iso").alias("datePosted"), F.array(F.struct(F.struct(
            c("location").alias("addressLocality"), F.lit("SE").alias("addressCountry")).alias("address"))).alias("jobLocation"))
    return _shown(R.good(R.read_teamtailor(_pages(
        spark, sf, "items", id=c("key"), title=c("name"), url=c("url"), content_html=c("encoded"), date_published=c("iso"),
        _jobposting=F.when(c("doc_id") % 2 == 0, posting)))))


@query("read_themuse", _sql(
    "CAST(id AS VARCHAR)", "CASE WHEN doc_id % 2 = 0 THEN url ELSE 'https://www.themuse.com/jobs/co/' || key END",
    company="CASE WHEN doc_id % 5 = 0 THEN '' ELSE company END",
    location="coalesce(place || '; ', '') || CASE WHEN doc_id % 3 = 0 THEN 'Flexible / Remote' ELSE 'Oslo' END",
    remote="CASE WHEN doc_id % 3 = 0 OR contains(lower(location), 'remote') THEN true END"))
def read_themuse(spark, sf):
    d = c("doc_id")
    return _shown(R.good(R.read_themuse(_pages(
        spark, sf, "results", id=c("num"), name=c("name"), contents=c("html"), publication_date=c("iso"),
        short_name=F.concat(F.lit("k"), c("id").cast("string")),
        locations=F.array(F.struct(c("location").alias("name")), F.struct(
            F.when(d % 3 == 0, "Flexible / Remote").otherwise("Oslo").alias("name"))),
        refs=F.struct(F.when(d % 2 == 0, c("url")).otherwise(" ").alias("landing_page")),
        company=F.struct(F.when(d % 5 == 0, " ").otherwise(c("company")).alias("name"), F.lit("co").alias("short_name"))))))


def _arbeitnow(spark, sf):
    d = c("doc_id")
    return R.read_arbeitnow(_pages(
        spark, sf, "data", slug=c("key"), company_name=F.when(c("id") % 31 != 0, c("company")), title=c("name"),
        description=c("encoded"), remote=d % 2 == 0, url=F.when(d % 3 == 0, c("url")).otherwise(""),
        location=c("location"), created_at=c("epoch")))


@query("read_arbeitnow", _sql(
    "key", "CASE WHEN doc_id % 3 = 0 THEN url ELSE 'https://www.arbeitnow.com/jobs/companies/' || key END",
    remote="CASE WHEN doc_id % 2 = 0 THEN true END", where="has_id AND has_title AND id % 31 <> 0"))
def read_arbeitnow(spark, sf):
    return _shown(R.good(_arbeitnow(spark, sf)))


@query("read_himalayas", _sql(
    "key", "CASE WHEN doc_id % 2 = 0 THEN url ELSE key END", location="coalesce(place || '; ', '') || 'Chad'",
    remote="true", salary="""CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EUR ' || low || '+ yearly'
      WHEN 2 THEN 'EUR up to ' || (low + 5) || ' yearly' ELSE 'EUR ' || low || '-' || (low + 5) || ' yearly' END"""))
def read_himalayas(spark, sf):
    d = c("doc_id")
    return _shown(R.good(R.read_himalayas(_pages(
        spark, sf, "jobs", guid=c("key"), title=c("name"), companyName=c("company"),
        minSalary=F.when(d % 4 % 2 == 1, c("low")), maxSalary=F.when(d % 4 >= 2, c("low") + 5), salaryPeriod=F.lit("yearly"),
        currency=F.lit(" EUR "), locationRestrictions=F.array(c("location"), F.lit("  "), F.lit("Chad")),
        description=c("html"), pubDate=c("epoch"), applicationLink=F.when(d % 2 == 0, c("url"))))))


@query("read_jobicy", _sql(
    "CAST(id AS VARCHAR)", "CASE WHEN doc_id % 2 = 0 THEN url ELSE 'https://jobicy.com/jobs/' || id END", remote="true",
    salary="""CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN format('{:,}', low) || '+ USD/yearly'
      ELSE format('{:,}', low) || '–' || format('{:,}', low + 5) || ' USD/yearly' END"""))
def read_jobicy(spark, sf):
    d = c("doc_id")
    return _shown(R.good(R.read_jobicy(_pages(
        spark, sf, "jobs", id=c("num"), jobTitle=c("name"), companyName=c("company"), jobGeo=c("location"),
        url=F.when(d % 2 == 0, c("url")), jobDescription=F.when(d % 4 != 0, c("encoded")), jobExcerpt=c("encoded"),
        pubDate=c("iso"), salaryMin=F.when(d % 3 > 0, c("low")), salaryMax=F.when(d % 3 == 2, c("low") + 5),
        salaryCurrency=F.lit("USD"), salaryPeriod=F.lit("yearly")))))


_USA_TEXT = S.html_text("'Summary' || chr(10) || chr(10) || 'one' || chr(10) || 'two' || chr(10) || chr(10) || html")


def _usajobs(spark, sf):
    d = c("doc_id")
    details = F.struct(F.lit("Summary").alias("JobSummary"), F.array(F.lit(" one "), F.lit(" "), F.lit("two")).alias("MajorDuties"),
                       c("encoded").alias("QualificationSummary"))
    pay = F.struct(F.concat(c("low").cast("string"), F.lit(".0")).alias("MinimumRange"),
                   F.when(d % 2 == 0, F.concat((c("low") + 5).cast("string"), F.lit(".0"))).otherwise("0").alias("MaximumRange"),
                   F.lit("PA").alias("RateIntervalCode"), F.when(d % 3 == 0, "Per Year").alias("Description"))
    return R.read_usajobs(_pages(
        spark, sf, "SearchResult.SearchResultItems", MatchedObjectId=c("key"), MatchedObjectDescriptor=F.struct(
            c("name").alias("PositionTitle"), c("url").alias("PositionURI"), F.when(d % 2 == 0, c("company")).alias("OrganizationName"),
            F.lit("Department").alias("DepartmentName"), c("location").alias("PositionLocationDisplay"),
            (d % 4 == 0).alias("PositionRemoteIndicator"), F.concat("iso", F.lit(".9600")).alias("PublicationStartDate"),
            F.array(pay).alias("PositionRemuneration"), F.struct(details.alias("Details")).alias("UserArea"))))


@query("read_usajobs", _sql(
    "key", "url", company="CASE WHEN doc_id % 2 = 0 THEN company ELSE 'Department' END",
    remote="CASE WHEN doc_id % 4 = 0 THEN true END", text=_USA_TEXT,
    salary="""'$' || format('{:,}', low) || CASE WHEN doc_id % 2 = 0 THEN '–$' || format('{:,}', low + 5) ELSE '+' END
      || CASE WHEN doc_id % 3 = 0 THEN ' Per Year' ELSE ' PA' END"""))
def read_usajobs(spark, sf):
    return _shown(R.good(_usajobs(spark, sf)))


@query("read_adzuna", _sql(
    "key", "url", location="CASE WHEN doc_id % 2 = 0 THEN coalesce(place, 'UK, Leeds') ELSE 'UK, Leeds' END",
    salary="""CASE doc_id % 3 WHEN 0 THEN '$' || format('{:,}', low) || ' (Adzuna estimate)'
      WHEN 1 THEN '$' || format('{:,}', low) || '–$' || format('{:,}', low + 5) ELSE 'up to $' || format('{:,}', low + 5) END"""))
def read_adzuna(spark, sf):
    d = c("doc_id")
    return _shown(R.good(R.read_adzuna(_pages(
        spark, sf, "results", id=c("key"), title=c("name"), company=F.struct(c("company").alias("display_name")),
        location=F.struct(F.when(d % 2 == 0, c("location")).otherwise(" ").alias("display_name"),
                          F.array(F.lit("UK"), F.lit(" "), F.lit("Leeds")).alias("area")),
        description=c("encoded"), redirect_url=c("url"), created=F.concat("iso", F.lit("Z")),
        salary_min=F.when(d % 3 != 2, c("low") + 0.25), salary_max=F.when(d % 3 == 0, c("low")).otherwise(c("low") + 5),
        salary_is_predicted=F.when(d % 3 == 0, "1").otherwise("0")))))


def _rss(spark, sf) -> DataFrame:
    """Two category feeds that share their even roles."""
    entry = F.concat(
        F.lit("<item><title><![CDATA[ "), F.when(c("id") % 23 == 0, "no heading").otherwise(
            F.concat("company", F.lit(": "), _escape(c("title")), F.lit(": extra"))),
        F.lit("]]></title><region>"), _escape(c("location")), F.lit('</region><media:content url="x"/><description>'),
        c("encoded"), F.lit("</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate>"),
        F.when(c("id") % 2 == 0, F.concat(F.lit("<guid>g"), c("id").cast("string"), F.lit("</guid>"))).otherwise(""),
        F.lit("<link>https://weworkremotely.com/r/"), c("id").cast("string"), F.lit("?a=1&amp;b=2</link></item>"))
    rows = _entries(spark, sf).select("page", "id", entry.alias("x")).withColumn(
        "query_no", F.explode(F.array(F.lit(0), F.lit(1)))).where("query_no = 0 OR id % 2 = 0")
    bodies = rows.groupBy("query_no", "page").agg(
        F.array_sort(F.collect_list(F.struct("id", "x"))).alias("xs"))
    return bodies.select(
        "query_no", "page", B.pick(("programming", "devops"), c("query_no")).alias("category"),
        F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(F.transform("xs", lambda v: v["x"]), ""),
                 F.lit("</channel></rss>")).alias("payload"))


@query("read_weworkremotely", _BASE + f"""
SELECT CASE WHEN id % 2 = 0 THEN 'g' || id ELSE 'https://weworkremotely.com/r/' || id || '?a=1&b=2' END AS source_native_id,
  'https://weworkremotely.com/r/' || id || '?a=1&b=2' AS url, company, title || ': extra' AS title, place AS location,
  true AS remote, NULL AS salary_text, sha256({_TEXT}) AS description_hash, '2024-01-01T10:00:00.000Z' AS posted_at
FROM feed WHERE has_title""")
def read_weworkremotely(spark, sf):
    flat = R.read_weworkremotely(_rss(spark, sf)).where("reject_reason IS NULL")
    return _shown(first_seen_dedupe(flat, "query_no", "page", "position"))


def _cards(spark, sf) -> DataFrame:
    i = c("id")
    card = F.concat(
        F.lit('<li><a class="base-card" href="https://uk.linkedin.com/jobs/view/role-at-x-'), (i + 1000000).cast("string"),
        F.lit('?refId=a&amp;b=2">go</a><h3 class="base-search-card__title"> '), _escape(c("title")),
        F.lit(' </h3><h4 class="base-search-card__subtitle">'),
        F.when(i % 19 == 0, "").otherwise(F.concat(F.lit('<a href="#">'), _escape(c("company")), F.lit("</a>"))),
        F.lit('</h4><span class="job-search-card__location">'), _escape(c("location")),
        F.lit('</span><time datetime="2024-01-05"></time></li>'))
    rows = _entries(spark, sf).withColumn("query_no", F.explode(F.array(F.lit(0), F.lit(1)))).where(
        "query_no = 0 OR id % 3 = 0")
    return rows.select("query_no", "page", "id", card.alias("x")).groupBy("query_no", "page").agg(
        F.array_sort(F.collect_list(F.struct("id", "x"))).alias("xs")).select(
        "query_no", "page", F.concat(F.lit("<ul>"), F.array_join(F.transform("xs", lambda v: v["x"]), "\n"), F.lit("</ul>")).alias("payload"))


@query("read_linkedin", _BASE + f"""
SELECT CAST(id + 1000000 AS VARCHAR) AS source_native_id, 'https://www.linkedin.com/jobs/view/' || (id + 1000000) AS url,
  company, title, place AS location, true AS remote, NULL AS salary_text,
  sha256(CASE WHEN id % 5 = 0 THEN 'kept ' || id ELSE {_TEXT} END) AS description_hash,
  '2024-01-05T00:00:00.000Z' AS posted_at
FROM feed WHERE id % 19 <> 0 AND (id % 5 = 0 OR id % 7 <> 0)""")
def read_linkedin(spark, sf):
    i = c("id")
    cards = R.read_linkedin_cards(_cards(spark, sf)).withColumn("source", F.lit("linkedin"))
    unique = first_seen_dedupe(cards, "query_no", "page", "position")
    ident = (i + 1000000).cast("string").alias("source_native_id")
    entries = _entries(spark, sf)
    details = entries.select(ident, F.when(i % 7 == 0, F.lit("<p>gone</p>")).otherwise(F.concat(
        F.lit('<section><div class="show-more-less-html__markup x">'), c("html"),
        F.lit('</div><button class="show-more-less-html__button">More</button></section>'))).alias("payload"))
    stored = entries.where("id % 5 = 0").select(
        ident, F.concat(F.lit("kept "), i.cast("string")).alias("description"))
    return _shown(R.good(R.read_linkedin(unique, details, stored)))


def _thread_bodies(spark, sf) -> DataFrame:
    talk = read_table(spark, sf, "conversations")
    child = F.to_json(F.struct(
        (c("conv_id") * 1000 + c("turn")).alias("id"), F.lit("2024-01-02T03:04:05.000Z").alias("created_at"),
        F.when(c("turn") % 5 != 3, F.concat(F.lit("<p>"), _escape(c("text")), F.lit("</p>"))).otherwise(" ").alias("text")))
    body = F.concat(F.lit('{"id":1,"children":['), F.array_join(F.transform("xs", lambda v: v["j"]), ","), F.lit("]}"))
    # a conversation is a thread; its turns are the top-level comments
    threads = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", child.alias("j")))).alias("xs"))
    return threads.select(c("conv_id").cast("string").alias("thread_id"), body.alias("payload"))


def _thread_comments(spark, sf) -> DataFrame:
    return R.read_thread_comments(_thread_bodies(spark, sf))


@query("read_hn", f"""
WITH spoken AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE turn % 5 <> 3),
kept AS (SELECT *, conv_id * 1000 + turn AS cid FROM spoken),
many AS (SELECT *, unnest([0, 1]) AS i FROM kept)
SELECT conv_id || ':' || cid || ':' || i AS source_native_id, 'https://news.ycombinator.com/item?id=' || cid AS url,
  'Co' || cid AS company, 'T' || i AS title, NULL AS location, CASE WHEN turn % 2 = 0 THEN true END AS remote, NULL AS salary_text,
  sha256('sum' || chr(10) || chr(10) || {S.html_text("'<p>' || " + _esc('text') + " || '</p>'")}) AS description_hash,
  '2024-01-02T03:04:05.000Z' AS posted_at
FROM many WHERE NOT (i = 0 AND turn % 4 = 0)""")
def read_hn(spark, sf):
    comments = _thread_comments(spark, sf)
    ident = c("comment_id")
    turn = ident.cast("bigint") % 1000

    def posting(n: int) -> Column:
        blank = (turn % 4 == 0) if n == 0 else F.lit(False)
        return F.struct(
            F.when(blank, " ").otherwise(F.concat(F.lit("Co"), ident)).alias("company"), F.lit(f" T{n}").alias("title"),
            F.lit(None).cast("string").alias("location"), (turn % 2 == 0).alias("remote"),
            F.lit(None).cast("string").alias("salaryText"), F.lit(None).cast("string").alias("url"), F.lit("sum").alias("summary"))

    found = comments.select("comment_id", F.array(posting(0), posting(1)).cast(f"array<{THREAD_POSTING}>").alias("postings"))
    return _shown(R.good(R.read_hn(comments, found)))


_COMPOSED_SQL = """
, lk AS (SELECT CAST(id + 1000000 AS VARCHAR) AS sid, id FROM feed),
spoken AS (SELECT conv_id, turn, conv_id * 1000 + turn AS cid FROM conversations WHERE turn % 5 <> 3)
SELECT 'linkedin' AS source, sid AS source_native_id, NULL AS reason FROM lk
  WHERE id % 19 <> 0 AND (id % 5 = 0 OR (id % 7 <> 0 AND id % 11 <> 0))
UNION ALL SELECT 'linkedin', sid, 'linkedin job ' || sid || ' detail failed' FROM lk
  WHERE id % 19 <> 0 AND id % 5 <> 0 AND id % 11 = 0
UNION ALL SELECT 'linkedin', sid, 'linkedin job ' || sid || ' returned no description block' FROM lk
  WHERE id % 19 <> 0 AND id % 5 <> 0 AND id % 11 <> 0 AND id % 7 = 0
UNION ALL SELECT 'linkedin', sid, 'linkedin detail ' || sid || ' has no card' FROM lk
  WHERE id % 19 = 0 AND id % 11 <> 0
UNION ALL SELECT 'hn', conv_id || ':' || cid || ':0', NULL FROM spoken WHERE cid % 7 <> 0 AND cid % 3 <> 0
UNION ALL SELECT 'hn', CAST(cid AS VARCHAR), 'hn comment ' || cid || ' has no extraction' FROM spoken WHERE cid % 7 = 0
UNION ALL SELECT 'hn', CAST(conv_id * 1000 + turn AS VARCHAR),
  'hn extraction ' || (conv_id * 1000 + turn) || ' has no comment' FROM conversations
  WHERE turn % 5 = 3 AND (conv_id * 1000 + turn) % 14 > 7"""


@query("landed_composed", _BASE + _COMPOSED_SQL)
def landed_composed(spark, sf):
    """Items and rejects of landed search pages, detail pages, threads and extractions."""
    def landing(category: str, token: Column, payload: Column) -> list[Column]:
        source = "linkedin" if category in ("results", "detail") else "hn"
        return [F.lit(source).alias("source"), token.alias("token"), F.lit(category).alias("category"),
                payload.alias("payload")]

    i, none = c("id"), F.lit(None).cast("string")
    first = [F.lit(0).alias("query_no"), F.lit(0).alias("page")]
    cards = _cards(spark, sf).select(*landing("results", none, c("payload")), "query_no", "page")
    ident = (i + 1000000).cast("string")
    entries = _entries(spark, sf)
    details = entries.where(i % 11 != 0).select(*landing("detail", ident, F.when(
        i % 7 == 0, F.lit("<p>gone</p>")).otherwise(F.concat(
            F.lit('<section><div class="show-more-less-html__markup x">'), c("html"),
            F.lit("</div></section>")))), *first)
    stored = entries.where(i % 5 == 0).select(
        ident.alias("source_native_id"), F.concat(F.lit("kept "), i.cast("string")).alias("description"))
    talk = read_table(spark, sf, "conversations").withColumn("cid", c("conv_id") * 1000 + c("turn"))
    found = F.when(c("cid") % 3 == 0, F.lit("[]")).otherwise(F.concat(
        F.lit('[{"company":"Co'), c("cid"), F.lit('","title":"T","summary":"s"},{"company":" ","title":"U"}]')))
    # some extractions landed, the others are cached
    named = talk.where("cid % 7 <> 0").withColumn("found", found)
    landed_now = named.where("cid % 14 >= 7").select(
        *landing("extraction", c("cid").cast("string"), c("found")), *first)
    cached = named.where("cid % 14 < 7").select(
        c("cid").cast("string").alias("comment_id"),
        F.from_json("found", f"array<{THREAD_POSTING}>").alias("postings"))
    threads = _thread_bodies(spark, sf).select(*landing("thread", c("thread_id"), c("payload")), *first)
    landed = cards.unionByName(details).unionByName(threads).unionByName(landed_now)
    seeds = spark.createDataFrame([], SEEDS)
    items, bad = flatten_landed(landed, seeds, stored, cached)
    return items.select("source", "source_native_id", none.alias("reason")).unionByName(bad)


@query("feed_rejects", _BASE + """
SELECT 'remotive' AS source, CASE WHEN has_id THEN CAST(id AS VARCHAR) END AS source_native_id,
  'remotive entry ' || CASE WHEN has_id THEN CAST(id AS VARCHAR) ELSE '(no id)' END || ' missing title or company' AS reason
FROM feed WHERE NOT (has_id AND has_title)
UNION ALL SELECT 'arbeitnow', CASE WHEN has_id THEN key END, 'arbeitnow entry ' || CASE WHEN has_id THEN key ELSE '(no slug)' END
  || ' is missing ' || array_to_string(list_filter([CASE WHEN NOT has_id THEN 'slug' END, CASE WHEN NOT has_title THEN 'title' END,
    CASE WHEN id % 31 = 0 THEN 'company_name' END], lambda x: x IS NOT NULL), ' and ')
FROM feed WHERE NOT (has_id AND has_title AND id % 31 <> 0)
UNION ALL SELECT 'usajobs', CASE WHEN has_id THEN key END, 'usajobs entry ' || CASE WHEN has_id THEN key ELSE '(no control number)' END
  || ' is missing title or organization' FROM feed WHERE NOT (has_id AND has_title)
UNION ALL SELECT 'weworkremotely', CASE WHEN id % 2 = 0 THEN 'g' || id ELSE 'https://weworkremotely.com/r/' || id || '?a=1&b=2' END,
  'weworkremotely entry ' || CASE WHEN id % 2 = 0 THEN 'g' || id ELSE 'https://weworkremotely.com/r/' || id || '?a=1&b=2' END
  || ' has no "Company: Title" heading'
FROM feed, (SELECT unnest([0, 1]) AS q) WHERE NOT has_title AND (q = 0 OR id % 2 = 0)""")
def feed_rejects(spark, sf):
    out = R.rejects(_remotive(spark, sf))
    for feed in (_arbeitnow, _usajobs):
        out = out.unionByName(R.rejects(feed(spark, sf)))
    return out.unionByName(R.rejects(R.read_weworkremotely(_rss(spark, sf))))

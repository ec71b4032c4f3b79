"""Items of linkedin and hn, put together from landed responses of several kinds."""

import json

from postgrain.schemas import THREAD_POSTING
from postgrain.sources.tables import LANDING, SEEDS
from postgrain.streaming.ingest import flatten_landed


def card(ident, title="Engineer", company="Acme"):
    return (f'<li><a class="base-card" href="https://www.linkedin.com/jobs/view/x-{ident}?r=1">x</a>'
            f'<h3 class="base-search-card__title">{title}</h3><h4 class="base-search-card__subtitle"><a href="#">{company}</a></h4>'
            '<span class="job-search-card__location">Berlin</span></li>')


def detail(text):
    return f'<div class="show-more-less-html__markup">{text}</div></section>'


def run(spark, rows, stored=None, extractions=None):
    landed = spark.createDataFrame(rows, LANDING).repartition(3)
    items, bad = flatten_landed(landed, spark.createDataFrame([], SEEDS), stored, extractions)
    return (sorted((r.source, r.source_native_id, r.description) for r in items.collect()),
            sorted((r.source, r.source_native_id or "", r.reason) for r in bad.collect()))


def test_cards_meet_details_and_stored_descriptions(spark):
    rows = [
        ("linkedin", None, None, 0, 0, card(1000001) + card(1000002) + card(1000003) + card(1000004)),
        ("linkedin", None, "search", 1, 0, card(1000001, "Again") + card(1000005, company="")),
        ("linkedin", None, None, 0, 1, "<ul></ul>"), ("linkedin", None, None, 0, 2, None),
        ("linkedin", "1000001", "detail", 0, 0, detail("one")),
        ("linkedin", "1000001", "Detail", 1, 0, detail("one later")),
        ("linkedin", "1000002", "detail", 0, 0, detail("page")),
        ("linkedin", "1000003", "detail", 0, 0, "<p>nothing</p>"),
        ("linkedin", "1000005", "detail", 0, 0, detail("no card")),
        ("linkedin", None, "detail", 0, 0, detail("no id")),
    ]
    stored = spark.createDataFrame([("1000002", "kept")], "source_native_id string, description string")
    items, bad = run(spark, rows, stored)
    assert items == [("linkedin", "1000001", "one"), ("linkedin", "1000002", "kept")]
    assert bad == [
        ("linkedin", "", "linkedin detail (no id) has no card"),
        ("linkedin", "1000003", "linkedin job 1000003 returned no description block"),
        ("linkedin", "1000004", "linkedin job 1000004 detail failed"),
        ("linkedin", "1000005", "linkedin detail 1000005 has no card"),
    ]
    assert run(spark, rows)[0][1] == ("linkedin", "1000002", "page")


def test_threads_meet_landed_and_cached_extractions(spark):
    def thread(*comments):
        return json.dumps({"children": [{"id": i, "text": t} for i, t in comments]})

    def found(*titles):
        return json.dumps([{"company": "Acme", "title": t, "summary": "s"} for t in titles])

    whole = thread((11, "a"), (12, "b"), (13, " "), (14, "c"), (15, "d"), (16, "e"))
    rows = [
        ("hn", None, "search", 0, 0, '{"hits": []}'), ("hn", None, None, 0, 0, "{}"),
        ("hn", "1", "thread", 0, 0, whole), ("hn", "1", "thread", 0, 1, whole),
        ("hn", "2", "thread", 0, 0, "{}"), ("hn", "3", "thread", 0, 0, None),
        ("hn", "11", "extraction", 0, 0, found("x", " ", "y")), ("hn", "11", "extraction", 0, 1, found("z")),
        ("hn", "12", "extraction", 0, 0, "[]"), ("hn", "15", "extraction", 0, 0, '{"error": 1}'),
        ("hn", "99", "extraction", 0, 0, found("x")),
    ]
    cache = spark.createDataFrame(
        [("11", [("Old", "old")]), ("14", [("Acme", "cached")]), ("16", None)],
        "comment_id string, postings array<struct<company: string, title: string>>").selectExpr(
        "comment_id", "transform(postings, p -> named_struct('company', p.company, 'title', p.title, 'location', "
        f"null, 'remote', null, 'salaryText', null, 'url', null, 'summary', 's')) :: array<{THREAD_POSTING}> AS postings")
    items, bad = run(spark, rows, extractions=cache)
    assert items == [("hn", "1:11:0", "s\n\na"), ("hn", "1:11:2", "s\n\na"), ("hn", "1:14:0", "s\n\nc")]
    assert bad == [
        ("hn", "", "hn response of unknown category (none)"),
        ("hn", "15", "hn comment 15 has no extraction"), ("hn", "16", "hn comment 16 has no extraction"),
        ("hn", "2", "hn thread 2 has no comments"), ("hn", "3", "hn thread 3 has no comments"),
        ("hn", "99", "hn extraction 99 has no comment"),
    ]


def test_no_landed_rows(spark):
    assert run(spark, []) == ([], [])

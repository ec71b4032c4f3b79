"""Expressions over texts stand in a plan once, and not in the filters above them."""

from pyspark.sql import functions as F

from postgrain.functions.patterns import jvm
from postgrain.functions.text import decode_entities, html_to_text
from postgrain.operators.filters import work_auth_reasons
from postgrain.operators.market import candidate_terms
from postgrain.operators.text_index import phrase_scan
from postgrain.sources import feeds as R

ITEM = "<item><title><![CDATA[ A &amp; B: Dev: x ]]></title><description>&lt;p&gt;t &amp;amp; u&lt;/p&gt;</description><guid>g1</guid></item>"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rss_entries_are_parsed_once(spark):
    pages = spark.createDataFrame([("devops", f"<rss>{ITEM}<item><title>none</title><guid>g2</guid></item></rss>")], "category string, payload string")
    flat = R.read_weworkremotely(pages)
    good = flat.where("reject_reason IS NULL")
    assert _plan(good).count("regexp_extract_all(_chunk") == 1
    assert [(r.source_native_id, r.company, r.title, r.description) for r in good.collect()] == [("g1", "A & B", "Dev: x", "t & u")]
    assert [r.source_native_id for r in flat.where("reject_reason IS NOT NULL").collect()] == ["g2"]


def test_detail_pages_are_cut_once(spark):
    page = '<div class="show-more-less-html__markup x">a<b>c</b> <i class="show-more-less-html__button">d</i></section>'
    found = spark.createDataFrame([(page,)], "p string").select(R.linkedin_description("p").alias("d"))
    assert _plan(found).count("show-more-less-html__markup") == 1
    assert found.collect() == [("ac",)]


def test_text_clean_up(spark):
    rows = spark.createDataFrame([(0, "&amp;lt; &#x41;&#66; &nope; & &"), (1, " a  \nb\t c  d\r\n\n\n\ne ")], "k int, t string")
    out = rows.orderBy("k").select(decode_entities("t"), html_to_text("t")).collect()
    assert out[0][0] == "&lt; AB &nope; & &"
    assert out[1][1] == "a\nb c d\n\ne"


def test_terms_need_no_lower_case_text(spark):
    rows = spark.createDataFrame([("İzmir K9 Go-Lang... 12 x c++ é Node.JS",)], "t string")
    found = rows.select(candidate_terms("t").alias("c"))
    assert "lower(t" not in _plan(found)
    assert sorted(found.collect()[0].c) == sorted([
        "zmir", "k9", "go-lang", "c++", "node.js", "zmir k9", "k9 go-lang", "c++ node.js"])


def test_words_are_stemmed_once_per_text(spark):
    rows = spark.createDataFrame([(1, "Headings heading the headed theme the")], "doc_id int, t string")
    scan = phrase_scan(rows, ["heading", "the"], ["t"])
    assert "map_from_entries" in _plan(scan)
    assert sorted((h.phrase, h.start) for h in scan.collect()[0].hits) == [(0, 0), (0, 1), (0, 3), (1, 2), (1, 5)]


def test_rules_begin_with_what_they_can_begin_with(spark):
    assert jvm(r"\b(must|required to)\s").startswith("(?=[mr])(?<!")
    assert not jvm(r"\b(a\s)?b").startswith("(?=")
    rows = spark.createDataFrame([(1, "You MUST reside in Canada"), (2, "xmust reside in canada"), (3, None)], "k int, t string")
    out = rows.orderBy("k").select(work_auth_reasons("t").alias("r")).collect()
    assert [r.r for r in out] == [["work-auth:local-residency-required"], [], []]
    assert "(?i)" in _plan(rows.select(F.size(work_auth_reasons("t"))))

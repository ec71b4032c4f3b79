"""Column functions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from postgrain.functions import labels as L
from postgrain.functions import money_time as M
from postgrain.functions import skills as K
from postgrain.functions import taxonomy as X
from postgrain.functions import text as T
from postgrain.functions import urls as U


def apply(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("function, pairs", [
    (T.decode_entities, {
        "a &amp;lt; b": "a &lt; b", "&#8364;&#x20AC;": "€€", "&bogus; &AMP;": "&bogus; &AMP;",
        "&#0;&#x110000;&#xD800;&#99999999999999999999;": "�" * 4, "x&nbsp;y&hellip;": "x y...",
        "&#38;lt;": "&lt;", "&#x0000041;": "A", "plain": "plain",
    }),
    (T.html_to_text, {
        "<p>Hi<br/>there</p><ul><li>one</li></ul>": "Hi\nthere\n- one",
        "a\r\n\n\n\nb \t c": "a\n\nb c", "<script>x()</script>t": "x()t", "  z  ": "z",
    }),
    (T.squash, {"  a \n b ": "a b", "": ""}),
    (U.canonicalize_url, {
        " HTTP://WWW.Ex.com:80/a/b/?utm_source=x&b=2&a=1#t ": "http://ex.com/a/b?a=1&b=2",
        "https://ex.com": "https://ex.com/", "ftp://x": "ftp://x", "not a url": "not a url",
        "https://u:p@ex.com:8443/a/../b/./c//?B=1&a=2&a=1": "https://ex.com:8443/b/c?a=1&a=2&B=1",
        "https://ex.com/é x?q=%zz+y": "https://ex.com/%C3%A9%20x?q=%25zz+y",
        "https://ex.com/?REF=a&flag": "https://ex.com/?flag=", "https:///x": "https://x/",
    }),
    (X.title_family, {
        "Senior AI Agents Engineer": "agentic-engineer", "Product Manager, AI": None,
        "AI-Native Software Developer": "ai-engineer", "caféllm x": "llm-engineer",
        "Engineering Program Manager - Data Platform": "data-engineer", "Chef": None,
    }),
    (X.company_key, {"Acme, Inc.": "acme", "Foo Co. Ltd": "foo", "A & B GmbH": "a & b"}),
    (M.timestamp_or_null, {}),
])
def test_text_functions(spark, function, pairs):
    assert apply(spark, function, *pairs) == list(pairs.values())


def test_timestamps(spark):
    shown = apply(
        spark, lambda c: M.iso_text(M.timestamp_or_null(c)), "2026-07-28T16:52:25",
        "2026-07-28T16:52:25-04:00", "Tue, 28 Jul 2026 16:52:25 +0000", "Tue, 28 Jul 2026 16:52:25 GMT",
        "soon", "", "2026-13-45T00:00:00")
    assert shown == ["2026-07-28T16:52:25.000Z", "2026-07-28T20:52:25.000Z",
                     "2026-07-28T16:52:25.000Z", "2026-07-28T16:52:25.000Z", None, None, None]


def test_seniority(spark):
    def level(title, text):
        return apply(spark, lambda c: X.seniority(c, F.lit(text)), title)[0]

    assert level("Sr. Engineer", "") == "senior"
    assert level("Head of AI", "2 years") == "director"
    assert level("Engineer", "5+ years, or 3 to 6 years") == "mid"
    assert level("Engineer", "12 - 15 years") == "staff"
    assert level("Engineer", "0 years; 40 years") is None
    assert level("Engineer", "1 year") == "junior"


def test_locations_and_similarity(spark):
    assert apply(spark, lambda c: X.location_key(c, F.lit(True)), "Remote - United States", "Remote",
                 "Paris, USA") == ["remote:us", "remote:any", "remote:paris us"]
    assert apply(spark, lambda c: X.location_key(c, F.lit(False)), " Paris,  FR ") == ["paris fr"]
    assert apply(spark, lambda c: X.title_similarity(c, F.lit("Data Engineer Remote")),
                 "Data Engineer", "x", "Chef") == [pytest.approx(2 / 3), 0.0, 0.0]


def test_skills(spark):
    text = ("Go-to-market LLM evaluation with Node.js, react.js; multi-agent orchestration, "
            "ai agents; python3 large language models and CI/CD")
    assert apply(spark, K.match_skills, text) == [[
        "agents", "ci/cd", "evals", "javascript", "llm", "orchestration", "react"]]
    assert apply(spark, lambda c: K.match_skill_list(F.split(c, ",")), "go, Python ,x") == [
        ["golang", "python"]]


def test_skill_pass_equals_one_regex_per_term(spark):
    """The single pass sees what separate searches see, for awkward neighbours."""
    import re

    from postgrain.rules.skills import prose_terms

    terms = prose_terms()
    names = sorted(terms)
    texts = [f"{a}{sep}{b}" for n, a in enumerate(names) for sep in (" ", "-", ".", "x")
             for b in (names[(n * 7 + 3) % len(names)],)]
    want = [sorted({s for t, s in terms.items()
                    if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", x)}) for x in texts]
    assert apply(spark, K.match_skills, *texts) == want


def test_money_and_labels(spark):
    def usd(low, high):
        return spark.range(1).select(M.usd_range(F.lit(low), F.lit(high))).first()[0]

    assert usd(1000.5, 1001.0) == "$1,001"
    assert usd(99518.0, None) == "$99,518+"
    assert usd(0.0, 5.0) == "up to $5"
    assert usd(-1.0, float("nan")) is None
    assert usd(1000.0, 2000.0) == "$1,000–$2,000"
    assert apply(spark, L.formula_guard, "=1+2", "-5", "+1e5", "@x", "-a", "ok", "\tz") == [
        "'=1+2", "-5", "+1e5", "'@x", "'-a", "ok", "'\tz"]
    assert apply(spark, lambda c: L.token_candidates(c, F.lit("www.foo.com")), "Foo AI, Inc") == [
        ["fooaiinc", "foo-ai-inc", "foo", "foo.com"]]


def test_stemmer_agrees_with_sqlite():
    """The stdlib's full-text tokenizer is an independent implementation of the algorithm."""
    import sqlite3

    from postgrain.functions.stemming import porter_stem

    words = ("agents agentic agency engineering engineered engineer relational conditional "
             "hopping hoping falling fizzed happy happiness running runs sky dying yes yearly "
             "generalization generalizations oscillators adjustable replacement adoption probate "
             "controlling roll caresses ponies ties cats feed agreed plastered motoring sized "
             "electricity triplicate hopeful goodness formalize sensitivity vietnamization digitizer "
             "decisiveness allowance inference irritant bowdlerize effective communism rate cease "
             "llms models model modeling modelling data database databases analytics analyst").split()
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    for word in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (word,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == porter_stem(word), word

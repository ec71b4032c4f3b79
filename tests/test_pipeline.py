"""Feeds with awkward entries, page state, export, streaming, and a whole run twice."""

import json

import pytest
from pyspark.sql import functions as F

from postgrain.operators import pages as P
from postgrain.operators.profiles import Profile
from postgrain.plans import scan
from postgrain.rules.constants import DIMENSIONS
from postgrain.schemas import RAW_ITEM
from postgrain.sources import feeds as R
from postgrain.sources import tables as T


def bodies(spark, *payloads, token="tok"):
    return spark.createDataFrame(
        [(token, "Acme", p if isinstance(p, str) else json.dumps(p)) for p in payloads],
        "token string, company string, payload string")


def test_bad_bodies_and_entries_become_rejects(spark):
    flat = R.read_ashby(bodies(spark, "not json", {"jobs": {"x": 1}}, {"jobs": [
        {"id": "1", "title": "A", "isRemote": True, "workplaceType": "Hybrid", "location": None},
        {"id": "2", "title": " "}, {"title": "x", "id": 7}, {"isListed": False, "id": "9", "title": "hidden"}]}))
    items = R.good(flat).collect()
    assert [(i.source_native_id, i.remote, i.location) for i in items] == [("tok:1", False, None)]
    assert json.loads(items[0].payload)["workplaceType"] == "Hybrid"
    assert sorted(r.reason for r in R.rejects(flat).collect()) == [
        "ashby board tok returned no jobs array", "ashby board tok returned no jobs array",
        "ashby tok entry (no id) is missing id", "ashby tok entry 2 is missing title"]


def test_bad_host_token(spark):
    flat = R.read_teamtailor(bodies(spark, {"items": [{"id": "1", "title": "t"}]}, token="evil.com/x"))
    assert [r.reason for r in R.rejects(flat).collect()] == [
        "teamtailor token evil.com/x is not a valid hostname label"]


def test_double_decoding_and_defaults(spark):
    flat = R.read_greenhouse(bodies(spark, {"jobs": [
        {"id": 5, "title": "T", "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;", "updated_at": "2026-01-02T03:04:05-04:00"}]}))
    row = R.good(flat).first()
    assert (row.description, row.url) == ("a & b", "https://job-boards.greenhouse.io/tok/jobs/5")
    assert row.posted_at.isoformat() == "2026-01-02T07:04:05"


def test_linkedin_description_cuts_at_first_marker(spark):
    page = ('<div class="show-more-less-html__markup a">Hello<p>x</p><ul class="description__job-criteria">c</ul>'
            '<button class="show-more-less-html__button">m</button></section>')
    rows = spark.createDataFrame([(page,), ("<p>none</p>",)], "h string")
    assert [r[0] for r in rows.select(R.linkedin_description("h")).collect()] == ["Hellox", ""]


def test_thread_choice(spark):
    hits = {"hits": [{"title": "Ask: Freelancer? Who is hiring", "objectID": "1"},
                     {"title": "Who wants to be hired / who is hiring", "objectID": "2"},
                     {"title": "Ask: Who is hiring? (May)", "objectID": "3"}]}
    assert [r.thread_id for r in R.choose_thread(bodies(spark, hits)).collect()] == ["3"]


def test_embedded_json(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": [{"title": 1}]}}}}}}
    many = "".join(f'<script type="application/json" id="s{n}">[{n}]</script>' for n in range(12))
    html = {
        "seven": f'<script id="__NEXT_DATA__">{json.dumps({"z": deep})}</script>',
        "many": many, "broken": '<script type="application/json">{"a":NaN}</script>',
        "tail": '<script type="application/json">{"a":1} x</script>',
        "brace": "<script>x=1; __DATA__; window.__DATA__ = {'a': 1}</script>",
        "quoted": '<script>__INITIAL_STATE__={"s":"}\\"}","l":[{"slug":"x"}]};y()</script>',
        "order": '<script>window.__NUXT__ = bad; __APOLLO_STATE__ = {"b":1,"10":2,"9":[3],"\\ud800":4}</script>'
                 '<script type="application/json"> 7 </script><script id="__NEXT_DATA__">[0,{"k":1}]</script>',
        "once": '<script>window.__NUXT__ = {"a":1}</script><script>window.__DATA__ = {"b":1}</script>',
        "null": '<script type="application/json">null</script>', "empty": "", "none": None,
        "nested": '<script type="application/json">' + "[" * 200_000 + "]" * 200_000 + "</script>",
        "levels": '<script type="application/json">' + '{"a":' * 900 + '[{"x":1}]' + "}" * 900 + "</script>",
    }
    rows = spark.createDataFrame(list(html.items()), "page_id string, html string")

    def roots(**limits):
        got = {}
        for r in P.embedded_json(rows, **limits).orderBy("page_id", "place").collect():
            got.setdefault(r.page_id, []).append(r)
        return got

    got = roots()
    assert set(got) == {"seven", "many", "quoted", "order", "once", "levels"}
    assert got["seven"][0].list_path == "z.a.b.c.d.e.f"
    assert [(r.place, r.source) for r in got["many"]] == [(n + 1, f"#s{n}") for n in range(12)]
    assert (got["quoted"][0].list_path, got["quoted"][0].posting_score) == ("l", 1)
    assert [(r.source, r.kind, r.length, r.keys, r.list_path, r.item_keys) for r in got["order"]] == [
        ("__NEXT_DATA__", "list", 2, [], "", ["k"]), ("application/json", "scalar", 0, [], None, []),
        ("__APOLLO_STATE__", "object", 4, ["9", "10", "b", "?"], None, [])]
    assert [r.source for r in got["once"]] == ["window.__NUXT__", "window.__DATA__"]
    assert got["levels"][0].list_path == ".".join("a" * 900)
    few = roots(max_roots=10, max_keys=2, max_depth=6)
    assert few["seven"][0].list_path is None and len(few["many"]) == 10
    assert few["order"][2].keys == ["9", "10"]


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([("=x", 1.0, None, 'a "q", b\nc')], "a string, b double, c string, d string")
    T.write_csv_export(rows.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert text == "a,b,c,d\r\n'=x,1,,\"a \"\"q\"\", b\nc\"\r\n"


def test_csv_cells_come_back_unchanged_in_order(spark, tmp_path):
    import csv

    cells = ["plain", "", "a,b", '"', "x\ry", "x\r\ny\n", " lead", "é", "'q'", '",\n"']
    rows = spark.createDataFrame([(k, cells[k % 10], cells[k % 7]) for k in range(300)], "k int, `a,b` string, c string")
    T.write_csv_export(rows.orderBy("k"), str(tmp_path / "out"))
    got = []
    for part in sorted((tmp_path / "out").glob("part-*")):
        with part.open(newline="") as file:
            head, *lines = csv.reader(file)
            assert head == ["k", "a,b", "c"]
            got += lines
    assert got == [[str(k), cells[k % 10], cells[k % 7]] for k in range(300)]
    T.write_csv_export(rows.limit(0), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "none").glob("part-*")) == b'k,"a,b",c\r\n'


def test_seeds_and_bronze(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("name,board,token,verified\nAcme,lever,acme,true\nBad,lever,bad,false\n")
    seeds = T.read_board_seeds(spark, str(tmp_path / "seeds.csv"))
    assert [s.token for s in seeds.collect()] == ["acme"]
    shipped = T.board_seeds(spark, only_verified=False)
    assert shipped.count() > T.board_seeds(spark).count() > 90 and shipped.schema == seeds.schema
    assert shipped.select("board", "token").distinct().count() == shipped.count()
    items = spark.createDataFrame([("lever", "1", "{}", "u", "c", "t", None, None, "d", None, None)], RAW_ITEM)
    for run in (1, 2):
        T.append_bronze(items, str(tmp_path / "bronze"), run, F.current_timestamp())
    stored = spark.read.parquet(str(tmp_path / "bronze"))
    assert sorted(r.run_id for r in stored.collect()) == [1, 2]


def test_stream_picks_up_only_new_files(spark, tmp_path):
    from postgrain.streaming.ingest import ingest_stream

    landing = tmp_path / "landing"
    landing.mkdir()
    seeds = spark.createDataFrame([("Acme", "lever", "acme", True)], T.SEEDS)

    def land(name, source, token, body):
        (landing / name).write_text(json.dumps({
            "source": source, "token": token, "query_no": 0, "page": 0, "payload": json.dumps(body)}) + "\n")

    counts = []

    def run():
        query = ingest_stream(spark, str(landing), seeds, str(tmp_path / "bronze"), str(tmp_path / "rejects"),
                              str(tmp_path / "checkpoint"), lambda items, _: counts.append(items.count()))
        query.awaitTermination()

    land("1.json", "lever", "acme", [{"id": "1", "text": "Dev"}, {"text": "no id"}])
    run()
    land("2.json", "arbeitnow", None, {"data": [{"slug": "s", "title": "t", "company_name": "c"}]})
    run()
    run()
    assert counts == [1, 1]
    stored = spark.read.parquet(str(tmp_path / "bronze"))
    assert {r.company for r in stored.collect()} == {"Acme", "c"}


ITEM = "seq bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_ITEM.fields)
STORED = (
    "seq bigint, id bigint, canonical_id string, source string, source_native_id string, company string, "
    "company_normalized string, title string, title_family string, seniority string, variant_markers array<string>, "
    "location string, location_key string, remote boolean, salary_text string, description string, "
    "description_hash string, url string, canonical_url string, posted_at timestamp, first_seen_at timestamp, "
    "last_seen_at timestamp, missed_runs int, status string")


def scorer(row):
    if "broken" in row["description"]:
        raise ValueError("no answer")
    return {"overall": 80, "uncertainty": "low", "rationale": "fine",
            "dimensions": {n: {"score": 5, "evidence": [], "note": ""} for n, _ in DIMENSIONS}}


@pytest.fixture()
def items(spark):
    def make(start, *rows):
        return spark.createDataFrame([
            (start + n, src, nid, "{}", f"https://x.com/{nid}", "Acme Inc.", title, "Austin, TX", None, text, None, None)
            for n, (src, nid, title, text) in enumerate(rows)], ITEM)
    return make


def test_two_runs_end_to_end(spark, items):
    profile = Profile("v1", skills=("python",), rare_skills=("rag",), target_companies=("acme",))
    walks = spark.createDataFrame([("lever", None), ("ashby", None)], "source string, covered_since timestamp")
    empty = spark.createDataFrame([], STORED)
    one, two = (F.lit(f"2024-01-0{d}").cast("timestamp") for d in (1, 2))
    rows = (("lever", "1", "AI Engineer", "python and rag"), ("ashby", "1", "AI Engineer", "python and rag"),
            ("lever", "2", "AI Engineer", "broken"), ("lever", "3", "Chef", "soup"))
    first = scan.collect(empty, items(1, *rows), walks, one, one)
    stages = {r.seq: r.stage for r in first.identities.collect()}
    assert stages == {1: "new", 2: "canonical-url", 3: "fingerprint", 4: "new"}
    stored = spark.createDataFrame(first.postings.drop("expired_now").select(*[c.split()[0] for c in STORED.split(", ")]).collect(), STORED)

    scores = spark.createDataFrame([], scan.SCORES)
    config = dict(prompt_version="p", model_id="m", now=one, stemmed=True)
    final, summary = scan.score(stored, scores, profile, scorer, **config)
    assert summary.first().asDict() == {
        "examined": 4, "passed": 3, "retrieved": 3, "scored": 1, "cache_hits": 1, "errors": 1}
    table = spark.createDataFrame(final.collect(), final.schema)
    assert sorted((r.rubric_score is not None) for r in table.collect()) == [False, False, True, True]

    # a repeat with nothing new scores nothing but retries the failure
    _, again = scan.score(stored, table, profile, scorer, **config)
    assert (again.first().scored, again.first().cache_hits, again.first().errors) == (0, 0, 1)

    second = scan.collect(stored, items(10, *rows[:1]), walks, two, two)
    after = {(r.source, r.source_native_id): (r.missed_runs, r.id) for r in second.postings.collect()}
    before = {(r.source, r.source_native_id): r.id for r in stored.collect()}
    assert {k: m for k, (m, _) in after.items()} == {
        ("lever", "1"): 0, ("ashby", "1"): 1, ("lever", "2"): 1, ("lever", "3"): 1}
    assert {k: i for k, (_, i) in after.items()} == before


def test_unread_sources_are_rejects(spark):
    from postgrain.streaming.ingest import flatten_landed

    rows = [(s, None, 0, 0, "{}") for s in ("elsewhere", "somewhere", None)]
    landed = spark.createDataFrame(rows, "source string, token string, query_no int, page int, payload string")
    items, bad = flatten_landed(landed, spark.createDataFrame([], T.SEEDS))
    assert items.count() == 0
    assert sorted((r.source or "", r.reason) for r in bad.collect()) == [
        (s, "no reader for this source") for s in ("", "elsewhere", "somewhere")]


def test_scores_of_other_profiles_stay(spark):
    from pyspark.sql import functions as F

    from postgrain.operators.scoring import merge_scores

    dims = "struct<a: double>"
    scores = spark.createDataFrame(
        [(1, "h", "r1", "pA", None, None, None, None, None, None, None), (1, "h", "r1", "pB", 88.0, None, None, None, "v", "m", None)],
        f"job_id long, description_hash string, rubric_version string, profile_version string, rubric_score double, dimensions {dims}, "
        "uncertainty string, rationale string, prompt_version string, model_id string, scored_at timestamp")
    candidates = scores.where("profile_version = 'pA'").select("job_id", "description_hash", "profile_version")
    results = spark.createDataFrame([("h", 10.0, None, "low", "why")], f"description_hash string, overall double, dimensions {dims}, uncertainty string, rationale string")
    got = merge_scores(scores, results, candidates, rubric_version="r1", prompt_version="v2", profile_version="pA", model_id="m1",
                       scored_at=F.lit("2024-06-01").cast("timestamp"))
    assert sorted((r.profile_version, r.rubric_score) for r in got.collect()) == [("pA", 10.0), ("pB", 88.0)]

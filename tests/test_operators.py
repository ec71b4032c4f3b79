"""Operators on small tables, checked against brute force where SQL is no oracle."""

import datetime as dt
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from postgrain.operators import filters, identity, lifecycle, runs, scoring, text_index, tracker
from postgrain.operators.profiles import Profile, load_profiles
from postgrain.operators.retrieval import family_score

NODE = ("seq bigint, source string, source_native_id string, canonical_url string, "
        "company_normalized string, title_family string, location_key string, "
        "variant_markers array<string>, title string")


def node(seq, title, source="a", native=None, url=None, company="acme", family="ml-engineer",
         place="us", markers=()):
    return (seq, source, native or f"n{seq}", url or f"u{seq}", company, family, place,
            list(markers), title)


def resolve(spark, existing, batch):
    old = spark.createDataFrame([(*r, f"c{r[0]}") for r in existing], NODE + ", canonical_id string")
    rows = identity.resolve_identity(old, spark.createDataFrame(batch, NODE)).collect()
    return {r.seq: (r.stage, r.canonical_id) for r in rows}


def brute_force(existing, batch):
    """Rows one after the other, each against all earlier ones."""
    import hashlib

    def words(title):
        return {w for w in re.sub(r"[^a-z0-9\s]", " ", title.lower()).split() if len(w) > 1}

    def block(r):
        return "|".join((r[4], r[5] or "", r[6], "+".join(sorted(r[7]))))

    def similar(a, b):
        x, y = words(a[8]), words(b[8])
        return bool(x and y) and len(x & y) / len(x | y) >= 0.6

    seen = [(r, f"c{r[0]}") for r in sorted(existing)]
    out = {}
    for r in sorted(batch):
        tests = (("source-id", lambda o: o[1:3] == r[1:3]), ("canonical-url", lambda o: o[3] == r[3]),
                 ("fingerprint", lambda o: block(o) == block(r) and similar(o, r)))
        found = next(((s, c) for s, t in tests for o, c in seen if t(o)), None)
        out[r[0]] = found or ("new", hashlib.sha256(block(r).encode()).hexdigest()[:32])
        seen.append((r, out[r[0]][1]))
    return out


def test_identity_stages_and_chains(spark):
    existing = [node(1, "Data Engineer", url="x"), node(2, "Data Engineer", url="x", company="other")]
    batch = [
        node(10, "Chef", native="n1"), node(11, "Chef", url="x"), node(12, "Data Engineer Remote"),
        node(13, "Platform Wizard"), node(14, "Totally Different"), node(15, "A"),
        # a chain inside the batch: each row resembles only the one before
        node(20, "aa bb cc dd", place="p"), node(21, "aa bb cc ee", place="p"),
        node(22, "aa bb ff ee", place="p"), node(23, "aa gg ff ee", place="p"),
        node(24, "hh gg ff ee", place="p"), node(30, "zz", native="n13"), node(31, "zz", native="n13"),
        node(32, "Data Engineer", markers=("senior",)), node(33, "Data Engineer", family=None),
    ]
    got = resolve(spark, existing, batch)
    assert got == brute_force(existing, batch)
    assert got[24][0] == "fingerprint" and got[24][1] == got[20][1]
    assert got[11] == ("canonical-url", "c1") and got[30][0] == "source-id"


@pytest.mark.parametrize("seed", [1, 2])
def test_identity_matches_brute_force(spark, seed):
    """Random titles, short and long, in few blocks with shared URLs and ids."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(18)]

    def row(seq):
        size = rng.choice((1, 2, 3, 5, 8, 12, 13, 15, 17))
        return node(seq, " ".join(rng.sample(pool, size)), source=rng.choice("ab"),
                    native=f"n{rng.randrange(150)}", url=f"u{rng.randrange(200)}",
                    place=rng.choice(("p", "q")))

    existing, used = [], set()
    for seq in range(60):
        r = row(seq)
        if r[1:3] not in used:
            used.add(r[1:3])
            existing.append(r)
    batch = [row(1000 + i) for i in range(80)]
    assert resolve(spark, existing, batch) == brute_force(existing, batch)


def test_one_block_with_many_near_copies(spark):
    """A hot block: every title differs in one word, all are one identity."""
    batch = [node(i, f"senior software engineer r{i}") for i in range(400)]
    got = resolve(spark, [], batch)
    assert len({c for _, c in got.values()}) == 1
    assert sum(s == "new" for s, _ in got.values()) == 1


EXISTING = ("source string, source_native_id string, value string, first_seen_at timestamp, "
            "last_seen_at timestamp, missed_runs int, status string, posted_at timestamp")
BATCH = "source string, source_native_id string, value string, posted_at timestamp, seq bigint, seen_at timestamp"


def day(n):
    return dt.datetime(2024, 1, n)


def test_upsert_revives_keeps_first_seen_and_is_idempotent(spark):
    old = spark.createDataFrame([
        ("s", "1", "old", day(1), day(2), 3, "expired", None), ("s", "2", "keep", day(1), day(2), 1, "active", None),
    ], EXISTING)
    batch = spark.createDataFrame([
        ("s", "1", "new", None, 5, day(5)), ("s", "3", "a", None, 6, day(5)), ("s", "3", "b", None, 7, day(6)),
    ], BATCH)
    once = lifecycle.upsert_postings(old, batch)
    rows = {r.source_native_id: r for r in once.collect()}
    assert (rows["1"].value, rows["1"].status, rows["1"].missed_runs, rows["1"].first_seen_at) == (
        "new", "active", 0, day(1))
    assert (rows["2"].value, rows["2"].missed_runs) == ("keep", 1)
    assert (rows["3"].value, rows["3"].first_seen_at, rows["3"].last_seen_at) == ("b", day(5), day(6))
    twice = lifecycle.upsert_postings(once, batch)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_sweep_loop_equals_closed_form(spark):
    """Run-by-run upsert and sweep end in the state the history formula gives."""
    rng = random.Random(7)
    seen = [("s", f"n{i}", d) for d in range(1, 13) for i in range(25) if rng.random() < 0.35]
    live = {d for _, _, d in seen}
    state = spark.createDataFrame([], EXISTING)
    names = state.columns
    for d in sorted(live):
        batch = spark.createDataFrame(
            [("s", n, "v", None, i, day(d)) for i, (_, n, x) in enumerate(seen) if x == d], BATCH)
        plan = spark.createDataFrame([("s", day(d), None)],
                                     "source string, started_at timestamp, covered_since timestamp")
        swept = lifecycle.sweep_missing(lifecycle.upsert_postings(state, batch), plan).drop("expired_now")
        state = spark.createDataFrame(swept.select(*names).collect(), EXISTING)
    history = lifecycle.lifecycle_history(spark.createDataFrame(
        [(s, n, d, day(d)) for s, n, d in seen], "source string, source_native_id string, run int, seen_at timestamp"))
    columns = ("source_native_id", "first_seen_at", "last_seen_at", "missed_runs", "status")
    assert sorted(map(tuple, state.select(*columns).collect())) == sorted(
        map(tuple, history.select(*columns).collect()))


def test_scoped_sweep_leaves_undated_and_older_rows(spark):
    old = spark.createDataFrame([
        ("s", "in", "v", day(1), day(2), 2, "active", day(9)), ("s", "old", "v", day(1), day(2), 2, "active", day(3)),
        ("s", "undated", "v", day(1), day(2), 2, "active", None), ("t", "other", "v", day(1), day(2), 2, "active", day(9)),
    ], EXISTING)
    plan = spark.createDataFrame([("s", day(10), day(8))],
                                 "source string, started_at timestamp, covered_since timestamp")
    rows = {r.source_native_id: (r.missed_runs, r.status, r.expired_now) for r in
            lifecycle.sweep_missing(old, plan).collect()}
    assert rows == {"in": (3, "expired", True), "old": (2, "active", False),
                    "undated": (2, "active", False), "other": (2, "active", False)}


PLACE_CASES = (
    # location, remote, accepted with ("united kingdom", "york")
    ("San Francisco, CA", False, True), ("Hyderabad, IN", False, True), ("Wilmington, DE", False, False),
    ("Sydney, Australia", False, False), ("Washington, D.C.", False, True), ("", True, True), ("", False, False),
    ("Remote", True, True), ("Remote - EMEA", True, False), ("Remote - Americas", True, True),
    ("Remote, Canada / North America", True, True), ("London, United Kingdom", False, True),
    ("United Arab Emirates", False, False), ("York, England", False, True), ("Toronto or Montreal", False, False),
    ("Anywhere", True, True), ("Worldwide", False, False), ("us", False, True), ("Austin – TX", False, True),
)


def test_place_rules(spark):
    profile = Profile("p", accepted_locations=("united kingdom", "york"))
    rows = spark.createDataFrame(
        [(i, place, remote) for i, (place, remote, _) in enumerate(PLACE_CASES)],
        "id int, location string, remote boolean")
    got = filters.place_features(rows).select("id", filters.location_accepted(profile).alias("ok")).orderBy("id")
    assert [r.ok for r in got.collect()] == [ok for *_, ok in PLACE_CASES]


def test_every_reason_is_collected_in_order(spark):
    rows = spark.createDataFrame([(
        1, "active", "Must be eligible to work in the UK. Active Secret clearance.", "h", None, "director", False, "Lyon"),
        (2, "expired", "", "h", None, None, True, "")],
        "id int, status string, description string, description_hash string, title_family string, "
        "seniority string, remote boolean, location string")
    profile = Profile("p", remote_only=True, seniority_max="staff")
    verdicts = filters.hard_filter_verdicts(rows, [profile, Profile("q")]).orderBy("profile_version").collect()
    auth = ["work-auth:non-us-work-authorization", "work-auth:active-clearance"]
    assert [v.reasons for v in verdicts] == [
        [*auth, "role-family:unclassified", "seniority-above:director", "remote-only", "location:lyon"],
        [*auth, "role-family:unclassified", "location:lyon"]]


DOCS = [
    (1, "AI Engineer", "Acme", "Build large language models and agents. Agents everywhere."),
    (2, "Data Analyst", "Beta AI", "Relational databases; running agents with Café culture."),
    (3, "Engineer, AI", "Gamma", "We engineer things. Large. Language. Modeling."),
    (4, "Chef", "Delta", "Nothing here."),
]


@pytest.mark.parametrize("stemmed", [True, False])
def test_bm25_equals_sqlite(spark, stemmed):
    con = sqlite3.connect(":memory:")
    tokenizer = "porter unicode61" if stemmed else "unicode61"
    try:
        con.execute(f"CREATE VIRTUAL TABLE d USING fts5(title, company, description, tokenize='{tokenizer}')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.executemany("INSERT INTO d(rowid, title, company, description) VALUES (?, ?, ?, ?)", DOCS)
    phrases = ["ai engineer", "large language model", "agent", "cafe", " "]
    match = " OR ".join(f'"{p}"' for p in text_index.clean_phrases(phrases))
    want = dict(con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (match,)))
    docs = spark.createDataFrame(DOCS, "doc_id int, title string, company string, description string")
    got = {r.doc_id: r["rank"] for r in text_index.bm25(docs, phrases, stemmed=stemmed).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_no_query_words_means_no_hits(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, title string, company string, description string")
    assert text_index.bm25(docs, ["  "]).count() == 0
    assert text_index.bm25(docs, ["absent"], stemmed=True).count() == 0


def test_family_score_slopes(spark):
    profile = Profile("p", target_families=("ai-engineer", "ml-engineer"))
    rows = spark.createDataFrame([("ai-engineer",), ("ml-engineer",), ("chef",), (None,)], "f string")
    assert [r[0] for r in rows.select(family_score("f", profile)).collect()] == [1.0, 0.75, 0.0, 0.0]


def test_budgets():
    assert scoring.parse_budget(None) == 250 and scoring.parse_budget("0") == 0
    for bad in ("-1", "2.5", "x"):
        with pytest.raises(ValueError):
            scoring.parse_budget(bad)
    assert [scoring.effective_budget(x) for x in (None, -3, float("nan"), 7)] == [250, 0, 0, 7]


def test_folding_events(spark):
    rows = [(1, "status", "applied", day(2), 1), (1, "status", "shortlisted", day(1), 0),
            (1, "status", "applied", day(5), 2), (1, "note", "  ", day(6), 3), (1, "note", "x", day(3), 4),
            (2, "note", "hello", day(1), 5)]
    events = spark.createDataFrame(rows, "job_id int, kind string, value string, at timestamp, seq int")
    got = {r.job_id: tuple(r)[1:] for r in tracker.fold_events(events).collect()}
    assert got == {1: ("applied", day(2), None, day(1), day(6)), 2: ("shortlisted", None, "hello", day(1), day(1))}


def test_run_log(spark):
    log = runs.start_run(spark, 1, day(1)).unionByName(runs.start_run(spark, 2, day(3)))
    stats = spark.createDataFrame([("b", 3, 1, 2, 0, 0), ("a", 1, 1, 0, 0, 1)],
                                  "source string, fetched long, created long, updated long, expired long, errors long")
    done = runs.finish_run(log, 2, "completed", day(4), stats)
    closed = runs.fail_stale_runs(done, F.lit("2024-01-04").cast("timestamp"))
    one, two = closed.orderBy("id").collect()
    assert (one.status, one.error, one.finished_at) == ("failed", runs.STALE_MESSAGE, day(4))
    assert two.status == "completed" and [s.source for s in two.stats] == ["a", "b"]
    assert runs.latest_run(closed).first().id == 2


def test_profiles_come_from_a_table(spark):
    table = spark.createDataFrame([("v", True, ["us"])], "version string, remote_only boolean, accepted_locations array<string>")
    assert load_profiles(table) == [Profile("v", True, ("us",))]

import random
import re

from pyspark.sql import functions as F

from postgrain.llm.secret_ledger import BASE, LEDGER, RULES, Rule, joined_spans, masked, scan, secrets
from postgrain.llm.shared import new_folder

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_force(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def texts():
    rng = random.Random(13)
    parts = ["password", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "é😀", "abcdef0123456789", "AKIA", "ABCDEFGH12345678",
             "AKIAAKIA", "deadbeef", "x", "\n", "aB3+/_.=-", "\x01", ",", "passwd: hunter2hunter2", "ſecret=abcdefghijklmnop"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return made + [None, "", made[0], made[0], "password=secret:abcdefghijklmnop", "token == abcdefghijkl", "AKIAAKIAAKIAAKIA12", "-----BEGIN RSA PRIVATE KEY-----",
                   "secret=abcdefghijkl " * 300 + "z" * 300_000]


def test_spans_equal_matching_one_by_one(spark):
    rows = list(enumerate(texts()))
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, blob string, _spans int").withColumns(
        {"_blob": F.lit(1), "odd.name": F.lit(2), "SPANS": F.lit(3), "_blob_of": F.lit(4)})
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    found = secrets(table.repartition(4)).select("doc_id", joined_spans(base).alias("base"), masked(F.coalesce("text", F.lit("")), F.col("spans")).alias("clean"))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        want = brute_force(text)
        assert got[doc].base == want, text
        if want:
            assert "[SECRET]" in got[doc].clean and not brute_force(got[doc].clean.replace("[SECRET]", "|||"))
    assert secrets(table.limit(0)).collect() == []


def test_only_unseen_pairs_are_scanned(spark):
    ledger = new_folder(spark, "test-ledger")
    first = spark.createDataFrame([("a", "token=abcdefghijklmnop"), ("b", "nothing")], "path string, text string")
    more = spark.createDataFrame([("c", "token=abcdefghijklmnop"), ("d", None), ("a", "AKIA12345678901234")], "path string, text string")
    read = lambda: spark.read.schema(LEDGER).parquet(ledger)
    scan(first, ledger)
    assert read().count() == 2 * len(RULES)
    scan(first, ledger)
    scan(first.limit(0), ledger)
    assert read().count() == 2 * len(RULES)
    rows = {(r.path, r.text): [s.kind for s in r.spans] for r in secrets(first.union(more), ledger).collect()}
    assert rows == {("a", "token=abcdefghijklmnop"): ["assign"], ("b", "nothing"): [], ("c", "token=abcdefghijklmnop"): ["assign"],
                    ("d", None): [], ("a", "AKIA12345678901234"): ["access"]}
    assert read().count() == 4 * len(RULES)
    newer = (*RULES[1:], Rule("assign", 2, "noth", 0, 1))
    rows = {r.path: [s.kind for s in r.spans] for r in secrets(first, ledger, newer).collect()}
    assert rows == {"a": [], "b": ["assign"]} and read().count() == 4 * len(RULES) + 2


def test_columns_of_any_name_stay(spark):
    table = spark.createDataFrame([("x", 1, 2, 3, 4)], "text string, _blob int, `odd.name` int, spans int, TEXT int")
    assert secrets(table).columns == ["text", "_blob", "odd.name", "TEXT", "spans"]
    assert tuple(secrets(table).first()) == ("x", 1, 2, 4, [])


def test_a_text_of_many_matches(spark):
    text = "é0123456789abcdef-" * 30_000
    row = secrets(spark.createDataFrame([(text,)], "text string")).select("spans", masked(F.col("text"), F.col("spans")).alias("clean")).first()
    assert [(s.start, s.end) for s in row.spans] == [(18 * k + 1, 18 * k + 17) for k in range(30_000)]
    assert row.clean == "é[SECRET]-" * 30_000

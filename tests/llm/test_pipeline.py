import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from postgrain.llm.queries import BYTE_TOKENIZER  # noqa: E402
from tests.llm.test_decontamination import brute_force as contaminated  # noqa: E402
from tests.llm.test_jaccard_join import brute_force as components  # noqa: E402
from tests.llm.test_secret_ledger import brute_force as spans  # noqa: E402
from tests.llm.test_tokens import direct  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    body = [" ".join(f"word{(k * 31 + j * 7) % 997}" for j in range(60)) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(body)]
    rows += [(100, body[3]), (101, body[4] + " extra"), (102, body[5] + " one two three four five six seven eight nine ten eleven"),
             (103, body[6] + " password = abcdefghijklmnop end"), (104, None), (105, ""), (106, "short")]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


def test_stages_decide_as_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = [(1, "one two three four five six seven eight nine ten")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    one_label = stages[names[0]](spark, docs, str(tmp_path))
    assert one_label.columns == docs.columns and one_label.count() == len(rows)

    unique = stages[names[1]](spark, docs, str(tmp_path))
    want = {d for d, _, c in components([(r[0], r[1]) for r in rows]) if d == c}
    assert {r.doc_id for r in unique.collect()} == want and unique.columns == docs.columns

    clean = stages[names[2]](spark, docs, str(tmp_path))
    hit = {r[0] for r in contaminated([(r[0], r[1]) for r in rows], items) if r[2]}
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - hit and hit == {102}

    safe = {r.doc_id: r for r in stages[names[3]](spark, docs, str(tmp_path)).collect()}
    assert len(safe) == len(rows)
    for d, text, *_ in rows:
        assert safe[d].text == text if not spans(text) else "[SECRET]" in safe[d].text and safe[d].n_chars == len(safe[d].text)

    pieces = stages[names[4]](spark, docs, str(tmp_path)).collect()
    for d, text, *_ in rows:
        ids = np.array(direct(BYTE_TOKENIZER, text, 0), "<u4")
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == d)
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n, _ in own] == [c for *_, c in own]
        assert sum(n for _, n, _ in own) == len(ids)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == want - hit


def test_empty_documents(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_passages_are_found_without_an_id(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before {passage} after", "en", "s", 1), (None, "other words", "en", None, None), (1, passage, "en", "s", 3),
            (2, "one two", None, "s", 4), (2, "one two", None, "s", 4), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted((r for k, r in enumerate(rows) if k not in (0, 2)), key=repr)


def test_one_row_of_each_group_also_of_repeated_rows_and_without_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "de", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1),
            (None, b + " end", "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, c + " end", "en", "s", 1),
            (7, d, "en", "s", 1), (7, d, "en", "s", 1), (8, None, "en", "s", 0), (8, None, "en", "s", 0), (9, "", "en", "s", 0),
            (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs.repartition(4), str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=repr)
    nameless = [r for r in got if r[0] is None and r[1]]
    assert len(nameless) == 1 and nameless[0][1] in (c, c + " end")
    assert [r for r in got if r not in nameless] == sorted(
        [(1, a, "de", "s", 1), (3, b, "en", "s", 1), (7, d, "en", "s", 1), (8, None, "en", "s", 0), (9, "", "en", "s", 0),
         (None, None, "en", "s", 0)], key=repr)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    words = " ".join(f"w{k}" for k in range(30))
    schema = SCHEMA + ", `odd.name` int, spans string, score int, c0 int, key int, `TEXT ` string"
    rows = [(1, words + " token=abcdefghijklmnop", "en", "s", 5, 1, "x", 2, 3, 4, "y"), (2, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        got = sorted(map(tuple, out.collect()), key=repr)
        if name == "secret scans":
            assert got[0][1] == words + " [SECRET]" and got[0][4] == len(words) + 9
            got[0] = (1, rows[0][1], *got[0][2:4], 5, *got[0][5:])
        assert got == rows, name

"""Stems as expressions, and recall by stems."""

from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from postgrain.functions import stemming
from postgrain.functions.stemming import common_start, porter_stem, stem_column, stem_expression
from postgrain.operators import retrieval, text_index
from postgrain.operators.profiles import Profile

ROOTS = ("run hop fall rel conduc control happi y tr agre b feed siz ration valenci digitiz conform radic vile analog predic "
         "decis hope form sensi electr allow adjust replac adop commun prob rat ceas rol sky possibil engine manag e iz at bl").split()
ENDS = ["", "s", "es", "ies", "ed", "ing", "eed", "y", "e", "ll", *stemming._STEP2, *stemming._STEP3, *stemming._STEP4]
WORDS = sorted({a + b + c for a, b, c in product(ROOTS, ENDS, ["", "s", "ed", "ly", "ness", "iti"])} | {"né", "a1s", "caresses"})


def test_expression_is_the_algorithm(spark):
    frame = spark.createDataFrame([(w,) for w in WORDS], "word string").repartition(8)
    want = {w: porter_stem(w) for w in WORDS}
    assert {r.word: r.stem for r in frame.select("word", stem_column(F.col("word")).alias("stem")).collect()} == want
    sql = stem_expression("word", lambda x: "'" + x.replace("'", "''") + "'")
    values = ", ".join(f"('{w}')" for w in WORDS)
    assert dict(duckdb.sql(f"SELECT word, {sql} FROM (VALUES {values}) t(word)").fetchall()) == want
    assert all(w.startswith(common_start(s)) for w, s in want.items())


DOCS = [(1, "Engineers and engineering", "x"), (2, "Data pipelines", "engineer, data pipeline"), (3, None, ""), (4, "engine", "y")]


@pytest.mark.parametrize("stemmed", [True, False])
def test_words_as_a_table_give_the_same(spark, monkeypatch, stemmed):
    docs = spark.createDataFrame(DOCS, "doc_id int, title string, description string")
    phrases, fields = ["engineer", "data pipeline", "pipeline", "a b"], ("title", "description")

    def found():
        scan = text_index.phrase_scan(docs, phrases, fields, stemmed)
        ranks = text_index.rank_scan(scan, phrases).collect()
        return ({(r.doc_id, r.dl, *sorted(map(tuple, r.hits))) for r in scan.collect()},
                {r.doc_id: pytest.approx(r["rank"]) for r in ranks})

    inlined = found()
    monkeypatch.setattr(text_index, "INLINE_WORDS", 0)
    assert found() == inlined
    assert set(inlined[1]) == ({1, 2, 4} if stemmed else {2})


def test_other_forms_of_a_word_are_recalled(spark):
    postings = spark.createDataFrame(
        [(1, "active", "Machine learning engineers", "acme", "agents"), (2, "active", "Chef", "beta", "one large language model"),
         (3, "active", "Waiter", "beta", "many large language models"), (4, "active", "Porter", "gamma", "nothing")],
        "id int, status string, title string, company string, description string").withColumn(
        "company_normalized", F.col("company"))
    scores = postings.select(F.col("id").alias("job_id"), F.lit(True).alias("hard_filter_pass"))
    profile = Profile("p", target_families=(), rare_skills=("large language model", "machine learning engineer"))
    assert {r.job_id for r in retrieval.recall_paths(postings, scores, profile).collect()} == {1, 2, 3}
    assert {r.job_id for r in retrieval.recall_paths(postings, scores, profile, stemmed=False).collect()} == {2}

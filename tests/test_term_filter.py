from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postgrain.operators import market as M
from postgrain.operators.term_filter import SLICE, may_reach, reaching_bits

WORDS = [f"kz{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]


def postings(spark):
    """Word i is in about 600 / (i + 1) postings; companies differ in size, some have no name."""
    rows = []
    for n in range(600):
        words = [w for i, w in enumerate(WORDS) if n % (i + 1) == 0]
        rows.append((None if n % 50 == 0 else f"c{n % 7 * (n % 3)}", " . ".join(words)))
    rows += [("c1", None), (None, None), ("c2", ""), ("c3", "kzaa kzaa kzaa")]
    return rows, spark.createDataFrame(rows, "company_normalized string, description string").repartition(5)


def brute(rows, terms_of):
    companies, count = defaultdict(set), Counter()
    for company, text in rows:
        for term in terms_of(text or ""):
            count[term] += 1
            companies[term].add(company)
    return {t: (len(companies[t]), n) for t, n in count.items()}


@pytest.mark.parametrize("least", [1, 2, 3, 40, 300])
@pytest.mark.parametrize("buckets", [SLICE, 4 * SLICE])
def test_terms_that_reach_the_threshold_keep_exact_counts(spark, least, buckets):
    rows, df = postings(spark)
    df = df.withColumn("description", F.regexp_replace("description", " [.] ", " 7 "))
    got = {r.term: (r.companies, r.postings)
           for r in M.term_counts(df, least=least, buckets=buckets).collect()}
    # a bare number between two words breaks bigrams across it, except where a word is repeated
    want = brute(rows, lambda t: set(t.split(" . ")) - {""} if "kzaa kzaa" not in t else {"kzaa", "kzaa kzaa"})
    assert {t: c for t, c in got.items() if c[1] >= least} == {
        t: c for t, c in want.items() if c[1] >= least}
    assert all(want[t] == c for t, c in got.items())


def test_rare_terms_are_dropped_before_the_shuffle(spark):
    rows, df = postings(spark)
    all_terms = M.term_counts(df, least=1).count()
    kept = M.term_counts(df, least=100).count()
    assert kept < all_terms / 2


def test_the_size_of_the_filter_never_changes_the_report(spark):
    _, df = postings(spark)
    reports = [M.discover_terms(df, min_postings=p, min_companies=c, buckets=b).collect()
               for p, c in ((3, 3), (2, 5)) for b in (SLICE, 16 * SLICE)]
    assert reports[0] == reports[1] and reports[2] == reports[3]
    assert len(reports[0]) == 40


def test_counters_stop_and_do_not_wrap(spark):
    df = spark.range(0, 3000, 1, 6).select(F.array(F.lit("x")).alias("t"))
    for least, expected in ((255, True), (1000, True)):
        bits = reaching_bits(df, "t", least, SLICE)
        assert df.limit(1).where(may_reach(F.lit("x"), bits, SLICE)).count() == expected
    assert spark.range(1).where(may_reach(F.lit("y"), reaching_bits(df, "t", 1, SLICE), SLICE)).count() == 0


def test_empty_tables(spark):
    _, df = postings(spark)
    assert M.discover_terms(df.where("false")).collect() == []
    assert M.term_counts(df.where("description IS NULL"), least=3).collect() == []


def test_sizes_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        reaching_bits(spark.range(1).select(F.array(F.lit("x")).alias("t")), "t", 2, 1000)

import random
import re
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postgrain.functions import terms as T
from postgrain.operators import market as M
from postgrain.operators.term_filter import SLICE, level_of_share, term_counters

STOP = ("the", "of", "c++")
ODD = (None, "", ".", "-", "a", "a.", "a--b", "the the of", "..ab..", "x" * 100, "12 13", "+-ab", "ab-", "ab-.", "ab.-",
       "-ab", "ab .-. cd", "ab 1 cd", "The OF cd", "ab\ncd", "Kab xKx İab", "éabé c++ c+ ab#")


def brute(text):
    if text is None:
        return None
    text = text.replace("K", "k").replace("İ", "İ".lower())
    found = re.findall(r"[a-zA-Z0-9][a-zA-Z0-9+#.]*(?:-[a-zA-Z0-9+#.]+)*", text)
    tokens = [t.lower().rstrip(".") for t in found]
    fit = [t if len(t) > 1 and not re.fullmatch("[0-9]+", t) and t not in STOP else None for t in tokens]
    return {t for t in fit if t} | {f"{a} {b}" for a, b in zip(fit, fit[1:]) if a and b}


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice("aB9.-+# \nKİé,12the") for _ in range(rng.randrange(60))) for _ in range(3000)]
    return [*ODD, *made, *ODD]


@pytest.mark.parametrize("size, rows", [(1, 1 << 16), (200, 7), (T.PIECE_BYTES, T.PIECE_ROWS)])
def test_terms_are_those_of_a_pattern_whatever_the_pieces(monkeypatch, size, rows):
    monkeypatch.setattr(T, "PIECE_BYTES", size)
    monkeypatch.setattr(T, "PIECE_ROWS", rows)
    given = texts()[: 300 if size < 1000 else None]
    want = [brute(t) for t in given]
    for kind in (pa.string(), pa.large_string()):
        got = T.terms_of(pa.array(given, kind).slice(1), STOP).to_pylist()
        assert [t if t is None else set(t) for t in got] == want[1:]
        assert all(t is None or len(t) == len(set(t)) for t in got)
    assert T.terms_of(pa.array([], pa.string()), STOP).to_pylist() == []


def test_hashes_are_those_of_the_terms(spark):
    given = [t for t in texts() if t][:500]
    terms, hashes = T.terms_of(pa.array(given), STOP).to_pylist(), T.hashes_of(pa.array(given), STOP).to_pylist()
    pairs = {(t, h) for row in zip(terms, hashes) for t, h in zip(*row, strict=True)}
    some = spark.createDataFrame(sorted(pairs), "t string, h long")
    assert some.where(T.term_hash(F.col("t")) != F.col("h")).count() == 0 < some.count()
    only = T.terms_of(pa.array(given), STOP, lambda h: h % 3 == 0).to_pylist()
    assert [set(t) for t in only] == [{t for t, h in zip(*row) if h % 3 == 0} for row in zip(terms, hashes)]
    assert dict(pairs)["ab"] == crc32(b"ab") * T._FACTOR


def reported(rows, limit, least):
    companies, postings = {}, {}
    for company, text in rows:
        for term in brute(text) or ():
            companies.setdefault(term, set()).add(company)
            postings[term] = postings.get(term, 0) + 1
    found = [(t, len(companies[t]), n) for t, n in postings.items() if n >= least and len(companies[t]) >= least]
    return sorted(found, key=lambda r: (-r[1], -r[2], r[0]))[:limit]


def counted_levels(monkeypatch):
    levels, count = [], M.term_counts

    def recorded(rows, stopwords, least, *more):
        levels.append(least)
        return count(rows, stopwords, least, *more)

    monkeypatch.setattr(M, "term_counts", recorded)
    return levels


def report(spark, rows, limit):
    df = spark.createDataFrame(rows, "company_normalized string, description string").repartition(3)
    return [tuple(r) for r in M.discover_terms(df, STOP, limit=limit, buckets=SLICE).collect()]


def test_only_terms_that_can_be_reported_are_counted(spark, monkeypatch):
    levels = counted_levels(monkeypatch)
    rows = [(f"c{n}", " 7 ".join([*(f"wide{i}" for i in range(12) if n % (i + 2)), *(f"rare{n // 4}x{i}" for i in range(60))]))
            for n in range(400)]
    assert report(spark, rows, 3) == reported(rows, 3, 3)
    # the rare terms are in four postings each
    assert len(levels) == 1 and levels[0] > 4


def test_frequent_terms_of_few_companies_do_not_hide_widespread_ones(spark, monkeypatch):
    levels = counted_levels(monkeypatch)
    rows = [("c0", " 7 ".join(f"local{i}" for i in range(40)))] * 300
    rows += [(f"c{n}", f"wide{n % 2} 7 wide{n % 3}x 7 wide") for n in range(60)] + [(None, "wide"), (None, None), ("c1", "")]
    assert report(spark, rows, 4) == reported(rows, 4, 3)
    assert levels[0] > 60 and levels[1:] == [3]
    # fewer terms than the report has room for
    assert report(spark, rows, 40) == reported(rows, 40, 3)


def test_the_last_reported_term_gives_the_second_level(spark, monkeypatch):
    levels = counted_levels(monkeypatch)
    rows = [(f"c{n % 20}", " 7 ".join([*(f"often{i}" for i in range(20)), "x"])) for n in range(200)]
    rows += [(f"d{n}", "wide0 7 wide1") for n in range(60)] + [(f"d{n}", "seldom") for n in range(5)]
    assert report(spark, rows, 4) == reported(rows, 4, 3)
    assert len(levels) == 2 and levels[0] > levels[1] == 20


@pytest.mark.parametrize("unnamed", [False, True])
def test_terms_of_all_companies_are_ranked_by_postings(spark, monkeypatch, unnamed):
    levels = counted_levels(monkeypatch)
    names = [None if unnamed else "c0", "c1", "c2"]
    rows = [(names[n % 3], " 7 ".join([*(f"wide{i}" for i in range(12) if n % (i + 2)), *(f"rare{n // 4}x{i}" for i in range(60))]))
            for n in range(400)]
    assert report(spark, rows, 3) == reported(rows, 3, 3)
    # the rare terms are in four postings each
    assert len(levels) == 1 and levels[0] > 4


def test_levels(spark):
    text = [(" ".join(["aa"] * 3),)] * 100 + [("bb 7 cc",)] * 10 + [("dd",)]
    counters = term_counters(spark.createDataFrame(text, "t string"), STOP, SLICE)
    # hits: aa and "aa aa" 100 each, bb and cc 10 each, dd 1
    assert level_of_share(counters, 1, 1) == 1
    assert level_of_share(counters, 8, 1) == level_of_share(counters, 8, 2) == 91
    assert level_of_share(counters, 8, 3) == 10 and level_of_share(counters, 8, 6) == 1

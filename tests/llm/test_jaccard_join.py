import random
import re

import pytest
from pyspark.sql import Row

from postgrain.llm.components import components
from postgrain.llm.jaccard_join import near_duplicates

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def corpus(seed, count=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 90]))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for d in range(count):
        words = list(rng.choice(base[:6] if d % 2 else base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = rng.randrange(len(words))
            words[at:at + rng.choice([0, 1, 1])] = [f"n{rng.random()}"] * rng.choice([0, 1, 1])
        if d % 7 == 0:
            words += passage
        rows.append((d * 3, " ".join(words).upper() if d % 5 == 0 else "\n".join(words)))
    return rows + [(2000, ""), (2001, None), (2002, " \t "), (2003, "one"), (2004, "ONE")]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_comparing_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"sketch_cells": 64, "hot_rows": 3, "salts": 3, "filter_bits": 64}):
        got = sorted(tuple(r) for r in near_duplicates(docs, **options).collect())
        assert got == brute_force(rows)


def test_odd_tables(spark):
    schema = "doc_id long, text string, n long, `component.id` string, TEXT int"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    long = "alpha beta gamma delta epsilon " * 40_000
    rows = [(5, "a b c d e f", 1, "x", 1), (5, "a b c d e f", 1, "x", 1), (None, "a b c d e f", 1, "x", 1),
            (9, long, 1, "x", 1), (2, long + "end", 1, "x", 1), (None, "only here", None, None, None),
            (None, None, None, None, None)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    # the long text has 5 distinct shingles, its copy one more: 5 of 6 are shared
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (9, 5, 2), (2, 6, 2),
                          (None, 1, None), (None, 0, None)], key=repr)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame([Row(a=a, b=b) for a, b in links])).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def one_node_per_id(rows):
    """Components where all rows of an id are one node, comparing all rows."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (9, b + " tail"), (5, c), (20, c + " end"), (20, None), (21, ""), (2, "alone here"),
            (4, c), (4, "other " + c), (30, a), (30, b), (31, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = one_node_per_id(rows)
    assert (9, 37, 3) in want and (20, 0, 3) in want
    for parts in (1, 6):
        assert sorted(tuple(r) for r in near_duplicates(docs.repartition(parts)).collect()) == want


def test_random_ids_with_several_texts(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(90), t) for _, t in corpus(4, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in near_duplicates(docs, sketch_cells=64, hot_rows=3, salts=3, filter_bits=64).collect())
    assert got == one_node_per_id(rows)

"""The manifest against trees built node by node, for blocks of several heights."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postgrain.llm.merkle_manifest import manifest, nodes_in, place

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """Root, and for every leaf the runs on its way up: (place in the run, run)."""
    ways = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[k:k + 3] for k in range(0, len(hashes), 3)]
        for way, k in zip(ways, range(len(at)), strict=True):
            way.append((at[k] % 3, runs[at[k] // 3]))
            at[k] //= 3
        hashes = [digest("".join(run)) for run in runs]
    return hashes[0], ways


def expected(rows, changed=lambda row: row):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        found.append((mine, *tree([leaf_of(r) for r in mine])))
    root, tops = tree([subroot for _, subroot, _ in found])
    out = []
    for (mine, subroot, ways), top in zip(found, tops, strict=True):
        for row, way in zip(mine, ways, strict=True):
            fold, proof = leaf_of(changed(row)), ""
            for k, run in way + top:
                proof += "".join(run[:k] + run[k + 1:])
                fold = digest("".join([*run[:k], fold, *run[k + 1:]]))
            out.append((row[0], leaf_of(row), subroot, root, digest(proof), fold, fold == root))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("levels", range(1, 8))
def test_every_node_has_its_own_place(levels):
    found = np.concatenate([place(levels, d, np.arange(3**d)) for d in range(levels)])
    assert sorted(found.tolist()) == list(range(nodes_in(levels)))


def test_halves_stay_together():
    # four levels: two above, then nine subtrees of two levels each
    assert place(4, 1, np.arange(3)).tolist() == [1, 2, 3]
    assert place(4, 2, np.array([0, 1, 8])).tolist() == [4, 8, 36]
    assert place(4, 3, np.array([0, 1, 2, 3, 26])).tolist() == [5, 6, 7, 9, 39]


ROWS = [(i, f"src{i % 3}" if i % 7 else None, "en" if i % 2 else None, i * 3, f"line {i}\nmore é") for i in range(83)]
ODD = [(None, "x", None, None, None), (None, "x", None, None, None), (5, "x", None, None, ""), (5, "x", "de", 0, "a\nb"),
       (5, "x", "de", 0, "a\nb"), (6, "", "de", 1, "long " * 50_000), (7, "é", "de", 1, "\n"), (8, "z", None, 0, "t")]


@pytest.mark.parametrize(("rows", "height"), [(ROWS, 1), (ROWS, 7), (ODD, 1), (ROWS[:1], 7)])
def test_as_built_node_by_node(spark, rows, height):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = got(manifest(frame, height=height))
    assert found == expected(rows)
    assert all(r[-1] for r in found)


def test_tampering_is_found(spark):
    rows = ROWS + ODD

    def changed(row):
        return (*row[:4], row[4] and row[4].replace("\n", ""))

    found = got(manifest(spark.createDataFrame(rows, SCHEMA), F.replace("text", F.lit("\n"), F.lit("")), height=2))
    assert found == expected(rows, changed)
    assert {r[-1] for r in found} == {True, False}


def test_other_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a", "en", 2, "hi", 1, 2, 3, 4)], SCHEMA + ", `tree` int, `pos` int, `odd.name` int, `n` int")
    assert got(manifest(frame)) == expected([(1, "a", "en", 2, "hi")])
    clash = frame.withColumnRenamed("odd.name", "TEXT")
    assert got(manifest(clash)) == expected([(1, "a", "en", 2, "hi")])
    assert manifest(frame.limit(0)).collect() == []

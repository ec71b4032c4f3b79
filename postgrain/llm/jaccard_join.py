"""Exact Jaccard links between documents: a blocked sparse product of documents and n-grams.

The incidence matrix has a row per distinct shingle set and a column per shingle. Two sets of sizes
m and n can reach the likeness t only with an overlap of t / (1 + t) * (m + n). If the shingles of
every set are put in one common order, two such sets therefore meet among their first
``n - ceil(t * n) + 1``; only that part of the matrix is multiplied, column by column. Columns that
many sets share come last in the order, which a fixed-size count sketch of all shingles gives; the
sketch only moves work around, any order gives the same links.

The product is not expanded inside groups that are already known to hang together:

1. in each column the set with the fewest rarer shingles is the pivot, and every other set is paired
   with it alone; pairs that fail the size bounds go;
2. the pairs that link give components; what is left of a column are pairs of sets in different
   components, listed component by component and cut by the same bounds.

The overlap of a pair is the product of its two rows of the matrix. The columns are cut into blocks; the
counts of one block after the other are added up, and a pair is given up as soon as its count and
what is left of the smaller row can no longer reach the bound.

Every link between two sets is either inside a component after step 1 or among the pairs of step 2. Rows
of the matrix are known by the digests of their sets, so that it does not matter which documents,
or how many, have a set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.llm.components import components
from postgrain.llm.shared import picked, slices, staged, utf8
from postgrain.llm.wordhash import mixed, shingles, words

PARTS = 64  # the sketch travels in so many pieces
BLOCKS = 8  # of columns, when the overlap of a pair is counted
KEY = ["s1", "s2"]  # digests of a set
U = np.uint64


def near_duplicates(
    docs: DataFrame, words_per_shingle: int = 5, percent: int = 75, sketch_cells: int | None = None,
    hot_rows: int = 20_000, salts: int = 32, filter_bits: int = 1 << 23,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Words are the runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered; a set holds the distinct
    shingles, or the whole sequence where there are fewer words. Two documents link when
    ``100 * overlap >= percent * union``. ``component_id`` is the smallest doc_id reachable by links.

    Null or blank text: no shingles, linked with nothing, its own component. Repeated rows are
    returned as often as they come. Rows that share a doc_id are one node of the link graph, whatever
    their texts. A null doc_id links nothing; its component is that of the equal sets that have an id, else
    null. Other columns, whatever their names, are ignored; an empty table gives an empty result.

    ``sketch_cells`` is the width of each of the two sketch rows (by default eight cells a row of
    ``docs``, between 2**16 and 2**22, rounded up to a power of two), ``hot_rows`` the estimated count
    from which a column is split over ``salts`` partitions, ``filter_bits`` the size of the filter
    that keeps the sets of unpaired documents from moving. None of them changes the result.
    """
    texts = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if sketch_cells is None:
        sketch_cells = 1 << min(22, max(16, (8 * docs.count() - 1).bit_length()))
    profile = staged(texts.mapInArrow(
        _profiler(words_per_shingle, sketch_cells),
        "doc_id long, n long, s1 long, s2 long, part int, cells binary"), "profile")
    rows = profile.where("part is null").select("doc_id", "n", *KEY)
    # a class: the smallest id that has the set
    classes = staged(rows.where("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("class")), "classes")

    sketch = texts.sparkSession.sparkContext.broadcast(_sketch(profile, sketch_cells))
    columns = staged(_columns(texts, sketch, words_per_shingle, percent, hot_rows, salts), "columns")
    sketch.destroy()  # stored columns need it no more
    stars = staged(_ordered(_stars(columns, percent)), "star-pairs")
    found = _linked(stars, texts, classes, words_per_shingle, percent, filter_bits)
    shared = staged(_same_id(rows, classes), "same-ids")
    roots = components(found.union(shared))
    rest = _ordered(_across(columns, classes, roots, percent)).join(stars, ["a1", "a2", "b1", "b2"], "left_anti")
    rest = staged(rest, "rest-pairs")
    more = _linked(rest, texts, classes, words_per_shingle, percent, filter_bits)
    roots = components(found.union(more).union(shared))

    named = classes.join(roots, classes["class"] == roots["node"], "left").select(
        *KEY, F.coalesce("root", "class").alias("component_id"))
    # equal sets may be a third of all rows: both sides are plain tables, so skewed parts are split
    linked = rows.where("n > 0").join(staged(named, "named"), KEY, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                       F.col("doc_id").alias("component_id"))
    return linked.union(alone.where("doc_id is null")).union(_as_other_rows(alone, rows, classes, roots))


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of the sets of one document; ids with a single set move as minima only."""
    known = rows.where("n > 0 and doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high"))
    several = several.where("low != high").select("doc_id")
    sets = known.join(several, "doc_id", "left_semi").distinct().join(classes, KEY).select("doc_id", "class")
    first = sets.groupBy("doc_id").agg(F.min("class").alias("a"))
    return sets.join(first, "doc_id").select("a", F.col("class").alias("b")).where("a != b").distinct()


def _as_other_rows(alone: DataFrame, rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows without shingles: their own component, or that of another row of their doc_id."""
    alone = alone.where("doc_id is not null")
    sets = rows.where("n > 0").join(alone.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    first = sets.join(classes, KEY).groupBy("doc_id").agg(F.min("class").alias("class"))
    other = first.join(roots, first["class"] == roots["node"], "left").select("doc_id", F.coalesce("root", "class").alias("other"))
    return alone.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("other", "component_id").alias("component_id"))


# --- passes over the texts ----------------------------------------------------------------------


def _sets(batch: pa.RecordBatch, size: int):
    """Shingles of the rows of a batch with their counts, and a two-word digest of each set."""
    grams, counts = shingles(*words(*utf8(batch.column("text"))), size)
    heads = np.cumsum(counts) - counts
    digests = np.zeros((2, len(counts)), U)
    full = counts > 0
    for k in (0, 1):
        if full.any():
            digests[k, full] = np.add.reduceat(mixed(grams, 11 + k), heads[full])
    return grams, counts, heads, digests.view(np.int64)


class _Seen:
    """Which sets this task met already: copies need no second row in the matrix."""

    def __init__(self):
        self.digests = set()

    def fresh(self, counts, digests) -> np.ndarray:
        new = np.zeros(len(counts), bool)
        for k, key in enumerate(zip(counts.tolist(), *digests.tolist(), strict=True)):
            if key[0] and key not in self.digests:
                self.digests.add(key)
                new[k] = True
        return new


def _cells(grams: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mixed(grams, 21 + k) % U(cells)).astype(np.int64) for k in (0, 1)]


def _packed(cells: np.ndarray) -> bytes:
    return zlib.compress(cells.astype("<u4").tobytes(), 1)


def _unpacked(piece: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(piece), "<u4")


def _profiler(size: int, cells: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()),
                        ("s2", pa.int64()), ("part", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros((2, cells), np.uint32), _Seen()
        for batch in slices(batches):
            grams, counts, _, digests = _sets(batch, size)
            new = grams[np.repeat(seen.fresh(counts, digests), counts)]
            for k, at in enumerate(_cells(new, cells)):
                np.add.at(sketch[k], at, 1)
            nothing = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(digests[0]),
                 pa.array(digests[1]), *nothing], schema=schema)
        if sketch.any():
            pieces = [_packed(x) for x in np.split(sketch.reshape(-1), PARTS)]
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(range(PARTS), pa.int32()),
                 pa.array(pieces, pa.binary())], schema=schema)

    return run


def _sketch(profile: DataFrame, cells: int) -> np.ndarray:
    """Both rows of the count sketch over all tasks; 2 * cells counters reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, piece in zip(batch["part"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                sums[part] = np.minimum(sums.get(part, 0) + _unpacked(piece).astype(np.int64), 2**32 - 1)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(sums), pa.int32()),
             "cells": pa.array([_packed(x) for x in sums.values()], pa.binary())})

    pieces = profile.where("part is not null").select("part", "cells")
    summed = pieces.repartition(PARTS, "part").mapInArrow(add, "part int, cells binary").collect()
    if not summed:
        return np.zeros((2, cells), np.uint32)
    return np.concatenate([_unpacked(r.cells) for r in sorted(summed, key=lambda r: r.part)]).reshape(2, cells)


def _columns(texts: DataFrame, shared: Broadcast, size: int, percent: int, hot: int, salts: int) -> DataFrame:
    """(gram, salt, s1, s2, n, i, pivot) of shingles that two sets at least have in their first part.

    ``i`` counts the rarer shingles of the set; ``pivot`` is the set of the column with the smallest.
    """
    cells = shared.value.shape[1]
    noise = float(shared.value[0].sum()) / cells
    schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("n", pa.int32()), ("i", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, _Seen()
        for batch in slices(batches):
            grams, counts, heads, digests = _sets(batch, size)
            valid = np.asarray(batch.column("doc_id").is_valid())
            if not len(grams):
                continue
            est = np.minimum(*(table[k][at] for k, at in enumerate(_cells(grams, cells))))
            # rarest first; equal estimates go by the shingle itself, in two steps to be exact
            rank = (np.minimum(est, 2**24 - 1).astype(U) << U(40)) | (grams >> U(24))
            rows, places = [], []
            # sets that no id has link nothing
            counts_with_id = np.where(valid, counts, 0)
            for d in np.flatnonzero(seen.fresh(counts_with_id, digests)):
                a, n = heads[d], counts[d]
                first = n - (percent * n + 99) // 100 + 1
                rows.append(a + np.argsort(rank[a:a + n], kind="stable")[:first])
                places.append((d, first))
            if not rows:
                continue
            at = np.concatenate(rows)
            docs, firsts = np.array(places).T
            of = np.repeat(docs, firsts)
            i = np.arange(len(at)) - np.repeat(np.cumsum(firsts) - firsts, firsts)
            many = est[at] > noise + hot
            salt = np.where(many, 1 + mixed(digests[0][of].view(U), 31) % U(salts), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[at].view(np.int64)), pa.array(salt.astype(np.int32)),
                 pa.array(digests[0][of]), pa.array(digests[1][of]), pa.array(counts[of].astype(np.int32)),
                 pa.array(i.astype(np.int32))], schema=schema)

    rows = texts.mapInArrow(run, "gram long, salt int, s1 long, s2 long, n int, i int")
    together = "partition by gram, salt"
    met = rows.withColumn("met", F.expr(f"count(*) over ({together})")).where("met > 1 or salt > 0")
    pivot = F.expr(f"min(struct(i, s1, s2, n)) over ({together})")
    return met.drop("met").withColumn("pivot", pivot)


# --- pairs --------------------------------------------------------------------------------------


def _possible(m: Column, n: Column, left: Column, right: Column, percent: int) -> Column:
    """Whether sets of m and n shingles, of which ``left`` and ``right`` remain, can still link."""
    need = percent * (m + n)
    return ((100 + percent) * F.least(left, right) >= need) & (100 * F.least(m, n) >= percent * F.greatest(m, n))


def _pair(left: str, right: str) -> list[Column]:
    return [F.col(f"{left}{k}").alias(f"{side}{n}") for side, left in (("x", left), ("y", right)) for n, k in enumerate(KEY, 1)]


def _stars(columns: DataFrame, percent: int) -> DataFrame:
    """Pairs (x1, x2, y1, y2) of each set with the pivot of its column; salted columns join their pivots."""
    own = columns.where("s1 != pivot.s1 or s2 != pivot.s2").where(_possible(
        F.col("n"), F.col("pivot.n"), F.expr("n - i"), F.expr("pivot.n - pivot.i"), percent)
    ).select(*_pair("", "pivot."))
    heads = columns.where("salt > 0").select("gram", "salt", "pivot").distinct()
    best = heads.groupBy("gram").agg(F.min("pivot").alias("best"))
    heads = heads.join(best, "gram").where("pivot != best").select(*_pair("pivot.", "best."))
    return own.union(heads)


def _across(columns: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (x1, x2, y1, y2) of a column whose sets are in different components and can still link."""
    named = classes.where("class is not null").join(roots, classes["class"] == roots["node"], "left").select(
        *KEY, F.coalesce("root", "class").alias("comp"))
    rows = staged(columns.select("gram", *KEY, "n", "i").join(named, KEY), "named-columns")
    groups = rows.groupBy("gram", "comp").agg(
        F.max(F.expr("n - i")).alias("left"), F.min("n").alias("small"), F.max("n").alias("large"))
    split = groups.groupBy("gram").agg(F.count("*").alias("comps")).where("comps > 1").select("gram")
    groups = staged(groups.join(split, "gram"), "split-columns")
    a, b = groups.alias("a"), groups.alias("b")
    meet = a.join(b, F.expr("a.gram = b.gram and a.comp < b.comp")).where(
        (F.lit(100 + percent) * F.least("a.left", "b.left") >= F.lit(percent) * F.expr("a.small + b.small"))
        & F.expr(f"100 * a.large >= {percent} * b.small and 100 * b.large >= {percent} * a.small")
    ).select("a.gram", F.col("a.comp").alias("comp"), F.col("b.comp").alias("other"))
    x = meet.join(rows, ["gram", "comp"]).select(
        "gram", F.col("other").alias("comp"), F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.col("n").alias("m"),
        F.expr("n - i").alias("rest"))
    return x.join(rows, ["gram", "comp"]).where(
        _possible(F.col("m"), F.col("n"), F.col("rest"), F.expr("n - i"), percent)
    ).select("x1", "x2", F.col("s1").alias("y1"), F.col("s2").alias("y2"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a1, a2, b1, b2) of sets, the smaller digest first."""
    x, y = (F.struct(F.col(f"{side}1").alias("one"), F.col(f"{side}2").alias("two")) for side in "xy")
    return pairs.where("x1 != y1 or x2 != y2").select(
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).select(
        F.col("a.one").alias("a1"), F.col("a.two").alias("a2"), F.col("b.one").alias("b1"), F.col("b.two").alias("b2")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(a, b): the classes of the pairs of sets that link, a < b."""
    nodes = pairs.select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).union(pairs.select("b1", "b2")).distinct()
    nodes = staged(nodes.join(classes.where("class is not null"), KEY), "paired-classes")
    # plain tables on both sides, so the parts of a pivot with many pairs are split
    a, b = (nodes.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("class").alias(x)) for x in "ab")
    named = staged(pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where("a != b"), "named-pairs")
    found = _verified(named, _paired_sets(texts, nodes, size, bits), percent)
    return staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def _paired_sets(texts: DataFrame, nodes: DataFrame, size: int, bits: int) -> DataFrame:
    """(class, s1, s2, n, blocks) of the sets of the documents that name a class in ``nodes``.

    A filter of fixed size, built from all nodes, keeps the other documents' sets from being made
    and moved; what it lets through by chance, or as another text of such a document, finds no
    partner in the join.
    """
    words_ = nodes.select(F.pmod(F.xxhash64("class"), F.lit(bits)).alias("bit")).groupBy(
        F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    mask = np.zeros(bits // 64, np.int64)
    filled = words_.toArrow()  # at most bits / 64 rows
    mask[filled["word"].to_numpy()] = filled["mask"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(mask.view(U))
    schema = pa.schema([("class", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int32()), ("blocks", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("bit"))
            wanted = (shared.value[at // 64] >> (at % 64).astype(U)) & U(1) == 1
            for part in slices([batch.filter(pa.array(wanted))]):
                grams, counts, heads, digests = _sets(part, size)
                # a set's shingles rise, so its blocks of columns follow one another
                row = np.repeat(np.arange(len(counts)), counts)
                block = (grams >> U(64 - BLOCKS.bit_length() + 1)).astype(np.int64)
                inner = np.bincount(row * BLOCKS + block, minlength=len(counts) * BLOCKS)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inner)).astype(np.int32)), pa.array(grams.view(np.int64)))
                blocks = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BLOCKS), lists)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests[0]), pa.array(digests[1]), pa.array(counts.astype(np.int32)), blocks],
                    schema=schema)

    keyed = texts.where("doc_id is not null").select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("bit"))
    sets = staged(keyed.mapInArrow(run, "class long, s1 long, s2 long, n int, blocks array<array<long>>"), "sets")
    shared.destroy()
    return sets


def _overlap(percent: int) -> Column:
    """The overlap of two rows, added up over blocks of columns; less than the bound where it cannot be reached."""
    need = F.lit(percent) * (F.col("na") + F.col("nb"))

    def step(state: Column, k: Column) -> Column:
        x, y = F.get("xa", k), F.get("xb", k)
        open_ = F.lit(100 + percent) * (state["count"] + F.least(state["left"], state["right"])) >= need
        count = F.when(open_, state["count"] + F.size(F.array_intersect(x, y))).otherwise(state["count"])
        return F.struct(count.alias("count"), (state["left"] - F.size(x)).alias("left"), (state["right"] - F.size(y)).alias("right"))

    start = F.struct(F.lit(0).alias("count"), F.col("na").alias("left"), F.col("nb").alias("right"))
    return F.aggregate(F.array(*(F.lit(k) for k in range(BLOCKS))), start, step, lambda s: s["count"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose overlap, counted over the whole sets, reaches the bound."""
    left, right = (sets.select(F.col("class").alias(x), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"),
                               F.col("n").alias(f"n{x}"), F.col("blocks").alias(f"x{x}")) for x in "ab")
    return pairs.join(left, ["a", "a1", "a2"]).join(right, ["b", "b1", "b2"]).where(
        F.lit(100 + percent) * _overlap(percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))).select("a", "b")

"""A Merkle manifest of a dataset whose trees are stored as blocks in van Emde Boas order.

Every source has a tree of its rows in the order of their ids, and the roots of the sources have a
tree above them. Up to three neighbours make a parent. A tree is cut into aligned subtrees of a
fixed height, its blocks: the nodes of a block are one binary value, laid out by splitting its levels at
half height again and again, the upper half first, then the lower subtrees from left to right. Where
a node stands follows from its depth and number by arithmetic alone, which serves the
construction (children to parents) as well as the retrieval of siblings. The roots of the blocks are
the leaves of the blocks one layer up, until a tree has a single block.

A block is one task's work and has a bounded size, so neither a large source nor a large table is
ever in one place. Only digests, ids and places are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.llm.shared import bucket_of, picked, shuffle_partitions, split_points, staged

FANOUT = 3
DIGEST = 32
#: Columns of a row that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- places of nodes ----------------------------------------------------------------------------


def nodes_in(levels: int) -> int:
    """How many nodes a full tree of so many levels has."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def place(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes ``number`` at ``depth`` (0: the root) of a full tree of ``levels`` levels."""
    number = np.asarray(number, np.int64)
    at = np.zeros_like(number)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, depth = levels - upper, depth - upper
        below = FANOUT**depth
        subtree = number // below
        at = at + nodes_in(upper) + subtree * nodes_in(lower)
        number, levels = number - subtree * below, lower
    return at


@lru_cache(maxsize=64)
def _places(levels: int) -> tuple[np.ndarray, ...]:
    return tuple(place(levels, d, np.arange(FANOUT**d)) for d in range(levels))


def combined(parts: list[bytes]) -> bytes:
    """The digest of digests, which enter as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


@dataclass
class Block:
    """An aligned subtree of ``levels`` levels over ``leaves`` leaves, its digests in van Emde Boas order."""

    levels: int
    leaves: int
    data: bytes | bytearray

    def width(self, depth: int) -> int:
        """Nodes at a depth: the ones on the right may be missing."""
        return -(-self.leaves // FANOUT ** (self.levels - 1 - depth))

    def node(self, depth: int, number: int) -> bytes:
        at = int(_places(self.levels)[depth][number]) * DIGEST
        return bytes(self.data[at:at + DIGEST])

    @property
    def root(self) -> bytes:
        return self.node(0, 0)

    def run(self, depth: int, number: int) -> tuple[int, list[bytes]]:
        """The place of a node among the children of its parent, and those children."""
        first = number - number % FANOUT
        last = min(first + FANOUT, self.width(depth))
        return number - first, [self.node(depth, k) for k in range(first, last)]

    def steps(self, number: int) -> list[tuple[int, list[bytes]]]:
        """``run`` of a leaf and of its ancestors below the root, upwards."""
        return [self.run(d, number // FANOUT ** (self.levels - 1 - d)) for d in range(self.levels - 1, 0, -1)]


def built(leaves: list[bytes], levels: int) -> Block:
    """The block over ``leaves``; on each level, the last parent may have fewer children, even one."""
    block = Block(levels, len(leaves), bytearray(nodes_in(levels) * DIGEST))
    row = leaves
    for depth in range(levels - 1, -1, -1):
        for at, digest in zip(_places(levels)[depth][:len(row)].tolist(), row, strict=True):
            block.data[at * DIGEST:(at + 1) * DIGEST] = digest
        if depth:
            row = [combined(row[k:k + FANOUT]) for k in range(0, len(row), FANOUT)]
    return block


def levels_of(leaves: int, height: int) -> int:
    """Levels of a tree's blocks: ``height + 1``, or fewer where the whole tree is lower."""
    levels, width = 1, 1
    while width < leaves and levels <= height:
        levels, width = levels + 1, width * FANOUT
    return levels


def packed(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """Steps as bytes: place, count and the siblings' digests of each."""
    return b"".join(bytes([k, len(run)]) + b"".join(run[:k] + run[k + 1:]) for k, run in steps)


def proof(steps: bytes) -> bytes:
    """Hexadecimal text of all siblings, level by level, left to right."""
    out, at = [], 0
    while at < len(steps):
        size = (steps[at + 1] - 1) * DIGEST
        out.append(steps[at + 2:at + 2 + size].hex().encode())
        at += 2 + size
    return b"".join(out)


def folded(digest: bytes, steps: bytes) -> bytes:
    """The root that a digest gives with its siblings."""
    at = 0
    while at < len(steps):
        k, count = steps[at], steps[at + 1]
        text = steps[at + 2:at + 2 + (count - 1) * DIGEST].hex()
        cut = k * 2 * DIGEST
        digest = hashlib.sha256((text[:cut] + digest.hex() + text[cut:]).encode()).digest()
        at += 2 + (count - 1) * DIGEST
    return digest


# --- layers of blocks ---------------------------------------------------------------------------


def layers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Blocks of all trees of ``nodes`` (tree, n, pos, digest, id, other), a table per layer.

    ``n`` is the tree's number of leaves and ``pos`` a leaf's number from 0. Each table has a row per
    block: (tree, n, block, levels, ids, others, data, root). The first layer keeps ``id`` and ``other``
    of its leaves. The last layer that has a tree has it in one block.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while True:
        size = FANOUT**height
        grouped = nodes.groupBy("tree", "n", F.expr(f"pos div {size}").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", "id", "other"))).alias("leaves"))
        flat = grouped.select("tree", "n", "block", F.col("leaves.digest").alias("digests"),
                              F.col("leaves.id").alias("ids"), F.col("leaves.other").alias("others"))
        out.append(staged(flat.mapInArrow(_builder(height), _LAYER), "merkle-blocks"))
        if most <= size:
            return out
        most = -(-most // size)
        nodes = out[-1].where(F.col("n") > size).select(
            "tree", F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"))


_LAYER = ("tree string, n long, block long, levels int, ids array<long>, others array<binary>, data binary, root binary")
_KINDS = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("levels", pa.int32()),
                    ("ids", pa.list_(pa.int64())), ("others", pa.list_(pa.binary())), ("data", pa.binary()),
                    ("root", pa.binary())])
_PART = 16  # blocks that a task holds in unpacked form


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _PART):
            yield batch.slice(at, _PART)


def _builder(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            blocks = [built(digests, levels_of(n, height))
                      for n, digests in zip(batch["n"].to_pylist(), batch["digests"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch["tree"].cast(pa.string()), batch["n"].cast(pa.int64()), batch["block"].cast(pa.int64()),
                pa.array([b.levels for b in blocks], pa.int32()), batch["ids"].cast(_KINDS.field("ids").type),
                batch["others"].cast(_KINDS.field("others").type), pa.array([bytes(b.data) for b in blocks], pa.binary()),
                pa.array([b.root for b in blocks], pa.binary())], schema=_KINDS)

    return run


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, path) of the blocks a layer down, whose roots are the leaves of these."""
    kinds = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.binary())])
    for batch in _parts(batches):
        rows = []
        for row in batch.to_pylist():
            block = Block(row["levels"], len(row["ids"]), row["data"])
            first = row["block"] * FANOUT ** (block.levels - 1)
            rows += [(row["tree"], first + k, packed(block.steps(k)) + row["path"]) for k in range(block.leaves)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def paths(tables: list[DataFrame], height: int, above: DataFrame | None = None) -> DataFrame:
    """(tree, block, path) for each block of the first of ``tables``: packed steps from its root upwards.

    ``above`` (tree, path) are steps from the roots of the trees on; by default none.
    """
    found = None
    for k in range(len(tables) - 1, -1, -1):
        whole = tables[k].where(F.col("n") <= FANOUT**height).select("tree", "block")
        whole = whole.withColumn("path", F.lit(b"")) if above is None else whole.join(above, "tree")
        found = whole if found is None else found.unionByName(whole)
        if k:
            rows = tables[k].join(found, ["tree", "block"]).select("tree", "block", "levels", "ids", "data", "path")
            found = staged(rows.mapInArrow(_descended, "tree string, block long, path binary"), "merkle-paths")
    return found


# --- the manifest -------------------------------------------------------------------------------


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row: ``-`` for null, else byte count, ``:`` and value of every field, one after the other."""
    texts = [c.cast("string") for c in fields.values()]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n`` (rows of the tree) and ``pos``: numbers from 0 by id, null first, then digest.

    Ids are dealt by ranges; the counts of every tree in every range give the offsets.
    """
    points = split_points(rows, "id", shuffle_partitions(rows.sparkSession))
    placed = rows.withColumn("range", bucket_of(F.col("id"), points))
    # the counts read ids and sources alone
    counts = staged(placed.groupBy("tree", "range").count(), "merkle-counts")
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    totals = counts.groupBy("tree").agg(F.sum("count").alias("n"))
    offsets = staged(offsets.join(totals, "tree"), "merkle-offsets")
    inside = Window.partitionBy("tree", "range").orderBy(F.asc_nulls_first("id"), "digest")
    numbered = placed.withColumn("pos", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["tree", "range"]).withColumn("pos", F.col("pos") + F.col("offset")).drop("range", "offset")


def _top_nodes(roots: DataFrame) -> DataFrame:
    """The roots of the sources as leaves of one tree, in the bytewise order of the sources."""
    key = "tree"
    parts = shuffle_partitions(roots.sparkSession)
    ordered = roots.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    ordered = staged(ordered, "merkle-sources")  # stored, so that part never changes
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part").count()
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"),
                            F.sum("count").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("part").orderBy(key)
    return ordered.withColumn("pos", F.row_number().over(inside) - 1).join(offsets, "part").select(
        F.lit("").alias("tree"), "n", (F.col("pos") + F.col("offset")).alias("pos"), F.col("root").alias("digest"),
        F.lit(None).cast("long").alias("id"), F.col("tree").cast("binary").alias("other"))


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``.

    ``leaf`` covers the five columns. Per source, rows stand by rising doc_id; runs of three become
    their digest until one is left, ``subroot`` (a lone leaf itself). The subroots by source, null first,
    then bytewise, give ``root`` alike. ``proof_sha256`` is the digest of all siblings from the leaf to the
    root; ``folded_root`` is computed anew from the row's leaf and these siblings, ``verified`` whether it
    is ``root``. ``tampered`` is an expression over the five columns: the text the row has by the time it
    is verified (by default, its own).

    Null fields count as ``-``. Rows of one doc_id stand by their leaf, those without a doc_id first; equal rows
    share a leaf and stand side by side. Other columns are ignored; an empty table gives an empty result.
    ``height`` is that of the stored blocks (3**height leaves) and changes no result.
    """
    rows = picked(docs, *FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("binary")
    if tampered is not None:
        other = F.when(~tampered.eqNullSafe(F.col("text")), leaf(fields | {"text": tampered}))
    nodes = rows.select(
        # null before every other source
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("id"), leaf(fields).alias("digest"), other.alias("other"))
    tables = layers(_numbered(nodes), height)
    whole = [t.where(F.col("n") <= FANOUT**height) for t in tables]
    roots = whole[0].select("tree", "root")
    for table in whole[1:]:
        roots = roots.unionByName(table.select("tree", "root"))
    roots = staged(roots, "merkle-roots")
    top = layers(_top_nodes(roots), height)
    root = top[-1].select("root").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _RESULT)
    named = top[0].join(paths(top, height), ["tree", "block"]).select("levels", "ids", "others", "data", "path")
    above = staged(named.mapInArrow(_source_paths, "tree string, path binary"), "merkle-top")
    found = paths(tables, height, above).join(roots.withColumnRenamed("root", "subroot"), "tree")
    # unique on both sides: a row per block
    rows = tables[0].join(found, ["tree", "block"]).select("levels", "ids", "others", "data", "path", "subroot")
    return rows.mapInArrow(_prover(bytes(root[0])), _RESULT)


def _source_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        rows = []
        for row in batch.to_pylist():
            block = Block(row["levels"], len(row["ids"]), row["data"])
            rows += [(bytes(name).decode(), packed(block.steps(k)) + row["path"]) for k, name in enumerate(row["others"])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1] for r in rows], pa.binary())], names=["tree", "path"])


_RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def _prover(root: bytes):
    """A row per leaf of the first layer, its proof followed from the leaf to the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            for row in batch.to_pylist():
                yield _checked(Block(row["levels"], len(row["ids"]), row["data"]), row, root)

    return run


def _checked(block: Block, row: dict, root: bytes) -> pa.RecordBatch:
    digests, proofs, ends = [], [], []
    for k in range(block.leaves):
        digests.append(block.node(block.levels - 1, k))
        steps = packed(block.steps(k)) + row["path"]
        proofs.append(hashlib.sha256(proof(steps)).hexdigest())
        ends.append(folded(row["others"][k] or digests[-1], steps))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(row["ids"], pa.int64()), "leaf": [x.hex() for x in digests],
        "subroot": [row["subroot"].hex()] * block.leaves, "root": [root.hex()] * block.leaves, "proof_sha256": proofs,
        "folded_root": [x.hex() for x in ends], "verified": pa.array([x == root for x in ends], pa.bool_())})

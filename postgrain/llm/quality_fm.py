"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of a text.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairwise sum is taken in
linear time: half of the square of the sum of v_i x_i less the sum of their squares, per factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postgrain.llm.shared import beside, mapped, picked, slices, staged, utf8
from postgrain.llm.wordhash import words

U = np.uint64
STATISTICS = ("bytes", "words", "lines", "word_length", "distinct", "again", "upper", "digits", "marks", "symbols",
              "bars", "breaks", "beyond_ascii", "no_words")
#: What the table says of a text: its length, and whether that is missing or another one than the text has.
METADATA = ("declared", "undeclared", "misdeclared")
EXTRA = len(STATISTICS) + len(METADATA)
_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _BAR, _BREAK, _SPACE, _BEYOND = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _BEYOND
_CLASS[list(b".,;:!?'\"()-")], _CLASS[ord("|")], _CLASS[10] = _MARK, _BAR, _BREAK
_CLASS[[32, 9, 11, 12, 13]] = _SPACE


@dataclass
class Features:
    """Sparse rows: values at ``index``; row k holds ``ends[k] - ends[k - 1]`` of them."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray


def statistics(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text; logarithms of sizes, and shares."""
    rows = len(counts)
    sizes = np.diff(offsets)
    kind = np.bincount(np.repeat(np.arange(rows), sizes) * 9 + _CLASS[data], minlength=9 * rows).reshape(rows, 9)
    of = np.repeat(np.arange(rows), counts)
    same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]) if len(hashes) else np.zeros(0, bool)
    again = np.bincount(of[1:][same], minlength=rows) if same.any() else np.zeros(rows)
    size, n = np.maximum(sizes, 1), np.maximum(counts, 1)
    share = kind / size[:, None]
    return np.column_stack([
        np.log1p(sizes), np.log1p(counts), np.log1p(kind[:, _BREAK]), np.log1p((sizes - kind[:, _SPACE] - kind[:, _BREAK]) / n),
        distinct / n, again / n, share[:, _UPPER], share[:, _DIGIT], share[:, _MARK], share[:, _SYMBOL], share[:, _BAR],
        share[:, _BREAK], share[:, _BEYOND], counts == 0]).astype(np.float64)


def raw_features(column: pa.Array, dims: int) -> tuple[Features, np.ndarray]:
    """Hashed words of each text (one value per distinct one) and its statistics."""
    data, offsets = utf8(column)
    hashes, counts = words(data, offsets, fold=False)
    of = np.repeat(np.arange(len(counts), dtype=U), counts)
    keys, times = np.unique((of << U(32)) | (hashes % U(dims)), return_counts=True)
    row, index = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
    distinct = np.bincount(row, minlength=len(counts))
    value = np.sqrt(times)
    norm = np.sqrt(np.bincount(row, value**2, len(counts)))
    return (Features(index, value / norm[row], np.cumsum(distinct)),
            statistics(data, offsets, hashes, counts, distinct))


def metadata(column: pa.Array, declared: pa.Array | None) -> np.ndarray:
    """One row of ``METADATA`` per text; without a declared length (or a negative one) its own counts."""
    own = np.array([len(x or "") for x in column.to_pylist()], float)
    if declared is None:
        said, missing = own, np.ones(len(own), bool)
    else:
        said = np.asarray(declared.cast(pa.float64()).fill_null(-1.0))
        missing = ~(said >= 0)
        said = np.where(missing, own, said)
    return np.column_stack([np.log1p(said), missing, said != own]).astype(np.float64)


def _features(text: pa.Array, declared: pa.Array | None, dims: int) -> tuple[Features, np.ndarray]:
    sparse, stats = raw_features(text, dims)
    return sparse, np.hstack([stats, metadata(text, declared)])


def _joined(sparse: Features, stats: np.ndarray, dims: int) -> Features:
    """Words and scaled statistics of each row, one after the other."""
    rows, extra = stats.shape
    sizes = np.diff(np.append(0, sparse.ends))
    ends = np.cumsum(sizes + extra)
    index, value = np.empty(int(ends[-1]) if rows else 0, np.int64), np.empty(int(ends[-1]) if rows else 0)
    at = np.arange(len(sparse.index)) + np.repeat(np.arange(rows) * extra, sizes)
    index[at], value[at] = sparse.index, sparse.value
    places = (ends - extra)[:, None] + np.arange(extra)
    index[places], value[places] = dims + np.arange(extra), stats
    return Features(index, value, ends)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    dims: int

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) / self.spread, -4, 4) / 4

    def _sums(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads = np.append(0, x.ends[:-1])
        parts = self.factors[x.index] * x.value[:, None]
        return (np.add.reduceat(self.linear[x.index] * x.value, heads), np.add.reduceat(parts, heads),
                np.add.reduceat(parts**2, heads))

    def margin(self, x: Features) -> np.ndarray:
        if not len(x.ends):
            return np.zeros(0)
        linear, sums, squares = self._sums(x)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)

    def score(self, column: pa.Array, declared: pa.Array | None = None) -> np.ndarray:
        """Scores of a text column; null counts as empty. ``declared``: lengths in code points, if known."""
        sparse, stats = _features(column, declared, self.dims)
        return 1 / (1 + np.exp(-np.clip(self.margin(_joined(sparse, self.scaled(stats), self.dims)), -40, 40)))


def _subset(x: Features, rows: np.ndarray) -> Features:
    heads = np.append(0, x.ends[:-1])[rows]
    sizes = x.ends[rows] - heads
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1])) + np.repeat(heads - (ends - sizes), sizes)
    return Features(x.index[at], x.value[at], ends)


def train(x: Features, stats: np.ndarray, y: np.ndarray, weight: np.ndarray, dims: int, factors: int,
          rounds: int, step: float, penalty: float, seed: int = 9) -> Model:
    """Minibatch adaptive gradient descent on the weighted logistic loss."""
    rng = np.random.default_rng(seed)
    spread = stats.std(axis=0)
    model = Model(0.0, np.zeros(dims + stats.shape[1]), rng.normal(0, 0.02, (dims + stats.shape[1], factors)),
                  stats.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), dims)
    x = _joined(x, model.scaled(stats), dims)
    past_bias, past_linear, past_factors = 1e-6, np.full_like(model.linear, 1e-6), np.full_like(model.factors, 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 64):
            rows = order[start:start + 64]
            part = _subset(x, rows)
            linear, sums, squares = model._sums(part)
            margin = model.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[rows]) * weight[rows]
            of = np.repeat(np.arange(len(rows)), np.diff(np.append(0, part.ends)))
            used, where = np.unique(part.index, return_inverse=True)
            base = slope[of] * part.value
            g_linear = np.bincount(where, base) + penalty * model.linear[used]
            g_factors = np.zeros((len(used), factors))
            own = sums[of] - model.factors[part.index] * part.value[:, None]
            for f in range(factors):
                g_factors[:, f] = np.bincount(where, base * own[:, f])
            g_factors += penalty * model.factors[used]
            past_linear[used] += g_linear**2
            past_factors[used] += g_factors**2
            past_bias += slope.sum() ** 2
            model.linear[used] -= step * g_linear / np.sqrt(past_linear[used])
            model.factors[used] -= step * 0.5 * g_factors / np.sqrt(past_factors[used])
            model.bias -= step * slope.sum() / np.sqrt(past_bias)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 2500, dims: int = 1 << 14,
        factors: int = 8, rounds: int = 8, step: float = 0.1, penalty: float = 1e-4) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text, n_chars) that have a 0 or 1 in ``labels`` (doc_id, label).

    The ``per_label`` ids with the smallest hashes are taken of each label, or all of them; this bound on the
    sample is the only one, and the loss weighs its rows so that both labels count as often as they occur.
    Only ids and labels of the sample are broadcast, and texts do not move. Null labels and ids and labels
    without a text row are ignored; a repeated label counts once, and of several rows of an id the one
    with the smallest features counts. The model is the same however rows are stored or dealt. Without rows of both
    labels every score is the share of label 1, or one half.
    """
    known = picked(labels, "doc_id", label).toDF("_id", "_label").where("_id is not null and _label in (0, 1)").select(
        F.col("_id").cast("long").alias("_id"), F.col("_label").cast("int").alias("_label")).distinct()
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    flat = Model(0.0, np.zeros(dims + EXTRA), np.zeros((dims + EXTRA, factors)), np.zeros(EXTRA), np.ones(EXTRA), dims)
    if len(counts) < 2:
        flat.bias = {(): 0.0, (0,): -40.0, (1,): 40.0}[tuple(counts)]
        return flat
    chosen = _smallest(known, counts, per_label)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sparse, stats = _features(batch["text"], batch["n_chars"], dims)
            heads = np.append(0, sparse.ends[:-1]).tolist()
            rows = [(sparse.index[a:b].astype("<u4").tobytes(), sparse.value[a:b].astype("<f4").tobytes())
                    for a, b in zip(heads, sparse.ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "id": batch["_id"], "label": batch["_label"], "places": pa.array([r[0] for r in rows], pa.binary()),
                "amounts": pa.array([r[1] for r in rows], pa.binary()),
                "stats": pa.array([s.tobytes() for s in stats], pa.binary())})

    texts = picked(_declared(docs), "doc_id", "text", "n_chars").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts = texts.select("_id", "_label", "text", "n_chars")
    found = texts.mapInArrow(features, "id long, label int, places binary, amounts binary, stats binary")
    one = F.min(F.struct("stats", "places", "amounts")).alias("row")
    rows = found.groupBy("id", "label").agg(one).select("id", "label", "row.*").collect()  # 2 * per_label at most
    rows.sort(key=lambda r: (r.label, r.id))  # training takes them in this order
    y = np.array([r.label for r in rows], float)
    if len(set(y.tolist())) < 2:
        return flat
    index = [np.frombuffer(r.places, "<u4") for r in rows]
    x = Features(np.concatenate(index).astype(np.int64), np.concatenate([np.frombuffer(r.amounts, "<f4") for r in rows]).astype(float),
                 np.cumsum([len(i) for i in index]))
    stats = np.array([np.frombuffer(r.stats) for r in rows])
    share = {k: counts[k] / sum(counts.values()) for k in (0, 1)}
    weight = np.array([share[int(k)] / (y == k).mean() for k in y])
    return train(x, stats, y, weight, dims, factors, rounds, step, penalty)


def _declared(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, null where the table has none."""
    if any(c.lower() == "n_chars" for c in docs.columns):
        return docs
    return docs.select("*", F.lit(None).cast("long").alias("n_chars"))


def _smallest(known: DataFrame, counts: dict[int, int], each: int) -> DataFrame:
    """(_id, _label): the ``each`` ids of every label with the smallest hashes, 2 * ``each`` rows at most.

    Hashes far above the wanted share are dropped before they move; should too few be left, all are drawn.
    """
    rows = known.withColumn("_hash", F.xxhash64("_id"))
    place = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", "_id"))
    for factor in (2, None):
        drawn = rows
        if factor:
            below = {k: min(2**63 - 1, int(2.0**64 * min(1.0, factor * each / n) - 2.0**63)) for k, n in counts.items()}
            drawn = rows.where(F.col("_hash") <= F.when(F.col("_label") == 1, below[1]).otherwise(below[0]))
        drawn = staged(drawn.withColumn("_place", place).where(F.col("_place") <= each).select("_id", "_label"), "sample")
        found = {r["_label"]: r["count"] for r in drawn.groupBy("_label").count().collect()}
        if all(found.get(k, 0) >= min(each, n) for k, n in counts.items()):
            break
    return drawn


def predict(docs: DataFrame, model: Model, keep: dict[str, Column] | None = None) -> DataFrame:
    """``score`` (0 to 1, higher: better) and ``predicted`` of every row of ``docs``, with ``keep``.

    Only ``text``, the whole of it, and ``n_chars`` (if there is such a column) are looked at; null counts as empty, and
    empty texts are scored by their statistics. ``keep`` are expressions by name, or None for every column of ``docs``; names may be any,
    ``score`` and dotted ones too. Repeated rows get equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, kept = beside(_declared(docs), ["text", "n_chars"], keep)
    if keep is None and len(kept) > len(docs.columns):  # the added column does not stay
        rows, kept = rows.drop(rows.columns[-1]), StructType(kept.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            score = shared.value.score(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[str(k) for k in range(len(kept) + 2)])

    return mapped(rows, run, StructType([*kept, *StructType.fromDDL("score double, predicted int")]))

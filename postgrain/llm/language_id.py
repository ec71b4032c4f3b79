"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each of its bits a binary classifier over hashed
character n-grams learns which of two groups of languages a text is from. A text gets one margin per
bit; decoding adds, for each language, the logistic loss of its codeword against the margins, each
bit weighted by how well its classifier did on rows it was not trained on, and takes the smallest.
A small lead over the second language marks the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postgrain.llm.shared import beside, mapped, picked, slices, staged, utf8
from postgrain.llm.wordhash import LOWER, mixed

U = np.uint64
UNKNOWN = "und"
_COMMON_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A +-1 codeword per class (rows). Up to five classes: every split of them is a bit."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = [(1, *rest) for rest in product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(splits, float).T
    bits, rng = max(15, int(np.ceil(10 * np.log2(classes)))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(max(1, 40_000 // classes**2)):  # many random words are far apart by themselves
        code = rng.choice([-1.0, 1.0], (classes, bits))
        mixed_bits = (np.abs(code.sum(axis=0)) < classes).all()
        near = (bits - (code @ code.T - 2 * bits * np.eye(classes)).max()) / 2
        if mixed_bits and near > apart:
            best, apart = code, near
    return best


def ngram_profiles(column: pa.Array, dims: int) -> np.ndarray:
    """A row per text: square roots of its counts of hashed 1-, 2- and 3-grams of UTF-8 bytes, ASCII
    letters lowered, scaled to length one."""
    data, offsets = utf8(column)
    data = LOWER[data].astype(U)
    out = np.zeros((len(offsets) - 1, dims), np.float32)
    codes = []
    for size in (1, 2, 3):
        gram = np.full(len(data), U(size))
        for k in range(size):
            gram[:len(data) - k] = gram[:len(data) - k] * U(257) + data[k:]
        codes.append((mixed(gram, 51) % U(dims)).astype(np.int32))
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            counts = sum(np.bincount(code[a:b - size], minlength=dims) for size, code in enumerate(codes) if b - size > a)
            row = np.sqrt(counts, dtype=np.float32)
            out[k] = row / np.linalg.norm(row)
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # dims + 1 by bits; the last row is the bias
    trust: np.ndarray  # of each bit

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its share of exp(-loss), its lead over the second share) of each row."""
        margins = profiles @ self.weights[:-1] + self.weights[-1]
        rows = max(1, (1 << 22) // self.code.size)  # losses of so many rows at a time
        loss = np.concatenate([np.logaddexp(0, -margins[k:k + rows, None, :] * self.code[None]) @ self.trust
                               for k in range(0, max(1, len(margins)), rows)])
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        lead = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
        return share.argmax(axis=1), order[:, -1], lead


def _fit_bits(x: np.ndarray, y: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Logistic regression of every column of ``y`` (+-1) on ``x``, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, step = w.copy(), np.float32(8.0)
    for k in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))
        new = ahead - step * (x.T @ slope.astype(np.float32) / len(x) + np.float32(penalty) * ahead)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, per_language: int = 400, dims: int = 1 << 12, rounds: int = 200,
        penalty: float = 1e-5, sample_bytes: int = 64 << 20) -> Model:
    """Learn from rows of ``docs`` (text, lang) that have a text and a language.

    Of every language ``per_language`` different texts are taken, those with the smallest hashes, or all
    of them where there are fewer; so copies do not count and every language is learned. With so many
    languages that their profiles would exceed ``sample_bytes``, each gives fewer texts, and below eight of them
    profiles get fewer dimensions (256 at least). Profiles are made where the rows are. Without any
    labelled row the model knows no language.
    """
    rows = picked(docs, "text", "lang").where("text is not null and lang is not null").select(
        "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("digest"))
    # a row per language: how many different texts it has, about
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("digest").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((dims + 1, 1), np.float32), np.ones(1))
    while dims > 256 and len(languages) * 8 * dims * 2 > sample_bytes:
        dims //= 2
    each = max(1, min(per_language, sample_bytes // (len(languages) * dims * 2)))
    sample = _smallest(rows, sizes, each)
    sample = rows.join(F.broadcast(sample), ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(
        F.min("text").alias("text")).select("text", "lang")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x.tobytes() for x in ngram_profiles(batch["text"], dims).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(found, pa.binary())], names=["lang", "profile"])

    # one row of each drawn text; sorted, so that the model does not depend on where rows are
    taken = sorted(sample.mapInArrow(profiles, "lang string, profile binary").collect(), key=lambda r: (r.lang, bytes(r.profile)))
    seen, place = languages, {lang: k for k, lang in enumerate(languages)}
    code = codewords(len(seen))
    if len(seen) < 2:
        return Model(seen, code, np.zeros((dims + 1, 1), np.float32), np.ones(1))
    x = np.array([np.frombuffer(r.profile, np.float16) for r in taken], np.float32)
    y = code[[place[r.lang] for r in taken]]
    order = np.random.default_rng(6).permutation(len(x))
    x, y = x[order], y[order]
    cut = max(1, len(x) // 5)
    trial = _fit_bits(x[cut:], y[cut:], rounds, penalty)
    right = ((x[:cut] @ trial[:-1] + trial[-1]) * y[:cut] > 0).mean(axis=0)
    right = np.clip(right, 0.51, 0.999)
    trust = np.log(right / (1 - right))
    return Model(seen, code, _fit_bits(x, y, rounds, penalty), trust / trust.mean())


def _smallest(rows: DataFrame, sizes: dict[str, int], each: int) -> DataFrame:
    """(lang, digest): the ``each`` smallest digests of every language.

    Digests above a bound are dropped before they move: it leaves about twice as many as are wanted, so
    no task gets more of a language than that. A language that it leaves too few of is drawn without one.
    """
    spark, span = rows.sparkSession, 2.0**64
    open_ended = set()
    while True:
        bounds = [(lang, None if lang in open_ended or 2 * each >= n else int(2 * each / n * span - span / 2))
                  for lang, n in sizes.items()]
        table = spark.createDataFrame(bounds, "lang string, bound long")  # a row per language
        drawn = rows.join(F.broadcast(table), "lang").where("bound is null or digest < bound").groupBy("lang", "digest").agg(
            F.count("*").alias("copies"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
        drawn = staged(drawn.select("lang", "digest", place.alias("place")).where(F.col("place") <= each), "sample")
        found = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
        few = {lang for lang, bound in bounds if bound is not None and found.get(lang, 0) < each}
        if not few:
            return drawn.select("lang", "digest")
        open_ended |= few


def has_letter(text: str | None) -> bool:
    return bool(text) and (_COMMON_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def predict(docs: DataFrame, model: Model, lead: float = 0.2, keep: dict[str, Column] | None = None) -> DataFrame:
    """``lang_pred, score, ambiguous`` of every row of ``docs``, with the columns in ``keep``.

    Only ``text`` is looked at, the whole of it. Null, empty or letterless text, or a model without
    languages: ``und`` with score 0, not ambiguous. ``score`` is the share of the chosen language,
    ``ambiguous`` whether its lead over the second is below ``lead``; of languages with equal losses the first by
    name is chosen. Columns may have any name, those kept also ``score`` or ``lang_pred``. Repeated rows get equal
    results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, kept = beside(docs, ["text"], {} if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dims = len(model.weights) - 1
        for batch in slices(batches, 0):
            text = batch.column(0)
            known = np.array([has_letter(x) for x in text.to_pylist()], bool)
            known &= bool(model.languages)
            best, score, gap = np.zeros(len(known), int), np.zeros(len(known)), np.ones(len(known))
            if known.any():
                best[known], score[known], gap[known] = model.decode(ngram_profiles(text.filter(pa.array(known)), dims))
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            new = [pa.array(names, pa.string()), pa.array(score.astype(float)), pa.array(gap < lead)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[str(k) for k in range(len(kept) + 3)])

    found = StructType.fromDDL("lang_pred string, score double, ambiguous boolean")
    return mapped(rows, run, StructType([*kept, *found]))

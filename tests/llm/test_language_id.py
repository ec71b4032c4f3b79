import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postgrain.llm import language_id
from postgrain.llm.language_id import Model, codewords, fit, has_letter, ngram_profiles, predict

SOUNDS = {"aa": ["ka", "lo", "ru"], "bb": ["sch", "ung", "ß"], "cc": ["eau", "ié", "ç"], "dd": ["ñ", "ción", "ar"],
          "ee": ["xi", "zh", "qu"], "ff": ["ów", "cz", "ł"], "gg": ["oo", "ij", "aa"]}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.mark.parametrize("count", [2, 4, 7])
def test_held_out_rows_get_their_language(spark, count):
    rng = random.Random(8)
    langs = list(SOUNDS)[:count]
    rows = [(k, prose(rng, langs[k % count], rng.choice([4, 40])), langs[k % count], 1) for k in range(60 * count)]
    cut = len(rows) // 2
    model = fit(table(spark, rows[:cut]), dims=1 << 10)
    docs = table(spark, rows[cut:])
    got = predict(docs, model, keep={"doc_id": docs["doc_id"], "lang": docs["lang"]}).collect()
    assert len(got) == len(rows) - cut and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_codewords_are_apart():
    for count in (2, 3, 4, 5, 6, 20):
        code = codewords(count)
        distance = [(a != b).sum() for k, a in enumerate(code) for b in code[k + 1:]]
        assert min(distance) >= (1 if count == 2 else 2) and code.shape[0] == count
        assert (np.abs(code.sum(axis=0)) < count).all()


def test_profiles_equal_counting():
    texts = ["Abcab", "é", "", None, "x" * 5000]
    got = ngram_profiles(pa.array(texts), 1 << 16)
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode().lower()
        grams = [raw[k:k + size] for size in (1, 2, 3) for k in range(len(raw) - size + 1)]
        counts = np.array(sorted(grams.count(g) for g in set(grams)), float)
        assert np.allclose(np.sort(row[row > 0]), np.sqrt(counts / max(1, counts.sum())), atol=1e-5)


def test_odd_rows(spark):
    rows = [(1, None, "aa", 1), (2, "", "aa", 1), (3, " 12 ½ .", "aa", 1), (None, "ka lo", None, None), (4, "ж", "aa", 1),
            (5, "ka lo " * 100_000, "aa", 1), (5, "ka lo " * 100_000, "aa", 1)]
    docs = table(spark, rows)
    assert [has_letter(r[1]) for r in rows] == [False, False, False, True, True, True, True]
    for model in (fit(docs.limit(0)), fit(docs.where("doc_id = 5"))):
        assert isinstance(model, Model)
        got = predict(docs, model, keep={"doc_id": docs["doc_id"]}).collect()
        assert [r.lang_pred for r in got][:3] == ["und"] * 3 and got[0].score == 0
        assert {r.lang_pred for r in got[3:]} == {"und" if not model.languages else "aa"}
    assert predict(docs.limit(0), model).collect() == []


def test_a_language_of_few_large_groups_is_learned(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, lang, 20), lang, 1) for lang in ("aa", "bb") for k in range(60)]
    # every copy of the one text of each of these has its own row, far more than the bound
    rows += [(k, text, lang, 1) for lang in ("cc", "dd", "ee", "ff", "gg") for text in [prose(rng, lang, 40)] for k in range(400)]
    model = fit(table(spark, rows).repartition(5), per_language=20, dims=1 << 10)
    assert model.languages == sorted(SOUNDS)
    docs = table(spark, [(k, prose(rng, lang, 40), lang, 1) for k in range(20) for lang in SOUNDS])
    got = predict(docs, model, keep={"lang": docs["lang"]}).collect()
    for lang in SOUNDS:
        assert np.mean([r.lang_pred == lang for r in got if r.lang == lang]) > 0.8, lang


def plain_decode(model, text, dims):
    """Margins, losses and shares of one text, one bit and one language at a time."""
    profile = ngram_profiles(pa.array([text]), dims)[0]
    margins = [sum(float(profile[i]) * float(model.weights[i, b]) for i in np.flatnonzero(profile)) + float(model.weights[-1, b])
               for b in range(model.code.shape[1])]
    losses = [sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(margins, code, model.trust, strict=True)) for code in model.code]
    shares = [math.exp(min(losses) - x) for x in losses]
    return losses.index(min(losses)), max(shares) / sum(shares)


def test_predictions_are_loss_weighted_decoding(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, lang, 30), lang, 1) for k in range(30) for lang in SOUNDS]
    model = fit(table(spark, rows), dims=256)
    docs = table(spark, [(k, prose(rng, lang, 12), None, 1) for k, lang in enumerate([*SOUNDS] * 4)])
    text = {r.doc_id: r.text for r in docs.collect()}
    for row in predict(docs, model, keep={"doc_id": docs["doc_id"]}).collect():
        best, share = plain_decode(model, text[row.doc_id], 256)
        assert row.lang_pred == model.languages[best] and np.isclose(row.score, share, atol=1e-4)


def test_sample_is_the_smallest_hashes_wherever_rows_are(spark):
    rng = random.Random(22)
    rows = [(k, prose(rng, "aa", 6), "aa", 1) for k in range(900)] + [(k, prose(rng, "bb", 6), "bb", 1) for k in range(20)]
    frame = table(spark, rows).select("text", "lang", F.xxhash64("text").alias("digest"))
    want = {lang: sorted({r.digest for r in frame.collect() if r.lang == lang})[:50] for lang in ("aa", "bb")}
    for parts, sizes in ((1, {"aa": 900, "bb": 20}), (6, {"aa": 10**6, "bb": 20})):  # a wrong estimate costs a second look
        got = language_id._smallest(frame.repartition(parts), sizes, 50).collect()
        assert {lang: sorted(r.digest for r in got if r.lang == lang) for lang in want} == want


def test_many_languages_within_a_budget(spark):
    rng = random.Random(23)
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * rng.randint(5, 30), f"l{k % 300}", 1) for k in range(1200)]
    model = fit(table(spark, rows), sample_bytes=1 << 20, rounds=5)
    assert len(model.languages) == 300 and len(model.weights) == 257


def test_kept_columns_of_any_name(spark):
    docs = spark.createDataFrame([("ka lo", 1, "x"), (None, None, None)], "text string, `odd.name` int, `TEXT` string")
    model = fit(table(spark, [(1, "ka lo", "aa", 1)]))
    rows = predict(docs, model, keep={"score": docs["`odd.name`"], "_text": F.lit(3)}).collect()
    assert [tuple(r) for r in rows] == [(1, 3, "aa", 1.0, False), (None, 3, "und", 0.0, False)]

import random

import numpy as np
import pyarrow as pa

from postgrain.llm.quality_fm import STATISTICS, Features, Model, fit, metadata, predict, raw_features


def test_pairwise_sum_equals_all_pairs():
    rng = np.random.default_rng(10)
    model = Model(0.3, rng.normal(size=20), rng.normal(size=(20, 3)), np.zeros(0), np.ones(0), 20)
    rows = [rng.choice(20, n, replace=False) for n in (1, 4, 7)]
    values = [rng.normal(size=len(r)) for r in rows]
    x = Features(np.concatenate(rows), np.concatenate(values), np.cumsum([len(r) for r in rows]))
    for got, index, value in zip(model.margin(x), rows, values, strict=True):
        want = model.bias + sum(model.linear[i] * v for i, v in zip(index, value, strict=True))
        for a in range(len(index)):
            for b in range(a + 1, len(index)):
                want += model.factors[index[a]] @ model.factors[index[b]] * value[a] * value[b]
        assert np.isclose(got, want)


def test_statistics_of_small_texts():
    sparse, stats = raw_features(pa.array(["Ab ab ab 1|", None, "", " \n"]), 1 << 12)
    row = dict(zip(STATISTICS, stats[0], strict=True))
    assert np.isclose(row["distinct"], 3 / 4) and np.isclose(row["again"], 1 / 4) and np.isclose(row["upper"], 1 / 11)
    assert np.isclose(row["digits"], 1 / 11) and np.isclose(row["bars"], 1 / 11)
    assert sparse.ends.tolist() == [3, 3, 3, 3] and stats[1:, -1].tolist() == [1, 1, 1]
    assert np.isclose((sparse.value**2).sum(), 1)


def corpus(count, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for k in range(count):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))]
        good = k % 5 != 0
        text = " ".join(words) if good else rng.choice([" ".join([words[0]] * 40), " ".join(words).upper() + "!!", " | ".join(words), " ".join(w + "##" for w in words)])
        rows.append((k, text, int(good)))
    return rows


def test_held_out_rows(spark):
    rows = corpus(900, 11)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows if d < 600] + [(5, None, 0), (None, 1, 0), (99999, 1, 1)], "doc_id long, quality int, text int")
    model = fit(docs, labels)
    got = {r.doc_id: r for r in predict(docs, model, {"doc_id": docs["doc_id"]}).collect()}
    held = [(got[d], q) for d, _, q in rows if d >= 600]
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r, _ in held)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for labels, want in ((none, 0.5), (ones, 1.0), (both, None)):
        model = fit(docs, labels)
        got = predict(docs, model).collect()
        assert len(got) == 4 and got[1] == got[2] and (want is None or all(abs(r.score - want) < 1e-6 for r in got))
        assert predict(docs.limit(0), model).collect() == []


def test_model_does_not_depend_on_where_rows_are(spark):
    rows = corpus(500, 12)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t, _ in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] * 2, "doc_id long, quality int")
    found = []
    for parts in (1, 7):
        model = fit(docs.repartition(parts, "text"), labels.repartition(parts), per_label=60)
        found.append({r.doc_id: r.score for r in predict(docs.repartition(parts), model, {"doc_id": docs["doc_id"]}).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) > 100


def test_scores_are_the_formula_over_all_pairs(spark):
    """The query's scores against words, statistics and pairs taken one by one."""
    rows = corpus(60, 13) + [(900, "", 0), (901, None, 0)]
    docs = spark.createDataFrame([(d, t, len(t or "") if d % 3 else None) for d, t, _ in rows], "doc_id long, text string, n_chars long")
    model = fit(docs, spark.createDataFrame([(d, q) for d, _, q in rows[:40]], "doc_id long, quality int"), dims=64, factors=3)
    got = {r.doc_id: r.score for r in predict(docs, model, {"doc_id": docs["doc_id"]}).collect()}
    for doc, text, _ in rows:
        column = pa.array([text])
        sparse, stats = raw_features(column, 64)
        declared = None if doc % 3 == 0 else pa.array([len(text or "")])
        extra = model.scaled(np.hstack([stats, metadata(column, declared)]))[0]
        x = np.zeros(64 + len(extra))
        x[sparse.index] = sparse.value
        x[64:] = extra
        margin = model.bias + model.linear @ x + sum(
            model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(len(x)) for j in range(i) if x[i] and x[j])
        assert np.isclose(got[doc], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_metadata():
    got = metadata(pa.array(["abc", "é", None, "x"]), pa.array([3, 7, None, -1]))
    assert np.allclose(got, [[np.log(4), 0, 0], [np.log(8), 0, 1], [0, 1, 0], [np.log(2), 1, 0]])


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6.0, "t", "x"), (None, None, None, None, None, None)],
                                 "doc_id long, text string, `odd.name` int, score double, `Text ` string, `TEXT` string")
    model = fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    rows = predict(docs, model).collect()
    assert rows[0][:6] == (1, "a b", 5, 6.0, "t", "x") and len(rows[0]) == 8 and rows[1][:6] == (None,) * 6

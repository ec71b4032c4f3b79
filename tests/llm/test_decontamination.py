import hashlib
import random
import re

from postgrain.llm.decontamination import decontaminate, without_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, hit, owners = split(text), set(), set()
        for item, item_text in items:
            own = split(item_text)
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if size else 0):
                for at in range(len(words) - size + 1):
                    if words[at:at + size] == own[k:k + size]:
                        hit.update(range(at, at + size))
                        owners.add(item)
        owners.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(owners), digest))
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, None) for r in docs], "doc_id long, text string, items int, spans string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    rows = decontaminate(d.repartition(3), b, **options)
    return sorted((tuple(r) for r in rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()), key=repr)


def corpus():
    rng = random.Random(5)
    vocabulary = ["a", "B", "é", "c9", "Dd", "x"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 10, 14, 30])))) for k in range(3, 40)]
    items += [(50, "unique"), (51, None), (52, " ..."), (53, items[0][1]), (3, "second text of three"), (None, "no item id here")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary + ["q"] * 6) for _ in range(rng.choice([0, 3, 12, 60]))]
        if words and d % 2:
            own = rng.choice(items)[1] or ""
            at = rng.randrange(len(words))
            words[at:at] = own.split()[rng.randrange(3):]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(100, None), (101, ""), (102, "UNIQUE, Second text-of three"), (102, "UNIQUE"), (None, "no item id here")]
    return docs, items


def test_same_as_direct_comparison(spark):
    docs, items = corpus()
    want = brute_force(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, block_bytes=40) == want
    assert got(spark, docs, items, window=3) == brute_force(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus()
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == brute_force(docs, [])


def test_spans_of_a_long_text(spark):
    words = [f"w{k}" for k in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(8, " ".join(words[20_000:20_015])), (9, "w5")], "item_id long, text string")
    row = decontaminate(docs, items).first()
    assert row.spans == [[5, 6], [20_000, 20_015]] and row.items == [8, 9] and row.n_hit == 16


def test_rows_without_passages_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, `odd.name` int, `TEXT` string, c0 int"
    docs = spark.createDataFrame([(1, "w5 x", 1, "a", 2), (2, "w6", 3, "w5", 4), (None, None, None, None, None)], schema)
    items = spark.createDataFrame([(9, "w5", "a")], "item_id long, text string, `x.y` string")
    kept = without_passages(docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == [
        (2, "w6", 3, "w5", 4), (None, None, None, None, None)]
    assert [r.n_hit for r in decontaminate(docs.where("doc_id = 1"), items).collect()] == [1]

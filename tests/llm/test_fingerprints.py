import base64
import hashlib
import random

import numpy as np

from postgrain.llm.fingerprints import chunk_set, containment, edited_fingerprints, fingerprints, written
from postgrain.llm.wordhash import mixed

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "ß") for b in ("ra", "sto", "pe", "vun", "x")]


def prose(rng, count):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(count))


def chunks_one_by_one(text):
    """Chunks as strings: a rolling hash, one code point after the other; only its random words are the module's."""
    out, start, rolling = [], 0, 0
    for end, c in enumerate(text, 1):
        rolling = (2 * rolling + int(mixed(np.array([ord(c)], np.uint64), 41)[0])) % 2**32
        size = end - start
        zeros = 6 if size < 32 else 4
        if size == 128 or (size >= 16 and rolling % 2**zeros == 0) or end == len(text):
            out.append(text[start:end])
            start = end
    return out


def share(inner, outer):
    inner, outer = set(inner), set(outer)
    return sum(map(len, inner & outer)) / sum(map(len, inner)) if inner else float(not outer)


def test_chunks_are_those_of_a_rolling_hash():
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([0, 1, 2, 4, 30, 200])) for _ in range(60)]
    texts += ["", "z" * 15, "z" * 16, "z" * 17, "z" * 1000, "é" * 128, "😀ab" * 300, "".join(chr(rng.randrange(32, 0xD000)) for _ in range(3000))]
    texts += [t[:len(t) // 2] + "!" + t[len(t) // 2:] for t in texts[:60]]
    plain = {t: chunks_one_by_one(t) for t in texts}
    name = {}
    for text, chunks in plain.items():
        digests, sizes = chunk_set(text)
        assert sorted(sizes) == sorted(map(len, set(chunks)))
        for chunk in set(chunks):  # a chunk has one digest wherever it stands, and no other chunk has it
            name.setdefault(chunk, chunk_set(chunk)[0][0] if len(chunks_one_by_one(chunk)) == 1 else None)
        alone = [name[c] for c in set(chunks) if name[c] is not None]
        assert set(alone) <= set(digests)
        packed = base64.b64decode(written((digests, sizes)))
        assert len(packed) == 9 * len(set(chunks)) and packed[:8 * len(digests)] == b"".join(int(d).to_bytes(8, "little") for d in digests)
    known = [d for d in name.values() if d is not None]
    assert len(set(known)) == len(known) > 0.95 * len(name) and len(name) > 400
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        assert abs(containment(chunk_set(a), chunk_set(b)) - share(plain[a], plain[b])) < 1e-12
    for a, b in zip(texts[:60], texts[-60:], strict=True):
        assert abs(containment(chunk_set(a), chunk_set(b)) - share(plain[a], plain[b])) < 1e-12


def brute_force(rows):
    """Every document against the next by falling id, one at a time."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        own, new, other = chunk_set(text), chunk_set(edited), chunk_set(following)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(new),
                    containment(own, new), containment(own, other)))
    return sorted(out, key=repr)


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    return sorted((tuple(r) for r in edited_fingerprints(docs.repartition(4)).collect()), key=repr)


def test_same_as_one_at_a_time(spark):
    rng = random.Random(3)
    rows = [(k * 5 - 40, prose(rng, rng.choice([0, 1, 5, 80, 300]))) for k in range(120)]
    rows += [(1000, None), (1001, ""), (7, "same"), (7, "same"), (7, "other"), (None, "no id"), (2000, "😀é" * 400)]
    result = got(spark, rows)
    assert result == brute_force(rows)
    long = [r for r in result if r[1] > 1500]
    assert len(long) > 20 and all(r[5] > 0.5 for r in long) and sum(r[6] < 0.1 for r in long) > len(long) * 0.9


def test_few_rows(spark):
    assert got(spark, []) == []
    for rows in ([(1, "alone " * 30)], [(1, None)], [(None, None)], [(1, "a"), (2, "b" * 70)]):
        assert got(spark, rows) == brute_force(rows)


def test_chunks_resist_shifts():
    text = prose(random.Random(4), 2000)
    own = chunk_set(text)
    assert 20 < own[1].mean() < 80 and own[1].max() <= 128
    assert containment(own, chunk_set("shifted by some words, " + text)) > 0.98
    assert containment(own, chunk_set(text[:6000] + "?" + text[6000:])) > 0.98
    assert written(own) == written(chunk_set(text)) and containment(own, own) == 1.0
    assert len(chunk_set("z" * 100_000)[0]) <= 2


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([("abc", 9, "x"), (None, None, None)], "text string, n_chars int, `odd.name` string")
    rows = fingerprints(docs).collect()
    assert [r.n_chars for r in rows] == [3, 0] and rows[0]["odd.name"] == "x" and rows[1].n_chunks == 0

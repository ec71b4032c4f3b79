import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postgrain.llm import tokens
from postgrain.llm.length_buckets import decompose, numbered, pack, piece_lengths
from postgrain.llm.shared import staged
from postgrain.llm.token_blocks import BLOCK, decoded_blocks, encoded_blocks, packed, token_blocks, unpacked

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "a  b", "a \n b", "a\n\n  b", " lead", "trail ", "it's we'll I'M", "a\x1cb c", "a \x85 b",
       "é tést ́x", "Σας ΣΑΣ", "日本 語", "😀 😀a", "<|endoftext|> x", "don 't", "1 22 34", "ab´c", "a.\nB", "x×y ÷",
       "É ÀB 12 3", "\n\n", "#" * 3000]
ROWS = [(k * 7, t) for k, t in enumerate(ODD)] + [(9999, "same"), (9999, "same"), (9999, "other"), (None, "no id")]


def direct(path, text, end):
    tokenizer = Tokenizer.from_file(path)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_ids_equal_those_of_the_tokenizer(path, drops, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "SLOTS", 256)  # the memory starts anew again and again
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(" \n\ta'sé1. ́Σ\x1cāB+") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(" \nasé1.ÀB+") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    own, tokenizer = tokens.Encoder(path, drops), Tokenizer.from_file(path)
    for k in range(0, len(texts), 20):
        part = texts[k:k + 20]
        want = [x.ids for x in tokenizer.encode_batch([x or "" for x in part], add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(pa.array(part, pa.string()))] == want


@pytest.mark.parametrize("width", [0, 1, 7, 13, 16, 31, 32])
def test_blocks_round_trip(width):
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << width, (5, BLOCK), np.uint64).astype(np.uint32)
    assert (unpacked(packed(values, width), width) == values).all()
    ids = rng.integers(0, 1 << width, 4 * BLOCK, np.uint64).astype(np.uint32)
    ids[rng.integers(0, len(ids), 30)] = 2**32 - 1
    ids[:BLOCK] = 77
    for percentile in (0.0, 0.9, 1.0):
        blocks = encoded_blocks(ids, percentile)
        starts = np.cumsum([0, *map(len, blocks)])
        assert (decoded_blocks(b"".join(blocks), starts) == ids).all()


def test_files_give_back_every_document(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, bucket string, start int")
    got = [tuple(r) for r in token_blocks(docs.repartition(3), WORD).collect()]
    want = {d: [] for d, _ in ROWS}
    for d, t in ROWS:
        want[d].append(np.array(direct(WORD, t, 2), "<u4").tobytes())
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [None, *sorted(d for d, _ in ROWS if d is not None)]
    at = 0
    for doc, start, count, ids in got:
        assert start == at and count == len(ids) // 4
        want[doc].remove(bytes(ids))
        at += count
    assert not any(want.values())
    assert token_blocks(docs.limit(0), WORD).collect() == []


def test_pieces_cover_documents(spark):
    assert piece_lengths(2 * 1024 + 13, 1024) == [1024, 1024, 8, 4, 1]
    assert all(sum(piece_lengths(n, 8)) == n and set(piece_lengths(n, 8)) <= {1, 2, 4, 8} for n in range(200))
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, length string")
    rows = pack(docs.repartition(3), BYTE, limit=16).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted((r.length for r in rows), reverse=True)
    found = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        found.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for doc, text in ROWS:
        if doc != 9999:
            ids = b"".join(x[1] for x in sorted(found[doc]))
            assert ids == np.array(direct(BYTE, text, 0), "<u4").tobytes()
            assert {x[2] for x in found[doc]} == {len(ids) // 4}
    assert zlib.crc32(b"") == 0 and numbered(staged(decompose(docs.limit(0), BYTE), "none")).collect() == []
    with pytest.raises(ValueError):
        decompose(docs, BYTE, limit=1000)

import base64
import gzip
import hashlib
import io
import random

import pytest

from postgrain.llm.warc_members import record, round_trip, split_members


def brute_force(pages, least):
    smallest = {}
    for page, _, html in pages:
        key = html or ""
        if page is not None and (smallest.get(key) is None or page < smallest[key]):
            smallest[key] = page
        smallest.setdefault(key, None)
    out = []
    for page, url, html in pages:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = len(raw) >= least and page != smallest[html or ""]
        out.append((page, url, "revisit" if revisit else "response", smallest[html or ""] if revisit else None,
                    len(raw), digest, None if revisit else html or ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_records_come_back(spark, least):
    rng = random.Random(12)
    bodies = ["", None, "a", "same\r\n\r\nbody", "WARC/1.1\r\n\r\n", "é" * 9, "z" * 700_000, *(f"<p>{k}</p>" for k in range(30))]
    pages = [(k * 3, rng.choice([None, "http://a/é", f"http://b/{k}"]), rng.choice(bodies)) for k in range(200)]
    pages += [(0, "u", "a"), (0, "u", "a"), (None, "u", "a"), (None, "u", "only once")]
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, first int")
    got = sorted((tuple(r) for r in round_trip(table.repartition(4), least).collect()), key=repr)
    assert got == brute_force(pages, least)
    assert round_trip(table.limit(0)).collect() == []


def test_members_can_be_read_alone():
    parts = [record(k, "http://x", bytes([65 + k]) * (400_000 * k), None, False) for k in range(4)]
    for whole in (gzip.compress(b"".join(parts)), b"".join(gzip.compress(p) for p in parts)):
        out = io.BytesIO()
        index = list(split_members(io.BytesIO(whole), out))
        assert [gzip.decompress(out.getvalue()[a:a + n]) for a, n, _, _ in index] == parts
        assert [x[3] for x in index] == [f"<urn:page:{k}>" for k in range(4)]
    with pytest.raises(ValueError):
        list(split_members(io.BytesIO(gzip.compress(parts[1][:-200])), io.BytesIO()))

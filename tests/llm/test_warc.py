import gzip
import hashlib
import os

import pytest

from caseweave.llm import warc
from caseweave.llm.common import scratch_folder

LONG, OTHER = "é" * 600, "x" * 1000
PAGES = [
    (1, "http://a.example/1", LONG),
    (7, "http://a.example/7", LONG),
    (3, "http://a.example/3?q=a b\r\nX: y", LONG),
    (7, "http://a.example/0", LONG),
    (4, None, OTHER),
    (4, None, OTHER),
    (4, None, OTHER),
    (5, "http://a.example/5", "x" * 999),
    (6, "http://a.example/6", "x" * 999),
    (8, "", ""),
    (9, "http://a.example/9", None),
    (None, "http://a.example/n", LONG),
    (None, None, "only " * 300),
    (None, None, "only " * 300),
    (10, "http://a.example/10", "\r\n\r\nWARC/1.1\r\n" + "y" * 400_000),
]
SCHEMA = "page_id long, url string, html string"


def pages(spark, rows=PAGES):
    """Columns clash with those that the operator makes."""
    return spark.createDataFrame([(*r, "x", 3, b"z") for r in rows], SCHEMA + ", digest string, copies int, payload binary")


def expected(rows):
    out, best = [], {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for r in sorted(rows, key=order):
        best[r[2] or ""] = r
    used = set()
    for page, url, html in rows:
        body = (html or "").encode()
        b = best[html or ""]
        first = (page, url) == b[:2] and (html or "") not in used
        if first:
            used.add(html or "")
        revisit = len(body) >= 1000 and not first
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", b[0] if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    assert found(warc.round_trip(pages(spark).repartition(3))) == expected(PAGES)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_more_copies_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [(2, "u", OTHER)] * 11 + [(2, "v", OTHER)]
    assert found(warc.round_trip(pages(spark, rows))) == expected(rows)


def test_payloads_are_stored_once_and_records_come_back(spark):
    folder = scratch_folder(spark, "warc")
    warc.write(pages(spark), folder)
    records = warc.restore(spark, folder).collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in records), key=str) == sorted(((p, (h or "").encode()) for p, _, h in PAGES), key=str)
    ids = {r.record_id for r in records}
    assert len(ids) == len(PAGES)
    for r in records:
        fields, block = warc.parsed(bytes(r.record))
        assert fields["warc-record-id"] == r.record_id and fields["warc-type"] == r.record_type
        assert block.partition(b"\r\n\r\n")[2] == (bytes(r.payload) if r.record_type == "response" else b"")
        assert r.record_type == "response" or fields["warc-refers-to"] in ids
        assert "\r" not in fields.get("warc-target-uri", "") and "x" not in fields
    local = folder.removeprefix("file://")
    stored = []
    for name in os.listdir(f"{local}/objects"):
        if name.endswith(".warc.gz"):
            with gzip.open(f"{local}/objects/{name}") as whole:
                stored += [m for m in whole.read().split(b"WARC-Type: resource") if b"urn:sha256" in m]
    assert len(stored) == len({h or "" for _, _, h in PAGES})
    target = scratch_folder(spark, "plain")
    files = warc.export(spark, folder, target).collect()
    plain = b"".join(gzip.open(f"{target.removeprefix('file://')}/{f.name}").read() for f in files)
    assert sorted(plain) == sorted(b"".join(bytes(r.record) for r in records))
    assert plain.count(b"WARC-Record-ID: <urn:uuid:") == len(PAGES)


def test_damage_raises(spark):
    folder = scratch_folder(spark, "warc")
    warc.write(pages(spark), folder)
    local = folder.removeprefix("file://") + "/objects"
    name = next(n for n in sorted(os.listdir(local)) if n.endswith(".warc.gz"))
    digest, payload = hashlib.sha256(b"one").hexdigest(), b"other"
    with open(f"{local}/{name}", "ab") as out:
        out.write(warc.object_record(digest, payload))
    crc = f"{local}/.{name}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(Exception, match="holds other bytes"):
        warc.restore(spark, folder).collect()


def test_members_across_chunks():
    import io

    parts = [warc.object_record(hashlib.sha256(p).hexdigest(), p) for p in (b"", b"a" * 10, os.urandom(5000), b"b")]
    whole = b"".join(parts)
    for chunk in (1, 7, 100, 1 << 16):
        assert [warc.parsed(m)[1] for m in warc.members(io.BytesIO(whole), chunk)] == [warc.parsed(gzip.decompress(p))[1] for p in parts]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(whole[:-3]), 64))

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from nearline.llm import warc

SCHEMA = "page_id long, url string, html string, kind string, size int"
BIG = "<p>" + "same body " * 200 + "é😀</p>"
TRICKY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n" * 20 + "\n\n end"
ROWS = [
    (1, "http://a.example/x?q=1", BIG, "k", 1), (7, "http://b.example/y", BIG, "k", 1), (3, "http://a.example/x?q=1", BIG, None, None),
    (4, None, BIG, "k", 1), (None, "http://n.example/", BIG, "k", 1),
    (5, "http://c.example", "small", "k", 1), (6, "http://d.example/", "small", "k", 1),              # equal, but small
    (8, "http://e.example/a\r\nWARC-Type: x", TRICKY, "k", 1), (9, "http://e.example/b", TRICKY, "k", 1),
    (10, "http://f.example/", None, "k", 1), (11, "http://g.example/", "", "k", 1),
    (12, "http://h.example/", "long " * 50000, "k", 1),
    (13, "http://r.example/", BIG + "!", "k", 1), (13, "http://r.example/", BIG + "!", "k", 1),        # a repeated row
    (14, "no url at all", "x" * 999, "k", 1), (15, "http://i.example/", "x" * 999, "k", 1),
    (16, "http://j.example/", "y" * 1000, "k", 1), (17, "http://j.example/", "y" * 1000, "k", 1),
]


def brute(rows, least=1000):
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").replace("\r", "%0D").replace("\n", "%0A"))
    for r in rows:
        body = (r[2] or "").encode()
        top = max((x for x in rows if (x[2] or "") == (r[2] or "")), key=key)
        again = len(body) >= least and key(r) != key(top)
        out.append((r[0], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top[0] if again else None))
    return sorted(out, key=str)


def captured(spark, rows, tmp_path, params=warc.WarcParams()):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(3), path, params=params)
    return path, warc.read_records(spark, path)


@pytest.mark.parametrize("file_bytes", [1, 32 << 20])
def test_round_trip(spark, tmp_path, file_bytes):
    _, records = captured(spark, ROWS, tmp_path, warc.WarcParams(file_bytes=file_bytes))
    captures = warc.assemble(records)
    found = warc.resolve_revisits(captures)
    got = sorted([(r["id"] and int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in found.collect()], key=str)
    assert got == brute(ROWS)
    rows = captures.collect()
    assert len(rows) == len(ROWS) and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in rows)
    texts = sorted(bytes(r["response"]["payload"]).decode() for r in rows if r["response"]["kind"] == "response")
    again = {k for k, r in zip([x[0] for x in ROWS], brute(ROWS))}
    assert again and set(texts) == {x[2] or "" for x in ROWS}


def test_hot_payload(spark, tmp_path):
    rows = [(i, f"http://h.example/{i}", BIG if i % 2 else f"{i} " * 400, "", 0) for i in range(400)]
    _, records = captured(spark, rows, tmp_path)
    found = warc.resolve_revisits(warc.assemble(records))
    assert sorted([(int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in found.collect()], key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    _, records = captured(spark, [], tmp_path)
    assert records.collect() == [] and warc.assemble(records).collect() == []
    assert warc.resolve_revisits(warc.assemble(records)).collect() == []


def record(kind, rid, block=b"", linked=(), version="1.0", **more):
    head = [f"WARC/{version}", f"warc-type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Length: {len(block)}",
            *[f"WARC-Concurrent-To: <{x}>" for x in linked], *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()]]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
FOREIGN = [
    record("warcinfo", "w", b"software: x\r\n"),
    record("response", "a", HTTP + b"body a", Content_Type="application/http;msgtype=response"),
    record("request", "ra", b"GET / HTTP/1.1\r\n\r\n", ["a"]),
    record("metadata", "ma", b"k: v\r\n", ["ra"], Content_Type="application/warc-fields"),            # two steps away
    record("metadata", "mma", b"k: w\r\n", ["ma"], Content_Type="application/warc-fields"),           # three steps away
    record("response", "b", HTTP + b"body b", ["rb"], Content_Type="application/http;msgtype=response"),  # names its request
    record("request", "rb", b"GET /b HTTP/1.1\r\n\r\n"),
    record("request", "rb", b"GET /b HTTP/1.1\r\n\r\n"),                                             # a repeated identifier
    record("resource", "c", b"plain bytes \x00\xff", version="1.1"),
    record("request", "lone", b"GET /lone HTTP/1.1\r\n\r\n", ["nowhere"]),
    record("metadata", "m2", b"k: z\r\n", ["b", "a"], Content_Type="application/warc-fields"),        # two anchors: the smaller
]


@pytest.mark.parametrize("form", ["plain", "gzip", "members", "cut"])
def test_foreign_archives(spark, tmp_path, form):
    if form == "members":
        (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in FOREIGN))
    elif form == "gzip":
        (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(FOREIGN[:5])))
        (tmp_path / "y.warc").write_bytes(b"".join(FOREIGN[5:]))
    else:
        (tmp_path / "x.warc").write_bytes(b"".join(FOREIGN) + (record("resource", "d", b"0123456789")[:-8] if form == "cut" else b""))
    rows = {r["capture_id"]: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}")).collect()}
    assert set(rows) == {"<a>", "<b>", "<c>", "<lone>"} | ({"<d>"} if form == "cut" else set())
    ids = lambda r: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]])
    assert ids(rows["<a>"]) == (["<ra>"], ["<m2>", "<ma>", "<mma>"]) and ids(rows["<b>"]) == (["<rb>"], [])
    assert ids(rows["<lone>"]) == (["<lone>"], []) and rows["<lone>"]["response"] is None
    assert bytes(rows["<a>"]["response"]["payload"]) == b"body a" and bytes(rows["<c>"]["response"]["payload"]) == b"plain bytes \x00\xff"
    assert rows["<a>"]["metadata"][1]["fields"] == {"k": "v"}
    if form == "cut":
        assert rows["<d>"]["response"]["truncated"] and not rows["<c>"]["response"]["truncated"]


def test_broken_file(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"garbage\r\n")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_records(spark, f"file://{tmp_path}").collect()


def test_files_are_plain_warc(spark, tmp_path):
    path, _ = captured(spark, ROWS[:3], tmp_path)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "archive").glob("part-*.gz"))
    kinds = [h["warc-type"] for h, *_ in warc.walk(io.BytesIO(data))]
    assert sorted(kinds) == ["metadata"] * 3 + ["request"] * 3 + ["response"] + ["revisit"] * 2
    assert data.endswith(b"\r\n\r\n")


def test_from_null_columns_only(spark, tmp_path):
    _, records = captured(spark, [(None, None, None, None, None)] * 2, tmp_path)
    found = warc.resolve_revisits(warc.assemble(records))
    assert [tuple(r) for r in found.collect()] == [(None, 0, hashlib.sha1(b"").hexdigest(), "response", None)] * 2
    assert records.where(F.col("target_uri").isNotNull()).count() == 0

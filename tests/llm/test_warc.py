import base64
import hashlib

from engram.llm import common, warc

PAGES = "page_id long, url string, html string, digest string"


def build(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_revisits(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "ü" * 50
    rows = [(1, "http://a", "same", "x"), (5, "http://b", "same", None), (3, None, "same", None), (2, "http://c\r\nX: y", tricky, None), (4, "u", None, None), (6, "u", "", None), (None, "n", "same", None), (7, "d", "twice", None), (7, "d", "twice", None), (8, "z", "x" * 200_000, None)]
    path = common.new_path(spark, "test-warc")
    warc.write_archives(build(spark, rows).repartition(3), path)
    out = warc.read_archives(spark, path).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.record_id, []).append(r)
    text = {f"<urn:record:{'null' if i is None else i}>": h or "" for i, _, h, _ in rows}
    for k, rs in by.items():
        for r in rs:
            body = text[k].encode()
            assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert r.payload == (body if r.record_type == "response" else None)
    kind = {k: (v[0].record_type, v[0].refers_to) for k, v in by.items()}
    five = ("revisit", "<urn:record:5>")
    assert kind == {"<urn:record:1>": five, "<urn:record:3>": five, "<urn:record:null>": five, "<urn:record:5>": ("response", None), "<urn:record:2>": ("response", None), "<urn:record:4>": ("revisit", "<urn:record:6>"), "<urn:record:6>": ("response", None), "<urn:record:7>": ("response", None), "<urn:record:8>": ("response", None)}
    assert len(by["<urn:record:7>"]) == 2
    assert next(r.target_uri for r in by["<urn:record:2>"]) == "http://c X: y"


def test_short_payloads_and_empty_table(spark):
    path = common.new_path(spark, "test-warc")
    warc.write_archives(build(spark, [(1, "a", "s", None), (2, "b", "s", None)]), path, min_bytes=2)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}
    path = common.new_path(spark, "test-warc")
    warc.write_archives(build(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000_000)
    rows = [(i, "u", chr(97 + i % 26) * (1_000_000 + i), None) for i in range(12)] + [(99, "long", "z" * 5_000_000, None)]
    path = common.new_path(spark, "test-warc")
    warc.write_archives(build(spark, rows).coalesce(1), path)
    out = warc.read_archives(spark, path).collect()
    assert sorted(r.payload_bytes for r in out) == sorted(len(h) for _, _, h, _ in rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count()
    assert files >= 12

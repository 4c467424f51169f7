"""WARC archives with revisit resolution.

Headers alone (id, URI, payload digest, length) are shuffled by payload digest; of the records with one digest the
largest id is the original response and the others are joined to it as revisits. The archives are then written
deduplicated and with fresh headers: a response carries its payload, a revisit only the HTTP head and what it
refers to. Records are built by column expressions and written by Spark's text writer, whose line separator is the
end of a WARC record, so archives can lie in any store that Spark writes. Reading parses each file as a stream by
Content-Length, whatever the payload holds.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

DATE = "2024-01-01T00:00:00Z"
#: Records with a shorter payload are always responses.
MIN_BYTES = 0
#: Records of one archive file at most, and the bytes that a file has on average: a file is read into one task's memory.
FILE_RECORDS, FILE_BYTES = 10_000, 64_000_000
#: The digits that conv() writes and those of base32.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload) -> F.Column:
    """The bare upper-case base32 SHA-1 of a binary column: eight digits for each 40 of the 160 bits."""
    h = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, 10 * g + 1, 10), 16, 32), 8, "0"), DIGITS, BASE32) for g in range(4)])


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, URI, payload, its digest and length, one row per page; a null payload is empty."""
    payload = common.utf8(html_col)
    return pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col).cast("string"), "[\r\n]+", " ").alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"),
    )


def revisits(head: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Which (id, digest) revisit which original: id, digest, refers_to, refers_uri, one row for each pair.

    Counted with map-side combining; the originals of digests that occur twice are written out, so that the join has
    plain exchanges on both sides and a hot digest can be split.
    """
    slim = head.filter(F.col("n") >= min_bytes).select("id", "uri", "digest")
    originals = slim.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least"), F.max_by("uri", "id").alias("refers_uri"), F.count(F.lit(1)).alias("copies"), F.count("id").alias("ids"))
    originals = common.written(originals.filter("least < refers_to or ids < copies").select("digest", "refers_to", "refers_uri"), "originals")
    pairs = slim.select("id", "digest").join(originals, "digest").filter("not (id <=> refers_to)")
    return pairs.groupBy("id", "digest").agg(F.first("refers_to").alias("refers_to"), F.first("refers_uri").alias("refers_uri"))


def record(record_type, date: str) -> F.Column:
    """The text of one record without its end."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n"), F.lit(END + END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    fields = F.concat_ws(
        END, F.lit("WARC/1.1"), line("WARC-Type", record_type), line("WARC-Record-ID", urn("id")), F.lit(f"WARC-Date: {date}"), line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, line("WARC-Refers-To", urn("refers_to"))), F.when(revisit, line("WARC-Refers-To-Target-URI", F.col("refers_uri"))), F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", size),
    )
    return F.concat(fields, F.lit(END + END), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write one record per row of ``pages`` to gzipped archives in ``path``.

    Null payloads are empty; a null URI has no target line; a null id is a revisit wherever an equal payload has an
    id, else a response. Rows that repeat the original's id and payload are responses as well, under the same record id. An empty
    table writes no record. Records lie in the order of their digests, so at random, and a file ends after as many as
    have ``FILE_BYTES`` together by the mean; with that a file of many records is about as large, plus its largest one.
    """
    head = headers(pages, id_col, url_col, html_col)
    seen = pages.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.coalesce(F.col(html_col), F.lit(""))) + F.lit(512)).alias("bytes")).first()
    per_file = max(1, min(FILE_RECORDS, FILE_BYTES * seen["rows"] // max(1, seen["bytes"] or 1)))
    links = revisits(head, min_bytes).withColumnsRenamed({"id": "id2", "digest": "digest2"})
    joined = head.join(links, (F.col("digest") == F.col("digest2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    text = joined.select(record(F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"), date).alias("value"))
    text.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive as (fields with lower-case names, block)."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut off")
        yield fields, block


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in ``path``: record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload.

    A response's digest is computed anew and must equal its header. Revisits have no payload; their length is that of
    their HTTP head. Without ``payload`` that column is null. A file is read into memory as it lies (compressed), its records one by one;
    what other tools have written must fit so too. A folder without archives gives no rows.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        out = {f.name: [] for f in schema}
        for b in rows:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = io.BytesIO(content.as_py())
                held = 0
                for f, block in parse(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw):
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest, size = f.get("warc-payload-digest", "").rpartition(":")[2], len(body)
                    if f["warc-type"] == "revisit":
                        body = None
                        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    elif digest != base64.b32encode(hashlib.sha1(body).digest()).decode():
                        raise ValueError(f"the payload of {f.get('warc-record-id')} doesn't have its digest")
                    for k, v in zip(out, (f.get("warc-record-id"), f["warc-type"], f.get("warc-target-uri"), f.get("warc-refers-to"), digest, size, body if payload else None)):
                        out[k].append(v)
                    held += len(body or b"") if payload else 64
                    if held > 8_000_000:
                        yield from common.batches(out, schema)
                        held = 0
            yield from common.batches(out, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(read, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def record_number(column: str, to: str) -> F.Column:
    """The id within a record's URN."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:record:(.*)>$', 1) as {to})")

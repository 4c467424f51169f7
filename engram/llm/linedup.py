"""Line dedup by overlapping three-line windows.

Every run of ``WINDOW`` consecutive lines is hashed to 128 bits. A window seen in an earlier document, or earlier
in the same document, is a later occurrence, and the lines that later occurrences cover, merged, are
removed. Documents are ordered by id, windows by place.

Only the first of equal windows within a document is sent around; equal windows of different documents are counted with
map-side combining, so a window in a third of all documents is one row per map task. The join that finds the
later occurrences has plain exchanges on both sides, so adaptive execution can split a hot window. Places come
back to their documents by a 128-bit row key, and the last pass over the texts removes the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm import common

WINDOW = 3


def window_hashes(lines: list[bytes], window: int) -> list[bytes | None]:
    """128-bit hashes of the windows by place; none for a window of blank lines only."""
    digest = xxhash.xxh3_128_digest
    blank = [not x.strip() for x in lines]
    return [None if all(blank[i : i + window]) else digest(b"\n".join(lines[i : i + window])) for i in range(len(lines) - window + 1)]


def line_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, ``text_col`` without removed lines, plus n_lines, n_removed, n_spans.

    Lines are what ``\\n`` separates; a text of fewer lines than a window, and a null or empty text, stays as it is
    (null and empty have 0 lines). Windows of blank lines only never count. Rows that share an id are no "earlier documents" of each
    other: each is cleaned against smaller ids and itself, so repeated rows give repeated rows. A null id
    comes after all others. A helper column's name is changed where ``docs`` has it already; a column named like
    one of the three counts is replaced.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_lines", "n_removed", "n_spans"}])
    key, key2, at = common.fresh(docs, "row_key", "row_key2", "later_at")
    id_type = docs.schema[id_col].dataType
    if isinstance(id_type, T.IntegralType):
        order, order_type = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "long"
    else:  # text ids in the order of their bytes
        order, order_type = F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1")), "string"
    k1, k2 = common.row_key(id_col, text_col)
    keyed = docs.withColumn(key, k1).withColumn(key2, k2)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            h, doc, place = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                first: dict[bytes, int] = {}
                for p, x in enumerate(window_hashes(text.split(b"\n"), window)):
                    if x is not None:
                        first.setdefault(x, p)
                h.extend(first), place.extend(first.values()), doc.extend([i] * len(first))
            doc = pa.array(doc, pa.int64())
            whole = pa.py_buffer(b"".join(h))
            halves = pa.Array.from_buffers(pa.int64(), 2 * len(h), [None, whole])
            even = pa.array(range(0, 2 * len(h), 2), pa.int64())
            odd = pa.array(range(1, 2 * len(h), 2), pa.int64())
            yield pa.RecordBatch.from_arrays([halves.take(even), halves.take(odd), *(c.take(doc) for c in b.columns[:3]), pa.array(place, pa.int32())], ["h1", "h2", "ord", "k", "k2", "place"])

    windows = keyed.filter(F.instr(text_col, "\n") > 0).select(order.alias("ord"), F.col(key).alias("k"), F.col(key2).alias("k2"), common.utf8(text_col).alias("text")).mapInArrow(emit, f"h1 long, h2 long, ord {order_type}, k long, k2 long, place int")
    repeated = windows.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").select("h1", "h2", "first")
    repeated = common.written(repeated, "repeated-windows")
    later = windows.join(repeated, ["h1", "h2"]).filter("ord > first").groupBy(F.col("k").alias(key), F.col("k2").alias(key2)).agg(F.collect_set("place").alias(at))
    shape = keyed.join(later, [key, key2], "left").drop(key, key2)
    names = [*docs.columns, at]
    out = [*docs.columns, "n_lines", "n_removed", "n_spans"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_removed long, n_spans long"
    text_at = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))

    def clean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts, n_lines, n_removed, n_spans = [], [], [], []
            for text, places in zip(b.column(text_at).to_pylist(), b.column(len(names) - 1).to_pylist()):
                lines = text.split("\n") if text else []
                gone = bytearray(len(lines))
                seen: set[bytes] = set()
                later_at = set(places or ())
                for p, x in enumerate(window_hashes([x.encode() for x in lines], window) if len(lines) >= window else ()):
                    if x is None:
                        continue
                    if x in seen or p in later_at:
                        gone[p : p + window] = b"\x01" * window
                    # a window that is later than another document's is later wherever it stands again here
                    seen.add(x)
                removed = sum(gone)
                texts.append("\n".join(x for x, g in zip(lines, gone) if not g) if removed else text)
                n_lines.append(len(lines)), n_removed.append(removed), n_spans.append(bytes(b"\0" + gone).count(b"\0\x01"))
            cols = [*b.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, out)

    return shape.select(*names).mapInArrow(clean, types)

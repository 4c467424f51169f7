"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to Python: a batch of long texts ends at the bytes (one row at least).
BATCH_ROWS, BATCH_BYTES = 256, 32_000_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ``BATCH_ROWS`` and ``BATCH_BYTES`` where they are larger.

    Spark reads them when a plan runs, which is after an operator has returned, so they stay set.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def bounded_batches(spark: SparkSession) -> None:
    """Lower the bytes of the session's Arrow batches to ``BATCH_BYTES`` where they are larger; for passes whose rows are small after a first one over texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master, whose only process is this one; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/engram-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; one of fewer files than cores is dealt to all cores, one of many files stays as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def row_key(*columns: str) -> tuple[F.Column, F.Column]:
    """Two 64-bit hashes of a row's columns, so 128 bits: rows of one key are copies, and what is found of one holds for all."""
    values = [F.col(c).cast("string") for c in columns]
    return F.xxhash64(*values), F.xxhash64(F.lit("second"), *reversed(values))


def utf8(column) -> F.Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def batches(rows: dict[str, list], schema: pa.Schema, at_least: int = 0) -> Iterator[pa.RecordBatch]:
    """The gathered rows as one batch, and an empty ``rows`` again; nothing below ``at_least`` rows."""
    n = len(next(iter(rows.values())))
    if n and n >= at_least:
        yield batch_of(schema, **rows)
        for v in rows.values():
            v.clear()

"""Numbers within keys, without one sort a key.

Rows are dealt by ranges of (key, order), counted by key and range, and the counts summed up over the ranges: a row's number is what lies in
earlier ranges of its key plus its place in its own range. A key that holds most rows is spread over as many tasks as it fills ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import storage


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within the rows of equal ``keys`` (null is a key) by ``order``.

    ``order`` should tell all rows of a key apart: rows that it doesn't tell apart share a range, and are numbered in any order.
    """
    part, before = (f"_{name}_{x}" for x in ("range", "before"))
    ranged = storage.written(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, part).count()
    past = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows a key as there are ranges at most
    offsets = counts.select(*(F.col(k).alias(f"_{name}_{i}") for i, k in enumerate(keys)), F.col(part).alias(f"_{name}_of"), F.coalesce(F.sum("count").over(past), F.lit(0)).alias(before))
    same = ranged[part] == offsets[f"_{name}_of"]
    for i, k in enumerate(keys):
        same &= ranged[k].eqNullSafe(offsets[f"_{name}_{i}"])
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    return ranged.join(offsets, same).withColumn(name, (F.col(before) + own).cast("long")).select(*df.columns, name)

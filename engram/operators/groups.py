"""Groups of linked nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators import storage

MAX_STEPS = 60


def groups(links: DataFrame) -> DataFrame:
    """The least reachable node of every node in ``links`` (u, v): node, group. Labels spread over links, and in each step a label takes that of
    its own label, so chains shorten by half. Steps are written to the shared folder."""
    ends = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = storage.written(links.filter("u <> v").select(F.inline(ends)).distinct(), "links")  # links are read once: what makes them may be long
    now = storage.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(MAX_STEPS):
        near = both.join(now.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        spread = now.join(near, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jumped = spread.join(now.select(F.col("u").alias("label"), F.col("label").alias("next")), "label", "left").select("u", F.least("label", F.coalesce("next", "label")).alias("label"), "before")
        step = storage.written(jumped, "labels")
        now = step.select("u", "label")
        if step.filter("label <> before").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("label").alias("group"))
    raise RuntimeError("groups did not settle")

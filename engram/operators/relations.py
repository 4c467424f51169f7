"""Relations between entities that stand in one record, kept up as records change.

A relation is a row (source, target, memory_id, at): the record that it comes from and since when. A change is a set of signed rows: what the changed and
forgotten records gave leaves with -1, what the changed ones give now comes with +1. One aggregation merges them; relations of other records aren't made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["source", "target", "memory_id"]


def relations(found: DataFrame, born: DataFrame) -> DataFrame:
    """Relations among the entities (id, name_key) of each record, since ``born`` (id, at). Names are in order, and a record gives a pair once."""
    names = found.select("id", "name_key").distinct()
    pairs = names.withColumnRenamed("name_key", "source").join(names.withColumnRenamed("name_key", "target"), "id").filter("source < target")
    return pairs.join(born.select("id", "at"), "id").select("source", "target", F.col("id").alias("memory_id"), "at")


def deltas(table: DataFrame, written: DataFrame, forgotten: DataFrame, now: Column) -> DataFrame:
    """Signed rows of a change: ``written`` has the entities (id, name_key; a null name for a record without any) of new and changed records, ``forgotten`` the ids that go."""
    ids = written.select("id").unionAll(forgotten.select("id")).distinct()
    gone = table.join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi").select(*KEYS, "at", F.lit(-1).alias("sign"))
    kept = written.filter("name_key is not null").join(forgotten.select("id").distinct(), "id", "left_anti")
    fresh = relations(kept, kept.select("id").distinct().withColumn("at", now))
    return gone.unionByName(fresh.withColumn("sign", F.lit(1)))


def merged(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The relations after the signed rows ``changes``."""
    both = table.select(*KEYS, "at", F.lit(1).alias("sign")).unionByName(changes)
    g = both.groupBy(*KEYS).agg(F.sum("sign").alias("n"), F.max(F.when(F.col("sign") > 0, F.col("at"))).alias("at"))
    return g.filter("n > 0").select(*KEYS, "at")


def newest(table: DataFrame, n: int = 4) -> DataFrame:
    """The newest relations of each entity, from either end: name_key, nth, and the relation. A frequent entity's are cut to ``n`` before they are shuffled."""
    ends = table.withColumn("name_key", F.explode(F.array("source", "target")))
    w = Window.partitionBy("name_key").orderBy(F.col("at").desc(), *KEYS)
    return ends.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).select("name_key", "nth", *KEYS, "at")


def context(hits: DataFrame, found: DataFrame, table: DataFrame, asked: DataFrame, most_hits: int = 5, per_entity: int = 4, lines: int = 8) -> DataFrame:
    """Per query (query_id, relations, context) the newest relations of its own entities ``asked`` (query_id, name_key), then of its best hits' by rank; without any, the entities.

    A relation stands once a record that it comes from, so a line may be repeated. Entities of one place go by name.
    """
    of_hits = hits.filter(F.col("rank") <= most_hits).join(found.select("id", "name_key").distinct(), "id").select("query_id", "name_key", F.col("rank").alias("place"))
    mine = of_hits.unionByName(asked.select("query_id", "name_key", F.lit(0).alias("place"))).groupBy("query_id", "name_key").agg(F.min("place").alias("place"))
    near = mine.join(newest(table, per_entity), "name_key").groupBy("query_id", *KEYS).agg(F.min(F.struct("place", "name_key", "nth")).alias("k"))
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("k", *KEYS))).filter(F.col("n") <= lines)
    text = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x.line), "\n")
    rel = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("relations"), text(F.concat(F.lit("- "), "source", F.lit(" co_occurs "), "target")).alias("rel"))
    first = mine.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "name_key"))).filter(F.col("n") <= lines)
    names = first.groupBy("query_id").agg(text(F.concat(F.lit("- "), "name_key")).alias("names"))
    shown = F.when(F.col("rel").isNotNull(), F.concat(F.lit("Related entity graph:\n"), "rel")).otherwise(F.concat(F.lit("Related entities:\n"), "names"))
    return names.join(rel, "query_id", "left").select("query_id", F.coalesce("relations", F.lit(0)).cast("long").alias("relations"), shown.alias("context"))

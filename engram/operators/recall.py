"""Recall in layers: what a turn is answered with, put together from records, index, documents, tasks and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import governance, search, storage, tasks

#: What tells a host how to use the memory.
HINT = "Long-term memory is available. Treat recalled entries as supporting context, prefer newer ones where they disagree, and read a record by its id before quoting it."


def retrieval_context(hits: DataFrame, records: DataFrame, most: int = 4000) -> DataFrame:
    """The retrieval layer's text: a head and a line a hit by rank, cut to ``most``: query_id, retrieval."""
    j = storage.written(hits.select("query_id", "rank", "id", "score"), "hits").join(records.select("id", "kind", "source", "tags", "summary", "content"), "id")
    marks = F.concat_ws("; ", F.concat(F.lit("id "), "id"), F.concat(F.lit("source "), "source"), F.when(F.size("tags") > 0, F.concat(F.lit("tags "), F.array_join("tags", ", "))), F.concat(F.lit("score "), F.format_string("%.2f", "score")))
    text = F.coalesce(F.when(T.trim("summary") != "", T.trim("summary")), T.trim("content"))
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), text, F.lit(" ("), marks, F.lit(")"))
    g = j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line), "\n").alias("lines"))
    return g.select("query_id", T.clamp_chars(F.concat(F.lit("Relevant memory:\n"), "lines"), most).alias("retrieval"))


def layers(turns: DataFrame, records: DataFrame, now: Column, requested: DataFrame | None = None, documents: DataFrame | None = None, windows: DataFrame | None = None, graph: DataFrame | None = None, most: int = 4000, indexed: DataFrame | None = None, retriever: DataFrame | None = None) -> DataFrame:
    """The layers of each turn and what is injected: query_id, palace, retrieval, active, task, graph, navigation, stable, dynamic, injected.

    ``turns``: query_id, text, recent (earlier messages), scope_key (whose documents are read), task_id. ``documents`` are active ones (scope_key,
    kind, content), ``windows`` task windows (task_id, window), ``graph`` graph contexts (query_id, context), ``retriever`` hits of another
    retriever (query_id, rank, id, score), shown beside the records. Layers that are empty are null. What stays equal
    between turns (documents, navigation) stands before what doesn't.
    """
    q = turns.select("query_id", search.recall_query(F.col("text"), F.col("recent")).alias("text"))
    hits = search.search(records, q, now, requested=requested, indexed=indexed)
    palace = search.recall_context(hits, records, most).filter("blocks > 0").select("query_id", F.col("context").alias("palace"))
    parts = turns.select("query_id", "scope_key", "task_id").join(palace, "query_id", "left")
    if retriever is not None:
        parts = parts.join(retrieval_context(retriever, records, most), "query_id", "left")
    else:
        parts = parts.withColumn("retrieval", F.lit(None).cast("string"))
    if documents is not None:
        parts = parts.join(governance.active_context(documents).select("scope_key", F.when(T.trim("context") != "", F.col("context")).alias("active")), "scope_key", "left")
    else:
        parts = parts.withColumn("active", F.lit(None).cast("string"))
    parts = parts.join(windows.select("task_id", F.when(T.trim("window") != "", F.col("window")).alias("task")), "task_id", "left") if windows is not None else parts.withColumn("task", F.lit(None).cast("string"))
    parts = parts.join(graph.select("query_id", F.col("context").alias("graph")), "query_id", "left") if graph is not None else parts.withColumn("graph", F.lit(None).cast("string"))
    room = 0 if most < 300 else min(1200, max(500, most // 5))
    nav = search.navigation(records, most=room).select("scope_key", F.col("navigation").alias("nav"))
    parts = parts.join(nav, "scope_key", "left").withColumn("navigation", F.when(F.coalesce("palace", "retrieval", "active", "task").isNotNull(), F.col("nav"))).drop("nav")
    parts = parts.withColumn("palace", F.array_join(F.array_compact(F.array("palace", "graph")), "\n\n"))
    parts = storage.written(parts, "parts")  # a row a turn, read twice
    whole = governance.layered(parts.withColumn("palace", F.when(F.col("palace") != "", F.col("palace"))))
    out = parts.join(whole, "query_id").withColumn("palace", F.when(F.col("palace") != "", F.col("palace")))
    return out.select("query_id", "palace", "retrieval", "active", "task", "graph", "navigation", "stable", "dynamic", T.join_nonblank("\n\n", "stable", "dynamic").alias("injected"))


def task_windows(turns: DataFrame, task_table: DataFrame, entries: DataFrame, decisions: DataFrame, most: int = 4000) -> DataFrame:
    """The window of each turn's task, in its share of a recall's characters."""
    asked = turns.filter("task_id is not null").groupBy("task_id").agg(F.max("text").alias("query"), F.lit(None).cast("string").alias("tool_context"))
    return tasks.windows(task_table, entries, decisions, asked, most=max(400, int(most * 0.35)))


def reflections(inputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What captured reflections (ord, scope_type, scope_id, scope_key, summary, tags, task_id, metadata) write: experience records (inputs for
    ``remember``), lines for the scopes' experience documents (scope_key, ord, content), and decisions (task_id, id, content)."""
    r = inputs.filter(T.trim("summary") != "").withColumn("summary", T.trim("summary"))
    records = r.select("ord", "scope_type", "scope_id", "scope_key", F.lit("experience").alias("kind"), F.col("summary").alias("content"), "summary", F.lit(0.7).alias("confidence"), F.lit(0.7).alias("importance"), F.lit("reflection").alias("source"), "tags", "metadata")
    lines = r.groupBy("scope_key").agg(F.max("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x.summary), "\n").alias("recent"))
    decisions = r.filter("task_id is not null").select("task_id", F.sha2(F.concat_ws("|", "task_id", F.col("ord").cast("string"), "summary"), 256).alias("id"), F.col("summary").alias("content"))
    return records, lines, decisions


def durable_writes(proposals: DataFrame, stored: DataFrame) -> DataFrame:
    """Proposals that no record of their scope already says word for word."""
    known = stored.select("scope_key", T.trim("content").alias("content")).distinct()
    return proposals.join(known, ["scope_key", "content"], "left_anti")

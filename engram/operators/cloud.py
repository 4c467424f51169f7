"""Synchronisation, metering, plan gates, events and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import numbering

#: Limits by plan (null: none) and features.
PLANS = [
    # plan, per period, total, agents, seats, sync, embedding, console, rbac, marketplace, dashboard
    ("free", 500, 2_000, 1, 1, False, False, False, False, False, False),
    ("pro", 5_000, 50_000, 10, 1, True, True, True, False, False, False),
    ("team", 50_000, 500_000, 50, 50, True, True, True, True, True, True),
    ("enterprise", None, None, None, None, True, True, True, True, True, True),
]
PLAN_SCHEMA = "plan string, per_period long, total long, max_agents long, max_seats long, sync boolean, embedding boolean, console boolean, rbac boolean, marketplace boolean, dashboard boolean"


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, PLAN_SCHEMA)


def usage(events: DataFrame) -> DataFrame:
    """Counters of each project and month: written, embeddings, sync operations."""
    of = lambda kind: F.count_if(F.col("counter") == kind)
    return events.groupBy("project_id", F.date_format("ts", "yyyy-MM").alias("period")).agg(of("memoriesWritten").alias("memories_written"), of("embeddingsCount").alias("embeddings_count"), of("syncOperations").alias("sync_operations"))


def gates(used: DataFrame, plan_table: DataFrame) -> DataFrame:
    """What a project may do under its plan (project_id, plan, memories_written, agents, seats)."""
    j = used.join(F.broadcast(plan_table), "plan")
    below = lambda value, limit: F.col(limit).isNull() | (F.col(value) < F.col(limit))
    return j.select(
        "project_id", "plan", below("memories_written", "per_period").alias("write_memory"), F.col("sync").alias("cloud_sync"), F.col("embedding").alias("cloud_embedding"), F.col("console").alias("cloud_console"),
        below("agents", "max_agents").alias("multi_agent"), F.col("rbac"), F.col("marketplace").alias("bridge_marketplace"), (F.col("dashboard") & below("seats", "max_seats")).alias("team_dashboard"),
    )


def numbered(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Changes (of one row an id) with sync versions: past the project's greatest, in order. A project of any size is numbered by ranges."""
    top = current.groupBy("project_id").agg(F.max("sync_version").alias("top"))
    counted = numbering.numbered(changes, ["project_id"], [F.col("ord"), F.col("id")], "_number")
    return counted.join(top, "project_id", "left").withColumn("sync_version", (F.coalesce("top", F.lit(0)) + F.col("_number")).cast("long")).drop("top", "_number")


def pushable(local: DataFrame) -> DataFrame:
    """Local records never synchronised: version 0 or none."""
    return local.filter(F.coalesce("sync_version", F.lit(0)) == 0)


def pulled(local: DataFrame, remote: DataFrame, since: Column) -> DataFrame:
    """What a pull does to each id: insert, replace, delete or keep; the remote one wins when at least as new, tombstones delete."""
    r = remote.filter(F.col("sync_version") > since).select("id", F.col("updated_at").alias("r_at"), F.col("deleted_at").isNotNull().alias("gone"), "sync_version")
    j = local.select("id", F.col("updated_at").alias("l_at")).join(r, "id", "full")
    action = F.when(F.col("r_at").isNull(), "keep").when(F.col("gone"), F.when(F.col("l_at").isNull(), "skip").otherwise("delete")).when(F.col("l_at").isNull(), "insert").when(F.col("r_at") >= F.col("l_at"), "replace").otherwise("keep")
    return j.select("id", action.alias("action"), "sync_version")


def pull_applied(local: DataFrame, remote: DataFrame, since: Column) -> DataFrame:
    """The local records after a pull of the remote ones (same columns, and deleted_at): what ``pulled`` decides is carried out."""
    names = [c for c in local.columns if c != "sync_version"]
    does = pulled(local, remote, since)
    kept = local.join(does.filter("action = 'keep'").select("id"), "id", "left_semi")
    taken = remote.join(does.filter("action in ('insert', 'replace')").select("id"), "id", "left_semi")
    return kept.select(*names, "sync_version").unionByName(taken.select(*names, "sync_version"))


def push_applied(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (project_id, id, ord, sync_version, ...) after a push: local records without a version get the next ones of their project and
    stand on the remote side as well. A record that was synchronised keeps its version, whatever became of its text."""
    new = numbered(pushable(local).drop("sync_version"), remote)
    versions = new.select("id", F.col("sync_version").alias("pushed"))
    after = local.join(versions, "id", "left").withColumn("sync_version", F.coalesce("pushed", "sync_version")).drop("pushed")
    return after, upserted(remote, new.select(*remote.columns))


def upserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def cursors(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The cursor of each project (project_id, last_version) after records with these versions were pulled or pushed; it never goes back."""
    return state.unionByName(seen.groupBy("project_id").agg(F.max("sync_version").alias("last_version"))).groupBy("project_id").agg(F.max("last_version").alias("last_version"))


def visible(rows: DataFrame, owners: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (project_id) that each user may see: as owner or member; union of keys, then a semi-join."""
    keys = owners.select("user_id", "project_id").unionAll(members.select("user_id", "project_id")).distinct()
    return rows.join(keys, "project_id").select("user_id", "project_id", "id")


def trail(events: DataFrame, most: int = 2000) -> DataFrame:
    """The bounded audit trail: the newest events, a top-k."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(most)


def page(events: DataFrame, kind: str | None, limit: int, offset: int) -> DataFrame:
    out = events.filter(F.col("type") == kind) if kind else events
    return out.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(offset).limit(min(limit, 500))


def key_hash(c: str) -> Column:
    return F.sha2(F.col(c), 256)


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of events by time window and type."""
    return events.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, category: str = "category") -> DataFrame:
    """recall@5, recall@10, NDCG@10 of the first relevant hit, per category and over all.

    ``ranked``: query_id, rank from 1, id. ``truth``: query_id, id, category.
    """
    asked = truth.select("query_id", category).distinct()
    first = ranked.join(truth.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    j = asked.join(first, "query_id", "left")
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    ndcg = F.avg(F.when(F.col("first") <= 10, 1 / F.log2(F.col("first") + 1)).otherwise(0.0))
    return j.rollup(category).agg(F.count(F.lit(1)).alias("questions"), at(5).alias("recall_5"), at(10).alias("recall_10"), ndcg.alias("ndcg_10")).select(F.coalesce(category, F.lit("all")).alias(category), "questions", "recall_5", "recall_10", "ndcg_10")

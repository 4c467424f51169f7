"""Whole turns and sessions committed to the memory: compositions of capture, tasks, sessions and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import capture, scopes, tasks
from engram.sources import sessions


def captured_inputs(turns: DataFrame, floor: bool = True) -> DataFrame:
    """What a batch of turns writes: inputs for ``remember`` (ord, scope, kind, content, ...), each in the scope where it lasts.

    Turns have turn_id, user_message, project_id, repo_id, user_id, agent_id, task_id. Host markup goes first; a turn without
    a person's words writes nothing, and with ``floor`` neither does a proposal of fewer than six characters.
    """
    made = capture.proposals(turns.withColumn("user_message", T.sanitize("user_message")), floor=floor)
    c = F.col
    write = scopes.write_scope(c("project_id"), c("repo_id"), c("agent_id"))
    task = scopes.task_id(c("project_id"), c("repo_id"), c("task_id"))
    j = made.join(turns.select("turn_id", "project_id", "repo_id", "user_id", "agent_id", "task_id"), "turn_id").withColumn("scope", scopes.durable_scope(c("kind"), c("user_id"), task, write))
    kind, ident = F.split_part("scope", F.lit(":"), F.lit(1)), F.regexp_replace("scope", "^[^:]*:", "")
    return j.select(
        F.xxhash64("turn_id", "ord").alias("ord"), "turn_id", kind.alias("scope_type"), ident.alias("scope_id"), F.lower("scope").alias("scope_key"), "kind", "content", F.col("content").alias("summary"), "confidence", "importance", "source", "tags",
        F.to_json(F.struct(F.col("project_id").alias("projectId"))).alias("metadata"),
    )


def session_records(messages: DataFrame, info: DataFrame, agent: str, now: Column) -> DataFrame:
    """The record of each session with user messages: id by session and task, title, summary, content, message count and last message's hash.

    ``messages``: session_id, ord, role, content. ``info``: session_id, cwd, started, rolling_summary.
    """
    line = F.struct("ord", F.concat("role", F.lit(": "), "content").alias("line"))
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("ord")))
    m = messages.groupBy("session_id").agg(first.alias("first_user"), F.count(F.lit(1)).alias("message_count"), F.max_by(T.message_hash("role", "content"), "ord").alias("last_message_hash"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n\n").alias("transcript"))
    j = m.filter("first_user is not null").join(info, "session_id", "left")
    place = F.coalesce(F.element_at(F.filter(F.split("cwd", "/"), lambda x: x != ""), -1), F.lit("session"))
    task = F.concat(F.lit(agent + ":"), "session_id")
    summary = F.when(F.coalesce(T.trim("rolling_summary"), F.lit("")) != "", T.trim("rolling_summary"))
    head = F.concat_ws("\n", F.concat(F.lit(f"{agent} session: "), "session_id"), F.concat(F.lit("Started: "), F.col("started")), F.concat(F.lit("Working directory: "), F.col("cwd")), F.concat(F.lit("Task id: "), task))
    return j.select(
        "session_id", F.sha2(F.concat_ws("|", "session_id", task), 256).alias("id"), task.alias("task_id"), T.clamp_chars(F.concat(F.lit(agent + " "), place, F.lit(": "), "first_user"), 120).alias("title"),
        T.clamp_chars(F.concat(F.lit(agent + " session in "), place, F.lit(": "), F.coalesce(summary, "first_user", "session_id")), 220).alias("summary"), F.concat(head, F.lit("\n\nSession summary:\n"), F.coalesce(summary, "transcript")).alias("content"),
        "message_count", "last_message_hash", now.alias("updated_at"),
    )


def committed(messages: DataFrame, imported: DataFrame, entries: DataFrame, known: DataFrame, state: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """A commit of sessions: the entries that it appends (only past those imported before), and the summaries afterwards.

    A session's task is made if it doesn't exist; a session without new messages changes nothing.
    """
    new = sessions.new_messages(messages, imported).select(F.concat(F.lit(agent + ":"), "session_id").alias("task_id"), "ord", "role", "content")
    every = known.select("task_id").unionByName(new.select("task_id")).distinct()
    added = tasks.appended(entries, new, every)
    pending = entries.select("task_id", "sequence", "content", "summary", "summarized").unionByName(added.select("task_id", "sequence", "content", F.lit(None).cast("string").alias("summary"), F.lit(False).alias("summarized")))
    touched = pending.join(added.select("task_id").distinct(), "task_id", "left_semi")
    return added, tasks.rolling_summaries(touched, state)

"""Chat sessions and other JSON files as tables, and tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as T

PARTS = "array<struct<type:string,text:string>>"


def flat_content(content: Column) -> Column:
    """The text of a message: a string, or the text parts of a JSON array of parts, a line each."""
    parts = F.from_json(content, PARTS)
    texts = F.transform(F.filter(parts, lambda p: p["type"].isin("text", "input_text", "output_text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.when(T.trim(content).startswith("[") & parts.isNotNull(), F.array_join(texts, "\n")).otherwise(content)


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of session files (JSON with id and messages): session_id, ord, role, content; blank ones dropped."""
    schema = "id string, timestamp string, cwd string, messages array<struct<role:string,content:string>>"
    s = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder)
    m = s.select(F.col("id").alias("session_id"), F.posexplode("messages").alias("ord", "m"))
    return m.select("session_id", "ord", F.col("m.role").alias("role"), flat_content(F.col("m.content")).alias("content")).filter(T.trim("content") != "")


def new_messages(messages: DataFrame, imported: DataFrame) -> DataFrame:
    """Messages past those imported before (session_id, message_count), of sessions in which a user speaks."""
    spoken = messages.filter("role = 'user'").select("session_id").distinct()
    j = messages.join(spoken, "session_id", "left_semi").join(imported, "session_id", "left")
    return j.filter(F.col("ord") >= F.coalesce("message_count", F.lit(0))).drop("message_count")


def transcript_tail(lines: DataFrame) -> DataFrame:
    """The last user and the last assistant message of JSONL transcripts (session_id, ord, line); bad lines are skipped."""
    e = lines.select("session_id", "ord", F.from_json("line", "role string, content string").alias("e")).filter("e.role is not null")
    last = lambda role: F.max_by(F.when(F.col("e.role") == role, F.col("e.content")), F.when(F.col("e.role") == role, F.col("ord")))
    return e.groupBy("session_id").agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def iso_time(value: Column) -> Column:
    """Times as ISO text or as epoch milliseconds in text or number; null where neither."""
    return F.coalesce(F.try_to_timestamp(value.cast("string")), F.timestamp_millis(value.cast("string").try_cast("bigint")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions over session haystacks: one row per question and session: question_id, category, question, session_id, text, relevant."""
    schema = "question_id string, question_type string, question string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
    q = spark.read.schema(schema).option("multiLine", True).json(path)
    e = q.select("question_id", F.col("question_type").alias("category"), "question", "answer_session_ids", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("z"))
    text = F.array_join(F.transform("z.haystack_sessions", lambda m: F.concat(m.role, F.lit(": "), m.content)), "\n")
    return e.select("question_id", "category", "question", F.col("z.haystack_session_ids").alias("session_id"), text.alias("text"), F.array_contains("answer_session_ids", F.col("z.haystack_session_ids")).alias("relevant"))


def write_mirror(records: DataFrame, folder: str) -> None:
    """A readable mirror: an index and the records as JSON lines by kind, and a text dump to search in; older files go."""
    records.select("id", "kind", "scope_key", "summary", "updated_at").write.mode("overwrite").json(f"{folder}/index")
    records.write.mode("overwrite").partitionBy("kind").json(f"{folder}/records")
    records.select(F.concat_ws(" | ", "id", "scope_key", T.collapse("content")).alias("value")).write.mode("overwrite").text(f"{folder}/dump")


def export_json(records: DataFrame, limit: int = 1000) -> DataFrame:
    """Records as JSON text, newest first, 5000 at most."""
    return records.orderBy(F.col("updated_at").desc(), "id").limit(min(limit, 5000)).select(F.to_json(F.struct(*records.columns)).alias("json"))

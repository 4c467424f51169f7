"""The driver's tables as the memory model's tables, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as T

SCOPE_TYPES = ["agent", "session", "user", "task", "document", "project", "repo"]
KINDS = ["fact", "preference", "decision", "identity", "experience", "lesson", "note", "principle"]
#: The instant at which all queries over these views stand.
NOW = "2025-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores dealt to all cores, for passes that are heavy on each row; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as records."""
    d, labels = spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")
    n = F.col("doc_id")
    hours = lambda h: F.timestamp_seconds(F.lit(1704067200) + h * 3600)
    at = hours(n % 8000)
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    meta = F.to_json(
        F.struct(
            F.when(n % 3 == 0, n % 5).alias("recallCount"),
            F.when(n % 3 == 0, F.date_format(hours(n % 8000 + (n % 11) * 720), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("lastRecalledAt"),
            F.when(n % 13 == 0, F.date_format(hours(n % 8000 + (n % 17) * 600), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("validUntil"),
            F.when(n % 26 == 0, F.concat(F.lit("doc-"), n + 1)).alias("supersededBy"),
            F.when(n % 9 == 0, F.concat(F.lit("conv:"), n % 50)).alias("taskId"),
            F.when(n % 8 == 7, F.array(F.concat(F.lit("doc-"), n - 1), F.concat(F.lit("doc-"), n * 3))).alias("supports"),
        )
    )
    out = d.join(labels, "doc_id", "left").select(
        n, F.concat(F.lit("doc-"), n).alias("id"), pick(SCOPE_TYPES, n % 7).alias("scope_type"), F.col("source").alias("scope_id"), pick(KINDS, n % 8).alias("kind"),
        F.col("text").alias("content"), T.summarize("text").alias("summary"), F.lit(0.7).alias("confidence"),
        F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.4).otherwise(0.5).alias("importance"), pick(["manual", "hook", "import"], n % 3).alias("source"),
        F.array_compact(F.array(F.col("lang"), F.col("source"), F.when(F.col("toxic") == 1, "pinned"))).alias("tags"), meta.alias("metadata"), at.alias("created_at"), hours(n % 8000 + (n % 50) * 24).alias("updated_at"),
    )
    return out.withColumn("scope_key", T.scope_key())


#: The same for DuckDB.
MEMORY_ITEMS = r"""memory_items AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS id, (['agent','session','user','task','document','project','repo'])[CAST(d.doc_id % 7 + 1 AS INT)] AS scope_type, d.source AS scope_id,
    (['fact','preference','decision','identity','experience','lesson','note','principle'])[CAST(d.doc_id % 8 + 1 AS INT)] AS kind, d.text AS content,
    CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 117) || '...' END AS summary, CAST(0.7 AS DOUBLE) AS confidence,
    CAST(CASE quality WHEN 1 THEN 0.8 WHEN 0 THEN 0.4 ELSE 0.5 END AS DOUBLE) AS importance, (['manual','hook','import'])[CAST(d.doc_id % 3 + 1 AS INT)] AS source,
    list_filter([d.lang, d.source, CASE WHEN toxic = 1 THEN 'pinned' END], lambda x: x IS NOT NULL) AS tags,
    CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 5 END AS recall_count, CASE WHEN d.doc_id % 3 = 0 THEN h(d.doc_id % 8000 + (d.doc_id % 11) * 720) END AS last_recalled,
    CASE WHEN d.doc_id % 13 = 0 THEN h(d.doc_id % 8000 + (d.doc_id % 17) * 600) END AS valid_until, CASE WHEN d.doc_id % 26 = 0 THEN 'doc-' || (d.doc_id + 1) END AS superseded_by,
    CASE WHEN d.doc_id % 9 = 0 THEN 'conv:' || (d.doc_id % 50) END AS task_id, CASE WHEN d.doc_id % 8 = 7 THEN ['doc-' || (d.doc_id - 1), 'doc-' || (d.doc_id * 3)] END AS supports,
    h(d.doc_id % 8000) AS created_at, h(d.doc_id % 8000 + (d.doc_id % 50) * 24) AS updated_at,
    lower((['agent','session','user','task','document','project','repo'])[CAST(d.doc_id % 7 + 1 AS INT)] || ':' || d.source) AS scope_key
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) d LEFT JOIN labels USING (doc_id))""".replace("h(d", "(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d").replace(" * 720) END", " * 720 AS INT))) END").replace(" * 600) END", " * 600 AS INT))) END").replace("8000) AS created_at", "8000 AS INT))) AS created_at").replace("* 24) AS updated_at", "* 24 AS INT))) AS updated_at")


def hot_keys(items: DataFrame) -> DataFrame:
    """The metadata keys that operators read, as columns."""
    meta = F.from_json("metadata", "recallCount double, lastRecalledAt string, validUntil string, valid_until string, supersededBy string, taskId string, supports array<string>")
    return (
        items.withColumn("m", meta).withColumn("recall_count", F.coalesce(F.col("m.recallCount"), F.lit(0.0))).withColumn("last_recalled", F.try_to_timestamp(F.col("m.lastRecalledAt")))
        .withColumn("valid_until", F.try_to_timestamp(F.coalesce("m.validUntil", "m.valid_until"))).withColumn("superseded_by", F.col("m.supersededBy")).withColumn("task_id", F.col("m.taskId")).withColumn("supports", F.col("m.supports")).drop("m")
    )


def task_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as task entries; some carry a summary, the first ones count as summarised."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv:"), F.col("conv_id")).alias("task_id"), F.concat_ws("-", F.lit("entry"), F.col("conv_id"), F.col("turn")).alias("id"), (F.col("turn") + 1).alias("sequence"), F.col("role"), F.col("text").alias("content"),
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit("s: "), F.substring("text", 1, 40))).alias("summary"), (F.col("turn") < 2).alias("summarized"),
    )


TASK_ENTRIES = r"""task_entries AS (
  SELECT 'conv:' || conv_id AS task_id, 'entry-' || conv_id || '-' || turn AS id, turn + 1 AS sequence, role, text AS content,
    CASE WHEN turn % 4 = 1 THEN 's: ' || substr(text, 1, 40) END AS summary, turn < 2 AS summarized FROM conversations)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each conversation, with status by id; not all have a state."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("conv_id")
    status = F.element_at(F.array(*map(F.lit, ["active", "paused", "completed", "archived", "weird"])), (k % 5 + 1).cast("int"))
    return c.select(F.concat(F.lit("conv:"), k).alias("task_id"), F.concat(F.lit("project:p"), k % 4).alias("scope_key"), F.when(status.isin("active", "paused", "completed", "archived"), status).otherwise("active").alias("status"), F.when(k % 3 != 0, F.concat(F.lit("summary of "), k)).alias("rolling_summary"), F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("updated_at"), "n")


TASKS = r"""tasks AS (
  SELECT 'conv:' || conv_id AS task_id, 'project:p' || (conv_id % 4) AS scope_key, CASE WHEN conv_id % 5 = 4 THEN 'active' ELSE (['active','paused','completed','archived'])[CAST(conv_id % 5 + 1 AS INT)] END AS status,
    CASE WHEN conv_id % 3 <> 0 THEN 'summary of ' || conv_id END AS rolling_summary, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS INT)) AS updated_at, count(*) AS n FROM conversations GROUP BY conv_id)"""


def with_ctes(sql: str, *ctes: str) -> str:
    """A DuckDB statement with the views it needs in front."""
    head, body = ",\n".join(ctes), sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"

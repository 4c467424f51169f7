"""Memory files that hosts keep, as inputs for ``remember``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.sources import markdown

#: The kind that entries of a target become; anything else is a note.
KINDS = {"memory": "note", "user": "preference", "dreams": "experience"}
RAW = r"(?s)<!-- RAW_JSON_START\s*(.*?)\s*RAW_JSON_END -->"


def host_inputs(files: DataFrame, host: str, scope: tuple[str, str], daily: str = "daily_log", kinds: dict[str, str] = KINDS) -> DataFrame:
    """Entries of a host's files (path, target, text) as inputs: the kind goes by the target (memory, user, daily, dreams, ...), entries of daily files carry their day.

    Equal entries stay; ``remember`` or ``new_only`` decides on them. Order is that of targets, paths and places.
    """
    e = markdown.entries(files).join(files.select("path", "target"), "path")
    kind = F.when(F.col("target") == "daily", daily)
    for target, name in kinds.items():
        kind = kind.when(F.col("target") == target, name)
    day = F.when(F.col("target") == "daily", F.regexp_extract("path", r"([^/]*)\.[mM][dD]$", 1))
    meta = F.to_json(F.struct(F.col("target").alias("projectionTarget"), day.alias("day")))
    return e.select(
        F.xxhash64("target", "path", "ord").alias("ord"), F.lit(scope[0]).alias("scope_type"), F.lit(scope[1]).alias("scope_id"), F.lit(f"{scope[0]}:{scope[1]}".lower()).alias("scope_key"), kind.otherwise("note").alias("kind"), F.col("entry").alias("content"),
        F.when(F.col("target") == "daily", T.summarize("entry")).otherwise(F.col("entry")).alias("summary"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("importance"), F.lit(f"{host}_import").alias("source"), F.array(F.lit(host), F.col("target")).alias("tags"), meta.alias("metadata"),
    )


def new_only(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Inputs whose text no stored record of the scope has as content or summary, each text once."""
    known = stored.select("scope_key", F.explode(F.array(T.trim("content"), T.trim("summary"))).alias("content")).filter("content is not null").distinct()
    first = inputs.withColumn("content", T.trim("content")).groupBy("scope_key", "content").agg(F.min_by(F.struct(*[c for c in inputs.columns if c not in ("scope_key", "content")]), "ord").alias("r"))
    return first.select("scope_key", "content", "r.*").join(known, ["scope_key", "content"], "left_anti").select(*inputs.columns)


def native_memory(files: DataFrame) -> DataFrame:
    """A host's own memory files (path, text): path, content, uid, version, at. The JSON block within counts where it has a text, else the file without it; files without any are left out."""
    raw = F.from_json(F.regexp_extract("text", RAW, 1), "memoryBlock string, uid string, version double, updatedAt string")
    j = files.select("path", "text", raw.alias("raw"))
    block = F.when(T.trim("raw.memoryBlock") != "", T.trim("raw.memoryBlock"))
    has = block.isNotNull()
    out = j.select("path", F.coalesce(block, T.trim(F.regexp_replace("text", RAW, ""))).alias("content"), F.when(has, F.col("raw.uid")).alias("uid"), F.when(has, F.col("raw.version")).alias("version"), F.when(has, F.col("raw.updatedAt")).alias("at"))
    return out.filter("content <> ''")


def native_changes(found: DataFrame, records: DataFrame) -> DataFrame:
    """What such files do to the records, keyed by path in their metadata: path, action (add, update, keep), id, content."""
    held = records.select("id", F.col("content").alias("old"), F.get_json_object("metadata", "$.nativeMemoryPath").alias("path")).filter("path is not null").groupBy("path").agg(F.min_by(F.struct("id", "old"), "id").alias("h")).select("path", "h.*")
    j = found.join(held, "path", "left")
    return j.select("path", F.when(F.col("id").isNull(), "add").when(F.col("old") == F.col("content"), "keep").otherwise("update").alias("action"), "id", "content")

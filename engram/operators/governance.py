"""Project membership, keys, isolation, repairs and layered recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import json as J
from engram.functions import text as T
from engram.operators import storage
from engram.operators.records import DAY


def belongs(project: str) -> Column:
    """A record of a project: by metadata, by project scope, or by a repo of it."""
    return (F.coalesce(F.get_json_object("metadata", "$.projectId") == project, F.lit(False))) | ((F.col("scope_type") == "project") & (F.col("scope_id") == project)) | ((F.col("scope_type") == "repo") & F.startswith("scope_id", F.lit(project + "::")))


def guarded(changes: DataFrame, records: DataFrame) -> DataFrame:
    """Changes (id, scope_key) of records that are in the scope given with them; others do nothing."""
    return changes.join(records.select("id", F.col("scope_key").alias("own")), "id").filter(F.col("scope_key").isNull() | (F.lower("scope_key") == F.col("own"))).drop("own")


def bearer_claims(token: Column) -> Column:
    """The claims of a JWT as a struct (sub, exp), unverified; null where it is none."""
    payload = F.get(F.split(token, r"\."), F.lit(1))
    padded = F.rpad(F.translate(payload, "-_", "+/"), (F.ceil(F.length(payload) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "sub string, exp long")


def api_keys(keys: DataFrame) -> DataFrame:
    """Keys as they are stored: a prefix to show and the SHA-256 to look up."""
    return keys.select("key_id", F.substring("key", 1, 12).alias("prefix"), F.sha2("key", 256).alias("hash"))


def resolve_keys(presented: DataFrame, stored: DataFrame) -> DataFrame:
    """The project of each presented key, by hash; unknown and revoked keys have none."""
    return presented.select("request_id", F.sha2("key", 256).alias("hash")).join(stored.filter("not revoked").select("hash", "project_id"), "hash", "left").select("request_id", "project_id")


def pruned_supports(records: DataFrame, now: Column) -> DataFrame:
    """Principles with supports that no longer exist, as they are afterwards: id, kept, dropped, audited time."""
    s = records.select("id", F.explode(F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>")).alias("s"))
    live = records.select(F.col("id").alias("s"), F.lit(True).alias("live"))
    g = s.join(live, "s", "left").groupBy("id").agg(F.count("live").alias("kept"), F.count_if(F.col("live").isNull()).alias("dropped"))
    return g.filter("dropped > 0").withColumn("pruned_at", now)


def with_pruned_supports(records: DataFrame, now: Column) -> DataFrame:
    """The records after that: principles keep the supports that exist, and say when and why others went."""
    s = records.filter("kind = 'principle'").select("id", F.posexplode(F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>")).alias("ord", "s"))
    live = records.select(F.col("id").alias("s"), F.lit(True).alias("live"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("ord", "s")))), lambda x: x.s)
    g = s.join(live, "s", "left").groupBy("id").agg(kept.alias("kept"), F.count_if(F.col("live").isNull()).alias("dropped")).filter("dropped > 0")
    reason = F.concat(F.lit("removed "), F.col("dropped"), F.lit(" support record(s)"))
    iso = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = J.with_keys("metadata", {"supports": J.variants("kept"), "supportsPrunedAt": J.variant(iso), "supportsPruneReason": J.variant(reason)})
    return records.join(g, "id", "left").withColumn("metadata", F.when(F.col("dropped") > 0, meta).otherwise(F.col("metadata"))).drop("kept", "dropped")


def reflect_marks(records: DataFrame) -> DataFrame:
    """When each scope last reflected: the newest of its principles that say so, else their time of writing."""
    p = records.filter("kind = 'principle'")
    at = F.coalesce(F.try_to_timestamp(F.get_json_object("metadata", "$.reflectedAt")), F.col("updated_at"))
    return p.groupBy("scope_key").agg(F.max(at).alias("last_reflect_at"))


def replaced_text(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Which record each edit (edit_id, scope_key, part) touches: the newest of the scope that contains the part; none means a new one."""
    hit = edits.join(records.select("scope_key", "id", "content", "updated_at"), "scope_key").filter(F.contains("content", F.col("part")))
    best = hit.groupBy("edit_id").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))
    return edits.select("edit_id").join(best, "edit_id", "left")


def edited(records: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """The records after edits (edit_id, scope_key, part, op, text): the newest record of the scope that contains the part takes the text
    (op replace) or goes (op remove). Of several edits of one record that with the greatest id counts; a replace without a match is for
    ``unmatched``."""
    at = replaced_text(records, edits).filter("id is not null").join(edits.select("edit_id", "op", "text"), "edit_id")
    last = at.groupBy("id").agg(F.max_by(F.struct("op", "text"), "edit_id").alias("e")).select("id", "e.op", "e.text")
    j = records.join(last, "id", "left").filter(F.coalesce(F.col("op") != "remove", F.lit(True)))
    hit = F.coalesce(F.col("op") == "replace", F.lit(False))
    out = j.withColumn("content", F.when(hit, T.trim("text")).otherwise(F.col("content"))).withColumn("summary", F.when(hit, T.summarize("content")).otherwise(F.col("summary")))
    return out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("op", "text")


def unmatched(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Replacements that match nothing, and additions: edit_id, scope_key, text, to be remembered."""
    none = replaced_text(records, edits).filter("id is null").select("edit_id")
    return edits.filter("op = 'add'").unionByName(edits.filter("op = 'replace'").join(none, "edit_id", "left_semi")).select("edit_id", "scope_key", "text")


def maintenance_requests(records: DataFrame, documents: DataFrame, now: Column, n: int = 12, hours: int = 24, chars: int = 700) -> DataFrame:
    """Per scope that is due the newest records for its host to look at: scope_key, rn, id, content cut to ``chars``."""
    mark = F.try_to_timestamp(F.get_json_object("metadata", "$.lastDeepGovernedAt"))
    fresh = documents.filter(F.unix_timestamp(now) - F.unix_timestamp(mark) < hours * 3600).select("scope_key")
    w = Window.partitionBy("scope_key").orderBy(F.col("updated_at").desc(), "created_at", "id")
    return records.join(fresh.distinct(), "scope_key", "left_anti").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("scope_key", "rn", "id", F.substring("content", 1, chars).alias("content"))


def graph_context(hits: DataFrame, found: DataFrame, edges: DataFrame, most_hits: int = 5, per_entity: int = 4, lines: int = 8) -> DataFrame:
    """Per query the relations among entities of its best hits, else the entities: query_id, lines, context."""
    top_hits = storage.written(hits.filter(F.col("rank") <= most_hits).select("query_id", "id"), "hits")
    mine = storage.written(top_hits.join(found.select("id", "name_key"), "id").select("query_id", "name_key").distinct(), "mine")  # read twice
    both = edges.select("source", "target", "n", F.explode(F.array("source", "target")).alias("name_key"))
    w = Window.partitionBy("query_id", "name_key").orderBy(F.col("n").desc(), "source", "target")
    near = mine.join(both, "name_key").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_entity).select("query_id", "source", "target", "n").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("n").desc(), "source", "target")
    top = near.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= lines)
    text = lambda items: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x.line), "\n")
    rel = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lines"), text(F.struct("rn", F.concat(F.lit("- "), "source", F.lit(" co_occurs "), "target").alias("line"))).alias("rel"))
    names = mine.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("name_key"))).filter(F.col("rn") <= lines).groupBy("query_id").agg(text(F.struct("rn", F.concat(F.lit("- "), "name_key").alias("line"))).alias("names"))
    out = names.join(rel, "query_id", "left")
    return out.select("query_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("relations"), F.when(F.col("rel").isNotNull(), F.concat(F.lit("Related entity graph:\n"), "rel")).otherwise(F.concat(F.lit("Related entities:\n"), "names")).alias("context"))


def active_context(documents: DataFrame, profile_chars: int = 1500) -> DataFrame:
    """Per scope its profile, context and experience, titled and joined."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, T.trim("content")))
    g = documents.groupBy("scope_key").agg(of("profile").alias("p"), of("context").alias("c"), of("experience").alias("e"))
    titled = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title + ":\n"), c))
    return g.select("scope_key", F.concat_ws("\n\n", titled("Profile", T.clamp_chars("p", profile_chars)), titled("Active context", F.col("c")), titled("Active experience", F.col("e"))).alias("context"))


def layered(parts: DataFrame) -> DataFrame:
    """Recall by layers (query_id, palace, retrieval, active, task, navigation): what stays stable between turns, and what doesn't."""
    filled = lambda *cs: F.array_join(F.filter(F.array(*map(F.col, cs)), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return parts.select("query_id", filled("active", "navigation").alias("stable"), filled("palace", "retrieval", "task").alias("dynamic"))


def fresh_drop(totals: DataFrame) -> DataFrame:
    """Runs (day, total) in which records went missing since the run before."""
    w = Window.orderBy("day")  # a row a run
    return totals.withColumn("before", F.lag("total").over(w)).filter("total < before").select("day", (F.col("before") - F.col("total")).alias("lost"))


def recent_sessions(records: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Scopes written to within the fallback window of a session."""
    return records.filter(F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= hours * 3600).select("scope_key").distinct()


def stale_tasks(tasks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return tasks.filter(F.col("status").isin("active", "paused") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > days * DAY)).select("task_id")

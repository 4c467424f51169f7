"""Operators that change tables, and layered recall, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import capture, cloud, governance, recall, records, remember, scopes, search, tasks
from engram.plans import views as V
from engram.plans.queries import DOCS, ENTRIES, FOUND, KNOWN, _documents, _found, now, query
from engram.plans.search_queries import METADATA, SIGNALS, _queries, _ranked
from engram.plans.write_queries import _inputs
from engram.sources import hosts

M = V.MEMORY_ITEMS
WITHOUT = METADATA.replace("CASE WHEN supports IS NOT NULL THEN '\"supports\":[\"' || array_to_string(supports, '\",\"') || '\"]' END", "CASE WHEN kept IS NOT NULL THEN '\"supports\":[' || CASE WHEN len(kept) > 0 THEN '\"' || array_to_string(kept, '\",\"') || '\"' ELSE '' END || ']' END")


@query(f"""SELECT id, {WITHOUT} AS metadata FROM (SELECT *, list_filter(supports, lambda s: CAST(substr(s, 5) AS BIGINT) % 4 <> 0 OR s NOT IN (SELECT id FROM memory_items)) AS kept FROM (SELECT * FROM memory_items WHERE doc_id % 4 <> 0))""".replace(" OR s NOT IN (SELECT id FROM memory_items)", ""), M)
def forget_metadata(spark, d):
    """A quarter of the records forgotten, and any support whose number says that it would be: what is left keeps all else of its metadata."""
    m = V.memory_items(spark, d)
    gone = spark.range(0, 4 * m.count() + 4, 4).select(F.concat(F.lit("doc-"), "id").alias("id"))
    return records.forget(m, gone).select("id", "metadata")


@query("""WITH ids AS (SELECT list(id) AS known FROM memory_items), k AS (SELECT id, supports, list_filter(supports, lambda s: list_contains(known, s)) AS kept FROM memory_items, ids WHERE kind = 'principle')
SELECT id, array_to_string(kept, ',') AS supports, CASE WHEN len(kept) < len(supports) THEN 'removed ' || (len(supports) - len(kept)) || ' support record(s)' END AS reason FROM k""", M)
def prune_supports_applied(spark, d):
    out = governance.with_pruned_supports(V.memory_items(spark, d), now()).filter("kind = 'principle'")
    held = F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>")
    return out.select("id", F.array_join(held, ",").alias("supports"), F.get_json_object("metadata", "$.supportsPruneReason").alias("reason"))


@query("""WITH p AS (SELECT *, lower(list_filter(tags, lambda t: t NOT IN ('p0', 'p1', 'sop', 'pinned', 'session'))[1]) AS tag FROM memory_items WHERE kind IN ('lesson', 'decision', 'note') AND NOT list_contains(tags, 'pinned') AND updated_at >= TIMESTAMP '2024-01-05 00:00:00'),
c AS (SELECT tag, string_agg(id, ',' ORDER BY created_at, id) AS supports, count(*) AS n, min((created_at, id)) AS f FROM p WHERE tag IS NOT NULL GROUP BY tag HAVING count(*) >= 3 ORDER BY n DESC, f LIMIT 6)
SELECT 'agent:host' AS scope_key, 'principle on ' || tag AS content, supports, tag || ',principle,reflected' AS tags FROM c""", M)
def reflected_principles(spark, d):
    m = V.memory_items(spark, d)
    texts = m.select(F.lower(F.get("tags", F.lit(0))).alias("tag")).distinct().withColumn("text", F.concat(F.lit(" principle on "), "tag"))
    docs = m.limit(1).select(F.lit("agent:host").alias("scope_key"), F.lit("context").alias("kind"), F.lit('{"lastReflectAt":"2024-01-01T00:00:00Z"}').alias("metadata"))
    made = records.reflected(m, docs, texts, ("agent", "host"), F.lit("2024-01-19 00:00:00").cast("timestamp"))
    return made.select("scope_key", "content", F.array_join(F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>"), ",").alias("supports"), F.array_join("tags", ",").alias("tags"))


OPEN = "kind NOT IN ('preference', 'principle') AND importance < 0.9"


@query(f"""WITH k AS (SELECT 'doc-' || (doc_id - 1) AS id FROM memory_items WHERE doc_id % 10 = 1 AND {OPEN})
SELECT id, CASE WHEN id IN (SELECT id FROM k) THEN substr(summary, 1, 300) ELSE content END AS content, id IN (SELECT id FROM k) AS changed FROM memory_items WHERE NOT (doc_id % 10 = 1 AND {OPEN})""", M)
def merged_groups(spark, d):
    """Each record whose number ends in 1 merged into the one before it, where it isn't protected."""
    m = V.memory_items(spark, d)
    n = F.col("doc_id")
    groups = m.filter(n % 10 < 2).select(F.floor(n / 10).alias("group_id"), (n % 10).alias("rank"), "id")
    plan = records.merge_plan(groups, records.protected(m), total=1 << 30)
    out = records.merged_groups(m, plan, now())
    return out.select("id", "content", (F.col("updated_at") == now()).alias("changed"))


@query("""SELECT id, CASE WHEN r IS NOT NULL AND (NOT own OR r >= l) THEN 'remote' ELSE 'local' END AS side, CAST(CASE WHEN r IS NOT NULL AND (NOT own OR r >= l) THEN v ELSE 1 END AS BIGINT) AS sync_version FROM (
  SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS own, l, r, coalesce(gone, false) AS gone, v FROM (SELECT id, updated_at AS l FROM memory_items WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT id, updated_at + to_days(CAST(doc_id % 5 AS INT) - 2) AS r, doc_id % 11 = 0 AS gone, doc_id AS v FROM memory_items WHERE doc_id % 3 <> 1 AND doc_id > 100) b ON a.id = b.id) WHERE NOT gone""", M)
def sync_pull_applied(spark, d):
    m = V.memory_items(spark, d).select("doc_id", "id", "updated_at")
    shifted = F.timestamp_seconds(F.unix_timestamp("updated_at") + (F.col("doc_id") % 5 - 2) * 86400)
    remote = m.filter("doc_id % 3 <> 1").select("id", shifted.alias("updated_at"), F.lit("remote").alias("side"), F.col("doc_id").alias("sync_version"), F.when(F.col("doc_id") % 11 == 0, F.col("updated_at")).alias("deleted_at"))
    local = m.filter("doc_id % 3 <> 0").select("id", "updated_at", F.lit("local").alias("side"), F.lit(1).cast("long").alias("sync_version"))
    return cloud.pull_applied(local, remote, F.lit(100)).select("id", "side", "sync_version")


@query("""WITH d AS (SELECT DISTINCT scope_key FROM memory_items WHERE scope_type = 'agent'),
t AS (SELECT scope_key, arg_max(strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ'), doc_id) AS at FROM memory_items WHERE kind = 'principle' AND doc_id % 3 = 2 GROUP BY scope_key)
SELECT coalesce(d.scope_key, t.scope_key) AS scope_key, coalesce(t.at, '2020-01-01T00:00:00Z') AS last_reflect_at, CASE WHEN d.scope_key IS NOT NULL THEN 'kept' END AS note, CASE WHEN d.scope_key IS NOT NULL THEN 'of ' || d.scope_key ELSE '' END AS content
FROM d FULL JOIN t ON d.scope_key = t.scope_key""", M)
def principle_reflect_marks(spark, d):
    """Principles as they are written by hosts, two thirds of them without a proper mark; half of the scopes have a context document."""
    m = V.memory_items(spark, d)
    said = F.when(F.col("doc_id") % 3 == 2, F.to_json(F.struct(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reflectedAt")))).when(F.col("doc_id") % 3 == 1, '{"reflectedAt":" "}')
    docs = m.filter("scope_type = 'agent'").select("scope_key").distinct().select("scope_key", F.lit("context").alias("kind"), F.concat(F.lit("of "), "scope_key").alias("content"), F.lit('{"lastReflectAt":"2020-01-01T00:00:00Z","note":"kept"}').alias("metadata"))
    out = records.with_reflect_marks(docs, records.principle_marks(m.select(F.col("doc_id").alias("ord"), "scope_key", "kind", said.alias("metadata"))))
    return out.select("scope_key", F.get_json_object("metadata", "$.lastReflectAt").alias("last_reflect_at"), F.get_json_object("metadata", "$.note").alias("note"), "content")


@query("""SELECT scope_id AS project_id, id, CAST(CASE WHEN doc_id % 4 = 0 THEN top + rn ELSE doc_id END AS BIGINT) AS sync_version FROM (SELECT *, max(CASE WHEN doc_id % 4 <> 0 THEN doc_id ELSE 0 END) OVER (PARTITION BY scope_id) AS top, row_number() OVER (PARTITION BY scope_id, doc_id % 4 = 0 ORDER BY doc_id, id) AS rn FROM memory_items)""", M)
def sync_push_applied(spark, d):
    m = V.memory_items(spark, d).select(F.col("scope_id").alias("project_id"), "id", F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).otherwise(0).alias("sync_version"))
    mine, _ = cloud.push_applied(m, m.filter("sync_version > 0"))
    return mine.select("project_id", "id", "sync_version")


@query("""SELECT 'conv:' || conv_id AS task_id, CASE WHEN conv_id % 4 = 0 THEN 'Named ' || conv_id ELSE 'conv:' || conv_id END AS title, CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' ELSE 'paused' END AS status FROM (SELECT DISTINCT conv_id FROM conversations)""")
def task_changes(spark, d):
    """Half of the tasks are new, half exist as paused ones; some changes name a title, an unknown status, or nothing."""
    ids = V.read(spark, d, "conversations").select("conv_id").distinct()
    task = F.concat(F.lit("conv:"), "conv_id").alias("task_id")
    old = ids.filter("conv_id % 2 = 0").select(task, F.lit("s").alias("scope_key"), F.concat(F.lit("conv:"), "conv_id").alias("title"), F.lit("paused").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    k = F.col("conv_id") % 3
    first = ids.select(F.lit(1).alias("ord"), task, F.lit("s").alias("scope_key"), F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Named "), "conv_id")).alias("title"), F.when(k == 0, "archived").when(k == 1, "no such status").otherwise("paused").alias("status"))
    then = ids.filter("conv_id % 3 = 0").select(F.lit(2).alias("ord"), task, F.lit(None).cast("string").alias("scope_key"), F.lit(" ").alias("title"), F.lit("completed").alias("status"))
    return tasks.with_changes(old, first.unionByName(then), now()).select("task_id", "title", "status")


@query("""SELECT scope_key, text, CAST(CASE WHEN ord % 3 = 0 THEN 2 WHEN ord % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS activations, CAST(CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS positives FROM (SELECT scope_key, text, min(ord) AS ord FROM entries GROUP BY 1, 2)""", M, DOCS, ENTRIES)
def experience_counters(spark, d):
    """Entries activated by two responses, one or none, in the documents' metadata and read back."""
    docs = _documents(spark, d).withColumn("metadata", F.lit(None).cast("string"))
    e = tasks.experience_entries(docs)
    first = e.groupBy("scope_key", "entry_id").agg(F.min("ord").alias("ord"))
    o = F.col("ord") % 3
    hits = first.filter("ord % 3 < 2").select("scope_key", "entry_id", F.when(o == 0, "positive").otherwise("neutral").alias("outcome")).unionByName(first.filter("ord % 3 = 0").select("scope_key", "entry_id", F.lit("negative").alias("outcome")))
    after = tasks.with_stats(docs, tasks.activated(tasks.merged_stats(e, tasks.entry_stats(docs), now()), hits, now()))
    return tasks.entry_stats(after).select("scope_key", "text", "activations", "positives")


@query("SELECT name_key, CAST(count(DISTINCT id) AS BIGINT) AS links FROM found WHERE CAST(substr(id, 5) AS BIGINT) % 4 <> 0 GROUP BY name_key", M, KNOWN, FOUND)
def entity_links_after_forget(spark, d):
    f = _found(spark, d)
    gone = f.filter(F.substring("id", 5, 12).cast("long") % 4 == 0).select("id")
    links, _, _ = capture.forgotten(f, f.select("name_key", F.col("id").alias("memory_id")), f.select("id"), gone)
    return links.groupBy("name_key").agg(F.count_distinct("id").alias("links"))


@query("SELECT id, name_key, kind FROM found WHERE CAST(substr(id, 5) AS BIGINT) % 3 <> 0 UNION ALL SELECT id, 'redis', 'tech' FROM memory_items WHERE doc_id % 3 = 0", M, KNOWN, FOUND)
def entity_links_refreshed(spark, d):
    m, f = V.memory_items(spark, d), _found(spark, d)
    changed = m.filter("doc_id % 3 = 0").select("id", F.lit("it uses redis").alias("content"))
    return capture.refreshed_links(f, changed, strict=False).select("id", "name_key", "kind")


@query("""WITH n AS (SELECT name_key FROM found GROUP BY 1 HAVING count(DISTINCT id) >= 2), edges AS (SELECT a.name_key AS source, b.name_key AS target, CAST(count(*) AS BIGINT) AS n FROM found a JOIN found b ON a.id = b.id AND a.name_key < b.name_key GROUP BY 1, 2)
SELECT source, target, n FROM edges WHERE source IN (SELECT name_key FROM n) AND target IN (SELECT name_key FROM n)""", M, KNOWN, FOUND)
def entity_node_edges(spark, d):
    f = _found(spark, d)
    return capture.node_edges(capture.co_occurrences(f), capture.entity_table(f).filter("links >= 2"))


@query("SELECT id, scope_type = 'agent' OR scope_key = 'user:src2' AS allowed FROM memory_items", M)
def scope_isolation(spark, d):
    asked = spark.createDataFrame([("agent", "*"), ("user", "SRC2"), ("task", "nowhere")], "scope_type string, scope_id string")
    return scopes.allowed(V.memory_items(spark, d), asked)


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT summary) AS BIGINT) AS texts FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'preference' ELSE 'daily_log' END AS kind, summary FROM memory_items WHERE regexp_matches(summary, '^[A-Za-zÀ-ÿ].*[^:：]$')) GROUP BY 1", M)
def host_files(spark, d):
    """Summaries as list items of three kinds of host files, read as inputs."""
    m = V.memory_items(spark, d).filter(F.col("summary").rlike(r"^[A-Za-zÀ-ÿ].*[^:：]$"))
    k = F.col("doc_id") % 3
    files = m.select(F.concat(F.lit("f/"), "doc_id", F.lit(".md")).alias("path"), F.when(k == 0, "memory").when(k == 1, "user").otherwise("daily").alias("target"), F.concat(F.lit("# Title\n- "), "summary").alias("text"))
    return hosts.host_inputs(files, "host", ("agent", "h")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("texts"))


@query(f"""WITH hits AS ({_ranked("0.5")}) SELECT query_id, rtrim(substr('Relevant memory:' || chr(10) || string_agg('- [' || kind || '] ' || summary || ' (id ' || id || '; source ' || source || CASE WHEN len(tags) > 0 THEN '; tags ' || array_to_string(tags, ', ') ELSE '' END || '; score ' || printf('%.2f', raw) || ')', chr(10) ORDER BY rank), 1, 1500), ' ' || chr(10)) AS retrieval
FROM hits JOIN memory_items USING (id) JOIN (SELECT query_id, id, validity * (0.45 * lexical + 0.35 * hash + 0.08 * recency + 0.07 * importance + 0.025 + 0.22 * fts + 0.10 * principle) AS raw FROM sc) s USING (query_id, id) GROUP BY query_id""", M, SIGNALS)
def retrieval_contexts(spark, d):
    m = V.memory_items(spark, d)
    return recall.retrieval_context(search.search(m, _queries(spark, d), now()), m, 1500)


ENTITY = """boost AS (WITH q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CASE item_id % 3 WHEN 0 THEN 'rest' WHEN 1 THEN 'go' ELSE 're' END AS name FROM benchmark), e AS (SELECT name_key, count(DISTINCT id) AS links FROM found GROUP BY name_key),
m AS (SELECT query_id, name_key, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN name_key = name THEN 0 ELSE 1 END, name_key) AS rn FROM q JOIN e ON contains(name_key, name))
SELECT query_id, f.id, least(sum(1 / (1 + links / 40.0)), 1.0) AS entity FROM m JOIN e USING (name_key) JOIN found f USING (name_key) WHERE rn <= 8 GROUP BY 1, 2)"""


@query("""WITH s AS (SELECT sc.*, coalesce(entity, 0) AS entity, validity * (0.45 * lexical + 0.35 * hash + 0.08 * recency + 0.07 * importance + 0.025 + 0.18 * coalesce(entity, 0) + 0.22 * fts + 0.10 * principle) AS score FROM sc LEFT JOIN boost USING (query_id, id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at, id) AS rank FROM s WHERE score >= 0.18)
SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score, round(entity, 6) AS entity FROM k WHERE rank <= 8""", M, SIGNALS, KNOWN, FOUND, ENTITY)
def search_with_entities(spark, d):
    """Search with the entity signal on: each query names an entity, or a part of several."""
    m, q, f = V.memory_items(spark, d), _queries(spark, d), _found(spark, d)
    n = F.col("query_id").cast("long") % 3
    names = q.select("query_id", F.when(n == 0, "rest").when(n == 1, "go").otherwise("re").alias("name"))
    hits = search.search(m, q, now(), named=capture.asked_links(capture.resolve_names(names, capture.entity_table(f)), f))
    return hits.select("query_id", "rank", "id", *[F.round(c, 6).alias(c) for c in ("score", "entity")])


def remember_batch(spark, d):
    """Every document, changed a little, written in order to the memory that holds the documents, each write seeing those before it."""
    out = remember.remember(_inputs(spark, d), V.memory_items(spark, d), now(), "rules")
    return out.select("id", "scope_key", "kind", "content", "importance", "confidence", "metadata", "updated_at")


query()(remember_batch)


def recall_layers(spark, d):
    """Every benchmark item as a turn, answered from records, documents and tasks in layers."""
    m, q = V.memory_items(spark, d), _queries(spark, d)
    k = F.col("query_id").cast("long")
    turns = q.select("query_id", "text", F.array(F.lit("user: earlier")).alias("recent"), F.concat(F.lit("agent:src"), k % 5).alias("scope_key"), F.concat(F.lit("conv:"), k % 50).alias("task_id"))
    docs = tasks.latest_documents(m.filter("kind in ('identity', 'note', 'experience')").withColumn("ord", F.col("doc_id"))).withColumn("kind", F.when(F.col("kind") == "identity", "profile").when(F.col("kind") == "note", "context").otherwise(F.col("kind")))
    said = V.task_entries(spark, d).limit(0).select("task_id", F.lit("").alias("id"), "content", F.lit(None).cast("timestamp").alias("created_at"))
    return recall.layers(turns, m, now(), documents=docs, windows=recall.task_windows(turns, V.tasks(spark, d), V.task_entries(spark, d), said))


query()(recall_layers)

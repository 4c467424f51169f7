"""Governance, joins and layered recall with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import capture, governance, records, relations, scopes, search, storage, tasks
from engram.plans import views as V
from engram.plans.queries import DOCS, EDGES, FOUND, KNOWN, _documents, _found, now, query
from engram.plans.search_queries import SIGNALS, _queries, _ranked

M = V.MEMORY_ITEMS


@query("SELECT scope_key, CAST(count(*) AS BIGINT) AS n FROM memory_items GROUP BY scope_key", M)
def scope_counts(spark, d):
    return V.memory_items(spark, d).groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM memory_items WHERE (scope_type = 'project' AND scope_id = 'src0') OR (scope_type = 'repo' AND false)", M)
def project_members(spark, d):
    return V.memory_items(spark, d).filter(governance.belongs("src0")).select("id")


@query("SELECT id FROM memory_items WHERE doc_id % 2 = 0", M)
def scope_guard(spark, d):
    m = V.memory_items(spark, d)
    changes = m.select("id", F.when(F.col("doc_id") % 2 == 0, F.upper("scope_key")).otherwise(F.lit("user:other")).alias("scope_key"))
    return governance.guarded(changes, m).select("id")


@query("""SELECT id, CASE WHEN kind IN ('preference', 'identity') THEN 'user:u' WHEN kind = 'decision' AND doc_id % 2 = 0 THEN 'task:t' WHEN doc_id % 3 = 0 THEN 'repo:p::r' WHEN doc_id % 3 = 1 THEN 'agent:a' ELSE 'project:p' END AS scope FROM memory_items""", M)
def durable_scopes(spark, d):
    n = F.col("doc_id")
    write = scopes.write_scope(F.lit("p"), F.when(n % 3 == 0, "r"), F.when(n % 3 == 1, "a"))
    return V.memory_items(spark, d).select("id", scopes.durable_scope(F.col("kind"), F.lit("u"), F.when(n % 2 == 0, "t"), write).alias("scope"))


@query("""SELECT c_custkey AS key_id, substr('key_' || c_name, 1, 12) AS prefix, sha256('key_' || c_name) AS hash FROM customer""")
def api_key_hashes(spark, d):
    return governance.api_keys(V.read(spark, d, "customer").select(F.col("c_custkey").alias("key_id"), F.concat(F.lit("key_"), "c_name").alias("key")))


@query("""SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 1 THEN 'p' || c_nationkey END AS project_id FROM customer""")
def api_key_resolution(spark, d):
    c = V.read(spark, d, "customer").withColumn("key", F.concat(F.lit("key_"), F.col("c_custkey")))
    stored = c.filter("c_custkey % 3 <> 0").select(F.sha2("key", 256).alias("hash"), F.concat(F.lit("p"), "c_nationkey").alias("project_id"), (F.col("c_custkey") % 4 == 1).alias("revoked"))
    return governance.resolve_keys(c.select(F.col("c_custkey").alias("request_id"), "key"), stored)


@query("SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS sub, CAST(1700000000 + c_custkey AS BIGINT) AS exp FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 2 = 1")
def bearer_tokens(spark, d):
    k = F.col("c_custkey")
    claims = F.to_json(F.struct(k.cast("string").alias("sub"), (k.cast("long") + 1700000000).alias("exp")))
    token = F.when(k % 2 == 0, F.concat(F.lit("head."), F.translate(F.regexp_replace(F.base64(F.encode(claims, "UTF-8")), "=+$", ""), "+/", "-_"), F.lit(".sig"))).otherwise("no token")
    return V.read(spark, d, "customer").select(k.alias("k"), governance.bearer_claims(token).alias("c")).select("k", "c.sub", "c.exp")


@query("""SELECT id, CAST(count_if(live) AS BIGINT) AS kept, CAST(count_if(NOT live) AS BIGINT) AS dropped, TIMESTAMP '2025-01-01 00:00:00' AS pruned_at FROM (SELECT id, s IN (SELECT id FROM memory_items) AS live FROM (SELECT id, unnest(supports) AS s FROM memory_items)) GROUP BY id HAVING count_if(NOT live) > 0""", M)
def prune_supports(spark, d):
    return governance.pruned_supports(V.memory_items(spark, d), now())


@query("SELECT scope_key, max(updated_at) AS last_reflect_at FROM memory_items WHERE kind = 'principle' GROUP BY scope_key", M)
def reflect_marks(spark, d):
    return governance.reflect_marks(V.memory_items(spark, d))


@query("""SELECT item_id AS edit_id, max(id) AS id FROM (SELECT item_id, id, rank() OVER (PARTITION BY item_id ORDER BY updated_at DESC, id DESC) AS r FROM benchmark b JOIN memory_items m ON m.scope_key = 'agent:src' || (item_id % 5) AND contains(content, split_part(b.text, ' ', 2))) WHERE r = 1 GROUP BY item_id
UNION ALL SELECT item_id, NULL FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM memory_items m WHERE m.scope_key = 'agent:src' || (item_id % 5) AND contains(content, split_part(b.text, ' ', 2)))""", M)
def edit_by_substring(spark, d):
    e = V.read(spark, d, "benchmark").select(F.col("item_id").alias("edit_id"), F.concat(F.lit("agent:src"), F.col("item_id") % 5).alias("scope_key"), F.split_part("text", F.lit(" "), F.lit(2)).alias("part"))
    return governance.replaced_text(V.memory_items(spark, d), e)


@query("""SELECT scope_key, CAST(rn AS INT) AS rn, id, substr(content, 1, 700) AS content FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY updated_at DESC, created_at, id) AS rn FROM memory_items WHERE scope_id NOT IN ('src0', 'src1')) WHERE rn <= 12""", M)
def maintenance_requests(spark, d):
    m = V.memory_items(spark, d)
    at = F.when(F.col("scope_id") == "src0", "2024-12-31T10:00:00Z").when(F.col("scope_id") == "src1", "2024-12-31T23:59:59Z").otherwise("2024-12-30T00:00:00Z")
    docs = m.select("scope_key", F.to_json(F.struct(at.alias("lastDeepGovernedAt"))).alias("metadata"))
    return governance.maintenance_requests(m, docs, now())


@query(rf"""WITH hits AS ({_ranked("0.5").replace("WITH s AS", "WITH s AS")}), mine AS (SELECT DISTINCT query_id, name_key FROM hits JOIN found USING (id) WHERE rank <= 5),
near AS (SELECT DISTINCT query_id, source, target, n FROM (SELECT query_id, source, target, n, row_number() OVER (PARTITION BY query_id, name_key ORDER BY n DESC, source, target) AS rn FROM mine JOIN edges ON source = name_key OR target = name_key) WHERE rn <= 4),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, source, target) AS rn FROM near), r AS (SELECT query_id, count(*) AS c, string_agg('- ' || source || ' co_occurs ' || target, chr(10) ORDER BY rn) AS rel FROM t WHERE rn <= 8 GROUP BY 1),
n AS (SELECT query_id, string_agg('- ' || name_key, chr(10) ORDER BY name_key) AS names FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name_key) AS rn FROM mine) WHERE rn <= 8 GROUP BY 1)
SELECT query_id, CAST(coalesce(c, 0) AS BIGINT) AS relations, CASE WHEN rel IS NOT NULL THEN 'Related entity graph:' || chr(10) || rel ELSE 'Related entities:' || chr(10) || names END AS context FROM n LEFT JOIN r USING (query_id)""", M, SIGNALS, KNOWN, FOUND, EDGES)
def recall_graph_context(spark, d):
    m, f = V.memory_items(spark, d), _found(spark, d)
    return governance.graph_context(search.search(m, _queries(spark, d), now()), f, capture.co_occurrences(f))


#: The records after an update of every tenth and the loss of another tenth, and their relations made anew.
CHANGED = """memory_items AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN 'redis, docker and GraphQL: ' || substr(content, 1, 200) ELSE content END AS content) FROM old_items WHERE doc_id % 10 <> 5)"""
RELATED = '''related AS (SELECT a.name_key AS source, b.name_key AS target, a.id AS memory_id, CASE WHEN doc_id % 10 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE updated_at END AS "at" FROM found a JOIN found b ON a.id = b.id AND a.name_key < b.name_key JOIN memory_items m ON m.id = a.id)'''


def _related(spark, d):
    """Relations of all records, then changed by deltas; nothing of an unchanged record is made again."""
    m = V.memory_items(spark, d)
    table = storage.written(relations.relations(_found(spark, d), m.select("id", F.col("updated_at").alias("at"))), "relations")
    changed = m.filter("doc_id % 10 = 0").select("id", F.concat(F.lit("redis, docker and GraphQL: "), F.substring("content", 1, 200)).alias("content"))
    found = capture.entities(changed).select("id", "name_key")
    written = changed.select("id").join(found, "id", "left")
    return relations.merged(table, relations.deltas(table, written, m.filter("doc_id % 10 = 5").select("id"), now()))


@query('SELECT source, target, memory_id, "at" FROM related', M.replace("memory_items AS", "old_items AS", 1), CHANGED, KNOWN, FOUND, RELATED)
def relations_after_update(spark, d):
    return _related(spark, d)


@query("""SELECT name_key, CAST(nth AS INT) AS nth, source, target, memory_id, "at" FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY "at" DESC, source, target, memory_id) AS nth FROM (SELECT *, source AS name_key FROM related UNION ALL SELECT *, target FROM related)) WHERE nth <= 4""", M.replace("memory_items AS", "old_items AS", 1), CHANGED, KNOWN, FOUND, RELATED)
def newest_relations(spark, d):
    return relations.newest(_related(spark, d))


@query("""SELECT scope_key, array_to_string(list_filter([CASE WHEN p IS NOT NULL THEN 'Profile:' || chr(10) || CASE WHEN length(p) <= 1500 THEN p ELSE rtrim(substr(p, 1, 1500), ' ' || chr(10)) END END, CASE WHEN c IS NOT NULL THEN 'Active context:' || chr(10) || c END, CASE WHEN e IS NOT NULL THEN 'Active experience:' || chr(10) || e END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS context
FROM (SELECT scope_key, arg_max(nullif(trim(content, ' ' || chr(10)), ''), doc_id) FILTER (kind = 'identity') AS p, arg_max(nullif(trim(content, ' ' || chr(10)), ''), doc_id) FILTER (kind = 'note') AS c, arg_max(nullif(trim(content, ' ' || chr(10)), ''), doc_id) FILTER (kind = 'experience') AS e FROM memory_items WHERE kind IN ('identity', 'note', 'experience') GROUP BY scope_key)""", M)
def active_contexts(spark, d):
    m = V.memory_items(spark, d).filter("kind in ('identity', 'note', 'experience')").withColumn("ord", F.col("doc_id"))
    kind = F.when(F.col("kind") == "identity", "profile").when(F.col("kind") == "note", "context").otherwise(F.col("kind"))
    return governance.active_context(tasks.latest_documents(m).withColumn("kind", kind))


@query("""SELECT id, CASE WHEN doc_id % 3 = 2 THEN '{"taskId":"' || id || '","truncated":true}' ELSE '{"pad":"' || repeat('x', CAST(doc_id % 3 * 600 AS INT)) || '","taskId":"' || id || '"}' END AS metadata FROM memory_items""", M)
def compact_results(spark, d):
    """Metadata of three sizes, the largest of which is cut to its hot keys; contents stay behind."""
    m = V.memory_items(spark, d)
    pad = F.expr("repeat('x', int(doc_id % 3 * 600))")
    return records.compact(m.withColumn("metadata", F.to_json(F.struct(pad.alias("pad"), F.col("id").alias("taskId")))), content=False).select("id", "metadata")


@query("""SELECT t.task_id, t.scope_key, coalesce(e.n, 0) AS entries, coalesce(length(rolling_summary), 0) AS summary_chars FROM tasks t LEFT JOIN (SELECT task_id, CAST(count(*) AS BIGINT) AS n FROM task_entries GROUP BY 1) e USING (task_id)""", V.TASKS, V.TASK_ENTRIES)
def task_overview(spark, d):
    e = V.task_entries(spark, d).groupBy("task_id").agg(F.count(F.lit(1)).alias("entries"))
    return V.tasks(spark, d).join(e, "task_id", "left").select("task_id", "scope_key", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), F.coalesce(F.length("rolling_summary"), F.lit(0)).cast("long").alias("summary_chars"))


@query("""SELECT name_key, id, summary FROM (SELECT f.name_key, m.id, m.summary, row_number() OVER (PARTITION BY f.name_key ORDER BY m.importance DESC, m.id) AS rn FROM found f LEFT JOIN memory_items m USING (id)) WHERE rn <= 60""", M, KNOWN, FOUND)
def entity_records(spark, d):
    from pyspark.sql import Window

    j = _found(spark, d).select("id", "name_key").join(V.memory_items(spark, d).select("id", "summary", "importance"), "id", "left")
    w = Window.partitionBy("name_key").orderBy(F.col("importance").desc(), "id")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn <= 60").select("name_key", "id", "summary")


@query(r"""WITH p AS (SELECT scope_key, [{'t': 'T1', 'b': content}, {'t': 'T2', 'b': lower(content)}, {'t': 'T3', 'b': ''}] AS s FROM docs) SELECT scope_key, CAST(i AS INT) AS ord, s[i].t AS title, regexp_replace(s[i].b, '\n+$', '') AS body FROM (SELECT scope_key, s, unnest(range(1, 4)) AS i FROM p)""", M, DOCS)
def profile_sections(spark, d):
    parts = [F.concat(F.lit(f"## T{i}\n"), body, F.lit("\n")) for i, body in enumerate((F.col("content"), F.lower("content"), F.lit("")), 1)]
    docs = _documents(spark, d).select("scope_key", F.concat(*parts).alias("content"))
    return tasks.profile_sections(docs).filter("title is not null")

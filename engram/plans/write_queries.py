"""Write-path queries with their SQL: every document, changed a little, written to the memory that holds the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import remember
from engram.plans import views as V
from engram.plans.queries import now, query
from engram.plans.search_queries import TEXT, TOK

M = V.MEMORY_ITEMS
INPUTS = """inputs AS (SELECT doc_id AS ord, scope_type, scope_id, scope_key, kind, tags, CASE doc_id % 5 WHEN 0 THEN content WHEN 1 THEN 'now ' || content WHEN 2 THEN substr(content, 1, CAST(length(content) // 2 AS BIGINT)) WHEN 3 THEN 'alpha beta ' || substr(content, 200) ELSE 'quite other words ' || doc_id END AS content, CAST(NULL AS VARCHAR) AS summary FROM memory_items)"""
SIMS = rf"""it AS (SELECT ord, scope_key, kind, {TOK.format(TEXT)} AS t FROM inputs), st AS (SELECT id, scope_key, kind, created_at, content AS old, {TOK.format(TEXT)} AS t FROM memory_items),
hs AS (SELECT x, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(x, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 128 AS INT) AS b FROM (SELECT unnest(t) AS x FROM it UNION SELECT unnest(t) FROM st)),
iv AS (SELECT ord, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT ord, unnest(t) AS x FROM it) JOIN hs USING (x) GROUP BY 1, 2), sv AS (SELECT id, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, unnest(t) AS x FROM st) JOIN hs USING (x) GROUP BY 1, 2),
ni AS (SELECT ord, sqrt(sum(n * n)) AS l FROM iv GROUP BY 1), ns AS (SELECT id, sqrt(sum(n * n)) AS l FROM sv GROUP BY 1),
pairs AS (SELECT ord, id, created_at, old, CASE WHEN len(it.t) = 0 OR len(st.t) = 0 THEN 0 ELSE len(list_intersect(list_distinct(it.t), list_distinct(st.t))) / CAST(len(list_distinct(it.t)) AS DOUBLE) END AS o FROM it JOIN st USING (scope_key, kind)),
dots AS (SELECT p.ord, p.id, sum(iv.n * sv.n) AS dot FROM pairs p JOIN iv ON iv.ord = p.ord JOIN sv ON sv.id = p.id AND sv.b = iv.b GROUP BY 1, 2),
sims AS (SELECT p.*, 0.5 * o + 0.5 * (coalesce(dot / (ni.l * ns.l), 0) + 1) / 2 AS s FROM pairs p LEFT JOIN dots USING (ord, id) LEFT JOIN ni USING (ord) LEFT JOIN ns USING (id))"""


def _inputs(spark, d):
    n = F.col("doc_id")
    c = F.col("content")
    text = F.when(n % 5 == 0, c).when(n % 5 == 1, F.concat(F.lit("now "), c)).when(n % 5 == 2, F.substring(c, 1, F.floor(F.length(c) / 2).cast("int"))).when(n % 5 == 3, F.concat(F.lit("alpha beta "), F.substring(c, 200, 1 << 30))).otherwise(F.concat(F.lit("quite other words "), n))
    return V.memory_items(spark, d).select(n.alias("ord"), "scope_type", "scope_id", "scope_key", "kind", "tags", text.alias("content"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("double").alias("importance"), F.lit(0.9).alias("confidence"))


def _decided(cut: float, action: str) -> str:
    return f"""WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(s, 12) DESC, created_at) AS rn FROM sims WHERE s >= {cut} - 1e-12) WHERE rn = 1)
SELECT ord, {action} AS action, CASE WHEN {action} <> 'add' THEN id END AS target, round(s, 9) AS similarity FROM inputs i LEFT JOIN best USING (ord)"""


def _decisions(spark, d, mode):
    out = remember.decisions(_inputs(spark, d), V.memory_items(spark, d), mode)
    return out.withColumn("similarity", F.round("similarity", 9))


@query(_decided(0.7 * 0.85, "CASE WHEN coalesce(s, 0) >= 0.85 THEN 'update' ELSE 'add' END"), M, INPUTS, SIMS)
def remember_threshold(spark, d):
    return _decisions(spark, d, "threshold")


OWN = r"list_distinct({0})".format(TOK)
RULES = f"""CASE WHEN coalesce(s, 0) >= 0.95 THEN 'ignore' WHEN coalesce(s, 0) >= 0.75 AND regexp_matches(content, '(?i)\\b(now|currently|changed to|switched to|no longer|instead)\\b') AND len(list_intersect({OWN.format('content')}, {OWN.format('old')})) / CAST(len({OWN.format('content')}) AS DOUBLE) >= 0.3 THEN 'contradict' WHEN coalesce(s, 0) >= 0.75 THEN 'update' ELSE 'add' END"""


@query(_decided(0.7, RULES), M, INPUTS, SIMS)
def remember_rules(spark, d):
    return _decisions(spark, d, "rules")


@query(_decided(0.7, "CASE WHEN coalesce(s, 0) >= 0.95 THEN 'ignore' ELSE 'add' END"), M, INPUTS, SIMS)
def remember_conservative(spark, d):
    return _decisions(spark, d, "conservative")


@query(f"""WITH dec AS ({_decided(0.7 * 0.85, "CASE WHEN coalesce(s, 0) >= 0.85 THEN 'update' ELSE 'add' END").replace('WITH best', 'WITH best')}),
l AS (SELECT target AS id, arg_max(content, ord) AS c FROM dec JOIN inputs USING (ord) WHERE action = 'update' GROUP BY 1),
upd AS (SELECT m.kind, CASE WHEN l.c IS NULL THEN m.content ELSE trim(l.c, ' ' || chr(10)) END AS c, CASE WHEN l.c IS NULL THEN m.importance ELSE greatest(m.importance, 0.5) END AS i, CASE WHEN l.c IS NULL THEN 0.7 ELSE 0.9 END AS f FROM memory_items m LEFT JOIN l USING (id)),
new AS (SELECT kind, trim(content, ' ' || chr(10)) AS c, 0.5 AS i, 0.9 AS f FROM dec JOIN inputs USING (ord) WHERE action = 'add')
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(c)) AS BIGINT) AS chars, round(CAST(sum(i) AS DOUBLE), 6) AS importance, round(CAST(sum(f) AS DOUBLE), 6) AS confidence FROM (SELECT * FROM upd UNION ALL SELECT * FROM new) GROUP BY kind""", M, INPUTS, SIMS)
def remember_result(spark, d):
    m, i = V.memory_items(spark, d), _inputs(spark, d)
    out = remember.remembered(i, m, remember.decisions(i, m), now())
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.round(F.sum("importance"), 6).alias("importance"), F.round(F.sum("confidence"), 6).alias("confidence"))

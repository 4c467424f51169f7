"""Queries over sources and time-driven folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as T
from engram.plans import views as V
from engram.plans.queries import query
from engram.sources import markdown, sessions
from engram.streaming import recalls

M = V.MEMORY_ITEMS


@query("""WITH RECURSIVE e AS (SELECT user_id AS id, ts FROM events), c AS (SELECT id, min(ts) AS ts FROM e GROUP BY id UNION ALL SELECT c.id, (SELECT min(e.ts) FROM e WHERE e.id = c.id AND e.ts >= c.ts + INTERVAL 5 MINUTE) AS ts FROM c WHERE c.ts IS NOT NULL)
SELECT id, CAST(count(ts) AS BIGINT) AS recall_count, max(ts) AS last_recalled_at FROM c GROUP BY id""")
def recall_counts(spark, d):
    return recalls.totals(V.read(spark, d, "events").select(F.col("user_id").alias("id"), "ts"))


@query("""WITH RECURSIVE e AS (SELECT 'doc-' || user_id AS id, ts FROM events WHERE event_id % 5 < 3), c AS (SELECT id, min(ts) AS ts FROM e GROUP BY id UNION ALL SELECT c.id, (SELECT min(e.ts) FROM e WHERE e.id = c.id AND e.ts >= c.ts + INTERVAL 5 MINUTE) AS ts FROM c WHERE c.ts IS NOT NULL),
t AS (SELECT id, CAST(count(ts) AS BIGINT) AS n, max(ts) AS last FROM c GROUP BY id)
SELECT id, CASE WHEN n IS NULL THEN recall_count ELSE coalesce(recall_count, 0) + n END AS recall_count, coalesce(strftime(last, '%Y-%m-%dT%H:%M:%S.%gZ'), strftime(last_recalled, '%Y-%m-%dT%H:%M:%SZ')) AS last_recalled_at
FROM memory_items LEFT JOIN t USING (id)""", M)
def recall_written_back(spark, d):
    """Events as hits of recalls, five ranks in turn: the top three count, and the counts land in the records."""
    hits = V.read(spark, d, "events").select((F.col("event_id") % 5 + 1).alias("rank"), F.concat(F.lit("doc-"), "user_id").alias("id"), "ts")
    done = recalls.written_back(V.memory_items(spark, d), recalls.totals(recalls.of_hits(hits)))
    return done.select("id", F.get_json_object("metadata", "$.recallCount").cast("long").alias("recall_count"), F.get_json_object("metadata", "$.lastRecalledAt").alias("last_recalled_at"))


def _pieces(text):
    """A text's parts between full stops, white space folded, that can stand as a line of prose: begun by a letter, not ended by a colon."""
    parts = F.transform(F.split(text, r"\. "), lambda x: T.collapse(x))
    return F.filter(parts, lambda x: x.rlike(r"^\p{L}.*[^:：]$"))


@query(r"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS path, list_filter(list_transform(string_split(text, '. '), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '^\p{L}.*[^:：]$')) AS l FROM documents WHERE text IS NOT NULL),
g AS (SELECT path, l, unnest(generate_series(0, CAST(ceil(len(l) / 5.0) AS BIGINT) - 1)) AS k FROM s WHERE len(l) > 0),
e AS (SELECT path, 3 * k + 0 AS o, 'H' || 5 * k || ' ' || l[5 * k + 1] || coalesce(' - ' || l[5 * k + 2], '') AS entry FROM g UNION ALL SELECT path, 3 * k + 1, 'H' || 5 * k || ' ' || l[5 * k + 3] FROM g UNION ALL SELECT path, 3 * k + 2, 'Lead ' || 5 * k + 3 || ': ' || l[5 * k + 4] || coalesce(' ' || l[5 * k + 5], '') FROM g)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY o) - 1 AS INT) AS ord, entry FROM e WHERE entry IS NOT NULL""")
def markdown_entries(spark, d):
    """Documents written as markdown (front matter, code, headings, nested items, lead-ins, prose of several lines) and read back."""
    head = "---\nname: x\n---\n# Title\n```\n- code\n```\n"
    i = lambda n: n.cast("string")
    line = lambda x, n: F.when(n % 5 == 0, F.concat(F.lit("\n## H"), i(n), F.lit("\n- "), x)).when(n % 5 == 1, F.concat(F.lit("  - "), x)).when(n % 5 == 2, F.concat(F.lit("* "), x)).when(n % 5 == 3, F.concat(F.lit("\nLead "), i(n), F.lit(":\n"), x)).otherwise(F.concat(F.lit("---\n"), x))
    text = F.concat(F.lit(head), F.array_join(F.transform(_pieces("text"), line), "\n"))
    files = V.read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))
    return markdown.entries(files)


@query(r"""WITH l AS (SELECT scope_id AS target, doc_id, '- ' || trim(summary, ' ' || chr(10)) AS line FROM memory_items WHERE trim(summary) <> ''), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY target ORDER BY doc_id DESC) - 1 AS used FROM l)
SELECT target, CAST(count(*) AS BIGINT) AS n, string_agg(rtrim(line), chr(10) ORDER BY doc_id) AS text FROM u WHERE used <= 900 GROUP BY target""", M)
def markdown_export(spark, d):
    m = V.memory_items(spark, d).select(F.col("scope_id").alias("target"), F.col("doc_id").alias("ord"), F.col("summary").alias("item"))
    return markdown.budgeted_list(m, 900)


@query("""WITH h AS (SELECT lang AS target, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS range, CAST(doc_id AS VARCHAR) AS path, sha256(CAST(doc_id AS VARCHAR) || chr(0) || text || chr(0)) AS digest FROM documents WHERE text IS NOT NULL),
r AS (SELECT target, range, sha256(string_agg(digest, '' ORDER BY path)) AS digest FROM h GROUP BY 1, 2) SELECT target, sha256(string_agg(digest, '' ORDER BY range)) AS fingerprint FROM r GROUP BY 1""")
def source_fingerprints(spark, d):
    return markdown.fingerprint(V.read(spark, d, "documents").filter("text is not null").select(F.col("lang").alias("target"), F.col("doc_id").cast("string").alias("path"), "text"))


@query("""SELECT 'conv:' || conv_id AS session_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE turn >= conv_id % 3 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user') AND trim(text) <> '' GROUP BY conv_id""")
def session_import(spark, d):
    c = V.read(spark, d, "conversations")
    session = F.concat(F.lit("conv:"), F.col("conv_id"))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))))
    m = c.select(session.alias("session_id"), F.col("turn").alias("ord"), "role", sessions.flat_content(F.when(F.col("turn") % 2 == 0, parts).otherwise(F.col("text"))).alias("content")).filter(T.trim("content") != "")
    done = c.select(session.alias("session_id"), (F.col("conv_id") % 3).alias("message_count")).distinct()
    return sessions.new_messages(m, done).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("""SELECT 'conv:' || conv_id AS session_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id HAVING count_if(role IN ('user', 'assistant', 'system')) > 0""")
def transcript_tails(spark, d):
    c = V.read(spark, d, "conversations")
    good = c.select(F.concat(F.lit("conv:"), F.col("conv_id")).alias("session_id"), F.col("turn").alias("ord"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("line"))
    bad = good.select("session_id", (F.col("ord") + 100).alias("ord"), F.lit("{not json").alias("line"))
    return sessions.transcript_tail(good.unionAll(bad))


@query("SELECT event_id, date_trunc('millisecond', ts) AS at FROM events")
def legacy_times(spark, d):
    e = V.read(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.unix_millis(ts).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return e.select("event_id", sessions.iso_time(text).alias("at"))

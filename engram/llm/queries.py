"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import collocations, common, compressclf, decontam, divergence, linedup, neardup, packing, passages, pii, rules, suffix, tokens, warc

#: Parameter: the tokenizer that the token operators use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the surrogates: the setting ``spark.engram.surrogateKey``, or one that only this run knows."""
    given = spark.conf.get("spark.engram.surrogateKey", None)
    return given.encode() if given else secrets.token_bytes(32)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    warc.write_archives(common.table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, payload=False)
    return found.select(warc.record_number("record_id", "long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.record_number("refers_to", "long").alias("refers_to"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, surrogate_key(spark)).select("doc_id", "n_entities", "n_values", "entities", "text")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return compressclf.quality_scores(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_spans", "text")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(common.utf8("text"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op11_passage_dedup": op11_passage_dedup,
    "op12_collocations": op12_collocations,
    "op13_source_divergence": op13_source_divergence,
    "op5_substring_dedup": op5_substring_dedup,
    "op10_near_duplicates": op10_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_compression_quality": op8_compression_quality,
    "op1_warc_revisits": op1_warc_revisits,
    "op9_line_dedup": op9_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op4_decontamination": op4_decontamination,
    "op6_packing": op6_packing,
}

ORACLE = {
    "op1_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(h, 10 * (j // 8) + 1, 10) AS UBIGINT) >> CAST(35 - 5 * (j % 8) AS UBIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
      FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM m""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(lines[i : i + 2], chr(10)) AS win
      FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(win, '[^ \t\n\r\v\f]')),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
k AS (SELECT doc_id, text, lines, coalesce(gone, []) AS gone FROM l LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
       CAST(len(list_filter(gone, lambda p: NOT list_contains(gone, p - 1))) AS BIGINT) AS n_spans,
       CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(list_filter(lines, lambda x, p: NOT list_contains(gone, p)), chr(10)) END AS text
FROM k""",
    "op4_decontamination": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, least(len(words), 10) AS size, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM w, sizes WHERE len(words) >= size)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op12_collocations": r"""
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, m, w[i : i + m - 1] AS w FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM p, range(1, 4) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, array_to_string(w, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
t AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN t USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM t GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p
      FROM g JOIN t USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
q AS (SELECT p.lang, p.term, 1 + (1000000000::HUGEINT * (sum(p.n) + 5)) // (any_value(w.n) + 5 * any_value(w.v)) AS q
      FROM p JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY lang) w USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50""",
    "op11_passage_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(words[i : i + 49], ' ')) AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
m AS (SELECT win, min(doc_id) AS owner FROM s GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM s JOIN m USING (win) WHERE owner < doc_id),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM p ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
}

"""Source divergence audit by DuckDB over shards.

Term counts by language, source and term are combined within map tasks, dealt by hash of language and term, and sorted. Each task cuts what it
gets into shards that end between two terms; a shard is one vectorised SQL aggregation that sums the counts and keeps the terms of enough documents. The kept
counts and the totals of all groups of a language meet in shards again, where SQL adds up the differences of each pair of sources and ranks the
terms of each source; Spark merges the shards' sums and rankings.

No group is gathered whole: a hot source or language is as many shards as its terms need; the rows of a hot term, one for each source and map task,
are summed by source as they come. What a shard holds besides its own terms is one row for each source of its language, as many as the result has
rows for one source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import common

LEAST_DOCS, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Counts that a map task holds before it hands them on; counts of a shard to be summed; terms times sources of a shard of the audit.
HELD, SHARD, GRID = 300_000, 400_000, 500_000
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PARTS = "lang string, part string, source string, item string, value long"


def _connection() -> duckdb.DuckDBPyConnection:
    """A database in memory of one thread, which never writes to a folder."""
    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '500MB'; SET temp_directory = ''")
    return con


def _term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs), combined within a task as far as ``HELD`` allows; a row of the empty term for each group met."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen: set[tuple[str, str]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                fixed = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], schema=_COUNTS)
            held.clear()

        for b in rows:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, source) not in seen:
                    seen.add((lang, source))
                    yield common.batch_of(_COUNTS, lang=[lang], source=[source], term=[""], n=[0], docs=[0])
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = _TERM.findall(text.lower())
                n.update(terms)
                d.update(set(terms))
                if len(n) > HELD:
                    yield from flush()
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    return docs.select(*named, common.utf8(text_col).alias("text")).mapInArrow(emit, COUNTS)


def _at_terms(rows: Iterator[pa.RecordBatch], con: duckdb.DuckDBPyConnection) -> Iterator[pa.Table]:
    """Sorted counts in tables of about ``SHARD`` rows that end where a term ends; one term's own rows are summed by source where they are more."""
    held, size = [], 0
    for b in rows:
        held.append(b)
        size += b.num_rows
        if size < SHARD:
            continue
        given = pa.Table.from_batches(held, _COUNTS)
        last = given.slice(size - 1, 1)
        rest = pc.sum(pc.and_(pc.equal(given["lang"], last["lang"][0]), pc.equal(given["term"], last["term"][0]))).as_py()
        if rest < size:
            yield given.slice(0, size - rest)
            given = given.slice(size - rest)
        else:
            given = con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM given GROUP BY ALL").to_arrow_table().cast(_COUNTS)
        held, size = given.to_batches(), given.num_rows
    if size:
        yield pa.Table.from_batches(held, _COUNTS)


def _kept(partial: DataFrame, least_docs: int) -> DataFrame:
    """Counts of the terms with ``least_docs`` documents in their language, summed by SQL in each shard; rows of the empty term stay, once a group."""

    def shard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for given in _at_terms(rows, con):
            kept = con.sql(f"""
                WITH counted AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM given GROUP BY ALL),
                often AS (SELECT lang, term FROM counted GROUP BY ALL HAVING sum(docs) >= {least_docs} OR term = '')
                SELECT lang, source, term, n, docs FROM counted JOIN often USING (lang, term)""")
            yield from kept.to_arrow_table().cast(_COUNTS).to_batches()
        con.close()

    group = F.when(F.col("term") == "", F.col("source"))  # rows without term are no hot key
    return partial.repartition("lang", "term", group).sortWithinPartitions("lang", "term").mapInArrow(shard, COUNTS)


#: Of the counts (source, term, n), the groups (source, n) and the terms' number v of one shard: p of each source and term, and q of the language.
_SHARES = """
    WITH terms AS (SELECT DISTINCT term FROM counts),
    grid AS (
      SELECT g.source, t.term, coalesce(c.n, 0) AS n, 1 + ({scale}::HUGEINT * (coalesce(c.n, 0) + {smooth})) // (g.n + {smooth} * g.v) AS p
      FROM groups g CROSS JOIN terms t LEFT JOIN counts c ON c.source = g.source AND c.term = t.term)
"""
_PAIRS = """
    SELECT a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
    FROM grid a JOIN grid b ON a.term = b.term AND a.source < b.source GROUP BY ALL
"""
_TERMS = """
    , whole AS (SELECT term, 1 + ({scale}::HUGEINT * (sum(n) + {smooth})) // ((SELECT sum(n) + {smooth} * any_value(v) FROM groups)) AS q FROM grid GROUP BY term)
    SELECT source, term AS item, (p - q)::BIGINT AS value FROM grid JOIN whole USING (term) WHERE n > 0 AND p > q
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, encode(term)) <= {ranks}
"""


def divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """How far the sources of each language lie apart: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language keeps those in ``least_docs`` of its rows or more. A group has
    for each kept term p = 1 + floor(10^9 (n + 5) / (N + 5 V)), with n its occurrences, N their sum, V the kept terms. Part ``pair``: the sum of the
    differences to each other source of the language, all ranks. Part ``term``: terms with n > 0 that have more in the group than in the
    whole language, by that difference, ``ranks`` of them.

    Null text, language and source count as empty strings. Each row is a document, repeated rows too. A group without terms has its pairs (its shares are equal),
    a language without kept terms has pairs of value 0; an empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    found = common.written(_kept(_term_counts(docs, lang_col, source_col, text_col), least_docs), "kept-terms")
    kept = found.filter("term <> ''")
    groups = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sizes = of_lang.join(v, "lang", "left").na.fill({"v": 0}).select("lang", "v", (F.ceil(F.col("v") * F.col("sources") / GRID) + 1).cast("int").alias("shards"))
    groups = common.written(groups.join(sizes, "lang"), "groups")
    own = kept.join(groups.select("lang", "source", "shards"), ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "source", "term", "n")
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def audit(key: tuple, counts: pa.Table, totals: pa.Table) -> pa.Table:
        con = _connection()
        con.register("counts", counts.select(["source", "term", "n"]))
        con.register("groups", totals.select(["source", "n", "v"]))
        shares, out = _SHARES.format(scale=SCALE, smooth=SMOOTH), []
        for part, sql in (("pair", _PAIRS), ("term", _TERMS.format(scale=SCALE, smooth=SMOOTH, ranks=ranks))):
            got = con.sql(shares + sql).to_arrow_table()
            fixed = [pa.repeat(pa.scalar(x, pa.string()), got.num_rows) for x in (key[0].as_py(), part)]
            out.append(pa.table([*fixed, got["source"].cast(pa.string()), got["item"].cast(pa.string()), got["value"].cast(pa.int64())], ["lang", "part", "source", "item", "value"]))
        con.close()
        return pa.concat_tables(out)

    partial = common.written(own.groupBy("lang", "shard").cogroup(everywhere.groupBy("lang", "shard")).applyInArrow(audit, PARTS), "shard-sums")
    summed = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source")
    both = names.alias("a").join(names.alias("b"), "lang").filter("a.source < b.source").select("lang", "a.source", F.col("b.source").alias("item"))
    half = both.join(summed, ["lang", "source", "item"], "left").na.fill({"value": 0})
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    terms = partial.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= ranks)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return out.select(*names).unionByName(terms.select(*names))

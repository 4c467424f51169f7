"""Findings of the third round: rows that the given tables have in their larger copies only."""

import duckdb

import __spark_entry__ as entry
from test_queries import shown


def agrees(spark, folder, name, tables):
    """The query's rows over small tables (name: DataFrame) and those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows and got == sorted(tuple(map(shown, r)) for r in rows)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_short_proposals(spark, tmp_path):
    c = conversations(spark, [(5, 1, "user", "En. What is on the list?"), (10, 1, "user", "The build needs node."), (6, 0, "user", "Go."), (7, 0, "user", "Ok. Why is it so?")])
    agrees(spark, tmp_path, "capture_proposals", {"conversations": c})


def test_short_captured_inputs(spark, tmp_path):
    c = conversations(spark, [(1017, 3, "user", "Ernd. Is in the list."), (9, 0, "user", "Go on. How?"), (10, 0, "user", "long texts."), (11, 0, "user", "no rule"), (12, 0, "assistant", "said by none")])
    agrees(spark, tmp_path, "capture_turn_inputs", {"conversations": c})


def test_summaries_that_end_in_a_blank(spark, tmp_path):
    c = conversations(spark, [(n, t, "user", "a" * 39 + " tail of the text" if t % 2 else " said ") for n, ts in ((1, 8), (3, 8), (4, 6)) for t in range(ts)])
    agrees(spark, tmp_path, "task_rolling_summaries", {"conversations": c})


def test_near_copies_are_not_given_pair_by_pair(spark, monkeypatch):
    """300 near copies against each other: one row an input and block where the best is asked for, a forest where links are, and the same best ones as among all pairs."""
    from pyspark.sql import functions as F

    from engram.operators import remember
    from test_memory import rows

    monkeypatch.setattr(remember, "BLOCK_ROWS", 100)
    r = rows(spark, *[{"content": f"the same words in every text but for one {n}"} for n in range(300)])
    i = r.withColumn("ord", F.col("id").cast("long")).drop("id")
    every = remember._similar(i, r, 0.7).collect()
    assert len(every) == 90_000 == len({(x.ord, x.id) for x in every})
    best = remember._similar(i, r, 0.7, "best").collect()
    assert len(best) <= 4 * 300 and {x.ord for x in best} == set(range(300))
    links = remember._similar(i, r, 0.7, "links").collect()
    assert len(links) <= 4 * 2 * 300
    group = {**{("i", n): ("i", n) for n in range(300)}, **{("r", str(n)): ("r", str(n)) for n in range(300)}}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in links:
        group[root(("i", x.ord))] = root(("r", x.id))
    assert len({root(x) for x in group}) == 1


def entities(spark):
    """40 queries in three groups that mean the same names, and 600 records: a name in all, one in a third, one in few, and one that nobody asks for."""
    groups = [["go", "rest"], ["go", "rust"], ["rest"]]
    resolved = spark.createDataFrame([(q, n) for q in range(40) for n in groups[q % 3]], "query_id long, name_key string")
    found = spark.createDataFrame([(f"r{i}", n) for i in range(600) for n in ["rest", *["go"] * (i % 3 == 0), *["rust"] * (i % 200 == 0), "other"]], "id string, name_key string")
    b = {"rest": 1 / (1 + 600 / 40), "go": 1 / (1 + 200 / 40), "rust": 1 / (1 + 3 / 40)}
    want = {}
    for q, n in resolved.collect():
        for r in found.filter(found.name_key == n).collect() if q < 3 else ():
            want[q, r.id] = want.get((q, r.id), 0) + b[n]
    return resolved, found, {(q, i): round(min(1.0, want[q % 3, i]), 9) for q in range(40) for x, i in want if x == q % 3}


def test_boosts_of_a_frequent_name_are_not_gathered(spark):
    """Nothing is grouped or shuffled after the pairs of queries and records are made."""
    from engram.operators import capture

    resolved, found, want = entities(spark)
    out = capture.entity_boosts(resolved, found)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) == out.count() and {(r.query_id, r.id): round(r.entity, 9) for r in out.collect()} == want


def test_search_by_names_equals_search_by_boosts(spark):
    """The entity signal from names that records have, with no row for each query and record."""
    from engram.operators import capture, search
    from engram.plans.queries import now
    from test_memory import rows

    resolved, found, _ = entities(spark)
    r = rows(spark, *[{"id": f"r{i}", "content": f"text {i} of many"} for i in range(60)])
    q = spark.createDataFrame([(i, f"many texts {i}") for i in range(40)], "query_id long, text string")
    by_rows = search.search(r, q, now(), entity=capture.entity_boosts(resolved, found), least=0.0)
    named = search.search(r, q, now(), named=capture.asked_links(resolved, found), least=0.0)
    shown = lambda hits: sorted((x.query_id, x["rank"], x.id, round(x.score, 9), round(x.entity, 9)) for x in hits.collect())
    assert shown(named) == shown(by_rows) and any(x[-1] for x in shown(named))


def test_words_that_never_end_are_not_kept(monkeypatch):
    """An index pass over ever new words keeps a bound of them, and its rows are the same."""
    from engram.operators import search

    monkeypatch.setattr(search, "KEPT_WORDS", 200)
    monkeypatch.setattr(search, "WORDS", search._Words())
    texts = [f"the same words and new{n} señor{n} 日本{n} é́{n} " + " ".join(f"x{n}y{i}" for i in range(n % 90)) for n in range(400)]
    texts += ["long" * 100 + " tail", "", "a b", "İstanbul ½ x² ﬁ", "a😀b 𝔘𝔫"]
    held = [search._indexed_texts(texts[n : n + 7]) for n in range(0, len(texts), 7)]
    assert len(search.WORDS.numbers) <= 200 + 700 and len(search.HASHED) <= 50_001
    found = [one for part in held for one in zip(*part)]
    for text, (ids, vector, term_ids) in zip(texts, found, strict=True):
        low = text.lower()
        assert sorted(search.word_id(w) for w in {*search.words(text)}) == ids.tolist()
        assert (search.hash_vector(search.words(text)) == vector).all()
        if low.isascii() or search.MARK.search(text):
            assert [search.word_id(w) for w in search.terms(text)] == term_ids.tolist()


def test_vectors_are_compared_in_slices(spark):
    """A batch is scored a slice at a time, and the best are those of the whole."""
    import numpy as np
    import pyarrow as pa

    from engram.operators import search

    whole = pa.RecordBatch.from_arrays([pa.array(range(2 * search.SLICE + 5))], ["n"])
    assert [b.num_rows for b in search._slices(iter([whole]))] == [search.SLICE, search.SLICE, 5]
    draw = np.random.default_rng(5).normal(size=(1500, 8))
    draw[700:720] = draw[3]
    v = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(draw)] + [("none", None), ("short", [1.0])], "id string, vector array<float>").coalesce(1)
    hits = search.vector_search(v, v.filter("id in ('3', '9')").selectExpr("id as query_id", "vector"), 30)
    f = draw.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    for q in ("3", "9"):
        want = sorted(range(1500), key=lambda i: (-round(min(max(float(f[i] @ f[int(q)]), 0.0), 1.0), 9), str(i)))[:30]
        assert [r.id for r in hits.filter(f"query_id = '{q}'").orderBy("rank").collect()] == [*map(str, want)]


def test_summaries_read_the_head_of_long_texts(spark):
    from engram.functions import text as T

    texts = ["", " ", "x " * 59 + "yz", "x " * 60 + "y", " " * 2000 + "late words", "a" + " " * 1500 + "b" * 130, "w " * 5000, "a" * 118 + " " * 900 + "b c", "a" * 120 + " " * 3000, "a" * 120 + " " * 3000 + "b"]
    out = spark.createDataFrame([*enumerate(texts)], "n int, t string").select("n", T.summarize("t").alias("s")).collect()
    for r in out:
        s = " ".join(texts[r.n].split())
        assert r.s == (s if len(s) <= 120 else s[:117] + "..."), r.n


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def few(spark):
    from test_memory import rows

    return rows(spark, {"content": "deploys of redis run on fridays and docker too"}, {"content": "lunch at noon"}), spark.createDataFrame([("q", "redis run on fridays and"), ("z", "lunch at")], "query_id string, text string")


def test_a_graph_context_searches_once(spark):
    from engram.operators import capture, governance, search
    from engram.plans.queries import now

    r, q = few(spark)
    f = capture.entities(r)
    out = governance.graph_context(search.search(r, q, now()), f, capture.co_occurrences(f))
    assert "MapInArrow" not in plan(out)
    assert [(x.query_id, x.context) for x in out.collect() if x.query_id == "q"] == [("q", "Related entity graph:\n- docker co_occurs redis")]


def test_texts_are_found_without_words_of_all_records_in_the_join(spark):
    from engram.operators import search

    r, q = few(spark)
    out = search.containing(q, r)
    assert "Generate" not in plan(out) and sorted(map(tuple, out.collect())) == [("q", "0"), ("z", "1")]


def test_layers_search_once(spark):
    from pyspark.sql import functions as F

    from engram.operators import recall
    from engram.plans.queries import now

    r, q = few(spark)
    turns = q.select("query_id", "text", F.array(F.lit("user: earlier")).alias("recent"), F.lit("user:u1").alias("scope_key"), F.lit(None).cast("string").alias("task_id"))
    out = recall.layers(turns, r, now())
    assert "MapInArrow" not in plan(out) and "deploys of redis" in out.filter("query_id = 'q'").first().palace

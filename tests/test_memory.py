"""Scenarios of records, search and writes."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import capture, cloud, records, remember, search, storage, tasks

NOW = datetime(2025, 1, 1)
SCHEMA = "id string, scope_type string, scope_id string, kind string, content string, summary string, confidence double, importance double, source string, tags array<string>, metadata string, created_at timestamp, updated_at timestamp"


def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def rows(spark, *given):
    base = {"scope_type": "user", "scope_id": "u1", "kind": "note", "content": "x", "summary": None, "confidence": 0.7, "importance": 0.5, "source": "manual", "tags": [], "metadata": None, "created_at": NOW, "updated_at": NOW}
    data = [{"id": str(i), **base, **g} for i, g in enumerate(given)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], SCHEMA).withColumn("scope_key", T.scope_key())


def ask(spark, text):
    return spark.createDataFrame([("q", text)], "query_id string, text string")


def wanted(spark, *scopes):
    return spark.createDataFrame([("q", i, t, s, w) for i, (t, s, w) in enumerate(scopes)], "query_id string, ord int, scope_type string, scope_id string, weight double")


def test_scoped_search(spark):
    r = rows(spark, {"content": "prefers dark mode", "kind": "preference"}, {"content": "prefers dark mode", "kind": "preference", "scope_id": "u2"})
    hits = search.search(r, ask(spark, "dark mode preference"), now(), requested=wanted(spark, ("user", "U1", 1.05))).collect()
    assert [h.id for h in hits] == ["0"] and round(hits[0].scope, 6) == 0.7
    assert search.search(r, ask(spark, "  "), now()).count() == 0


def test_full_text_ranks_within_the_scopes_asked_for(spark):
    """The best 30 of all records lie in another scope: the scope's own records have their ranks all the same."""
    other = [{"content": "zebra zebra zebra", "scope_id": "u2"}] * 40
    own = [{"content": "a zebra among very many other words of a long record"}, {"content": "zebra crossing"}, {"content": "nothing of it"}]
    r = rows(spark, *other, *own)
    hits = {h.id: round(h.fts, 6) for h in search.search(r, ask(spark, "zebra"), now(), requested=wanted(spark, ("user", "u1", 1.0)), least=0.0).collect()}
    assert hits == {"41": 1.0, "40": 0.978, "42": 0.0}
    assert {round(h.fts, 6) for h in search.search(r, ask(spark, "zebra"), now(), most=50, least=0.0).collect() if int(h.id) >= 40} == {0.0}
    # scopes are compared as they are written: another case and a wildcard have hits, but no full-text signal
    for scope in (("user", "U1", 1.0), ("user", "*", 1.0)):
        assert {h.fts for h in search.search(r, ask(spark, "zebra"), now(), requested=wanted(spark, scope), most=50, least=0.0).collect()} == {0.0}


def test_search_joins_nothing_by_record(spark):
    """Neither records nor their index are shuffled, whatever the number of blocks; only the best of each task are."""
    r = rows(spark, *[{"content": f"record number {i} tea"} for i in range(50)])
    q = spark.createDataFrame([(f"q{i}", f"tea number {i}") for i in range(1100)], "query_id string, text string")
    for df in (search.search(r, q, now()), search.search(r, q, now(), indexed=storage.written(search.index(r), "kept"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") == 3
    assert search.search(r, q, now()).select("query_id").distinct().count() == 1100


def test_floor_without_a_match(spark):
    r = rows(spark, {"content": "alpha", "importance": 1.0}, {"content": "alpha", "importance": 0.9})
    hits = search.search(r, ask(spark, "zzzzqq"), now(), requested=wanted(spark, ("user", "u1", 1.0))).collect()
    assert [(h.id, round(h.score - 0.35 * h.hash, 5)) for h in hits if h.hash == 0] == [("0", 0.18333)] or hits[0].hash > 0


def test_validity_and_principle(spark):
    stale = '{"validUntil": "2024-06-01T00:00:00Z"}'
    chained = '{"validUntil": "2024-06-01T00:00:00Z", "supersededBy": "9"}'
    r = rows(spark, {"content": "tea"}, {"content": "tea", "metadata": stale}, {"content": "tea", "metadata": chained}, {"content": "tea", "kind": "principle"})
    s = {h.id: h.score for h in search.search(r, ask(spark, "tea"), now(), fts=False, least=0.0).collect()}
    assert round(s["1"] * 2, 9) == round(s["0"], 9) == round(s["2"], 9) and s["3"] > s["0"]


def test_entity_signal(spark):
    e = spark.createDataFrame([("q", "1", 1 / (1 + 1 / 40))], "query_id string, id string, entity double")
    hits = search.search(rows(spark, {}, {}), ask(spark, "ts"), now(), entity=e, least=0.0).collect()
    assert hits[0].id == "1" and round(hits[0].entity, 5) == 0.97561


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [-1.0, 0.0]), ("d", None), ("e", [1.0]), ("z", [0.0, 0.0])], "id string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [(r.id, round(r.score, 6)) for r in search.vector_search(v, q, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.8)]
    assert [r.id for r in search.vector_search(v, q, 5, 0.9).collect()] == ["a"]


def test_rerank_keeps_small_results(spark):
    h = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.8)], "query_id string, rank int, id string, score double")
    s = spark.createDataFrame([("q", "b", 1.0)], "query_id string, id string, rerank double")
    assert [r.id for r in search.reranked(h, s).orderBy("rank").collect()] == ["a", "b"]
    three = h.unionAll(spark.createDataFrame([("q", 3, "c", 0.1)], h.schema))
    assert search.reranked(three, s).orderBy("rank").first().id == "b"


def test_context_stops_at_the_first_overflow(spark):
    r = rows(spark, {"content": "a" * 100}, {"content": "b" * 900}, {"content": "c" * 10})
    h = spark.createDataFrame([("q", i + 1, str(i), 0.5) for i in range(3)], "query_id string, rank int, id string, score double")
    out = search.recall_context(h, r, 600).first()
    assert out.blocks == 1 and "aaa" in out.context and "ccc" not in out.context


def test_decay_borders(spark):
    old, edge, young = (NOW - timedelta(days=d) for d in (181, 180, 179))
    fresh, spent = ('{"recallCount": 2, "lastRecalledAt": "%s"}' % (NOW - timedelta(days=d)).strftime("%Y-%m-%dT%H:%M:%SZ") for d in (89, 90))
    r = rows(spark, {"updated_at": old}, {"updated_at": edge}, {"updated_at": young}, {"updated_at": old, "tags": ["pinned"]}, {"updated_at": old, "metadata": fresh}, {"updated_at": old, "metadata": spent}, {"updated_at": old, "importance": 0.3})
    assert sorted(x.id for x in records.decay(r, now()).collect()) == ["0", "1", "5"]


def test_forget_prunes_supports(spark):
    r = rows(spark, {}, {}, {"kind": "principle", "metadata": '{"supports": ["0", "1"], "k": 1}'})
    out = {x.id: x.supports for x in records.forget(r, spark.createDataFrame([("0",)], "id string")).collect()}
    assert out == {"1": None, "2": ["1"]}


def test_update_and_upsert(spark):
    r = rows(spark, {"content": "old", "created_at": NOW - timedelta(days=9), "updated_at": NOW - timedelta(days=9)})
    p = spark.createDataFrame([("0", "  new text ", 2.0, None, ["A  b", "", "a b"])], "id string, content string, importance double, confidence double, tags array<string>")
    u = records.update(r, p, now()).first()
    assert (u.content, u.summary, u.importance, u.tags, u.updated_at) == ("new text", "new text", 1.0, ["a b"], NOW)


def test_merge_plan_limits(spark):
    g = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(9)], "group_id string, rank int, id string")
    guard = spark.createDataFrame([("a1",)], "id string")
    assert records.merge_plan(g, guard).count() == 9
    assert records.merge_plan(g, guard, most=8, total=10).count() == 0


def inputs(spark, *given):
    return rows(spark, *[{"confidence": None, "importance": None, **g} for g in given]).withColumn("ord", F.col("id").cast("long")).drop("id")


def test_remember_threshold(spark):
    r = rows(spark, {"content": "the user prefers dark mode in the editor", "tags": ["ui"], "importance": 0.5})
    i = inputs(spark, {"content": "the user prefers dark mode in the editor", "tags": ["UI ", "new"], "importance": 0.9}, {"content": "completely other words stand here"})
    d = remember.decisions(i, r)
    assert {(x.ord, x.action, x.target) for x in d.collect()} == {(0, "update", "0"), (1, "add", None)}
    out = remember.remembered(i, r, d, now()).orderBy("created_at").collect()
    assert len(out) == 2
    kept = next(x for x in out if x.id == "0")
    assert kept.importance == 0.9 and kept.tags == ["ui", "new"]


def test_remember_rules(spark):
    r = rows(spark, {"content": "we deploy the service with docker compose on the old server"})
    i = inputs(spark, {"content": "we deploy the service with docker compose on the old server"}, {"content": "now we deploy the service with docker compose on the big server"}, {"content": "we deploy the service with docker compose on the new server too"}, {"content": "lunch"}, {"content": "we deploy the service with docker compose on the old server", "scope_id": "u2"})
    d = {x.ord: x.action for x in remember.decisions(i, r, "rules").collect()}
    assert d == {0: "ignore", 1: "contradict", 2: "update", 3: "add", 4: "add"}
    out = remember.remembered(i, r, remember.decisions(i, r, "rules"), now()).filter("id = '0'").first()
    assert out.previous_content.endswith("old server")


def test_remember_conservative(spark):
    head = "---\nname: weekly report\nkind: summary of the work that was done by everyone in this long week\n---\n"
    r = rows(spark, {"content": head + "alpha beta gamma delta epsilon zeta eta theta"})
    i = inputs(spark, {"content": head + "alpha beta gamma delta epsilon zeta other things"})
    assert remember.decisions(i, r, "conservative").first().action == "ignore"


@pytest.mark.parametrize("cut", [0.595, 0.7, 0.85, 0.95])
def test_write_candidates_equal_all_pairs(spark, cut):
    """Texts of 40 words from few and many, shortened and mixed, blank ones and copies: the same pairs as all against all."""
    import random

    draw = random.Random(5)
    texts = [" ".join(draw.choice(("rare%d" % draw.randrange(400), "word%d" % draw.randrange(12))) for _ in range(draw.choice((3, 12, 40)))) for _ in range(60)] + ["", "", "one"]
    near = [" ".join(w for w in t.split() if draw.random() > draw.choice((0, 0.1, 0.3, 0.6))) for t in texts]
    r = rows(spark, *[{"content": t, "kind": draw.choice(("note", "fact"))} for t in texts])
    i = inputs(spark, *[{"content": t, "kind": draw.choice(("note", "fact"))} for t in near])
    fold = remember.Fold("threshold", 0.85, 80, NOW)
    fold.cut = cut
    for x in r.orderBy(F.col("id").cast("int")).collect():
        fold.put({**x.asDict(), "kind": x.kind})
    want = {(x.ord, fold.rows[at]["id"], round(s, 9)) for x in i.collect() for s, at in fold.candidates(x.asDict())}
    assert {(x.ord, x.id, round(x.similarity, 9)) for x in remember.similarities(i, r, cut).collect()} == want
    best = {x.ord: round(x.similarity, 9) for x in remember.best_candidates(i, r, [0.96, cut]).collect()}
    assert best == {o: max(s for p, _, s in want if p == o) for o in {p for p, _, _ in want}}


def test_write_candidates_of_a_large_group_are_few(spark):
    """2,000 records of one scope and kind that share a third of their words: looked up at the deciding threshold are few of 400,000 pairs."""
    import random

    draw = random.Random(6)
    r = rows(spark, *[{"content": " ".join([f"common{n}" for n in range(10)] + [f"word{draw.randrange(3000)}" for _ in range(20)])} for _ in range(2000)])
    i = r.filter(F.col("id").cast("int") % 10 == 0).withColumn("ord", F.col("id").cast("long")).drop("id").withColumn("content", F.concat("content", F.lit(" more")))
    a, b = remember.features(i, "ord"), remember.features(r, "id")
    first = remember.candidates(remember.rarest_first(a, b), b, 2 * 0.85 - 1)
    assert 200 <= first.count() <= 400_000 // 100
    assert remember.best_candidates(i, r, [0.85, 0.595]).filter("cast(id as long) = ord").count() == 200


def sequential(records_, inputs_, mode):
    """One write after the other over all records, without groups."""
    fold = remember.Fold(mode, 0.85, 80, NOW)
    for r in sorted(records_, key=lambda r: (r["created_at"], r["id"])):
        fold.put({c: r[c] for c in remember.ROW})
    for i in sorted(inputs_, key=lambda r: r["ord"]):
        fold.write({c: i.get(c) for c in remember.ROW})
    return sorted((r["scope_key"], r["kind"], r["content"], r["summary"], round(r["importance"], 6), round(r["confidence"], 6), tuple(r["tags"]), r["source"], r["metadata"]) for r in fold.rows)


@pytest.mark.parametrize("mode", remember.MODES)
def test_a_batch_is_written_in_its_order(spark, mode):
    deploy = "we deploy the service with docker compose on the {} server in the {} room"
    r = rows(spark, {"content": deploy.format("old", "first"), "metadata": '{"supports":["a"],"recallCount":3}'}, {"content": "lunch is at noon every day of the working week", "tags": ["food"]}, {"content": deploy.format("old", "first"), "scope_id": "u2"})
    said = [
        {"content": "the team meets on tuesday morning at nine in the large hall", "tags": ["B"], "metadata": '{"k":1}'}, {"content": "the team meets on tuesday morning at nine in the large hall", "source": "hook", "metadata": '{"k":2,"m":"x\\"y"}'},
        {"content": "now " + deploy.format("big", "first")}, {"content": deploy.format("big", "second"), "importance": 0.9}, {"content": deploy.format("big", "second")},
        {"content": "lunch is at noon every day of the working week", "tags": ["Food", "new"], "source": "import"}, {"content": "something quite different here"}, {"content": "now the team meets on tuesday morning at ten in the large hall"}, {"content": "  "},
    ]
    data = [{"confidence": None, "importance": None, "source": None, **x} for x in said]
    i = rows(spark, *data).withColumn("ord", F.col("id").cast("long")).drop("id")
    out = remember.remember(i, r, now(), mode)
    got = sorted((x.scope_key, x.kind, x.content, x.summary, round(x.importance, 6), round(x.confidence, 6), tuple(x.tags), x.source, x.metadata) for x in out.collect())
    expected = sequential([x.asDict() for x in r.collect()], [x.asDict() for x in i.collect()], mode)
    assert got == expected
    if mode == "threshold":
        meets = [x for x in got if "team meets" in x[2]]
        assert len(meets) == 1 and json.loads(meets[0][8])["markerHistory"][0]["metadata"] == {"k": 2, "m": 'x"y'} and json.loads(meets[0][8])["sourceHistory"] == ["manual", "hook"]
    if mode == "rules":
        old = next(json.loads(x[8]) for x in got if x[8] and "supports" in x[8])
        assert old["supports"] == ["a"] and old["recallCount"] == 3 and len(old["changelog"]) == 1 and old["previousContent"].startswith("we deploy")


def test_markers():
    assert remember.marked(None, "a", [], None, None) is None and remember.marked({"x": 1}, "a", [], None, "a") == {"x": 1}
    assert remember.marked({"x": 1}, "a", ["t"], {"x": 2, "y": 3}, None) == {"x": 1, "y": 3, "markerHistory": [{"source": "manual", "tags": ["t"], "metadata": {"x": 2, "y": 3}}]}
    assert remember.marked({"sourceHistory": ["z"]}, "a", [], None, "b")["sourceHistory"] == ["a", "z", "b"]


def test_windows_modes(spark):
    t = spark.createDataFrame([("t", "sum")], "task_id string, rolling_summary string")
    e = spark.createDataFrame([("t", i, "user", f"m{i}") for i in range(1, 5)], "task_id string, sequence long, role string, content string")
    d = spark.createDataFrame([("t", f"d{i}", f"dec{i}", NOW - timedelta(hours=i)) for i in range(15)], "task_id string, id string, content string, created_at timestamp")
    q = spark.createDataFrame([("t", "go", None)], "task_id string, query string, tool_context string")
    old = tasks.windows(t, e, d, q, recent=2).first()
    new = tasks.windows(t, e, d, q, recent=2, mode="latest").first()
    assert "user: m1\nuser: m2" in old.window and "m3" not in old.window and "user: m3\nuser: m4" in new.window
    assert "- dec11" in old.window and "- dec12" not in old.window and old.decision_chars == sum(len(f"dec{i}") for i in range(15))


def test_profile_merge(spark):
    doc = spark.createDataFrame([("s", "intro\n\n## A\none\n\n## B\ntwo\n## C\nthree\n")], "scope_key string, content string")
    new = spark.createDataFrame([("s", "## B\nTWO\n## D\nfour\n")], "scope_key string, content string")
    s = tasks.profile_sections(doc)
    assert [(r.title, r.body) for r in s.orderBy("ord").collect()] == [(None, "intro"), ("A", "one"), ("B", "two"), ("C", "three")]
    m = tasks.profile_merge(s, tasks.profile_sections(new)).orderBy("ord").collect()
    assert [(r.title, r.body) for r in m] == [("A", "one"), ("B", "TWO"), ("C", "three"), ("D", "four")]


def test_proposals(spark):
    said = ["remember that the build needs node 22", "I prefer tabs. What do you use?", "我是通过代理访问的", "我是一名后端工程师", '里面有"我是"这两个字吗？', ".", "hello, i am a data engineer @image#1:x.png", "we decided to use parquet"]
    t = spark.createDataFrame([(str(i), s) for i, s in enumerate(said)], "turn_id string, user_message string")
    out = {(r.turn_id, r.kind, r.content) for r in capture.proposals(t).collect()}
    assert out == {("0", "fact", "the build needs node 22"), ("1", "preference", "I prefer tabs."), ("3", "identity", "我是一名后端工程师"), ("6", "identity", "hello, i am a data engineer"), ("7", "decision", "we decided to use parquet")}


def test_entities(spark):
    r = spark.createDataFrame([("1", 'Uses TypeScript with pnpm, ask @maria or @qq.com and v@0.1.1 about "Blue Sky" and DataLoader'), ("2", "restore")], "id string, content string")
    found = {(x.id, x.name, x.kind) for x in capture.entities(r).collect()}
    assert {("1", "typescript", "tech"), ("1", "pnpm", "tool"), ("1", "maria", "person"), ("1", "qq.com", "org"), ("1", "Blue Sky", "project"), ("1", "DataLoader", "tech"), ("2", "rest", "tech")} <= found
    assert not any(n == "0.1.1" for _, n, _ in found)
    strict = {x.name for x in capture.entities(r, [("Blue Sky", "project")], strict=True, whole_words=True).collect()}
    assert "DataLoader" not in strict and "Blue Sky" in strict and "rest" not in strict


def test_gates(spark):
    u = spark.createDataFrame([("a", "free", 499, 0, 0), ("b", "free", 500, 1, 1), ("c", "enterprise", 10**9, 999, 999)], "project_id string, plan string, memories_written long, agents long, seats long")
    g = {r.project_id: r for r in cloud.gates(u, cloud.plans(spark)).collect()}
    assert g["a"].write_memory and not g["b"].write_memory and not g["b"].multi_agent and g["c"].write_memory and g["c"].team_dashboard and not g["a"].cloud_sync


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", 1, "a"), ("q1", 6, "b"), ("q2", 7, "x")], "query_id string, rank int, id string")
    truth = spark.createDataFrame([("q1", "b", "c1"), ("q1", "a", "c1"), ("q2", "x", "c2"), ("q3", "y", "c2")], "query_id string, id string, category string")
    m = {r.category: r for r in cloud.retrieval_metrics(ranked, truth).collect()}
    assert m["all"].questions == 3 and round(m["all"].recall_5, 6) == round(1 / 3, 6) and round(m["all"].recall_10, 6) == round(2 / 3, 6) and round(m["c2"].ndcg_10, 6) == round(1 / 3 / 2, 6)

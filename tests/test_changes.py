"""Operations that change tables: what becomes of records, documents, tasks, entities and copies elsewhere."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from engram.api import Memory
from engram.functions import json as J
from engram.operators import capture, cloud, governance, recall, records, scopes, search, tasks
from engram.sources import hosts
from test_memory import NOW, now, rows

META = '{"supports":["0","keep"],"recallCount":3,"note":"he said \\"hi\\" ü","deep":{"a":[1,null]},"on":true}'


def test_keys_keep_the_rest(spark):
    df = spark.createDataFrame([(META,), (None,), ("no json",), ("[1]",)], "m string")
    out = [json.loads(r.x) for r in df.select(J.with_keys("m", {"on": J.variant(F.lit("off")), "n": J.variants(F.array(F.lit(1))), "gone": F.lit(None).cast("variant")}).alias("x")).collect()]
    assert out[0] == {**json.loads(META), "on": "off", "n": [1]} and out[1:] == [{"on": "off", "n": [1]}] * 3
    assert json.loads(df.limit(1).select(J.merged("m", F.lit('{"on":false,"z":1.5}')).alias("x")).first().x) == {**json.loads(META), "on": False, "z": 1.5}


def test_forget_keeps_metadata(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.save(rows(spark, {}, {"kind": "principle", "metadata": META}))
    m.forget(spark.createDataFrame([("0",)], "id string"))
    assert json.loads(m.get("1").first().metadata) == {**json.loads(META), "supports": ["keep"]} and m.items().count() == 1


def test_contradiction_keeps_metadata(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.save(rows(spark, {"content": "we deploy the service with docker compose on the old server", "metadata": META}))
    new = spark.createDataFrame([(0, "user", "u1", "note", "now we deploy the service with docker compose on the big server", None, [], None, None)], "ord long, scope_type string, scope_id string, kind string, content string, summary string, tags array<string>, importance double, confidence double")
    m.remember(new, now(), "rules")
    got = json.loads(m.items().first().metadata)
    assert {k: got[k] for k in json.loads(META)} == json.loads(META) and got["contradicted"] is True and got["previousContent"].endswith("old server") and [x["action"] for x in got["changelog"]] == ["contradict"]


def test_metadata_filters_know_types(spark):
    r = rows(spark, {"metadata": '{"k":5,"b":true}'}, {"metadata": '{"k":"5","b":"true"}'}, {"metadata": '{"k":5.0}'}, {"metadata": None}, {"metadata": "x"})
    ids = lambda **m: sorted(x.id for x in records.listing(r, metadata=m).collect())
    assert ids(k="5") == ["1"] and ids(k=5) == ["0", "2"] and ids(b=True) == ["0"] and ids(b="true") == ["1"] and ids(none="x") == []


def test_pruned_supports_and_edits(spark):
    r = rows(spark, {}, {"kind": "principle", "metadata": META}, {"content": "alpha beta", "updated_at": NOW - timedelta(days=1)}, {"content": "alpha gamma"})
    p = json.loads(governance.with_pruned_supports(r, now()).filter("id = '1'").first().metadata)
    assert p["supports"] == ["0"] and p["note"] == 'he said "hi" ü' and p["supportsPruneReason"] == "removed 1 support record(s)"
    e = spark.createDataFrame([(1, "user:u1", "alpha", "replace", " omega "), (2, "user:u1", "beta", "remove", None), (3, "user:u1", "none", "replace", "fresh"), (4, "user:u2", "alpha", "remove", None), (5, "user:u1", None, "add", "more")], "edit_id long, scope_key string, part string, op string, text string")
    out = {x.id: (x.content, x.summary) for x in governance.edited(r, e, now()).collect()}
    assert out["3"] == ("omega", "omega") and "2" not in out and len(out) == 3
    assert sorted(x.text for x in governance.unmatched(r, e).collect()) == ["fresh", "more"]


def test_reflection(spark):
    r = rows(spark, *[{"kind": "lesson", "tags": ["P0", "Build"], "content": f"c{i}"} for i in range(3)], {"kind": "lesson", "tags": ["other"]}, {"kind": "lesson", "tags": ["build", "pinned"]}, {"kind": "lesson", "tags": ["build"], "updated_at": NOW - timedelta(days=20)})
    docs = spark.createDataFrame([("agent:a", "context", '{"lastReflectAt":"2024-12-20T00:00:00Z"}'), ("agent:b", "context", '{"lastReflectAt":"2024-12-31T00:00:00Z"}')], "scope_key string, kind string, metadata string")
    texts = spark.createDataFrame([("build", "# Builds are pinned."), ("other", "x")], "tag string, text string")
    made = records.reflected(r, docs, texts, ("agent", "a"), now()).collect()
    assert len(made) == 1 and json.loads(made[0].metadata)["supports"] == ["0", "1", "2"] and made[0].tags == ["build", "principle", "reflected"]
    assert records.reflected(r, docs, texts, ("agent", "b"), now()).count() == 0


def test_consolidation(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.save(rows(spark, {"content": "a" * 400, "summary": "kept text"}, {"content": "b"}, {"kind": "preference", "content": "p"}, {"kind": "principle", "metadata": '{"supports":["1","2"],"n":1}'}, {"content": "old", "created_at": NOW - timedelta(days=400), "importance": 0.4}))
    plan = spark.createDataFrame([("0", "1")], "keep string, drop string")
    m.consolidate(plan, now(), "archive")
    out = {r.id: r for r in m.items().collect()}
    assert sorted(out) == ["0", "2", "3", "4"] and out["0"].content == "kept text" and json.loads(out["3"].metadata) == {"supports": ["2"], "n": 1} and out["4"].importance == 0.05
    with pytest.raises(ValueError):
        m.consolidate(spark.createDataFrame([("0", "2")], plan.schema), now())
    assert m.items().count() == 4 and m.versions(2) == [2, 1] and m.index().count() == 4 and m.index().count() == 4
    m.export([("prefs", ["preference"], [])], str(tmp_path / "out"))
    assert {r.target for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"prefs", "memory"}


def test_attribution_limit_and_principles(spark):
    r = rows(spark, {}, {}, {}, {"kind": "principle", "metadata": META})
    ids = spark.createDataFrame([("2", 0), ("0", 1), ("1", 2)], "id string, ord int")
    assert sorted(x.id for x in records.attributed(r, ids, most=2).collect()) == ["0", "2"]
    assert [(x.id, x.supports) for x in records.principles(r).collect()] == [("3", 2)]
    assert "content" not in records.compact(r, content=False).columns
    assert "truncated" in records.compact(r, most=10).filter("id = '3'").first().metadata
    d = spark.createDataFrame([("2025-01-06",), ("2024-12-31",)], "d string").select(records.next_first_monday(F.col("d").cast("date")).alias("x")).collect()
    assert [str(x.x) for x in d] == ["2025-02-03", "2025-01-06"]


def test_tasks(spark):
    t = spark.createDataFrame([("t1", "s", "Old", "active", NOW, NOW)], "task_id string, scope_key string, title string, status string, created_at timestamp, updated_at timestamp")
    c = spark.createDataFrame([(1, "t1", None, None, "paused"), (2, "t1", None, "New", None), (3, "t1", None, " ", "weird"), (4, "t2", "s2", None, None)], "ord int, task_id string, scope_key string, title string, status string")
    out = {r.task_id: (r.scope_key, r.title, r.status) for r in tasks.with_changes(t, c, now()).collect()}
    assert out == {"t1": ("s", "New", "active"), "t2": ("s2", "t2", "active")}
    e = spark.createDataFrame([("t1", i, f" m{i} ", "sum" if i == 2 else None, i == 1) for i in range(1, 5)], "task_id string, sequence long, content string, summary string, summarized boolean")
    got = {r.sequence: (r.summary, r.summarized) for r in tasks.summarised(e, 2).collect()}
    assert got == {1: (None, True), 2: ("sum", True), 3: ("m3", True), 4: (None, False)}


def test_experience_counters(spark):
    doc = spark.createDataFrame([("s", "- first lesson here\n- second lesson there\n", '{"x":1.5}')], "scope_key string, content string, metadata string")
    e = tasks.experience_entries(doc)
    ids = {r.text: r.entry_id for r in e.collect()}
    stats = tasks.merged_stats(e, tasks.entry_stats(doc), now())
    hits = spark.createDataFrame([("s", ids["first lesson here"], "positive"), ("s", ids["first lesson here"], "neutral")], "scope_key string, entry_id string, outcome string")
    after = tasks.with_stats(doc, tasks.activated(stats, hits, now()))
    meta = json.loads(after.first().metadata)
    assert meta["x"] == 1.5 and [(s["text"], s["activationCount"], s["positiveCount"]) for s in meta["entryStats"]] == [("first lesson here", 2, 1), ("second lesson there", 0, 0)]
    again = tasks.merged_stats(tasks.experience_entries(after.withColumn("content", F.lit("- third"))), tasks.entry_stats(after), now())
    assert {(r.text, r.activations) for r in again.collect()} == {("first lesson here", 2), ("second lesson there", 0), ("third", 0)}
    v = spark.createDataFrame([("s", ids["second lesson there"], "zombie")], "scope_key string, entry_id string, verdict string")
    c = tasks.calibrated(after, v, now()).first()
    assert c.content == "- first lesson here" and json.loads(c.metadata)["lastCalibrationAt"].startswith("2025-01-01") and json.loads(c.metadata)["x"] == 1.5


def test_profile_operations(spark):
    doc = spark.createDataFrame([("s", "intro\n\n## A\none\n\n## B\ntwo\n## C\nthree\n")], "scope_key string, content string")
    say = '```json\n[{"op":"append_to_section","section":"A","content":"more"},{"op":"remove_section","section":"B"},{"op":"set_section","section":"D","content":"four"},{"op":"append_to_section","section":"B","content":"again"},{"op":"set_section","section":"C","content":" "},{"op":"bad","section":"A","content":"x"}]\n```'
    s = tasks.profile_sections(doc)
    ops = tasks.profile_ops(spark.createDataFrame([("s", say), ("t", "no json")], "scope_key string, text string"))
    out = tasks.profile_changed(s, ops).orderBy("ord").collect()
    assert [(r.title, r.body) for r in out] == [("A", "one\nmore"), ("C", "three"), ("D", "four"), ("B", "again")]
    text = tasks.profile_text(tasks.profile_changed(s, ops), s.filter("title is null")).first().content
    assert text == "intro\n\n## A\none\nmore\n\n## C\nthree\n\n## D\nfour\n\n## B\nagain\n"


def test_url_scopes_and_types(spark):
    ask = lambda *a, **k: {n: v for n, v in scopes.context_of_url(*a, **k).items() if v}
    assert ask("all") == ask(None, "all") == {"all_scopes": True} and ask("Host") == {"any_type": "agent", "any_id": "host"} and ask("USER:x:y") == {"any_type": "user", "any_id": "x:y"}
    assert ask(None, "shared", ("a", "b")) == {"agent_ids": ["a", "b"], "user_id": "*"} and ask("nosuch:x") == ask("") == {}
    asked = spark.createDataFrame([("user", "u1"), ("agent", "*")], "scope_type string, scope_id string")
    assert [r.scope_id for r in scopes.of_types(asked, "agent").collect()] == ["*"]
    r = rows(spark, {}, {"scope_id": "u2"}, {"scope_type": "agent"})
    assert {x.id: x.allowed for x in scopes.allowed(r, asked).collect()} == {"0": True, "1": False, "2": True}


def test_entities_kept_up(spark):
    table = spark.createDataFrame([("postgresql", "PostgreSQL", ["PG"], "tech", NOW, NOW)], "name_key string, name string, aliases array<string>, kind string, created_at timestamp, updated_at timestamp")
    c = spark.createDataFrame([(1, "pg", ["Postgres"], None), (2, "Maria", [], "person"), (3, "maria", ["M"], None), (4, " ", [], "x")], "ord int, name string, aliases array<string>, kind string")
    out = {r.name_key: (r.name, r.aliases, r.kind) for r in capture.upserted_entities(table, c, now()).collect()}
    assert out == {"postgresql": ("PostgreSQL", ["PG", "Postgres"], "tech"), "maria": ("Maria", ["M"], "person")}
    names = spark.createDataFrame([("q1", "pg"), ("q2", "gres"), ("q3", "o"), ("q4", "zz"), ("q5", "PostgreSQL")], "query_id string, name string")
    assert {(r.query_id, r.how) for r in capture.resolve_names(names, table).collect()} == {("q1", 0), ("q2", 1), ("q3", 1), ("q5", 0)}
    links = capture.entities(spark.createDataFrame([("1", "uses redis"), ("2", "uses docker")], "id string, content string"))
    new = capture.refreshed_links(links, spark.createDataFrame([("1", "uses mysql")], "id string, content string"))
    assert {(r.id, r.name_key) for r in new.collect()} == {("1", "mysql"), ("2", "docker")}
    rel = spark.createDataFrame([("a", "b", "1"), ("a", "c", "2")], "source string, target string, memory_id string")
    vec = spark.createDataFrame([("1",), ("2",)], "id string")
    left = capture.forgotten(links, rel, vec, spark.createDataFrame([("1",)], "id string"))
    assert [x.count() for x in left] == [1, 1, 1]
    nodes = spark.createDataFrame([("a",), ("b",)], "name_key string")
    assert [(r.source, r.target) for r in capture.node_edges(rel, nodes).collect()] == [("a", "b")]


def test_sync_applies(spark):
    s = "project_id string, id string, ord long, updated_at timestamp, content string, sync_version long"
    later = NOW + timedelta(days=1)
    local = spark.createDataFrame([("p", "a", 1, NOW, "old", 1), ("p", "b", 2, later, "newer", 1), ("p", "c", 3, NOW, "gone", 2), ("p", "n", 4, NOW, "new", 0)], s)
    remote = spark.createDataFrame([("p", "a", 1, later, "remote", 5, None), ("p", "b", 2, NOW, "older", 6, None), ("p", "c", 3, later, "gone", 7, later), ("p", "d", 9, NOW, "fresh", 8, None), ("p", "e", 9, NOW, "old news", 2, None)], s + ", deleted_at timestamp")
    out = {r.id: r.content for r in cloud.pull_applied(local, remote, F.lit(4)).collect()}
    assert out == {"a": "remote", "b": "newer", "d": "fresh", "n": "new"}
    mine, theirs = cloud.push_applied(local, remote.drop("deleted_at"))
    assert {r.id: r.sync_version for r in mine.collect()}["n"] == 9 and theirs.filter("id = 'n'").first().content == "new" and theirs.count() == 6
    state = spark.createDataFrame([("p", 10)], "project_id string, last_version long")
    assert cloud.cursors(state, remote.select("project_id", "sync_version")).first().last_version == 10


def test_recall_layers(spark):
    r = rows(spark, {"content": "deploys run on fridays", "tags": ["ops"]}, {"content": "lunch at noon"})
    turns = spark.createDataFrame([("q", "when do deploys run", ["user: hello"], "user:u1", "t"), ("z", " ", None, "user:none", None)], "query_id string, text string, recent array<string>, scope_key string, task_id string")
    docs = spark.createDataFrame([("user:u1", "profile", "likes tea")], "scope_key string, kind string, content string")
    t = spark.createDataFrame([("t", "so far")], "task_id string, rolling_summary string")
    none = spark.createDataFrame([], "task_id string, sequence long, role string, content string"), spark.createDataFrame([], "task_id string, id string, content string, created_at timestamp")
    w = recall.task_windows(turns, t, *none)
    other = spark.createDataFrame([("q", 1, "1", 0.5)], "query_id string, rank int, id string, score double")
    out = {x.query_id: x for x in recall.layers(turns, r, now(), documents=docs, windows=w, retriever=other).collect()}
    q = out["q"]
    assert q.stable.startswith("Profile:\nlikes tea") and "Memory navigation:" in q.stable and q.dynamic.index("Relevant long-term memory") == 0 and "Task summary:\nso far" in q.dynamic
    assert q.retrieval == "Relevant memory:\n- [note] lunch at noon (id 1; source manual; score 0.50)" and q.injected == q.stable + "\n\n" + q.dynamic
    assert out["z"].injected == "" and out["z"].palace is None and out["z"].navigation is None
    ix = search.index(r)
    assert recall.layers(turns, r, now(), indexed=ix).filter("query_id = 'q'").first().palace == q.palace and "memory" in recall.HINT
    assert search.reindexed(ix, r.filter("id = '1'").withColumn("content", F.lit("dinner")), spark.createDataFrame([("1",), ("0",)], "id string")).count() == 1


def test_reflections(spark):
    i = spark.createDataFrame([(1, "user", "u1", "user:u1", " learned a lot ", ["x"], "t", None), (2, "user", "u1", "user:u1", " ", [], "t", None)], "ord long, scope_type string, scope_id string, scope_key string, summary string, tags array<string>, task_id string, metadata string")
    made, lines, decisions = recall.reflections(i)
    assert [(r.kind, r.content, r.source) for r in made.collect()] == [("experience", "learned a lot", "reflection")] and lines.first().recent == "learned a lot" and decisions.count() == 1
    doc = tasks.rebuilt(spark.createDataFrame([("user:u1", "before")], "scope_key string, content string"), lines)
    assert doc.first().content == "before\nlearned a lot"
    p = spark.createDataFrame([("user:u1", "x"), ("user:u1", "learned a lot")], "scope_key string, content string")
    assert [r.content for r in recall.durable_writes(p, made).collect()] == ["x"]


def test_host_files(spark):
    f = spark.createDataFrame([("m.md", "memory", "- one\n- two"), ("u.md", "user", "- one"), ("d/2025-01-02.md", "daily", "# T\nday text"), ("x.md", "rules", "- rule")], "path string, target string, text string")
    out = hosts.host_inputs(f, "host", ("agent", "Host"))
    assert {(r.kind, r.content) for r in out.collect()} == {("note", "one"), ("note", "two"), ("preference", "one"), ("daily_log", "day text"), ("note", "rule")}
    assert json.loads(out.filter("kind = 'daily_log'").first().metadata) == {"projectionTarget": "daily", "day": "2025-01-02"}
    stored = spark.createDataFrame([("agent:host", "two", "rule")], "scope_key string, content string, summary string")
    assert sorted(r.content for r in hosts.new_only(out, stored).collect()) == ["day text", "one"]
    n = spark.createDataFrame([("a", 'x <!-- RAW_JSON_START {"memoryBlock":" block ","uid":"u","version":2} RAW_JSON_END -->'), ("b", "plain <!-- RAW_JSON_START nope RAW_JSON_END --> text"), ("c", " ")], "path string, text string")
    found = hosts.native_memory(n)
    assert {(r.path, r.content, r.uid, r.version) for r in found.collect()} == {("a", "block", "u", 2.0), ("b", "plain  text", None, None)}
    r = rows(spark, {"content": "block", "metadata": '{"nativeMemoryPath":"a"}'})
    assert {(x.path, x.action) for x in hosts.native_changes(found, r).collect()} == {("a", "keep"), ("b", "add")}


def test_sentinels(spark):
    totals = spark.createDataFrame([(1, 10), (2, 8), (3, 9)], "day int, total long")
    assert [(r.day, r.lost) for r in governance.fresh_drop(totals).collect()] == [(2, 2)]
    r = rows(spark, {"updated_at": NOW - timedelta(hours=1)}, {"updated_at": NOW - timedelta(hours=3), "scope_id": "u2"})
    assert [x.scope_key for x in governance.recent_sessions(r, now()).collect()] == ["user:u1"]
    t = spark.createDataFrame([("a", "active", NOW - timedelta(days=8)), ("b", "active", NOW), ("c", "archived", NOW - timedelta(days=9))], "task_id string, status string, updated_at timestamp")
    assert [x.task_id for x in governance.stale_tasks(t, now()).collect()] == ["a"]


def test_ties_are_bounded_in_a_task():
    import numpy as np

    best = search._Best(["q"], 3)
    for lo in range(0, 5000, 500):
        best.add(np.ones((500, 1)), [f"r{i:05d}" for i in range(lo, lo + 500)], np.arange(5000 - lo, 4500 - lo, -1), lambda i, q: ())
        assert len(best.rows[0]) <= 3
    assert best.batch(["query_id", "id", "score"]).column(1).to_pylist() == ["r04999", "r04998", "r04997"]


def test_containing_is_exact(spark):
    texts = ["alpha beta gamma delta", "beta gamma", "x", "a\nb c d e", "beta gamma delta"]
    held = ["zz alpha beta gamma deltas", "beta gamma", "no", "xa\nb c d ef", None]
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    r = spark.createDataFrame([(str(i), t) for i, t in enumerate(held)], "id string, content string")
    assert {(x.query_id, x.id) for x in search.containing(q, r).collect()} == {(str(i), str(j)) for i, t in enumerate(texts) for j, h in enumerate(held) if h and t in h}


def test_the_best_of_shuffled_batches():
    import numpy as np

    rnd = np.random.default_rng(4)
    score = np.round(rnd.random((600, 3)), 2)
    best = search._Best(["a", "b", "c"], 7)
    for lo in range(0, 600, 7):
        best.add(score[lo : lo + 7], [f"{i:03d}" for i in range(lo, min(lo + 7, 600))], None, lambda i, q: ())
    got = {q: [x[2] for x in best.rows[k]] for k, q in enumerate("abc")}
    assert got == {q: [f"{i:03d}" for i in sorted(range(600), key=lambda i: (-score[i, k], i))[:7]] for k, q in enumerate("abc")}


def test_patches_of_everything(spark):
    r = rows(spark, *[{"content": f"text {i}", "metadata": META, "source": "hook"} for i in range(5)])
    p = spark.createDataFrame([
        ("0", None, " ", " cli ", None, None, None, '{"a":1}'), ("1", None, " short ", "  ", "lesson", None, " U9 ", None), ("2", " new text ", "own summary", None, None, "agent", "Bot", "null"), ("3", " new text ", None, None, None, None, None, None),
    ], "id string, content string, summary string, source string, kind string, scope_type string, scope_id string, metadata string")
    later = NOW + timedelta(days=9)
    got = {x.id: x for x in records.update(r, p, F.lit(later)).collect()}
    assert (got["0"].summary, got["0"].source, got["0"].metadata, got["0"].content) == ("text 0", "cli", '{"a":1}', "text 0")
    assert (got["1"].summary, got["1"].source, got["1"].kind, got["1"].scope_id, got["1"].scope_key, got["1"].metadata) == ("short", "hook", "lesson", "U9", "user:u9", META)
    assert (got["2"].summary, got["2"].content, got["2"].metadata, got["2"].scope_key) == ("own summary", "new text", None, "agent:bot")
    assert got["3"].summary == "new text" and got["3"].metadata == META and got["4"].asDict() == r.filter("id = '4'").first().asDict()
    assert {got[k].updated_at for k in "0123"} == {later.replace(tzinfo=None)}


def test_reflections_are_marked(spark):
    docs = spark.createDataFrame([("agent:a", "context", "text", '{"note":1,"lastReflectAt":"2024-12-20T00:00:00Z"}'), ("agent:b", "context", "", '{"lastReflectAt":"2024-12-31T00:00:00Z"}'), ("agent:a", "profile", "p", None)], "scope_key string, kind string, content string, metadata string")
    after = lambda scope: {(x.scope_key, x.kind): (x.content, x.metadata) for x in records.reflected_documents(docs, scope, now()).collect()}
    at = NOW.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    a, b, c = after(("agent", "A")), after(("agent", "b")), after(("user", "New"))
    assert json.loads(a["agent:a", "context"][1]) == {"note": 1, "lastReflectAt": at} and a["agent:a", "context"][0] == "text" and a["agent:a", "profile"] == ("p", None) and len(a) == 3
    assert {k: v[1] for k, v in b.items()} == {k: v for k, v in zip([("agent:a", "context"), ("agent:b", "context"), ("agent:a", "profile")], ['{"note":1,"lastReflectAt":"2024-12-20T00:00:00Z"}', '{"lastReflectAt":"2024-12-31T00:00:00Z"}', None])}
    assert c["user:new", "context"][0] == "" and json.loads(c["user:new", "context"][1]) == {"lastReflectAt": at} and len(c) == 4
    # a second run within the interval finds the mark of the first and writes nothing
    texts = spark.createDataFrame([("ops", "a principle")], "tag string, text string")
    r = rows(spark, *[{"kind": "lesson", "tags": ["ops"], "scope_type": "agent", "scope_id": "a", "updated_at": NOW - timedelta(days=1)}] * 3)
    assert records.reflected(r, docs, texts, ("agent", "a"), now()).count() == 1
    assert records.reflected(r, records.reflected_documents(docs, ("agent", "a"), now()), texts, ("agent", "a"), now()).count() == 0


def test_marks_of_written_principles(spark):
    given = [(1, "agent:a", "principle", '{"reflectedAt":"2025-01-01"}'), (3, "agent:a", "principle", '{"reflectedAt":"2024-01-01"}'), (2, "agent:a", "note", '{"reflectedAt":"2026-01-01"}'), (4, "agent:a", "principle", '{"reflectedAt":5}'), (5, "agent:b", "principle", None), (6, "agent:c", "principle", '{"reflectedAt":" "}')]
    got = records.principle_marks(spark.createDataFrame(given, "ord int, scope_key string, kind string, metadata string")).collect()
    assert [(x.scope_key, x.at) for x in got] == [("agent:a", "2024-01-01")]

import json

from pyspark.sql import functions as F

from engram.sources import markdown, sessions


FILES = {
    "---\nname: x\n---\n# Title\nfirst line\nsecond line\n\n## Rules\n- one\n  - nested\n- two\n\n---\n**Bold lead**\n1. item\n\nNotes:\n* starred\n```\ncode\n```\n- ---\n\n### Orphan": ["first line second line", "Rules one - nested", "Rules two", "**Bold lead** item", "Notes: starred"],
    "": [],
    "lead:\nprose here\n\nplain": ["lead: prose here", "plain"],
    "## H\nprose\n- a\n- b\n## I\n- c\nprose\n    - deep\n- d": ["H prose", "a", "b", "I c", "I prose - deep", "d"],
    "    - deep first\n  - less\n      - more\n- top\n  1. sub": ["deep first", "less - more", "top 1. sub"],
    "---\nk: v\n---\n---\nmore: y\n\n- not read\n---\n```\n- code\n---\n```\ntext": [],
    "```\n---\n```\n- hidden": [],
    "text\n---\nmore\n# Title\nstill": ["text more still"],
    "-\n\n- \n\n2.x\n\n**b**:\n+ plus\r\n\u3000\n+ blank above": ["-", "-", "2.x", "**b**: plus", "blank above"],
    "- a:\n\n  - b\nshort lead：\n\n- c": ["a:", "b", "c"],
}


def test_markdown_entries(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(FILES)] + [("null", None)], "path string, text string")
    got = {}
    for r in markdown.entries(df).orderBy("path", "ord").collect():
        assert r.ord == len(got.setdefault(r.path, []))
        got[r.path].append(r.entry)
    for i, (text, expected) in enumerate(FILES.items()):
        assert got.get(str(i), []) == expected, text
    assert "null" not in got


def test_folders_and_fingerprints(spark, tmp_path):
    assert markdown.read_folder(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "A.MD").write_text("- x")
    (tmp_path / "b.txt").write_text("- y")
    assert [r.text for r in markdown.read_folder(spark, str(tmp_path)).collect()] == ["- x"]
    rows = [("t", f"p{i}", f"text {i}") for i in range(50)] + [("u", "p1", None)]
    one, other = (markdown.fingerprint(spark.createDataFrame(x, "target string, path string, text string").repartition(3)).collect() for x in (rows, rows[::-1]))
    assert {tuple(r) for r in one} == {tuple(r) for r in other} and len(one) == 2
    changed = [("t", "p0", "other"), *rows[1:]]
    assert {r.fingerprint for r in markdown.fingerprint(spark.createDataFrame(changed, "target string, path string, text string")).collect()} != {r.fingerprint for r in one}


def test_budget(spark):
    rows = [("t", 1, "aaaa"), ("t", 2, "bbbb"), ("t", 3, "cccc"), ("u", 1, "x" * 50), ("u", 2, "y" * 50), ("v", 1, "  ")]
    out = {r.target: r.text for r in markdown.budgeted_list(spark.createDataFrame(rows, "target string, ord int, item string"), 13).collect()}
    assert out == {"t": "- bbbb\n- cccc", "u": "- " + "y" * 11}


def test_import_skips_known(spark):
    found = spark.createDataFrame([("a", 0, "known"), ("a", 1, "new "), ("b", 0, "new")], "path string, ord int, entry string")
    stored = spark.createDataFrame([("user:u", "known", "s"), ("user:v", "new", "s")], "scope_key string, content string, summary string")
    assert [r.entry for r in markdown.import_entries(found, stored, F.lit("note"), "user:u").collect()] == ["new"]


def test_sessions(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    parts = json.dumps([{"type": "text", "text": "hi"}, {"type": "image", "text": "no"}, {"type": "output_text", "text": "there"}])
    (tmp_path / "sub" / "s.json").write_text(json.dumps({"id": "s1", "messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "ok"}, {"role": "user", "content": " "}]}))
    (tmp_path / "t.json").write_text(json.dumps({"id": "s2", "messages": [{"role": "assistant", "content": "alone"}]}))
    m = sessions.read_sessions(spark, str(tmp_path))
    assert {(r.session_id, r.content) for r in m.collect()} == {("s1", "hi\nthere"), ("s1", "ok"), ("s2", "alone")}
    done = spark.createDataFrame([("s1", 1)], "session_id string, message_count int")
    assert [(r.session_id, r.ord) for r in sessions.new_messages(m, done).collect()] == [("s1", 1)]


def test_times(spark):
    df = spark.createDataFrame([("1704067200000",), ("2024-01-01T00:00:00Z",), ("nonsense",), (None,)], "t string")
    out = [r.x for r in df.select(F.date_format(sessions.iso_time(F.col("t")), "yyyy-MM-dd").alias("x")).collect()]
    assert out == ["2024-01-01", "2024-01-01", None, None]


def test_questions_and_mirror(spark, tmp_path):
    q = [{"question_id": "q", "question_type": "c", "question": "?", "answer_session_ids": ["b"], "haystack_session_ids": ["a", "b"], "haystack_sessions": [[{"role": "user", "content": "x"}], [{"role": "user", "content": "y"}, {"role": "assistant", "content": "z"}]]}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    rows = sessions.read_questions(spark, str(tmp_path / "q.json")).orderBy("session_id").collect()
    assert [(r.session_id, r.text, r.relevant) for r in rows] == [("a", "user: x", False), ("b", "user: y\nassistant: z", True)]
    rec = spark.createDataFrame([("1", "note", "user:u", "s", "c  d", None)], "id string, kind string, scope_key string, summary string, content string, updated_at timestamp")
    sessions.write_mirror(rec, str(tmp_path / "mirror"))
    sessions.write_mirror(rec, str(tmp_path / "mirror"))
    assert [r.value for r in spark.read.text(str(tmp_path / "mirror" / "dump")).collect()] == ["1 | user:u | c d"]
    assert json.loads(sessions.export_json(rec, 9).first().json)["id"] == "1"

from pyspark.sql import functions as F

from engram import plugins
from engram.api import Memory
from engram.operators import search

IN = "ord long, scope_type string, scope_id string, kind string, content string, summary string, tags array<string>, importance double, confidence double"


def at(day):
    return F.lit(f"2025-01-{day:02d}").cast("timestamp")


def test_life_of_a_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "memory"))
    assert m.items().count() == 0
    m.remember(spark.createDataFrame([(0, "user", "U", "preference", "prefers dark mode in the editor", None, ["UI"], 0.8, None), (1, "repo", "r", "note", "the build runs on node twenty two", None, [], None, None)], IN), at(1))
    m.remember(spark.createDataFrame([(0, "user", "u", "preference", "prefers dark mode in the editor", None, ["new"], 0.9, None)], IN), at(2))
    rows = {r.kind: r for r in m.items().collect()}
    assert len(rows) == 2 and rows["preference"].importance == 0.9 and rows["preference"].tags == ["ui", "new"]
    q = spark.createDataFrame([("q", "dark mode")], "query_id string, text string")
    assert m.search(q, at(3)).first().id == rows["preference"].id
    assert "dark mode" in m.recall(q, at(3)).first().context
    ids = m.items().filter("kind = 'note'").select("id")
    m.pin(ids)
    assert m.get(rows["note"].id).first().tags == ["pinned"]
    m.attribute(ids)
    assert round(m.get(rows["note"].id).first().importance, 2) == 0.55
    m.decay(F.lit("2026-01-01").cast("timestamp"))
    assert {r.kind: r.importance for r in m.items().collect()} == {"preference": 0.3, "note": 0.55}
    one = rows["note"].id
    p = m.items().limit(1).withColumn("id", F.lit("p")).withColumn("kind", F.lit("principle")).withColumn("metadata", F.lit(f'{{"supports": ["{one}", "x"], "k": "v"}}'))
    m.save(m.items().unionByName(p))
    m.forget(spark.createDataFrame([(one,)], "id string"))
    left = m.get("p").select(F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>").alias("s"), F.get_json_object("metadata", "$.k").alias("k")).first()
    assert left.s == ["x"] and left.k == "v" and m.get(one).count() == 0
    assert m.list(kinds=["principle"]).count() == 1 and m.statistics().filter("kind is null and scope_key is null and source is null").first().n == 2


def test_plugins(spark):
    df = spark.createDataFrame([("q", "a", "tea", "green tea"), ("q", "b", "tea", " ")], "query_id string, id string, query string, document string")
    assert [(r.id, r.rerank) for r in plugins.reranker_scores(df, lambda q, d: [float(len(x)) for x in d]).collect()] == [("a", 9.0)]

    def broken(texts):
        raise OSError("no network")

    p = spark.createDataFrame([("p", "plain")], "prompt string, plain string")
    assert plugins.answered(p, broken, "plain").first().answer == "plain"
    assert plugins.answered(p, lambda t: ["model"] * len(t), "plain").first().answer == "model"
    assert [(r.error, r.n) for r in plugins.failures(plugins.answered(p, broken, "plain")).collect()] == [("OSError: no network", 1)]
    assert len(plugins.embedded(df, "document", broken, plugins.hash_embedding).first().vector) == 128 and plugins.embedded(df, "document", broken).first().vector is None
    v = plugins.embedded(df, "document").collect()
    assert len(v[0].vector) == 128 and abs(sum(x * x for x in v[0].vector) - 1) < 1e-9 and sum(map(abs, v[1].vector)) == 0
    assert search.hash_vector([]).sum() == 0

"""Relations by deltas equal those made anew; the graph's context has a query's own entities first and the newest relations."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from engram.operators import relations

OLD, NEW = datetime(2024, 1, 1), datetime(2025, 1, 1)


def table(spark, records, at):
    found = spark.createDataFrame([(i, n) for i, names in records.items() for n in names], "id string, name_key string")
    born = spark.createDataFrame([(i, at(i)) for i in records], "id string, at timestamp")
    return relations.relations(found, born)


def shown(rows):
    return sorted(map(tuple, rows.select("source", "target", "memory_id", "at").collect()))


def test_changes_equal_a_rebuild(spark):
    draw = random.Random(2)
    names = [f"n{x}" for x in range(9)]
    some = lambda: draw.sample(names, draw.randrange(5)) + ["n0"] * draw.randrange(3)
    before = {str(i): some() for i in range(60)}
    changed = {str(i): some() for i in range(50, 70)} | {"3": []}
    forgotten = {"7", "8", "55", "unknown"}
    after = {i: n for i, n in (before | changed).items() if i not in forgotten}
    old = table(spark, before, lambda i: OLD)
    written = spark.createDataFrame([(i, n) for i, ns in changed.items() for n in ns or [None]], "id string, name_key string")
    gone = spark.createDataFrame([(i,) for i in forgotten], "id string")
    changes = relations.deltas(old, written, gone, F.lit(NEW))
    assert {r.memory_id for r in changes.collect()} <= {*changed, *forgotten}
    got = relations.merged(old, changes)
    assert shown(got) == shown(table(spark, after, lambda i: NEW if i in changed else OLD))
    again = relations.deltas(got, written, gone, F.lit(NEW))
    assert shown(relations.merged(got, again)) == shown(got)


def test_nothing_changed(spark):
    old = table(spark, {"a": ["x", "y"]}, lambda i: OLD)
    none = spark.createDataFrame([], "id string, name_key string")
    assert shown(relations.merged(old, relations.deltas(old, none, none.select("id"), F.lit(NEW)))) == [("x", "y", "a", OLD)]


def test_context(spark):
    records = {str(i): ["hub", f"e{i}"] for i in range(6)} | {"own": ["mine", "other"], "lonely": ["alone"]}
    t = table(spark, records, lambda i: OLD + timedelta(days=int(i) if i.isdigit() else 0))
    found = spark.createDataFrame([(i, n) for i, ns in records.items() for n in ns], "id string, name_key string")
    hits = spark.createDataFrame([("q", 1, "2"), ("q", 6, "lonely"), ("r", 1, "lonely")], "query_id string, rank int, id string")
    asked = spark.createDataFrame([("q", "mine"), ("s", "unknown")], "query_id string, name_key string")
    got = {r.query_id: (r.relations, r.context.split("\n")) for r in relations.context(hits, found, t, asked).collect()}
    assert got["q"][0] == 5 and got["q"][1][1:] == ["- mine co_occurs other", "- e2 co_occurs hub", "- e5 co_occurs hub", "- e4 co_occurs hub", "- e3 co_occurs hub"]
    assert got["r"] == (0, ["Related entities:", "- alone"]) and got["s"] == (0, ["Related entities:", "- unknown"])

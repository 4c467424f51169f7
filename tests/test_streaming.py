import json
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from engram.api import Memory
from engram.streaming import pipelines, recalls
from test_memory import rows

T0 = datetime(2025, 1, 1)


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_counting_stream_agrees_with_batch(spark, tmp_path):
    seconds = [0, 100, 299, 300, 550, 601, 10_000]
    data = [("a", T0 + timedelta(seconds=s)) for s in seconds] + [("b", T0)]
    df = spark.createDataFrame(data, "id string, ts timestamp")
    assert {(r.id, r.recall_count) for r in recalls.totals(df).collect()} == {("a", 4), ("b", 1)}
    for i, s in enumerate(([0, 1, 2], [3, 4], [5, 6, 7])):
        spark.createDataFrame([data[k] for k in s], "id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(recalls.counting_stream(stream), "update", "counts")
    last = spark.table("counts").groupBy("id").agg(F.max("recall_count").alias("n"))
    assert {(r.id, r.n) for r in last.collect()} == {("a", 4), ("b", 1)}


def sequential(data, seconds=300):
    """One record after the other, one recall after the other."""
    out, last = [], {}
    for k, t in sorted(x for x in data if None not in x):
        if k not in last or t - last[k] >= timedelta(seconds=seconds):
            last[k] = t
            out.append((k, t))
    return out


def test_counting_by_chunks_equals_one_after_the_other(spark):
    rnd = random.Random(4)
    at = lambda s: T0 + timedelta(milliseconds=s)
    data = [("dense", at(rnd.randrange(40_000_000))) for _ in range(6000)] + [("sparse", at(rnd.randrange(10**11))) for _ in range(300)]
    data += [("even", at(300_000 * i)) for i in range(2000)] + [("odd", at(299_999 * i)) for i in range(2000)] + [("seconds", at(1000 * i)) for i in range(8000)]
    data += [("bursts", at(3_600_000 * i + j)) for i in range(0, 900, 7) for j in (0, 1, 299_999, 300_000)] + [("early", T0 - timedelta(days=30000, seconds=i * 200)) for i in range(50)]
    data += [("one", T0), ("one", T0), (None, T0), ("none", None)]
    df = spark.createDataFrame(data, "id string, ts timestamp").repartition(5)
    want = sequential(data)
    assert sorted((r.id, r.ts) for r in recalls.counted(df).collect()) == want
    ends = {k: (sum(x == k for x, _ in want), max(t for x, t in want if x == k)) for k in {x for x, _ in want}}
    assert {r.id: (r.recall_count, r.last_recalled_at) for r in recalls.totals(df).collect()} == ends
    numbers = df.filter("id = 'odd'").select(F.lit(7).alias("n"), "ts")
    assert [(r.n, r.recall_count) for r in recalls.totals(numbers, key="n").collect()] == [(7, ends["odd"][0])] and recalls.counted(numbers, key="n").schema["n"].dataType.simpleString() == "int"
    assert recalls.totals(df.limit(0)).count() == 0 and recalls.counted(df.limit(0)).count() == 0


def test_one_record_of_a_million_recalls_is_counted_by_many_tasks(spark):
    """No task folds more than the chunks it was dealt; what meets at the record are its spans."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 2_000_000).alias("ts"))
    t = recalls._Timelines(df, 300, "id")
    chunks, spans = t.steps.count(), t.spans.select("span").count()
    sizes = [r["count"] for r in t.times.groupBy("chunk").count().collect()]
    assert max(sizes) <= 1800 and chunks == len(sizes) > 500 and spans <= chunks // recalls.SPAN + 2
    (r,) = recalls.totals(df).collect()
    assert r.recall_count == -(-n // 150)


def test_steps_compose():
    rnd = random.Random(6)
    for _ in range(200):
        parts = [np.array(sorted(rnd.sample(range(100 * i, 100 * i + 100), rnd.randint(1, 40)))) for i in range(3)]
        steps = [recalls.Step.of(p, 100 * i, 7) for i, p in enumerate(parts)]
        whole = steps[0].then(steps[1]).then(steps[2])
        for before in [recalls.NEVER, *range(-9, 0)]:
            n, last = 0, before
            for x in np.concatenate(parts).tolist():
                if x - last >= 7:
                    n, last = n + 1, x
            assert whole.after(before) == (n, last)


def test_counts_are_written_into_the_records(spark, tmp_path):
    kept = ('{"recallCount":2,"note":"x"}', '{"recallCount":"many"}', None, '{"recallCount":1.5}', '{"lastRecalledAt":"2020-01-01T00:00:00Z"}')
    m = Memory(spark, str(tmp_path / "m"))
    m.save(rows(spark, *[{"content": f"text {i}", "metadata": x} for i, x in enumerate(kept)]))
    hits = [(1, "0", 0), (1, "0", 10), (2, "0", 300), (2, "1", 0), (3, "2", 0), (3, "3", 7), (4, "4", 0), (1, "gone", 0)]
    m.recalled(spark.createDataFrame([(r, i, T0 + timedelta(seconds=s)) for r, i, s in hits], "rank int, id string, ts timestamp"))
    got = {r.id: json.loads(r.metadata) if r.metadata else None for r in m.items().collect()}
    assert got["0"] == {"recallCount": 4, "note": "x", "lastRecalledAt": "2025-01-01T00:05:00.000Z"} and got["1"]["recallCount"] == 1
    assert got["2"] == {"recallCount": 1, "lastRecalledAt": "2025-01-01T00:00:00.000Z"} and got["3"]["recallCount"] == 2.5
    assert got["4"] == {"lastRecalledAt": "2020-01-01T00:00:00Z"} and len(got) == 5


def test_capture_and_buffers(spark, tmp_path):
    spark.createDataFrame([("1", "<system-reminder>x</system-reminder>remember that tests stay green")], "turn_id string, user_message string").write.parquet(str(tmp_path / "turns"))
    turns = spark.readStream.schema("turn_id string, user_message string").parquet(str(tmp_path / "turns"))
    got = []
    q = pipelines.capture_stream(turns, lambda batch, n: got.extend(batch.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and [r.content for r in got] == ["tests stay green"]
    spark.createDataFrame([("s", i, "user", f"m{i}") for i in range(30)], "session_id string, ord long, role string, content string").coalesce(1).write.parquet(str(tmp_path / "m"))
    m = spark.readStream.schema("session_id string, ord long, role string, content string").parquet(str(tmp_path / "m"))
    run(pipelines.session_buffers(m), "update", "buffers")
    r = spark.table("buffers").first()
    assert r.messages == 24 and r.buffer.startswith("user: m6") and r.buffer.endswith("user: m29")


def test_event_windows_and_audit(spark, tmp_path):
    e = [(i, T0 + timedelta(minutes=20 * i), "view") for i in range(12)]
    spark.createDataFrame(e, "event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    run(pipelines.event_stream_counts(s), "append", "windows")
    assert {r.n for r in spark.table("windows").collect()} == {3}
    q = s.writeStream.foreachBatch(pipelines.audit_sink(str(tmp_path / "audit"))).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "audit")).count() == 12


def test_flush_webhook_and_sync(spark, tmp_path):
    m = [("a", T0 + timedelta(minutes=i), i, "user", f" m{i} ") for i in range(30)] + [("b", T0 + timedelta(hours=9), 0, "user", "late")]
    schema = "session_id string, ts timestamp, ord long, role string, content string"
    for k, part in enumerate((m[:20], m[20:30], m[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    run(pipelines.flushed_sessions(stream, chars=12), "append", "flushed")
    flushed = spark.table("flushed").collect()
    assert [(r.session_id, r.messages, len(r.buffer)) for r in flushed] == [("a", 30, 12)] and flushed[0].buffer.endswith("user: m29")

    out = str(tmp_path / "posted")

    def post(texts):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))

    events = spark.createDataFrame([(1, "recall"), (2, "write"), (3, "recall")], "event_id long, type string")
    pipelines.webhook_sink(post, {"recall"}, rows=1)(events, 0)
    assert sorted(p.read_text() for p in (tmp_path / "posted").iterdir()) == ['{"event_id":1,"type":"recall"}', '{"event_id":3,"type":"recall"}']

    table = {"now": spark.createDataFrame([("a", T0, "old", 1), ("b", T0, "gone", 1)], "id string, updated_at timestamp, content string, sync_version long")}
    later = T0 + timedelta(days=1)
    remote = spark.createDataFrame([("a", later, "mid", 2, None), ("a", later, "new", 3, None), ("b", later, "gone", 4, later), ("c", T0, "fresh", 5, None)], "id string, updated_at timestamp, content string, sync_version long, deleted_at timestamp")
    pipelines.sync_sink(lambda: table["now"], lambda t: table.update(now=t))(remote, 0)
    assert {(r.id, r.content) for r in table["now"].collect()} == {("a", "new"), ("c", "fresh")}

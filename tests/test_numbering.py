from collections import Counter

from pyspark.sql import functions as F

from engram.operators import cloud, numbering


def test_numbers_equal_one_sort_a_key(spark):
    rows = [(k, (i * 7919) % 1013, f"x{i}") for i in range(700) for k in (["a"] if i % 10 else ["b", None])]
    got = numbering.numbered(spark.createDataFrame(rows, "k string, v long, x string"), ["k"], [F.col("v").desc(), F.col("x")], "n")
    want = {}
    for key in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r] = n
    assert got.columns == ["k", "v", "x", "n"] and {tuple(r)[:3]: r.n for r in got.collect()} == want
    assert numbering.numbered(spark.createDataFrame([], "k string, v long"), ["k"], [F.col("v")], "n").count() == 0


def test_a_project_of_a_million_changes_is_numbered_by_many_tasks(spark):
    """No task numbers more than its share, though one project has nearly all changes."""
    n = 1_000_000
    changes = spark.range(n).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("big").alias("project_id"), F.col("id").cast("string").alias("id"), ((F.col("id") * 7919) % 1_000_003).alias("ord"))
    current = spark.createDataFrame([("big", 41)], "project_id string, sync_version long")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = numbering.numbered(changes, ["project_id"], [F.col("ord"), F.col("id")], "number")
        plan = counted._jdf.queryExecution().executedPlan().toString()
        by_task = Counter({r.t: r["count"] for r in counted.groupBy(F.spark_partition_id().alias("t")).count().collect()})
        pushed = cloud.numbered(changes, current)
        ends = {r.project_id: (r.lo, r.hi, r.n, r.d) for r in pushed.groupBy("project_id").agg(F.min("sync_version").alias("lo"), F.max("sync_version").alias("hi"), F.count("*").alias("n"), F.countDistinct("sync_version").alias("d")).collect()}
        in_order = pushed.filter("project_id = 'big'").select("sync_version", "ord").orderBy("ord").limit(5).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sum(by_task.values()) == n and len(by_task) >= 3 and max(by_task.values()) <= 0.6 * n
    assert all("_number_range" in x for x in plan.split("\n") if "Window [row_number" in x)
    assert ends == {"big": (42, 41 + n - n // 1000, n - n // 1000, n - n // 1000), "small": (1, n // 1000, n // 1000, n // 1000)}
    assert [r.sync_version for r in in_order] == [42, 43, 44, 45, 46]

"""Recalled contexts at their limit (F2 of the fourth round)."""

from test_findings import agrees


def test_a_context_between_both_counts_of_its_head(spark, tmp_path):
    """One block that fits with the head's own 69 characters and doesn't with the 73 of the SQL."""
    from pyspark.sql import functions as F

    from engram.operators import search

    head = "- [preference] session:src1 (score 0.00)\n  markers: id: doc-1; source: hook; tags: en, src1; metadata: {}\n  "
    text = "zebra " * 700
    text = text[: 4000 - 69 - 1 - len(head) - 1] + "x"
    docs = spark.createDataFrame([(1, text, "en", "src1", len(text)), (2, "other words", "en", "src1", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    agrees(spark, tmp_path, "recall_contexts", {"documents": docs, "labels": labels, "benchmark": spark.createDataFrame([(7, "zebra")], "item_id long, text string")})

    r = docs.filter("doc_id = 1").select(F.lit("doc-1").alias("id"), F.lit("preference").alias("kind"), F.lit("session").alias("scope_type"), F.lit("src1").alias("scope_id"), F.lit("hook").alias("source"), F.array(F.lit("en"), F.lit("src1")).alias("tags"), F.lit("{}").alias("metadata"), F.col("text").alias("content"))
    hits = spark.createDataFrame([("7", 1, "doc-1", 0.5)], "query_id string, rank int, id string, score double")
    whole = search.recall_context(hits, r).first()
    assert (whole.blocks, len(whole.context)) == (1, 4000) and search.recall_context(hits, r, head_chars=73).first().blocks == 0

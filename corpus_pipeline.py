"""The corpus pipeline: five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of
documents (doc_id, text, lang, source, n_chars); the last returns the packed pieces. ``run`` writes every stage's
result as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common, compressclf, decontam, linedup, neardup, packing
from engram.llm.queries import tokenizer_path

#: SQL can't express the classifier's stage, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None
#: Similarity of word shingles from which documents are near copies.
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject.

    Null and empty texts are judged as empty ones, repeated rows alike; an empty table stays empty.
    """
    scored = compressclf.quality_scores(docs, common.table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows the text, and a document left without a word goes.

    Null, empty and short texts stay as they are; rows that share an id don't clean each other; an empty table stays empty.
    """
    cleaned = linedup.line_dedup(docs)
    changed = F.col("n_removed") > 0
    kept = cleaned.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows that share this id are one document and stay.

    Documents are linked from a similarity of 0.8 on. Null and empty texts have no links and stay; an empty table stays empty.
    """
    (key,) = common.fresh(docs, "kept_id")
    keep = neardup.near_duplicates(docs, percent=SIMILAR_PERCENT).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window.

    Null and empty texts have none and stay; with one row of an id all its rows go; an empty table stays empty.
    """
    found = decontam.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    (key,) = common.fresh(docs, "hit_id")
    hit = found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents in sequences of 2048; null and empty texts are their end token; an empty table has no pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; the last stage's rows."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs

"""Models as plug-ins: embeddings, rerankers and language models as callables over batches of texts.

They run in Arrow batches and belong behind a cut (a top-k, a due scope), never over a whole table. A failing
call gives null for its batch, so what stands behind it falls back to its plain form, and says in ``error`` what it was; ``failures``
counts them. Errors of the engine itself surface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.search import hash_vector, words


def hash_embedding(texts: list[str], dims: int = 128) -> list[list[float]]:
    """The built-in embedding: signed token hashes, scaled to length 1. Needs no network."""
    out = []
    for t in texts:
        v = hash_vector(words(t), dims)
        n = float((v @ v) ** 0.5)
        out.append((v / n if n else v).tolist())
    return out


def _mapped(df: DataFrame, columns: list[str], name: str, kind: str, arrow: pa.DataType, call: Callable) -> DataFrame:
    df = df.drop("error")
    names = [*df.columns, name, "error"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} {kind}, error string"
    at = [df.columns.index(c) for c in columns]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            error = None
            try:
                values = call(*[[x or "" for x in b.column(i).to_pylist()] for i in at])
            except Exception as e:  # the model's failure, not ours
                values, error = [None] * b.num_rows, f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow), pa.array([error] * b.num_rows, pa.string())], names)

    return df.mapInArrow(run, types)


def failures(called: DataFrame) -> DataFrame:
    """How many rows of a plug-in's result failed, by error: error, n."""
    return called.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def embedded(df: DataFrame, text_col: str = "text", call: Callable[[list[str]], list[list[float]]] = hash_embedding, fallback: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``df`` plus ``vector`` and ``error``; where the call fails, the vector of ``fallback``, if there is one (its vectors must have the same length to be compared)."""

    def either(texts: list[str]) -> list[list[float]]:
        try:
            return call(texts)
        except Exception:
            if fallback is None:
                raise
            return fallback(texts)

    return _mapped(df, [text_col], "vector", "array<double>", pa.list_(pa.float64()), either)


def reranker_scores(pairs: DataFrame, call: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """(query_id, id, rerank) of pairs with query and document texts; blank documents are not asked for."""
    asked = pairs.filter(F.trim("document") != "")
    return _mapped(asked, ["query", "document"], "rerank", "double", pa.float64(), call).select("query_id", "id", "rerank")


def answered(prompts: DataFrame, call: Callable[[list[str]], list[str]], fallback_col: str, prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` plus ``answer``: the model's, or the fallback column where it gave none."""
    out = _mapped(prompts, [prompt_col], "answer", "string", pa.string(), call)
    return out.withColumn("answer", F.coalesce(F.when(F.trim("answer") != "", F.col("answer")), F.col(fallback_col)))

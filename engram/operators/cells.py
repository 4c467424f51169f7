"""A store of vectors in cells: near vectors lie together, so a search reads few of them.

Cells are fitted by k-means on a bounded sample; every vector lies in the cell of its nearest centre, with its distance to it. The exact search skips a cell only
where the triangle inequality rules out that it holds a hit; the fast one reads the nearest cells alone. Vectors are scaled to length 1, for which the
order by cosine is that by distance. Queries go to the tasks in blocks; a cell is a folder of the written store, so unread cells aren't opened, and a cell of many
vectors is read by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import search, storage

#: Vectors that cells are fitted on, and steps of the fit.
SAMPLE, STEPS = 20_000, 12
#: What a bound must fall short of a score for a cell to be skipped: scores are compared to nine digits.
MARGIN = 1e-8


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zeros stay."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From each row of ``a`` to each of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE, steps: int = STEPS) -> np.ndarray:
    """Centres of at most ``cells`` cells, from the ``sample`` vectors (id, vector) whose ids hash lowest: the same for the same vectors. Without vectors one
    centre of no numbers."""
    drawn = vectors.filter("vector is not null").select(F.col("id").cast("string").alias("id"), "vector").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = [r.vector for r in drawn.collect() if r.vector]  # ``sample`` rows at most
    rows = [r for r in rows if len(r) == len(rows[0])]
    if not rows:
        return np.zeros((1, 0))
    x = np.unique(unit(np.array(rows, float)), axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(steps):
        near = distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Vectors (id, vector, ...) with ``cell``, ``away`` (their distance to its centre), and the vector at length 1; null ones and those of another length have no place."""
    kept = [c for c in vectors.columns if c not in ("id", "vector", "cell", "away")]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names = ["id", "vector", "cell", "away", *kept]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            lists = b.column(1).to_pylist()
            ok = [i for i, v in enumerate(lists) if v is not None and len(v) == c.shape[1]]
            if ok:
                v = unit(np.array([lists[i] for i in ok], float).reshape(len(ok), c.shape[1]))
                d = distances(v, c)
                near = d.argmin(1)
                rest = b.take(pa.array(ok))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1) * c.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([rest.column(0), flat, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(ok)), near]), *rest.columns[2:]], names)

    kinds = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept)
    return vectors.select(F.col("id").cast("string").alias("id"), "vector", *kept).mapInArrow(place, "id string, vector array<double>, cell int, away double" + kinds)


class Store:
    """Vectors by cell, written to the folder that driver and executors share. A change writes the store anew and leaves the old one as it was."""

    def __init__(self, rows: DataFrame, centres: np.ndarray):
        spark = rows.sparkSession
        self.centres = centres
        self.path = f"{storage.shared_dir(spark)}/engram-cells-{uuid.uuid4().hex}"
        rows.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(self.path)  # a cell of many vectors is split over tasks, small ones share one
        self.rows = spark.read.schema(rows.schema).parquet(self.path)
        stats = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # a row a cell
        self.sizes = {r.cell: r.n for r in stats}
        self.radius = np.full(len(centres), -np.inf)
        for r in stats:
            self.radius[r.cell] = r.radius

    def count(self) -> int:
        return sum(self.sizes.values())

    def upserted(self, vectors: DataFrame) -> Store:
        """With these vectors (id, vector, ...; an id once) new or in the place of those of the same id."""
        return Store(self.rows.join(vectors.select(F.col("id").cast("string").alias("id")), "id", "left_anti").unionByName(assigned(vectors, self.centres)), self.centres)

    def deleted(self, ids: DataFrame) -> Store:
        return Store(self.rows.join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_anti"), self.centres)

    def search(self, queries: DataFrame, most: int = 10, least: float = 0.0, probes: int = 4, exact: bool = True) -> DataFrame:
        """Best vectors of each query (query_id, vector; with ``scope_key`` among rows of that scope only): query_id, rank, id, score, cosine clamped to 0..1.

        ``exact`` gives what a scan of all vectors gives: after the ``probes`` nearest cells each query reads those whose bound reaches its worst hit so far.
        Otherwise the nearest cells are all that is read.
        """
        scoped = "scope_key" in queries.columns
        q = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector", *(["scope_key"] if scoped else []))
        found, rows = [], []
        for r in q.orderBy("query_id").toLocalIterator():
            rows.append(tuple(r))
            if len(rows) == search.BLOCK:
                found += self._block(rows, scoped, most, least, probes, exact)
                rows = []
        if rows or not found:
            found += self._block(rows, scoped, most, least, probes, exact)
        w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
        return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "id", "score")

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """Which cells (columns) each query (row) reads first: the nearest that hold vectors."""
        d = np.where(np.isfinite(self.radius), distances(vectors, self.centres), np.inf)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argsort(d, 1, kind="stable")[:, :probes], True, 1)
        return out & np.isfinite(d)

    def reaching(self, vectors: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Which cells may hold a score as good as each query's worst hit; all where that is 0, as all scores below are 0 too."""
        bound = 1 - np.maximum(distances(vectors, self.centres) - self.radius, 0) ** 2 / 2
        return ((bound >= worst[:, None] - MARGIN) | (worst[:, None] <= MARGIN)) & np.isfinite(self.radius)

    def _block(self, rows: list[tuple], scoped: bool, most: int, least: float, probes: int, exact: bool) -> list[DataFrame]:
        ids = [r[0] for r in rows]
        vectors = unit(np.array([r[1] for r in rows], float).reshape(len(rows), self.centres.shape[1]))
        scopes = [r[2] for r in rows] if scoped else None
        first = self.probed(vectors, probes)
        hits = self._read(ids, vectors, scopes, first, most, least)
        if not exact or not ids:
            return [hits]
        hits = storage.written(hits, "hits")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        last = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") == most).select("query_id", "score").collect()  # a row a query of the block
        worst = np.full(len(ids), least)
        for r in last:
            worst[ids.index(r.query_id)] = max(least, r.score)
        more = self.reaching(vectors, worst) & ~first
        return [hits, self._read(ids, vectors, scopes, more, most, least)] if more.any() else [hits]

    def _read(self, ids: list[str], vectors: np.ndarray, scopes: list[str] | None, reads: np.ndarray, most: int, least: float) -> DataFrame:
        shared = self.rows.sparkSession.sparkContext.broadcast((ids, vectors, reads, scopes))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m, asked, within = shared.value
            best = search._Best(names, most)
            within = None if within is None else np.array(within, object)
            for b in (whole.slice(lo, search.SLICE) for whole in batches for lo in range(0, whole.num_rows, search.SLICE)):
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m.shape[1])
                s = np.clip(v @ m.T, 0, 1)
                ok = asked[:, b.column(2).to_numpy()].T & (s >= least)
                if within is not None:
                    ok &= np.array(b.column(3).to_pylist(), object)[:, None] == within
                best.add(np.where(ok, s, -np.inf), b.column(0).to_pylist(), None, lambda i, q: ())
            yield best.batch(["query_id", "id", "score"])

        cells = np.flatnonzero(reads.any(0)).tolist()
        columns = ["id", "vector", "cell", *(["scope_key"] if scopes is not None else [])]
        return self.rows.filter(F.col("cell").isin(cells)).select(*columns).mapInArrow(score, "query_id string, id string, score double")


def store(vectors: DataFrame, cells: int = 64, sample: int = SAMPLE) -> Store:
    """A store of vectors (id, vector, and columns to keep, as ``scope_key``), in cells fitted on at most ``sample`` of them."""
    centres = fit(vectors, cells, sample)
    return Store(assigned(vectors, centres), centres)


def scoped_hits(of: Store, queries: DataFrame, scopes: DataFrame, records: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """Records of the best vectors of each query (query_id, vector) in its scopes (query_id, scope_key): query_id, rank, id, score.

    Each scope gives ``2 * limit`` hits, a record counts once with its best score, and vectors of records that are gone or lie in another scope by now give none.
    """
    each = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").join(scopes.select(F.col("query_id").cast("string").alias("query_id"), "scope_key").distinct(), "query_id")
    named = each.select(F.to_json(F.struct("query_id", "scope_key")).alias("query_id"), "vector", "scope_key")
    hits = of.search(named, 2 * limit, least).withColumn("asked", F.from_json("query_id", "query_id string, scope_key string")).select("asked.query_id", "asked.scope_key", "id", "score")
    there = hits.join(records.select("id", "scope_key"), ["id", "scope_key"], "left_semi")
    return search.merged_scopes(there.select("query_id", "id", "score"), limit).select("query_id", "rank", "id", "score")

"""Vectors in cells: the exact search equals a scan, the fast one finds most of it, and changes touch their vectors only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import cells, search, storage


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors around twelve directions, the first of which has a third of all; among them copies, zeros, a null and one of another length."""
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(12, 16))
    of = np.where(draw.random(1500) < 0.3, 0, draw.integers(0, 12, 1500))
    v = (middle[of] + 0.45 * draw.normal(size=(1500, 16))).tolist()
    v[7], v[8], v[1400] = v[6], v[6], [0.0] * 16
    data = [(str(i), x, "even" if i % 2 == 0 else "odd") for i, x in enumerate(v)] + [("none", None, "odd"), ("short", [1.0], "odd")]
    return storage.written(spark.createDataFrame(data, "id string, vector array<double>, scope_key string"), "vectors")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.filter("try_cast(id as int) % 50 = 0 or id = '6'").select(F.col("id").alias("query_id"), "vector")


def shown(hits):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in hits.collect())


@pytest.mark.parametrize("probes", [1, 3, 50])
def test_exact_equals_a_scan(vectors, queries, probes):
    held = cells.store(vectors, 24)
    assert held.count() == 1500
    for most, least in ((10, 0.0), (3, 0.6)):
        assert shown(held.search(queries, most, least, probes)) == shown(search.vector_search(vectors.filter("size(vector) = 16"), queries, most, least))


def test_few_cells_are_read_and_recall_is_high(vectors, queries):
    held = cells.store(vectors, 24)
    wanted = {(q, i) for q, _, i, _ in shown(search.vector_search(vectors.filter("size(vector) = 16"), queries, 10))}
    found = {(q, i) for q, _, i, _ in shown(held.search(queries, 10, probes=5, exact=False))}
    assert len(found & wanted) / len(wanted) >= 0.9
    v = cells.unit(np.array([r.vector for r in queries.filter("query_id <> '1400'").collect()]))
    assert held.probed(v, 5).sum(1).max() == 5
    best = search.vector_search(vectors.filter("size(vector) = 16"), queries.filter("query_id <> '1400'"), 10).filter("rank = 10").orderBy("query_id")
    v = cells.unit(np.array([r.vector for r in queries.filter("query_id <> '1400'").orderBy("query_id").collect()]))
    reached = held.reaching(v, np.array([r.score for r in best.collect()]))
    assert reached.mean() < 0.7  # the bound rules cells out


def test_changes(spark, vectors, queries):
    held = cells.store(vectors, 8)
    fresh = spark.createDataFrame([("3", [1.0] + [0.0] * 15, "odd"), ("new", [2.0] + [0.0] * 15, "odd"), ("bad", None, "odd")], "id string, vector array<double>, scope_key string")
    after = held.upserted(fresh)
    asked = spark.createDataFrame([("q", [1.0] + [0.0] * 15)], "query_id string, vector array<double>")
    assert after.count() == 1501 and held.count() == 1500
    assert [r.id for r in after.search(asked, 2).orderBy("rank").collect()] == ["3", "new"]
    gone = after.deleted(spark.createDataFrame([("3",), ("new",), ("unknown",)], "id string"))
    assert gone.count() == 1499
    rest = vectors.filter("size(vector) = 16 and id <> '3'")
    assert shown(gone.search(asked, 5)) == shown(search.vector_search(rest, asked, 5))


def test_scopes_and_records(spark, vectors, queries):
    held = cells.store(vectors, 24)
    records = vectors.select("id", F.when(F.col("id").cast("int") % 7 == 0, "moved").otherwise(F.col("scope_key")).alias("scope_key")).filter("try_cast(id as int) % 5 <> 0")
    asked = queries.select("query_id", F.explode(F.array(F.lit("even"), F.lit("odd"), F.lit("nowhere"))).alias("scope_key"))
    got = shown(cells.scoped_hits(held, queries, asked, records, 4))
    kept = {(r.id, r.scope_key) for r in records.collect()}
    want = []
    for q in {r.query_id for r in queries.collect()}:
        both = []
        for s in ("even", "odd"):
            hits = search.vector_search(vectors.filter(f"size(vector) = 16 and scope_key = '{s}'"), queries.filter(F.col("query_id") == q), 8)
            both += [(-round(r.score, 9), r.id, r.score) for r in hits.collect() if (r.id, s) in kept]
        want += [(q, n, i, round(x, 8)) for n, (_, i, x) in enumerate(sorted(both)[:4], 1)]
        if len(want) > 40:
            break
    chosen = {w[0] for w in want}
    assert sorted(want) == [g for g in got if g[0] in chosen]


def test_nothing(spark):
    none = spark.createDataFrame([], "id string, vector array<double>")
    asked = spark.createDataFrame([], "query_id string, vector array<double>")
    held = cells.store(none)
    assert held.count() == 0 and held.search(asked).count() == 0
    assert cells.store(spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")).search(asked).count() == 0

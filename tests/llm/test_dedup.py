import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import linedup, neardup, suffix
from engram.llm.components import components
from engram.llm.shingles import shingle_set
from tests_llm_data import prose


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# -- line dedup


def brute_lines(rows):
    first = {}
    order = sorted(((1 << 63) - 1 if d is None else d, d, t) for d, t in rows)
    for o, _, t in order:
        lines = t.split("\n") if t else []
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" \t\n\r\v\f") for x in w):
                first.setdefault(w, o)
    out = []
    for o, d, t in order:
        lines = t.split("\n") if t else []
        gone, seen = set(), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in first and (first[w] < o or w in seen):
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t))
    return sorted(out, key=str)


def test_line_dedup(docs, none):
    got = linedup.line_dedup(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in got.collect()), key=str) == brute_lines(rows_of(docs))
    assert {"extra", "Score", "source"} <= set(got.columns)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == kept[r.doc_id] for r in got.collect() if r.n_removed == 0)
    assert linedup.line_dedup(none).count() == 0


def test_line_dedup_of_text_ids(spark):
    lines = "\n".join(f"line number {i}" for i in range(5))
    rows = [("b", lines), ("a", lines + "\nmore"), (None, lines), ("a10", "x\n" + lines)]
    got = linedup.line_dedup(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {"a": 0, "a10": 5, "b": 5, None: 5}


# -- substring dedup


def brute_spans(rows, w=200):
    count = defaultdict(int)
    texts = [(d, t.encode()) for d, t in rows]
    for _, t in texts:
        for i in range(len(t) - w + 1):
            count[t[i : i + w]] += 1
    out = []
    for d, t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                hit[i] += 1
                hit[i + w] -= 1 if i + w < len(hit) else 0
        cover = np.cumsum(hit)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        out.append((d, len(t), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def spans(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_spans(docs).collect()), key=str)


def test_substrings(docs, none):
    assert spans(docs) == brute_spans(rows_of(docs))
    assert suffix.repeated_spans(none).count() == 0


def test_many_different_fragments_of_one_anchor(spark, monkeypatch):
    passage = prose(5, 60)
    data = [(i, prose(500 + i, 8) + passage[: 190 + i % 40] + prose(700 + i, 8)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole = brute_spans(data)
    for many, very in ((4096, 50_000), (5, 50_000), (3, 6)):
        monkeypatch.setattr(suffix, "MANY", many)
        monkeypatch.setattr(suffix, "VERY_MANY", very)
        assert spans(df) == whole


@pytest.mark.parametrize("length,copies", [(30_000, 1), (300, 1000)])
def test_very_many_places_of_one_anchor(spark, monkeypatch, length, copies):
    monkeypatch.setattr(suffix, "VERY_MANY", 1500)
    char = min("-=*#~.:_ 0", key=lambda c: suffix.fragments(c.encode() * 200)[3][0])  # its gram has the least hash, so it anchors what is around a run
    edges = [prose(800 + i, 40)[:30] + char * 300 for i in range(12)]  # shared, within fragments that differ
    source = "".join(prose(900 + i, 60) + e for i, e in enumerate(edges)) + char * length
    least = spark.range(1000, 1400).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(source))).first().id  # it sorts before the others
    data = [(i, prose(950 + i, 60) + e) for i, e in enumerate(edges)] + [(least, source)] * copies
    got = spans(spark.createDataFrame(data, "doc_id long, text string"))
    assert len(got) == len(data) and set(got) == set(brute_spans(data[:14]))  # two copies stand for all


def test_a_large_route_keeps_all_its_kinds(monkeypatch):
    """Two windows in one route, the second in the first and in the last row of many."""
    monkeypatch.setattr(suffix, "VERY_MANY", 3000)
    a, b = prose(60, 60)[:200].encode(), prose(61, 60)[:200].encode()
    n = 13_002
    texts = [b, *[a] * (n - 2), b]
    cols = {"route": np.zeros(n, np.int64), "k": np.arange(n), "k2": np.arange(n), "first": np.zeros(n, np.int64), "off": np.full(n, 70, np.int32), "count": np.ones(n, np.int32)}
    t = pa.table({**cols, "bytes": pa.array(texts, pa.binary())})
    found = {k for batch in suffix.search_routes(iter(t.to_batches(max_chunksize=1000)), 200) for k in batch.column(0).to_pylist()}
    assert {0, n - 1} <= found and len(found) > 2


def test_a_collision_is_no_equality(monkeypatch):
    """With a hash that calls all parts equal, what differs is still told apart by its bytes."""
    monkeypatch.setattr(suffix.Hashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    texts = [prose(70 + i, 60)[:200].encode() for i in range(4)]
    f, _, _ = suffix.repeated_windows(texts, np.zeros(4, np.int64), np.full(4, 70), np.ones(4, np.int64))
    assert not len(f)


def test_suffix_sort_and_collisions(monkeypatch):
    rnd = np.random.default_rng(1)
    text = bytes(rnd.integers(97, 99, 4000, dtype=np.uint8))
    h = suffix.Hashes(text)
    start = rnd.integers(0, 3900, 300)
    segment = np.sort(rnd.integers(0, 20, 300))
    order = suffix.merge_sort(h, start, segment, 50)
    assert (segment[order] == segment).all()
    cut = [(s, text[p : p + 50]) for s, p in zip(segment, start[order])]
    assert cut == sorted(cut)
    same = np.ones(5, bool)
    same[0] = False
    assert suffix.verified(h, np.array([0, 0, 7, 7, 9]), same, 40).tolist()[1] is True


def test_long_texts_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    data = [(1, prose(1, 900)), (2, prose(2, 50) + prose(1, 900)[300:2900] + prose(3, 50))]
    parts = [suffix.fragments(t.encode()) for _, t in data]
    assert all((p[1] > 0).all() and p[1].sum() == len(t) - 199 for p, (_, t) in zip(parts, data))


# -- near duplicates


def brute_components(rows, percent=85):
    sets = defaultdict(list)
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d].append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d][0]), root(d)) for d in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, none, percent):
    got = neardup.near_duplicates(docs, percent=percent).collect()
    assert len(got) == docs.count()
    expected = brute_components(rows_of(docs), percent)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(none, percent=percent).count() == 0


def test_the_radius_follows_the_similarity():
    rnd = np.random.default_rng(5)
    assert [neardup.radius_of(p) for p in (100, 85, 80)] == [0, 20, 24]
    for percent in (80, 85):
        beyond = sum(int(rnd.binomial(neardup.HASHES, 1 - percent / 100) > neardup.radius_of(percent)) for _ in range(20_000))
        assert beyond <= 40


def test_every_pair_of_different_components_meets(spark, monkeypatch):
    """Pieces of a bucket with one large and many small components hold all pairs that can matter, and no piece is large."""
    monkeypatch.setattr(neardup, "BLOCK", 10)
    comp = [0] * 60 + [*range(60, 90)]
    rows = spark.createDataFrame([(5, i, c, 90, 0, 30, 1, bytearray(b"x")) for i, c in enumerate(comp)], "key long, node long, comp long, c long, main long, rest long, n long, sig binary")
    pieces = defaultdict(list)
    for r in neardup.whole_buckets(rows).collect():
        pieces[r.i, r.j].append((r.node, r.own))
    met = {tuple(sorted((a, b))) for (i, j), rs in pieces.items() for a, x in rs for b, y in rs if a != b and (i == j or x != y)}
    assert {(a, b) for a in range(90) for b in range(a + 1, 90) if comp[a] != comp[b]} <= met
    assert sum(map(len, pieces.values())) < 90 * 12 and max(map(len, pieces.values())) <= 60


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    base = prose(42, 150).split(" ")
    rnd = np.random.default_rng(3)
    data = []
    for i in range(120):
        words = [*base]
        for k in rnd.integers(0, len(words), i % 7):
            words[k] = f"edit{i}x{k}"
        data.append((1000 - i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute_components(data)


def test_pigeonhole_finds_every_pair_within_the_radius():
    rnd = np.random.default_rng(7)
    for hashes, radius, chunks in ((24, 7, 5), (neardup.HASHES, 24, neardup.CHUNKS), (neardup.HASHES, 20, neardup.CHUNKS)):
        plan = neardup.chunk_plan(hashes, radius, chunks)
        for _ in range(2000):
            wrong = set(rnd.choice(hashes, rnd.integers(0, radius + 1), replace=False).tolist())
            assert any(not wrong & set(k) for k in plan)


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(9)
    pool = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for n in (5, 50, 500):
        a, b = (np.unique(rnd.choice(pool, n)) for _ in range(2))
        x, y = (np.frombuffer(neardup.parities(s), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_short_texts_are_one_shingle():
    assert len(shingle_set(b"a b c")) == 1 and len(shingle_set(b" ")) == 0 and len(shingle_set(b"A b c d e f")) == 2
    assert (shingle_set(b"A B c") == shingle_set(b"a b  C\n")).all() and shingle_set(b"a b")[0] != shingle_set(b"a b c")[0]

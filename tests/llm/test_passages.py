"""Repeated passages against a version that compares all windows."""

import random

import numpy as np
import pytest

from engram.llm import passages
from tests_llm_data import prose


def brute(rows, window):
    """rows: (order, id, text). First owner of each window, then what later documents lose."""
    owner = {}
    for o, _, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            owner[k] = min(owner.get(k, o), o)
    out = []
    for o, d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < o:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), None if t is None else b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def ordered(docs):
    return [((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.doc_id, r.text) for r in docs.collect()]


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize(("window", "anchor"), [(50, 12), (7, 3), (20, 20), (2, 1)])
def test_repeated_passages(docs, none, window, anchor):
    got = passages.repeated_passages(docs, window, anchor)
    want = brute(ordered(docs), window)
    assert found(got) == want and sum(x[2] for x in want) > 500
    assert {"extra", "Score", "source", "n_lines"} <= set(got.columns) and got.columns[-3:] == ["n_words", "n_removed", "spans"]
    for r in got.collect():
        assert r.n_removed == sum(s.end - s.begin for s in r.spans)
    assert passages.repeated_passages(none, window, anchor).count() == 0


@pytest.fixture(scope="module")
def tangled(spark):
    """Near copies of one text, a passage in many surroundings, periodic texts, copies whose smallest owner lacks a part, and a phrase of fewer
    words than a window before everything."""
    rnd = random.Random(3)
    base = prose(1, 400).split()
    rows = []
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(99)}"
        a, z = sorted(rnd.sample(range(len(w)), 2))
        rows.append(" ".join(w if rnd.random() < 0.5 else w[a:z]))
    shared, short = prose(2, 66), prose(3, 30)
    rows += [prose(100 + i, 20 + i) + shared + prose(200 + i, 25) for i in range(40)]
    rows += [short + prose(300 + i // 2, 90) for i in range(30)]
    rows += ["a b c " * n for n in (16, 17, 20, 400)] + ["a " * 300 + "b " * 300, "b " * 100 + "a " * 100, "x\x1cy\x85 " * 80, "x\x1cy\x85 " * 60]
    rnd.shuffle(rows)
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string").repartition(6)


@pytest.mark.parametrize("small", [False, True])
def test_passages_of_tangled_documents(tangled, monkeypatch, small):
    if small:  # many shards, many copies of an owner's passages, anchors chosen in small stretches
        for name, size in (("PARTS", 3), ("SHARD_BYTES", 500), ("CHUNK_BITS", 7)):
            monkeypatch.setattr(passages, name, size)
    got = passages.repeated_passages(tangled)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    assert found(got) == brute(ordered(tangled), 50)


def test_passages_of_text_ids(spark):
    text = prose(8, 80)
    rows = [("b", text), ("a", text + " more"), (None, text), ("a10", "x " + text), ("a", text), ("c", "short text"), ("", prose(9, 60))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string"))
    order = [("1" if d is None else "0" + d, d, t) for d, t in rows]
    assert found(got) == brute(order, 50)
    assert {(r.doc_id, r.n_removed) for r in got.collect()} == {("b", 80), ("a", 0), (None, 80), ("a10", 80), ("c", 0), ("", 0)}


def test_extent_of_equal_words():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.choice(b"ab") for _ in range(rnd.randint(8, 60))]
        i, j = rnd.randrange(len(a) - 4), rnd.randrange(6)
        b = [rnd.choice(b"ab") for _ in range(j)] + a[i : i + rnd.randint(4, 40)]
        got = passages._extended(a, i, b, j, 4)
        lo, hi = 0, 4
        while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1]:
            lo += 1
        while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
            hi += 1
        assert got == (i - lo, i + hi)


def test_least_places(monkeypatch):
    rnd = np.random.default_rng(2)
    for bits in (6, 20):
        monkeypatch.setattr(passages, "CHUNK_BITS", bits)
        for width in (1, 2, 5, 39):
            v = rnd.integers(0, 50, 300, np.uint64) << np.uint64(40)
            want = [max(i for i in range(s, s + width) if v[i] == v[s : s + width].min()) for s in range(len(v) - width + 1)]
            assert passages.least_places(v, width).tolist() == want

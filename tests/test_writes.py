"""Writes of large groups (F1 and F3 to F6 of the fourth round): the same as all against all, with few pairs counted and links made once."""

import random
from datetime import datetime

import numpy as np
import pytest

from engram.operators import remember, search
from engram.operators.groups import groups

ODD = ["", " ", "a b", "İstanbul ist NAÏVE café x² 1 22", "我是 a bb 工程师 c", "x" * 60 + " yy " + "Ä" * 49, "emoji 😀 𝒜𝒜 ab", "русский текст а бб", "é é combine", "tab\tnew\nline ʼn ß ẞ"]


def texts(n: int, seed: int) -> list[str]:
    """Texts of three to 200 words, from few and many, some of them copies, shortened or near."""
    draw, out = random.Random(seed), [*ODD]
    while len(out) < n:
        kind = draw.randrange(4)
        if kind < 2 or len(out) < 20:
            out.append(" ".join(draw.choice((f"rare{draw.randrange(4000)}", f"word{draw.randrange(30)}")) for _ in range(draw.choice((3, 12, 60, 200)))))
        else:
            old = draw.choice(out)
            out.append(old if kind == 2 else " ".join(w for w in old.split() if draw.random() > draw.choice((0.02, 0.1, 0.3))))
    return out


def scores(a: list[str], b: list[str]) -> np.ndarray:
    """Similarities of all pairs, one by one."""
    one = lambda t: ({*search.words(t)}, search.hash_vector(search.words(t)))
    theirs, out = [one(t) for t in b], np.zeros((len(a), len(b)))
    for i, (t, v) in enumerate(map(one, a)):
        for j, (u, w) in enumerate(theirs):
            length = np.sqrt(v @ v) * np.sqrt(w @ w)
            out[i, j] = 0.5 * (len(t & u) / len(t) if t else 0) + 0.5 * min(max(((v @ w / length if length else 0) + 1) / 2, 0), 1)
    return out


def met(a: list[str], b: list[str], cut: float, keep: str, whole=()) -> list[tuple]:
    m = remember.Meeting(cut, keep)
    m.a.add([(i, i in whole) for i in range(len(a))], a)
    m.b.add([(str(j), j % 7) for j in range(len(b))], b)
    return [(r["ord"], int(r["id"]), r["similarity"]) for x in m.pairs() for r in x.to_pylist()]


def test_token_sets_equal_those_of_the_index():
    given = texts(200, 1)
    sets, vectors = remember.token_sets(given)
    for t, ids, v in zip(given, sets, vectors):
        old, w, _ = search._indexed(t)
        assert len(ids) == len(old) and (ids[1:] > ids[:-1]).all() and (v == w).all()
    held = [*zip(given, sets)]
    for (t, x), (u, y) in zip(held[:100], held[100:]):
        assert len(np.intersect1d(x, y)) == len({*search.words(t)} & {*search.words(u)})


@pytest.mark.parametrize("way", ["listed", "read", "bits"])
@pytest.mark.parametrize("cut", [0.595, 0.7])
def test_blocks_equal_all_pairs(monkeypatch, cut, way):
    """Each way to count, and slices that don't come out even."""
    monkeypatch.setattr(remember, "SLICE_ROWS", 37)
    monkeypatch.setattr(remember, "COUNTED", 500)
    monkeypatch.setattr(remember, "LISTED", 0 if way == "listed" else 1 << 40)
    if way == "bits":
        monkeypatch.setattr(remember, "BITS", 64)
    a, b = texts(150, 2), texts(160, 3) + texts(150, 2)[60:90]
    s = scores(a, b)
    want = {(i, j): s[i, j] for i, j in zip(*np.nonzero(s >= cut - 1e-12))}
    got = met(a, b, cut, "all")
    assert len(got) == len(want) and all(abs(want[i, j] - x) < 1e-12 for i, j, x in got)

    best, some = met(a, b, cut, "best", whole={30, 40}), {i for i, _ in want}
    rank = lambda i, j: (-round(s[i, j], 12), j % 7, str(j))
    assert {(i, j) for i, j, _ in best if i not in (30, 40)} == {(i, min((j for k, j in want if k == i), key=lambda j: rank(i, j))) for i in some - {30, 40}}
    assert {(i, j) for i, j, _ in best if i in (30, 40)} == {(i, j) for i, j in want if i in (30, 40)}

    def parts(links):
        root = {}
        top = lambda k: k if root.setdefault(k, k) == k else top(root[k])
        for i, j in links:
            root[top(("a", i))] = top(("b", j))
        found = {}
        for k in [*root]:
            found.setdefault(top(k), set()).add(k)
        return {frozenset(x) for x in found.values()}

    links = met(a, b, cut, "links")
    assert all((i, j) in want for i, j, _ in links) and parts((i, j) for i, j, _ in links) == parts(want) and len(links) < len(a) + len(b)


def test_few_pairs_are_counted(monkeypatch):
    """Of 360,000 pairs of long texts in which each input has its own record, most are left out by what bounds them."""
    draw, seen, whole = random.Random(4), [], remember.Meeting.counted
    monkeypatch.setattr(remember.Meeting, "counted", lambda self, at, i, r, *x: (seen.append(len(i)), whole(self, at, i, r, *x))[1])
    b = [" ".join([f"common{k}" for k in range(10)] + [f"word{draw.randrange(3000)}" for _ in range(60)]) for _ in range(600)]
    got = met(["now " + t for t in b], b, 0.7, "best")
    assert [(i, j) for i, j, _ in sorted(got)] == [(i, i) for i in range(600)] and sum(seen) < 360_000 // 50


@pytest.mark.parametrize("mode", remember.MODES)
def test_a_fold_finds_what_a_scan_finds(mode):
    class Scan(remember.Fold):
        def candidates(self, r, every=True, made=None):
            same = [k for k, x in enumerate(self.rows) if (x["scope_key"], x["kind"]) == (r["scope_key"], r["kind"])]
            s = scores([self.text(r)], [self.text(self.rows[k]) for k in same])[0]
            return sorted(((x, k) for x, k in zip(s.tolist(), same) if x >= self.cut - 1e-12), key=lambda x: (-round(x[0], 12), x[1]))

    front = "---\nname: weekly report\nkind: summary of the work that was done by everyone in this long week\n---\n"
    given = [t for t in texts(120, 5) if t.strip()] + [front + "alpha beta gamma", front + "alpha delta"]
    row = lambda t, n: {"id": str(n), "scope_type": "user", "scope_id": "u1", "scope_key": "user:u1", "kind": ("note", "fact")[n % 2], "content": t, "summary": None, "confidence": 0.7, "importance": 0.5, "source": "manual", "tags": ["x"], "metadata": None, "created_at": None, "updated_at": None}
    folds = [kind(mode, 0.85, 80, datetime(2025, 1, 1)) for kind in (remember.Fold, Scan)]
    for f in folds:
        for n, t in enumerate(given[::2]):
            f.put(row(t, n))
        for n, t in enumerate([*given, *("now " + t for t in given)]):
            f.write(row(t, n))
    assert folds[0].rows == folds[1].rows and len(folds[0].rows) < len(given) * 3


def test_links_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "u string, v string").mapInArrow(count, "u string, v string")
    assert {(r.node, r.group) for r in groups(links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert made.value == 4


@pytest.mark.parametrize("mode", remember.MODES)
def test_a_group_in_many_blocks_is_decided_as_in_one(spark, monkeypatch, mode):
    from test_memory import inputs, now, rows

    draw = random.Random(6)
    said = [" ".join(draw.choice((f"rare{draw.randrange(100)}", f"word{draw.randrange(8)}")) for _ in range(12)) for _ in range(40)]
    r, i = rows(spark, *[{"content": t} for t in said]), inputs(spark, *[{"content": t if n % 2 else t.rsplit(" ", 3)[0]} for n, t in enumerate(said)])
    found = []
    for most in (1000, 11):
        monkeypatch.setattr(remember, "BLOCK_ROWS", most)
        decided = sorted((x.ord, x.action, x.target, x.similarity and round(x.similarity, 9)) for x in remember.decisions(i, r, mode).collect())
        written = sorted((x.content, x.importance, tuple(x.tags)) for x in remember.remember(i, r, now(), mode).select("content", "importance", "tags").collect())
        found.append((decided, written))
    assert found[0] == found[1] and {a for _, a, _, _ in found[0][0]} != {"add"}

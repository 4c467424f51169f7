"""Phrase collocations and source divergence against step-by-step versions."""

import random
from collections import Counter, defaultdict

import pytest

from engram.llm import collocations, divergence
from tests_llm_data import ODD, prose

SCHEMA = "doc_id long, text string, lang string, source string, n string, rank string, score string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    odd = [*ODD, "a\x01b a\x01b a a\x01 b\x00 a b", "A b. a B; a\tb!a b?\r\nÀ b: À b", "x\x08y " * 12 + "\n" + "x x\x08y " * 11 + "x\x08y", "same same same. " * 40, "Is Onhe. " * 60]
    words = ["the", "The", "of", "in", "a", "é", "Éa", "b\x02", "x-1", "naïve", "漢字", "😀", "don't"]
    loose = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rnd.randint(0, 120))) for _ in range(120)]
    texts = odd + loose + [prose(i, 80, 40) for i in range(40)] + [prose(1, 80, 40)] * 3
    rows = [(i, t, rnd.choice(["en", "de", None, ""]) if i % 3 else "en", rnd.choice(["s1", "s2", "S2", None, "", "é"]) if i % 4 else "hot", "n", "r", "s") for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id of this row", "xx", "alone", None, None, None), (None, None, "yy", None, None, None, None), (None, None, "yy", "other", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# -- collocations


def brute_collocations(rows, max_n=3, least=10, top=2000):
    f, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        piece = lowered(text)
        for c in ",;:!?\n\v\f\r":
            piece = piece.replace(c, ".")
        for p in piece.split("."):
            w = [x for x in p.replace("\t", " ").split(" ") if x]
            words[lang] += len(w)
            for n in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    long = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    worst = defaultdict(int)
    for (lang, p), a in long.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                worst[lang, p[i : i + n]] = max(worst[lang, p[i : i + n]], a)
    by_lang = defaultdict(list)
    for (lang, p), a in long.items():
        if 100 * worst[lang, p] >= 50 * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, words[lang], -s) for lang, v in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize(("max_n", "least", "top"), [(3, 10, 2000), (3, 2, 7), (4, 3, 2000), (2, 1, 2000)])
def test_collocations(corpus, max_n, least, top):
    got = collocations.collocations(corpus, max_n, least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for _, t in got.dtypes} == {"string", "bigint"}
    want = brute_collocations([(r.lang, r.text) for r in corpus.select("lang", "text").collect()], max_n, least, top)
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_small_tasks(corpus, monkeypatch):
    """Counters that hand on early, and words dealt to several tasks, change nothing."""
    monkeypatch.setattr(collocations, "HELD", 20)
    want = brute_collocations([(r.lang, r.text) for r in corpus.select("lang", "text").collect()])
    assert sorted(map(tuple, collocations.collocations(corpus).collect())) == want


def test_collocations_of_nothing(spark, none):
    assert collocations.collocations(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " . ,\n", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(blank).count() == 0


def test_stack_counts_prefixes_of_sorted_suffixes():
    rows = [("b", b"x", 1, False), ("a", b"b", 2, False), ("a", b"a\tc", 1, False), ("a", b"a\tb\tb", 3, True), ("a", b"a\tb", 1, False), ("a", b"a", 5, True)]
    got = list(collocations.prefix_counts(iter(rows), 3, 1))
    assert got == [("b", b"x", 1), ("a", b"b", 2), ("a", b"a\tc", 1), ("a", b"a\tb\tb", 3), ("a", b"a\tb", 4), ("a", b"a", 10)]


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of thousands of millions: the quotient stays exact."""
    big = 3_999_999_999_989
    f = [("en", "p q", big - 7), ("en", "p", big), ("en", "q", big + 3)]
    table = spark.createDataFrame(f, "lang string, phrase string, f long").withColumnRenamed("phrase", "p")
    table = table.selectExpr("lang", "replace(p, ' ', '\t') as phrase", "f")
    monkeypatch.setattr(collocations, "phrases", lambda *a, **k: (table, spark.createDataFrame([("en", big * 2)], "lang string, n long")))
    (r,) = collocations.collocations(table).collect()
    assert (r.a, r.l, r.r, r.score) == (big - 7, big, big + 3, 1_000_000 * (big - 7) ** 2 // (big * (big + 3)))


# -- source divergence


def brute_divergence(rows, least=30, ranks=50):
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = "".join(c if c > "\x7f" or c.isalpha() else " " for c in lowered(text)).split(" ")
        terms = [t for t in terms if t]
        n.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), c in docs.items() if of == lang and c >= least]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept)) for t in kept}
        counts = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        p = {s: share(c) for s, c in counts.items()}
        q = share({t: sum(c[t] for c in counts.values()) for t in kept})
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks"), [(30, 50), (2, 3), (1, 50), (10_000, 50)])
def test_divergence(corpus, least, ranks):
    got = divergence.divergence(corpus, least, ranks)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = brute_divergence([(r.lang, r.source, r.text) for r in corpus.collect()], least, ranks)
    assert sorted(map(tuple, got.collect())) == want and {r[2] for r in want} == ({"pair", "term"} if least < 10_000 else {"pair"})


def test_divergence_of_small_shards(corpus, monkeypatch):
    """Shards of a few counts and terms, and terms whose own rows are more than a shard, change nothing."""
    for name, size in (("HELD", 20), ("SHARD", 15), ("GRID", 20)):
        monkeypatch.setattr(divergence, name, size)
    want = brute_divergence([(r.lang, r.source, r.text) for r in corpus.collect()], 10)
    assert sorted(map(tuple, divergence.divergence(corpus, 10).collect())) == want


def test_divergence_of_nothing(none):
    assert divergence.divergence(none).count() == 0

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
import zstandard

from engram.llm import common, compressclf, rules


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + o for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@pytest.fixture(scope="module")
def labelled(spark):
    """The driver's documents and labels."""
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_base_rules(docs, none, labelled):
    rows = rules.quality_rules(docs, labelled[1]).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        b = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
    assert rules.quality_rules(none, labelled[1]).count() == 0


def test_regression_holds_out(labelled):
    d, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [r for r in rules.quality_rules(d, labels).collect() if r.doc_id in truth and crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.probability >= rules.KEEP_FROM) == bool(truth[r.doc_id]) for r in out]
    assert sum(right) / len(right) >= 0.9


def test_compression_holds_out(labelled, docs, none):
    d, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = compressclf.quality_scores(d, labels).collect()
    assert {r.doc_id for r in out if r.held_out} == {r.doc_id for r in out if crc32(str(r.doc_id).encode()) % 5 == 0}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum((r.predicted == 1) == bool(truth[r.doc_id]) for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    odd = compressclf.quality_scores(docs, labels)
    assert odd.count() == docs.count() and set(docs.columns) - {"Score"} <= set(odd.columns)
    assert compressclf.quality_scores(none, labels).count() == 0


def plain_score(model, text):
    """The score of one text, step by step: both compressors block by block, the prior, the straight line between two calibrated points."""
    kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
    sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[i : i + 1024])) for i in range(0, len(text), 1024)) for d in (model.bad, model.good)]
    margin = (sizes[0] - sizes[1] + model.typical * 128) / (len(text) + 128)
    x, y = model.margins, model.shares
    if margin <= x[0] or len(x) == 1:
        share = y[0]
    elif margin >= x[-1]:
        share = y[-1]
    else:
        k = max(i for i in range(len(x) - 1) if x[i] <= margin)
        share = y[k + 1] if x[k] == x[k + 1] else y[k] + (y[k + 1] - y[k]) * (margin - x[k]) / (x[k + 1] - x[k])
    return 0.99 * share + 0.01 / (1 + math.exp(-margin / model.spread))


def test_scores_by_brute_force(spark, labelled):
    d, labels = labelled
    model = compressclf.fit(d, labels)
    text = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    for r in compressclf.quality_scores(d, labels).filter("doc_id % 4 = 0").collect():
        assert r.score == pytest.approx(plain_score(model, text[r.doc_id]), abs=1e-9)


def test_calibration_is_isotonic_regression():
    """Pooled shares against the max-min formula over all intervals."""
    rnd = random.Random(8)
    margin = np.array(sorted(rnd.sample(range(1000), 60)), float)
    label = np.array([float(rnd.random() < m / 1000) for m in margin])
    points, shares = compressclf.calibration(margin, label)
    mean = lambda i, j: label[i : j + 1].mean()
    best = [max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    groups = [[0]]
    for k in range(1, 60):
        groups.append([k]) if best[k] > best[k - 1] + 1e-12 else groups[-1].append(k)
    assert points.tolist() == [x for g in groups for x in (margin[g[0]], margin[g[-1]])]
    expected = np.maximum.accumulate([(label[g].sum() + 0.5) / (len(g) + 1) for g in groups])
    assert shares[::2] == pytest.approx(expected) and shares[1::2] == pytest.approx(expected)


def test_verdicts_by_brute_force(spark, labelled):
    """Each kept flag and probability from the fitted weights, n-gram by n-gram."""
    d, labels = labelled
    model = rules.fit(d, labels)
    text = {r.doc_id: r.text or "" for r in d.collect()}
    rows = rules.quality_rules(d, labels).filter("doc_id % 5 = 0").collect()
    for r in rows:
        t = text[r.doc_id]
        h = [xxhash.xxh3_64_intdigest(w) for w in t.encode().split()]
        big, small = (1 << 64) - 1, (1 << 32) - 1
        grams = [x >> 47 for x in h] + [((((a * 0x9E3779B97F4A7C15 & big) ^ b) * 0xD6E8FEB86659FD93) & big) >> 47 for a, b in zip(h, h[1:])]
        c = [*map(ord, t)]
        chars = [(((((x * 0x9E3779B1 & small) ^ (y * 0x85EBCA77 & small) ^ (z * 0xC2B2AE3D & small)) * 0x27D4EB2F) & small) >> 15) + (1 << 17) for x, y, z in zip(c, c[1:], c[2:])]
        margin = model.bias + 8 * sum(float(np.mean(model.weights[g])) for g in (grams, chars) if g)
        p = 0.99 * np.interp(margin, model.margins, model.shares) + 0.01 / (1 + math.exp(-margin))
        assert r.probability == pytest.approx(p, abs=1e-4) and r.kept == (not r.base_failed and r.probability >= 0.3)


def test_without_labels(spark, docs, labelled):
    no = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 2) for r in compressclf.quality_scores(docs, no).collect()} <= {0.5, 0.51, 0.49}
    assert rules.quality_rules(docs, no).filter("kept").count() > 0
    one = spark.createDataFrame([(1, None, 0), (None, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    assert compressclf.quality_scores(docs, one).filter("predicted = 1").count() == docs.count()


def test_the_sample_takes_long_texts_and_one_row_an_id(spark):
    rows = [(1, "b" * 300_000), (1, "a" * 300_000), (1, "a" * 300_000), (2, "x"), (None, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    assert compressclf.sample(d, labels, lambda c: compressclf.fold(c) >= 0, 10) == [(b"a" * 300_000, 1), (b"x", 0)]
    assert compressclf.quality_scores(d, labels).count() == len(rows)


def test_labels_of_the_held_out_fold_change_nothing(spark, labelled):
    d, labels = labelled
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality if crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 0) for r in labels.collect()], labels.schema)
    a, b = ({r.doc_id: r.score for r in compressclf.quality_scores(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

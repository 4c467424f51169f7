"""The pipeline against a plain version of its stages."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from engram.llm import common, compressclf
from test_decontam_pii import brute as brute_contamination
from test_dedup import brute_components, brute_lines
from test_quality import plain_score
from tests_llm_data import ODD

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["driver's", "odd"])
def stages(request, spark):
    """Each stage's rows before and after it: of the driver's documents, and of null, empty, odd, long and repeated ones with columns of helpers' names."""
    docs, out = common.table(spark, DATA, "documents"), []
    if request.param == "odd":
        texts = [r.text for r in docs.filter("doc_id < 40").orderBy("doc_id").collect()]
        rows = [(i, t, "en", "s", len(t or ""), "x", "y", 1.0) for i, t in enumerate([*ODD, *texts, *texts[:5], texts[0] + "\nend", " " * 1_200_000])]
        rows += [(None, texts[6], "en", "s", 1, None, None, None), rows[3], rows[14], (14, "another text under an id that is taken", None, None, None, None, None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id string, Row_Key string, score double").repartition(3)
    for _, stage in pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, DATA), "test-stage")
        out.append((before, docs))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(spark, stages):
    before, after = stages[0]
    model = compressclf.fit(before, common.table(spark, DATA, "labels"))
    rows = pairs(before)
    scores = [plain_score(model, (t or "").encode()) for _, t in rows]
    assert Counter((d, t) for (d, t), s in zip(rows, scores) if s >= 0.3) == Counter(pairs(after))


def test_lines(stages):
    before, after = stages[1]
    expected = [(d, t) for d, _, n, t in brute_lines([(d, t or "") for d, t in pairs(before)]) if not n or re.search(r"[^\x20\x09-\x0D]", t)]
    assert Counter((d, t or "") for d, t in pairs(after)) == Counter(expected)
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text and r.n_chars and r.doc_id is not None)


def test_near(stages):
    before, after = stages[2]
    expected = brute_components([(d, t or "") for d, t in pairs(before)], 80)
    assert {d for d, _ in pairs(after)} - {None} == {d for d, (_, c) in expected.items() if d == c}
    kept = {d for d, _ in pairs(after)}
    assert Counter(pairs(after)) == Counter((d, t) for d, t in pairs(before) if d in kept)


def test_contamination(spark, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    hit = {d for d, *_, c in brute_contamination(pairs(before), items) if c}
    assert Counter(pairs(after)) == Counter((d, t) for d, t in pairs(before) if d not in hit)


def test_packed(stages, tokenizer):
    before, after = stages[4]
    library = Tokenizer.from_file(tokenizer)
    expected = Counter()
    for d, t in pairs(before):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cut = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        for k, (s, e) in enumerate(zip([0, *range(cut, len(ids), 2048)], [*range(cut, len(ids) + 1, 2048)])):
            expected[d, k, s, e - s, crc32(ids[s:e].tobytes())] += 1
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0


def test_empty(spark):
    docs = spark.createDataFrame([], common.table(spark, DATA, "documents").schema)
    for _, stage in pipeline.STAGES:
        docs = common.written(stage(spark, docs, DATA), "test-stage")
        assert docs.count() == 0

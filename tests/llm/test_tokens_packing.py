import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from engram.llm import packing, tokens


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts(docs, none, tokenizer, library):
    rows = tokens.token_counts(docs, tokenizer).collect()
    by = defaultdict(list)
    for r in docs.collect():
        by[r.doc_id].append(r.text)
    assert len(rows) == docs.count()
    for r in rows:
        text = by[r.doc_id][0]
        n = len(ids(library, text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 1024)
    assert tokens.token_counts(none, tokenizer).count() == 0


def test_every_prefix(tokenizer, library):
    counter, rnd = tokens.PrefixCounter(tokenizer), random.Random(3)
    for _ in range(150):
        text = "".join(rnd.choice("abcdeft  '\n\t.,é日12relvs\x85\xa0😀²\x1c") for _ in range(rnd.randint(0, 25))) + rnd.choice(["", "don't we'll", "  end  ", " <|endoftext|>x", "!!<|endoftext|><|endoftext|> 're"])
        table = counter.prefix_table(text)
        assert table == [len(ids(library, text[:i])) for i in range(len(text) + 1)]


def test_pairs_agree_with_merging(tokenizer, library):
    counter, rnd = tokens.PrefixCounter(tokenizer), random.Random(5)
    pool = [t for t in counter.ids if t.isalpha() and len(t) < 6]
    for _ in range(500):
        a, b = rnd.choice(pool), rnd.choice(pool)
        assert counter.pair_stays((a, b)) == (ids(library, (a + b).decode()) == [counter.ids[a], counter.ids[b]])


RUNS = [" " * 1_500_000, "x" * 50_000, "=-" * 30_000, "漢字" * 20_000, "\n" * 40_000 + "end", "0123456789" * 4000, "".join(random.Random(4).choice("abcdefgh") for _ in range(20_000))]


def test_long_runs(tokenizer, library):
    """Runs of one class, which are one piece: exact, and without time in proportion to the longest token."""
    counter = tokens.PrefixCounter(tokenizer)
    for text in RUNS:
        assert counter.count(text) == len(ids(library, text))
        assert packing.token_ids(tokenizer, text) == ids(library, text)


def test_budgets_are_read_from_the_stored_table(docs, none, tokenizer, library):
    counted = tokens.token_counts(docs, tokenizer)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokens.budget_points(counted, 10, at_char=40).collect():
        t = text[r.doc_id]
        assert r.n_tokens == len(ids(library, t[: r.n_chars])) <= 10 and r.tokens_at == len(ids(library, t[:40]))
        assert all(len(ids(library, t[:i])) > 10 for i in range(r.n_chars + 1, min(len(t), r.n_chars + 40) + 1))
    assert tokens.budget_points(tokens.token_counts(none, tokenizer), 10).count() == 0


def test_packing_of_a_long_blank_run(spark, tokenizer, library):
    rows = packing.pack(spark.createDataFrame([(1, RUNS[0]), (2, "after it")], "doc_id long, text string"), tokenizer).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(ids(library, RUNS[0])) + 1
    whole = np.array([*ids(library, RUNS[0]), 0], "<u4")
    assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in rows if r.doc_id == 1)


def test_packing(docs, none, tokenizer, library):
    rows = packing.pack(docs, tokenizer, packer_pieces=20).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter(r.doc_id for r in docs.collect())
    seen, sequences = Counter(), defaultdict(list)
    for r in rows:
        whole = np.array([*ids(library, text[r.doc_id]), 0], "<u4")
        assert r.length <= 2048 and zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        if len(whole) <= 2048:
            assert (r.piece, r.start, r.length) == (0, 0, len(whole))
        elif r.piece:
            assert r.length == 2048
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {d: n * (len(ids(library, text[d])) + 1) for d, n in copies.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, tokenizer).count() == 0


def test_bounded_space_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third opens a bin too many: it is the fullest and closes
    assert fit.place(2) == (1, 7) and fit.place(4) == (0, 6)
    rnd = random.Random(1)
    sizes = sorted((rnd.randint(1, 2048) for _ in range(3000)), reverse=True)
    fit = packing.BestFit(2048)
    for n in sizes:
        fit.place(n)
        assert fit.n_open <= packing.OPEN_BINS
    assert fit.n_sequences <= 1.03 * sum(sizes) / 2048 + 1


def test_the_bound_binds_and_costs_little():
    """Of 40,000 pieces in runs, sequences close for the bound, and few sequences more are needed than without it."""
    rnd = random.Random(2)
    pieces = [min(2048, int(rnd.lognormvariate(6.3, 1)) + 1) for _ in range(40_000)]
    arrive = [n for k in range(0, len(pieces), packing.RUN_PIECES) for n in sorted(pieces[k : k + packing.RUN_PIECES], reverse=True)]
    bound, free = packing.BestFit(2048), packing.BestFit(2048, 10**9)
    most = 0
    for n in arrive:
        bound.place(n), free.place(n)
        most = max(most, free.n_open)
    assert most > packing.OPEN_BINS and bound.n_sequences <= 1.01 * free.n_sequences

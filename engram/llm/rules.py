"""Quality rules: text counts with fixed limits, and a hashed n-gram logistic regression.

The regression sees word 1- and 2-grams and character 3-grams, hashed, as shares of the text's n-grams. It is trained
on a bounded sample of labelled quality rows (``TRAIN_DOCS`` of each label, by a hash of the id, from the folds that learn), its
output is calibrated by isotonic regression on another fold, and texts are scored in Arrow batches against
fixed thresholds. One pass over whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common
from engram.llm.compressclf import calibration, fold, sample, sigmoid

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW, SYMBOLS, SPACES = 50, 50, 3, "#*$%&|<>", " \t\n\v\f\r"
#: Texts whose probability of quality is below this are not kept.
KEEP_FROM = 0.3
BITS = 17
TRAIN_DOCS, CALIBRATE_DOCS = 1200, 3000
STEPS, RATE, DECAY = 200, 0.3, 1e-6
SCALE = 8.0
CACHE = 300_000
_HASHES: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    if len(_HASHES) >= CACHE:
        _HASHES.clear()
    value = _HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return value


class Words:
    """A text's words, with their ids in order of first use."""

    def __init__(self, text: str):
        self.words = text.encode().split()
        first: dict[bytes, int] = {}
        self.ids = np.array([first.setdefault(w, len(first)) for w in self.words], np.int64)
        get = _HASHES.get
        self.hashes = np.array([get(w) or word_hash(w) for w in first], np.uint64)[self.ids] if first else np.zeros(0, np.uint64)
        self.distinct = len(first)

    def repeated(self, window: int = REPEAT_WINDOW) -> int:
        """Words in windows that occur twice or more, the first occurrence included; windows are compared exactly."""
        n = len(self.ids) - window + 1
        if n < 2:
            return 0
        key, base = self.ids[:n], self.distinct
        for o in range(1, window):
            if base * self.distinct >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                base = n
            key, base = key * self.distinct + self.ids[o : o + n], base * self.distinct
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[where] > 1)
        edge = np.zeros(n + window, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str, words: Words) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words.words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, words.repeated()


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word n-grams, and hashed character n-grams in a range of their own."""
    h = words.hashes
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    grams = np.concatenate([h, pairs * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(64 - BITS)
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    three = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    chars = (three * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    return grams.astype(np.int64), chars.astype(np.int64) + (1 << BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    margins: np.ndarray
    shares: np.ndarray

    def margin(self, text: str, words: Words) -> float:
        return self.bias + SCALE * sum(float(self.weights[x].mean()) for x in features(text, words) if len(x))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 0.99 * np.interp(margins, self.margins, self.shares) + 0.01 * sigmoid(margins)


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on shares of n-grams, by Adam steps over the whole sample; both labels weigh the same."""
    rows, cols, vals = [], [], []
    for i, t in enumerate(texts):
        for x in features(t, Words(t)):
            at, n = np.unique(x, return_counts=True)
            rows.append(np.full(len(at), i, np.int32)), cols.append(at.astype(np.int32)), vals.append((SCALE * n / max(1, len(x))).astype(np.float32))
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    seen, col = np.unique(col, return_inverse=True)  # n-grams that no text has keep weight 0
    of_row = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    by_col = np.argsort(col, kind="stable")
    of_col, row_c, val_c = np.flatnonzero(np.r_[True, np.diff(col[by_col]) != 0]), row[by_col], val[by_col]
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    w, b = np.zeros(len(seen)), 0.0
    m, v, mb, vb = np.zeros(len(seen)), np.zeros(len(seen)), 0.0, 0.0
    with_grams = row[of_row]
    for step in range(1, STEPS + 1):
        margin = np.zeros(len(texts))
        margin[with_grams] = np.add.reduceat(val * w[col], of_row) if len(row) else 0
        error = (sigmoid(margin + b) - labels) * share
        g = (np.add.reduceat(val_c * error[row_c], of_col) if len(row) else np.zeros(0)) + DECAY * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        grow, settle = 1 - 0.9**step, 1 - 0.99**step
        w -= RATE * (m / grow) / (np.sqrt(v / settle) + 1e-8)
        b -= RATE * (mb / grow) / (np.sqrt(vb / settle) + 1e-8)
    out = np.zeros(2 << BITS, np.float32)
    out[seen] = w
    return out, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from bounded samples; without texts of both labels every text gets the share of label 1 (0.5 without any)."""
    learned = sample(docs, labels, lambda c: fold(c) > 1, TRAIN_DOCS, id_col, text_col)
    y = np.array([q for _, q in learned], float)
    if len({*y}) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(2 << BITS, np.float32), 0.0, np.zeros(1), np.array([share]))
    model = Model(*train([t.decode() for t, _ in learned], y), np.zeros(1), np.zeros(1))
    check = sample(docs, labels, lambda c: fold(c) == 1, CALIBRATE_DOCS, id_col, text_col, by_label=False)
    if len({q for _, q in check}) < 2:
        check = learned
    margins = np.array([model.margin(t := x.decode(), Words(t)) for x, _ in check])
    model.margins, model.shares = calibration(margins, np.array([q for _, q in check]))
    return model


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    Words are what ASCII white space separates. Null and empty texts have no words, so they fail the base rules. Repeated
    rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"]
    id_type = docs.schema[id_col].dataType.simpleString()

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            counts, margins = [], []
            for text in b.column(1).to_pylist():
                words = Words(text)
                counts.append(base_counts(text, words))
                margins.append(model.value.margin(text, words))
            p = model.value.probability(np.array(margins, float))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(p)], names)

    kept = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = kept.mapInArrow(judge, f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_from))

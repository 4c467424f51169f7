"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled texts. A text is compressed in blocks with
either; the difference of the two sizes, divided by the text's length (with ``PRIOR_BYTES`` bytes of the typical
difference added, so that a very short text is judged by little evidence), becomes a probability by isotonic regression on
labelled rows of another fold. Labels are learned only from rows whose crc32(id as text) mod 5 is not 0; of these, remainder 1
calibrates and the others build the dictionaries. Scores see nothing but the text.

Fitting uses a bounded sample (``TRAIN_DOCS`` rows of each label, ``CALIBRATE_DOCS`` rows of any, by a hash of the id); scoring is
one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common

TRAIN_DOCS = 1500
CALIBRATE_DOCS = 3000
DICT_BYTES = 112_640
BLOCK = 1024
LEVEL = 3
PRIOR_BYTES = 128
FOLDS = 5
CUT = 0.3


def fold(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, where, rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", by_label: bool = True) -> list[tuple[bytes, int]]:
    """Texts and labels of at most ``rows`` labelled documents (of each label, or of all), by a hash of the id: bounded, so it may go to the driver.

    The chosen ids, which are as few, meet the documents where those are read. Texts are taken whole, whatever their length; of rows that
    share an id and label, one is taken (the least text), which each task picks before anything is shuffled.
    """
    slim = labels.select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("int").alias("sample_label")).filter(F.col("sample_id").isNotNull() & F.col("sample_label").isin(0, 1))
    slim = slim.filter(where("sample_id")).distinct()
    by_hash = [F.xxhash64("sample_id"), "sample_id"]
    if not by_label:
        chosen = slim.orderBy(*by_hash).limit(rows)
    else:
        chosen = slim.filter("sample_label = 0").orderBy(*by_hash).limit(rows).unionAll(slim.filter("sample_label = 1").orderBy(*by_hash).limit(rows))
    texts = docs.select(F.col(id_col), common.utf8(text_col).alias("t"))
    found = texts.join(F.broadcast(chosen), F.col(id_col) == F.col("sample_id"))
    got = found.groupBy("sample_id", "sample_label").agg(F.min("t").alias("t")).collect()
    return [(bytes(r.t), r.sample_label) for r in sorted(got, key=lambda r: (r.sample_id, r.sample_label))]


@dataclass
class Model:
    """What the executors need: two dictionaries, the typical difference, and the calibration."""

    bad: bytes
    good: bytes
    raw: bool
    typical: float = 0.0
    margins: tuple[float, ...] = (0.0,)
    shares: tuple[float, ...] = (0.5,)
    spread: float = 1.0

    def compressors(self):
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.bad, self.good)]

    def differences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes by which the bad dictionary's output is larger, and the lengths."""
        bad, good = (c.compress for c in self.compressors())
        out = []
        for t in texts:
            d = 0
            for i in range(0, len(t), BLOCK):
                block = t[i : i + BLOCK]
                d += len(bad(block)) - len(good(block))
            out.append(d)
        return np.array(out, float), np.array([len(t) for t in texts], float)

    def margin(self, difference: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (difference + self.typical * PRIOR_BYTES) / (length + PRIOR_BYTES)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Interpolated shares; a hundredth of a logistic curve keeps texts of one flat part in their order."""
        margin = self.margin(*self.differences(texts))
        return 0.99 * np.interp(margin, self.margins, self.shares) + 0.01 * sigmoid(margin / self.spread)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibration(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the margin: points between which the probability is interpolated.

    Neighbouring blocks are pooled until their shares rise. A block's share, which counts half a row of either label
    more, holds from its least to its greatest margin.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # rows, rows of label 1, least and greatest margin
    for m, y in zip(margin[order].tolist(), label[order].tolist()):
        blocks.append([1, y, m, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, ones, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + ones, blocks[-1][2], top]
    n, ones, low, high = np.array(blocks, float).T
    shares = np.maximum.accumulate((ones + 0.5) / (n + 1))
    return np.stack([low, high], 1).ravel(), np.repeat(shares, 2)


def dictionary(texts: list[bytes]) -> bytes | None:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from bounded samples. Without texts of both labels it scores every text by the share of label 1 (0.5 without any)."""
    build = sample(docs, labels, lambda c: fold(c) > 1, TRAIN_DOCS, id_col, text_col)
    bad, good = ([t for t, y in build if y == k and t] for k in (0, 1))
    if not bad or not good:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return Model(b" ", b" ", True, shares=(share,))
    trained = dictionary(bad), dictionary(good)
    raw = None in trained
    if raw:  # a share of each text's beginning, as much as fits
        trained = tuple(b"".join(t[: max(256, DICT_BYTES // len(ts))] for t in ts)[:DICT_BYTES] for ts in (bad, good))
    model = Model(*trained, raw)
    check = sample(docs, labels, lambda c: fold(c) == 1, CALIBRATE_DOCS, id_col, text_col, by_label=False)
    if len({y for _, y in check}) < 2:
        check = build
    d, n = model.differences([t for t, _ in check])
    model.typical = float(np.median((d / np.maximum(n, 1))[np.array([y == 1 for _, y in check])]))
    margin = model.margin(d, n)
    model.margins, model.shares = (tuple(x.tolist()) for x in calibration(margin, np.array([y for _, y in check])))
    model.spread = float(margin.std()) or 1.0
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` plus held_out, score and predicted (1 from ``cut`` on).

    A null text is an empty one; empty texts get the score of the typical difference. A null id is held out. Repeated
    rows get equal scores. Columns of ``docs`` named like one of the three are replaced.
    """
    common.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"held_out", "score", "predicted"}])
    (scratch,) = common.fresh(docs, "utf8_text")
    names = [*docs.columns, "score"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.value.score(b.column(b.num_columns - 1).to_pylist()))], names)

    scored = docs.withColumn(scratch, common.utf8(text_col)).mapInArrow(score, types)
    return scored.withColumn("held_out", fold(id_col) == 0).withColumn("predicted", (F.col("score") >= cut).cast("int"))

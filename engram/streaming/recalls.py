"""Recall counting: a record counts again only five minutes after it last counted.

In batch, a record's timeline is cut into chunks. What a chunk does is a function of the time that counted last before it: it tells how many recalls of the chunk count, and
which of them last. That function is a short table, as only the chunk's first five minutes depend on what came before. Tables of neighbouring
chunks are composed into one of the same size, so a record's whole timeline is folded by a row for each ``SPAN`` chunks, however often it was recalled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.functions import json as J
from engram.operators import storage

SUPPRESS_SECONDS = 300
#: A chunk in times of suppression, and the chunks that are composed into one.
CHUNK, SPAN = 12, 64
#: Hits of a recall that count.
TOP = 3
NEVER = -(1 << 62)
_STEP = "until array<long>, n array<long>, last array<long>"


class Step:
    """What a stretch of a timeline does: after a last counted time of at most ``until[i]``, ``n[i]`` more count, the last of them at ``last[i]``; after a later one, none."""

    def __init__(self, until: list[int], n: list[int], last: list[int]):
        self.until, self.n, self.last = until, n, last

    @classmethod
    def of(cls, times: np.ndarray, begin: int, gap: int) -> Step:
        """times: sorted and distinct, from ``begin`` on; whatever counted before did so before ``begin``."""
        following = np.searchsorted(times, times + gap).tolist()
        size = len(times)
        n, last = [0] * size, times.tolist()
        for i in range(size - 1, -1, -1):
            j = following[i]
            n[i], last[i] = (n[j] + 1, last[j]) if j < size else (1, last[i])
        reach = min(size, int(np.searchsorted(times, begin + gap)) + 1)
        return cls._short(zip((times[:reach] - gap).tolist(), n, last))

    @classmethod
    def _short(cls, entries) -> Step:
        """Entries in order, neighbours of one effect as one."""
        out: list[list[int]] = []
        for until, n, last in entries:
            if out and out[-1][1:] == [n, last]:
                out[-1][0] = until
            else:
                out.append([until, n, last])
        return cls(*map(list, zip(*out)))

    def after(self, before: int) -> tuple[int, int]:
        """How many count after ``before``, and the last counted time then."""
        i = bisect_left(self.until, before)
        return (self.n[i], self.last[i]) if i < len(self.until) else (0, before)

    def then(self, other: Step) -> Step:
        """Both stretches, one after the other."""
        own = [(u, n + other.after(t)[0], other.after(t)[1]) for u, n, t in zip(self.until, self.n, self.last)]
        return self._short([*own, *(x for x in zip(other.until, other.n, other.last) if x[0] > self.until[-1])])


def _by_group(columns: list[str], types: str, one: Callable) -> Callable:
    """An Arrow function over rows sorted by their first columns: ``one(key, rows)`` yields what comes of each group, whose rows pass as tuples."""
    fields = [(t.split(" ")[0].strip("`"), pa.list_(pa.int64()) if "array<" in t else pa.int64()) for t in types.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kind[:] = [b.schema.field(0).type]  # the record's own type
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch() -> pa.RecordBatch:
            schema = pa.schema([(fields[0][0], kind[0]), *fields[1:]])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        out: list[tuple] = []
        for k, group in groupby(rows(), lambda r: r[: len(columns)]):
            for x in one(k, (r[len(columns) :] for r in group)):
                out.append(x)
                if len(out) == 5000:
                    yield batch()
                    out = []
        if out:
            yield batch()

    return run


class _Timelines:
    """Recalls (key, ts) by chunk and span, their steps, and what is asked of them. Recalls without a record or a time don't count."""

    def __init__(self, recalls: DataFrame, seconds: int, key: str):
        self.kind = recalls.schema[key].dataType.simpleString()
        recalls = recalls.select(F.col(key).alias("_key"), "ts")  # a key's name clashes with no other
        self.key, self.gap = (key := "_key"), seconds * 1_000_000
        length, span = CHUNK * self.gap, SPAN
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        times = recalls.select(key, us.alias("us")).dropna().distinct()
        self.times = times.withColumn("chunk", F.floor(F.col("us") / length)).withColumn("span", F.floor(F.col("chunk") / span))
        gap = self.gap

        def step(k, rows):
            s = Step.of(np.array([r[0] for r in rows], np.int64), k[2] * length, gap)
            yield *k, s.until, s.n, s.last

        def compose(k, rows):
            whole = None
            for _, *table in rows:
                whole = Step(*table) if whole is None else whole.then(Step(*table))
            yield *k, whole.until, whole.n, whole.last

        by = [key, "span", "chunk"]
        steps = self.times.select(*by, "us").repartition(*by).sortWithinPartitions(*by, "us").mapInArrow(_by_group(by, (t := f"`{key}` {self.kind}, span long, chunk long, {_STEP}"), step), t)
        self.steps = storage.written(steps, "recall-steps")
        spans = self.steps.repartition(key, "span").sortWithinPartitions(*by).mapInArrow(_by_group([key, "span"], (t := f"`{key}` {self.kind}, span long, {_STEP}"), compose), t)
        self.spans = spans.repartition(key).sortWithinPartitions(key, "span")

    def ends(self) -> DataFrame:
        """key, recall_count, last: of each whole timeline."""

        def fold(k, rows):
            n, last = 0, NEVER
            for _, *table in rows:
                more, last = Step(*table).after(last)
                n += more
            yield *k, n, last

        t = f"`{self.key}` {self.kind}, recall_count long, last long"
        return self.spans.mapInArrow(_by_group([self.key], t, fold), t)

    def counted(self) -> DataFrame:
        """key, us: the recalls that count; spans learn what counted before them, then their chunks, then the recalls."""
        key, gap = self.key, self.gap

        def spans(k, rows):
            last = NEVER
            for span, *table in rows:
                yield *k, span, last
                last = Step(*table).after(last)[1]

        def chunks(k, rows):
            last = None
            for chunk, before, *table in rows:
                last = before if last is None else last
                yield *k, chunk, last
                last = Step(*table).after(last)[1]

        def recalls(k, rows):
            last = None
            for us, before in rows:
                last = before if last is None else last
                if us - last >= gap:
                    last = us
                    yield *k, us

        before = self.spans.mapInArrow(_by_group([key], (t := f"`{key}` {self.kind}, span long, before long"), spans), t)
        chunked = self.steps.join(before, [key, "span"]).select(key, "span", "chunk", "before", "until", "n", "last").repartition(key, "span").sortWithinPartitions(key, "span", "chunk")
        known = chunked.mapInArrow(_by_group([key, "span"], (t := f"`{key}` {self.kind}, span long, chunk long, before long"), chunks), t)
        by = [key, "span", "chunk"]
        told = self.times.join(known, by).select(*by, "us", "before").repartition(*by).sortWithinPartitions(*by, "us")
        return told.mapInArrow(_by_group(by, (t := f"`{key}` {self.kind}, span long, chunk long, us long"), recalls), t).select(key, "us")


def counted(recalls: DataFrame, seconds: int = SUPPRESS_SECONDS, key: str = "id") -> DataFrame:
    """Which recalls (id, ts) count, in batch: key, ts. Of recalls of one record at one time one counts at most; those without record or time don't."""
    return _Timelines(recalls, seconds, key).counted().select(F.col("_key").alias(key), F.timestamp_micros("us").alias("ts"))


def totals(recalls: DataFrame, seconds: int = SUPPRESS_SECONDS, key: str = "id") -> DataFrame:
    """Counted recalls of each key and the last of them."""
    return _Timelines(recalls, seconds, key).ends().select(F.col("_key").alias(key), "recall_count", F.timestamp_micros("last").alias("last_recalled_at"))


def of_hits(hits: DataFrame, ts: Column | str = "ts", most: int = TOP) -> DataFrame:
    """The recalls (id, ts) that hits (rank, id) are: the ``most`` best of each query."""
    return hits.filter(F.col("rank") <= most).select("id", F.col(ts).alias("ts") if isinstance(ts, str) else ts.alias("ts"))


def written_back(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Records with counts (id, recall_count, last_recalled_at) added to their metadata: ``recallCount`` (what isn't a number counts as 0) and ``lastRecalledAt``; all other
    keys and all other records stay as they are."""
    j = records.join(counts.select("id", F.col("recall_count").alias("_more"), F.col("last_recalled_at").alias("_at")), "id", "left")
    old = F.from_json("metadata", J.VALUES)["recallCount"]
    kind = F.schema_of_variant(old)
    whole, real = F.try_variant_get(old, "$", "bigint"), F.try_variant_get(old, "$", "double")
    count = F.when(kind == "BIGINT", J.variant(whole + F.col("_more"))).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), J.variant(real + F.col("_more"))).otherwise(J.variant(F.col("_more")))
    new = J.with_keys("metadata", {"recallCount": count, "lastRecalledAt": J.variant(F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))})
    return j.withColumn("metadata", F.when(F.col("_more").isNull(), F.col("metadata")).otherwise(new)).select(*records.columns)


def counting_stream(recalls: DataFrame, seconds: int = SUPPRESS_SECONDS, key: str = "id") -> DataFrame:
    """The running counts of a stream of recalls: key, recall_count, last_recalled_at, one row for each key and micro-batch it occurs in."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -(1 << 60))
        for t in sorted(int(x) for f in frames for x in f["us"]):
            if t - last >= seconds * 1_000_000:
                n, last = n + 1, t
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "recall_count": [n], "last_us": [last]})

    id_type = recalls.schema[key].dataType.simpleString()
    out = recalls.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select(key, "us").groupBy(key).applyInPandasWithState(update, f"`{key}` {id_type}, recall_count long, last_us long", "n long, last long", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("last_recalled_at", F.timestamp_micros("last_us")).drop("last_us")

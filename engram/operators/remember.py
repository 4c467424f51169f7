"""Duplicate-aware writes: a batch of inputs against the stored records, and against each other.

Inputs meet the records of their scope and kind in blocks of bounded rows, multiplied as matrices. The similarity is half token overlap (over the
input's tokens) and half (1 + cosine) / 2 of the hashed vectors; as the cosine of these vectors is never above 1, a pair
below ``2 * cut - 1`` overlap cannot reach the cut. A block gives on only what is asked for, so the pairs themselves are never written.

``decisions`` judges each input against the records as they stand and needs an input's best record only. ``remember`` writes a whole batch one input after the other, as
its order says: inputs and records that are linked by similarity form groups, and only within a group does one write bear on the
next. Groups are folded in parallel, each as a stream of its rows; what is linked to nothing is added set at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import storage
from engram.operators.groups import groups
from engram.operators.search import DIMS, LATIN, LONG_WORD, _indexed, words

THRESHOLD, CANDIDATE_SHARE, EVALUATED, IGNORED = 0.85, 0.7, 0.7, 0.95
MODES = ("threshold", "rules", "conservative")


def features(rows: DataFrame, key: str) -> DataFrame:
    """What similarity needs of records or inputs: key, scope_key, kind, ids of the distinct tokens, and the hashed vector scaled to length 1.

    One Arrow pass; scores agree with the column functions of ``engram.functions.text``.
    """
    key_type = rows.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, vectors = [], []
            for t in b.column(3).to_pylist():
                ids, v = scaled(t)
                tokens.append(ids), vectors.append(v)
            lists = lambda rows, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists(tokens, pa.int64()), lists(vectors, pa.float64())], ["key", "scope_key", "kind", "tokens", "v"])

    picked = rows.select(F.col(key).alias("key"), "scope_key", "kind", T.search_text())
    return picked.mapInArrow(read, f"key {key_type}, scope_key string, kind string, tokens array<long>, v array<double>")


def scaled(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids, v, _ = _indexed(text)
    v = v.astype(float)
    return ids, v / (np.sqrt(v @ v) or 1.0)


#: Tokens of an input that are looked up beyond the fewest: each asks for one more token in common before a pair counts as a candidate.
BEYOND = 2


def _in_group(a: DataFrame) -> DataFrame:
    """The tokens of ``features``, one hash each of scope, kind and token: those of other groups are others. Where two hashes are equal, a pair too many is compared."""
    return a.select("key", "scope_key", "kind", F.explode("tokens").alias("x")).select("key", F.xxhash64("scope_key", "kind", "x").alias("x"))


def rarest_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """The key of inputs ``a``, their tokens (``_in_group``) in order of the number of records in ``b`` (both ``features``) of the same scope and kind that have them, and ``unmet``, how many
    at the head no record has. What all records of a group share, as the kind's and scope's own names, comes last."""
    df = _in_group(b).groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = _in_group(a).join(df, "x", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "x"))).alias("ts"), F.count_if(F.col("df").isNull()).cast("int").alias("unmet"))
    return ranked.select("key", F.transform("ts", lambda t: t.x).alias("tokens"), "unmet")


def candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(ord, id) of inputs ``a`` (of ``rarest_first``) and records ``b`` of the same scope and kind that may share a part ``least`` of the input's tokens.

    A record that shares a part t of an input's n tokens lacks at most n - ceil(t * n) of them. So an input is looked up by its rarest tokens, that many, one, and
    ``BEYOND`` more, and a pair needs ``BEYOND + 1`` of them. Frequent tokens are looked up only where an input has little else.
    """
    held = _in_group(b).withColumnRenamed("key", "id")
    n = F.size("tokens")
    need = F.ceil(n * F.lit(least) - 1e-9).cast("int")
    size = F.least(n, n - need + 1 + BEYOND)
    looked_up = F.slice("tokens", F.col("unmet") + 1, F.greatest(size - F.col("unmet"), F.lit(0)))
    asked = a.select(F.col("key").alias("ord"), (need - (n - size)).alias("common"), F.explode(looked_up).alias("x"))
    met = asked.join(held, "x")
    return met.groupBy("ord", "id", "common").agg(F.count(F.lit(1)).alias("met")).filter("met >= common").select("ord", "id")


#: Rows of a side that meet in one block of a scope and kind, inputs of them that are compared at once, tokens that are counted at once, and links of a block that are held before they are given on.
BLOCK_ROWS, SLICE_ROWS, COUNTED, HELD = 12_288, 256, 1 << 21, 50_000
#: Bits that stand for a record's tokens when the tokens in common are bounded, and what bounds may lack by their single precision.
BITS, SLACK = 2048, 1e-5
#: About what steps cost in nanoseconds, by which a way to count is chosen: an entry of a token's list of records, a pair's sets of bits, a token of a record.
LISTED, PAIRED, READ = 2, 150, 10


def _parts(df: DataFrame) -> int:
    """Partitions for work that grows faster than its rows: as many as are set, so that few bytes don't bring much of it together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _met(inputs: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    """Inputs (side 0) and records (side 1) dealt into blocks in which each input meets each record of its scope and kind once: scope_key, kind, i, j, side, ord, id, born, whole, text.

    A side of a scope and kind is cut into pieces of about ``BLOCK_ROWS`` rows; texts are dealt, so a block's words and vectors are made where they are compared and pairs
    are never shuffled.
    """
    a = inputs.select("scope_key", "kind", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("born"), (F.col("whole") if "whole" in inputs.columns else F.lit(False)).alias("whole"), T.search_text().alias("text"))
    born = F.unix_micros("created_at") if "created_at" in records.columns else F.lit(0).cast("long")
    b = records.select("scope_key", "kind", F.lit(None).cast("long").alias("ord"), F.col(id_col).cast("string").alias("id"), born.alias("born"), F.lit(False).alias("whole"), T.search_text().alias("text"))
    pieces = lambda df, n: df.groupBy("scope_key", "kind").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(n))
    sizes = storage.written(pieces(inputs, "ni").join(pieces(records, "nj"), ["scope_key", "kind"]).coalesce(1), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    piece = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    names = ["scope_key", "kind", "i", "j", "side", "ord", "id", "born", "whole", "text"]
    left = a.join(sizes, ["scope_key", "kind"]).withColumn("i", piece("ord", "ni")).withColumn("j", every("nj")).withColumn("side", F.lit(0)).select(*names)
    right = b.join(sizes, ["scope_key", "kind"]).withColumn("j", piece("id", "nj")).withColumn("i", every("ni")).withColumn("side", F.lit(1)).select(*names)
    block = ["scope_key", "kind", "i", "j"]
    return left.unionAll(right).repartition(_parts(inputs), *block).sortWithinPartitions(*block, "side")


def token_sets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text the sorted ids of its distinct tokens and its hashed vector, as ``search.index`` has them but with ids of another kind.

    New words never end, so none is looked up: words of all texts are runs between blanks in one array of UTF-16 units, and a step of both hashes goes over all of them.
    """
    parts, short = [], []
    for text in texts:
        low = text.lower()
        try:
            parts.append(np.frombuffer((low.encode("latin-1") + b" ").translate(LATIN), np.uint8).astype(np.uint16))
            short.append(1)
        except UnicodeEncodeError:
            parts.append(np.frombuffer((" ".join(words(text)) + " ").encode("utf-16-le", "surrogatepass"), "<u2"))
            short.append(0)
    units = np.concatenate(parts)
    ends_of = np.cumsum([len(x) for x in parts])
    edge = np.flatnonzero(np.diff((units != 32).astype(np.int8), prepend=0))
    start, size = edge[::2], edge[1::2] - edge[::2]
    of = np.searchsorted(ends_of, start, "right")
    token = size > np.array(short)[of]
    start, size, of = start[token], size[token], of[token]
    h, wide = np.full(len(start), 2166136261, np.uint32), np.full(len(start), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(np.minimum(size, LONG_WORD + 1).astype(np.int16), kind="stable")[::-1]
    at, left = start[order], size[order]
    long = int(np.searchsorted(-left, -LONG_WORD))
    for k in range(long):  # one by one
        x, y = 2166136261, 0xCBF29CE484222325
        for u in units[at[k] : at[k] + left[k]].tolist():
            x, y = ((x ^ u) * 16777619) & 0xFFFFFFFF, ((y ^ u) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        h[k], wide[k] = x, y
    at, left, low_, high = at[long:], left[long:], h[long:], wide[long:]
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step))  # as many as are longer
        u = units[at[:n] + step]
        low_[:n] = (low_[:n] ^ u) * np.uint32(16777619)
        high[:n] = (high[:n] ^ u) * np.uint64(0x100000001B3)
    hashed, ids = h.astype(np.int64), np.empty(len(wide), np.int64)
    vectors = np.bincount(of[order] * DIMS + hashed % DIMS, 1.0 - 2 * (hashed % 2), len(texts) * DIMS).astype(np.float32).reshape(-1, DIMS)
    ids[order] = wide.view(np.int64)
    sets = [np.sort(x) for x in np.split(ids, np.searchsorted(of, np.arange(1, len(texts))))]
    return [x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x for x in sets], vectors


class Side:
    """The rows of one side of a block: keys, and in flat arrays the tokens, the hashed vectors and a set of bits for the tokens."""

    def __init__(self, known: dict[bytes, tuple]):
        self.known = known  # what is made of a text, by its digest: copies and texts of both sides are read once
        self.keys: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []

    def add(self, keys: list[tuple], texts: list[str]) -> None:
        for lo in range(0, len(texts), SLICE_ROWS):
            part = texts[lo : lo + SLICE_ROWS]
            marks = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in part]
            new = {m: t for m, t in zip(marks, part) if m not in self.known}
            ids, vectors = token_sets([*new.values()]) if new else ([], np.zeros((0, DIMS), np.float32))
            self.known.update(zip(new, zip(ids, vectors)))
            self.tokens += [self.known[m][0] for m in marks]
            self.vectors.append(np.stack([self.known[m][1] for m in marks]))
        self.keys += keys

    def ready(self) -> None:
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.tokens)
        self.v = np.concatenate(self.vectors)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.v, self.v, dtype=float))
        self.scale = (1 / np.where(self.norm > 0, self.norm, 1)).astype(np.float32)
        self.bits = _bits(self.flat, np.repeat(np.arange(len(self.size)), self.size), len(self.size))
        self.spare = self.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)  # tokens that share their bit with another
        self.tokens, self.vectors, self.known = [], [], {}


def _bits(tokens: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A set of ``BITS`` bits for each of ``n`` rows of tokens."""
    out = np.zeros((n, BITS // 8), np.uint8)
    bit = (tokens & (BITS - 1)).astype(np.int64)
    np.bitwise_or.at(out.reshape(-1), row * (BITS // 8) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return out.view(np.uint64)


def _spans(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive places whose sizes sum to ``most`` about, one at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


class Meeting:
    """The inputs and records of one block; ``keep`` says what is given on: all pairs, each input's best one (all of inputs marked whole), or links enough to join what similarity joins.

    The cosines of all pairs are made as matrices. They bound the similarity, as the overlap is at most 1 and at most the record's share of tokens, and sets of bits bound the overlap; only pairs that may still
    count (from the cut on, better than the input's best one so far, or not joined yet) have their tokens counted.
    """

    def __init__(self, cut: float, keep: str):
        self.cut, self.keep = cut, keep
        known: dict[bytes, tuple] = {}
        self.a, self.b = Side(known), Side(known)
        self.out: list[tuple] = []

    def pairs(self) -> Iterator[pa.RecordBatch]:
        a, b = self.a, self.b
        if a.keys and b.keys:
            a.ready(), b.ready()
            self.listed()
            self.whole = np.array([w for _, w in a.keys])
            self.best: list[tuple | None] = [None] * len(a.keys)
            self.parent = np.arange(len(a.keys) + len(b.keys))
            order = np.argsort(a.size, kind="stable")
            for lo in range(0, len(order), SLICE_ROWS):
                self.slice(order[lo : lo + SLICE_ROWS])
                if len(self.out) >= HELD:
                    yield self.batch()
            self.out += [x[1] for x in self.best if x is not None]
        yield self.batch()

    def slice(self, at: np.ndarray) -> None:
        """Some inputs against all records."""
        a, b = self.a, self.b
        cosine = (a.v[at] @ b.v.T) * a.scale[at, None] * b.scale
        bound = np.minimum(b.size.astype(np.float32) / np.maximum(a.size[at, None], 1).astype(np.float32), 1) * 0.5 + (cosine + 1) * 0.25
        bound[a.size[at] == 0] = 0
        if self.keep == "links":
            for floor in (max(IGNORED, self.cut), self.cut):
                joined = self.parent[at][:, None] == self.parent[None, len(a.keys) :]
                self.join(*self.counted(at, *np.nonzero((bound >= floor - SLACK) & ~joined), cosine, np.full(len(at), self.cut)))
            return
        floor = np.full(len(at), self.cut)
        if self.keep == "best":
            first = self.counted(at, np.arange(len(at)), bound.argmax(1), cosine, floor)
            self.better(*first)
            floor[[k for k in range(len(at)) if not self.whole[at[k]] and self.best[at[k]] is not None]] = [self.best[k][0][0] for k in at.tolist() if not self.whole[k] and self.best[k] is not None]
        found = self.counted(at, *np.nonzero(bound >= (floor - SLACK)[:, None]), cosine, floor)
        (self.better if self.keep == "best" else self.give)(*found)

    def listed(self) -> None:
        """Numbers of the block's tokens in place of their ids, and of each token the records that have it."""
        a, b = self.a, self.b
        every = np.concatenate([a.flat, b.flat])
        order = np.argsort(every)
        every = every[order]
        number = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]), dtype=np.int32)
        ids = np.empty(len(every), np.int32)
        ids[order] = number
        a.flat, b.flat = ids[: len(a.flat)], ids[len(a.flat) :]
        theirs = order >= len(a.flat)
        self.have = np.repeat(np.arange(len(b.size)), b.size)[order[theirs] - len(a.flat)]
        ends = np.cumsum(np.bincount(number[theirs], minlength=int(number[-1]) + 1))
        self.ends = np.concatenate([[0], ends])
        had = np.concatenate([[0], np.cumsum(np.diff(self.ends)[a.flat])])
        self.entries = had[a.start + a.size] - had[a.start]
        self.mark = np.zeros(len(ends), bool)

    def counted(self, at: np.ndarray, i: np.ndarray, r: np.ndarray, cosine: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs (place in the slice, in order, and record) that may reach their input's floor those from the cut on: input, record, overlap, similarity."""
        a, b = self.a, self.b
        lists = LISTED * self.entries[at]
        kept = [np.flatnonzero((easy := lists < PAIRED * np.bincount(i, minlength=len(at)))[i])]
        hard = np.flatnonzero(~easy[i])
        for lo in range(0, len(hard), 1 << 13):
            k = hard[lo : lo + (1 << 13)]
            x, y = i[k], r[k]
            met = np.bitwise_count(a.bits[at[x]] & b.bits[y]).sum(1, dtype=np.int64) + a.spare[at[x]]
            kept.append(k[np.minimum(met / np.maximum(a.size[at[x]], 1), 1) * 0.5 + (cosine[x, y] + 1) * 0.25 >= floor[x] - SLACK])
        kept = np.sort(np.concatenate(kept))
        i, r = i[kept], r[kept]
        n = np.zeros(len(i), np.int64)
        read = READ * np.bincount(i, b.size[r], minlength=len(at))
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
            x = at[i[lo]]
            mine = a.flat[a.start[x] : a.start[x] + a.size[x]]
            if lists[i[lo]] < read[i[lo]]:
                n[lo:hi] = np.bincount(np.concatenate([self.have[p:q] for p, q in zip(self.ends[mine].tolist(), self.ends[mine + 1].tolist())]), minlength=len(b.size))[r[lo:hi]]
                continue
            self.mark[mine] = True
            for part in _spans(b.size[r[lo:hi]], COUNTED):
                y = r[lo:hi][part]
                ends = np.cumsum(b.size[y])
                hit = self.mark[b.flat[np.repeat(b.start[y] - (ends - b.size[y]), b.size[y]) + np.arange(ends[-1])]]
                sums = np.concatenate([[0], np.cumsum(hit)])
                n[lo:hi][part] = sums[ends] - sums[ends - b.size[y]]
            self.mark[mine] = False
        overlap = n / np.maximum(a.size[at[i]], 1)
        near = np.flatnonzero(overlap * 0.5 + (cosine[i, r] + 1) * 0.25 >= floor[i] - SLACK)
        i, r, n, overlap = at[i[near]], r[near], n[near], overlap[near]
        dot = np.concatenate([[0.0], *(np.einsum("ij,ij->i", a.v[i[lo : lo + (1 << 13)]], b.v[r[lo : lo + (1 << 13)]], dtype=float) for lo in range(0, len(i), 1 << 13))])[1:]
        length = a.norm[i] * b.norm[r]
        s = 0.5 * overlap + 0.5 * np.clip((np.divide(dot, length, out=np.zeros(len(i)), where=length > 0) + 1) / 2, 0, 1)
        ok = (s >= self.cut - 1e-12) & (n > 0)
        return i[ok], r[ok], overlap[ok], s[ok]

    def row(self, i: int, r: int, o: float, s: float) -> tuple:
        return (self.a.keys[i][0], self.b.keys[r][0], o, s, self.b.keys[r][1])

    def give(self, i, r, o, s) -> None:
        self.out += map(self.row, i.tolist(), r.tolist(), o.tolist(), s.tolist())

    def better(self, i, r, o, s) -> None:
        for x in zip(i.tolist(), r.tolist(), o.tolist(), s.tolist()):
            if self.whole[x[0]]:
                self.out.append(self.row(*x))
                continue
            id_, born = self.b.keys[x[1]]
            rank, held = (round(x[3], 12), born is not None, -(born or 0)), self.best[x[0]]
            if held is None or rank > held[0] or (rank == held[0] and id_ < held[1][1]):
                self.best[x[0]] = rank, self.row(*x)

    def join(self, i, r, o, s) -> None:
        root = self.parent.tolist()

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for x in zip(i.tolist(), r.tolist(), o.tolist(), s.tolist()):
            p, q = top(x[0]), top(len(self.a.keys) + x[1])
            if p != q:
                root[max(p, q)] = min(p, q)
                self.out.append(self.row(*x))
        self.parent = np.array(root)
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up

    def batch(self) -> pa.RecordBatch:
        cols, self.out = list(zip(*self.out)) or [()] * 5, []
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["ord", "id", "overlap", "similarity", "born"])


def _similar(inputs: DataFrame, records: DataFrame, cut: float, keep: str = "all", id_col: str = "id") -> DataFrame:
    """(ord, id, overlap, similarity, born) of inputs and records with the same scope and kind, from ``cut`` on; of them what ``keep`` says (``Meeting``), by block."""
    if 2 * cut - 1 <= 0:
        raise ValueError("a cut of one half or less would admit pairs without a common token")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            block = list(zip(*(b.column(k).to_pylist() for k in range(5))))
            starts = [k for k in range(len(block)) if k == 0 or block[k] != block[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(block)]):
                key, side = block[lo][:4], block[lo][4]
                if key != at:
                    if state is not None:
                        yield from state.pairs()
                    at, state = key, Meeting(cut, keep)
                ords, ids, born, whole, texts = (b.column(k).slice(lo, hi - lo).to_pylist() for k in range(5, 10))
                if side == 0:
                    state.a.add([*zip(ords, whole)], texts)
                elif state.a.keys:
                    state.b.add([*zip(ids, born)], texts)
        if state is not None:
            yield from state.pairs()

    return _met(inputs, records, id_col).mapInArrow(read, "ord long, id string, overlap double, similarity double, born long")


def similarities(inputs: DataFrame, records: DataFrame, cut: float, id_col: str = "id") -> DataFrame:
    """(ord, id, overlap, similarity) of inputs (ord, ...) and records with the same scope and kind, from ``cut`` on."""
    return _similar(inputs, records, cut, "all", id_col).drop("born")


def best_candidates(inputs: DataFrame, records: DataFrame, cuts: list[float], every: DataFrame | None = None) -> DataFrame:
    """The most similar record of each input from the last of the falling ``cuts`` on (of equal ones the oldest): ord, id, similarity, and, for inputs in ``every`` (ord), ``found``, all ids from there on.

    A block gives one record an input, so what is shuffled after the comparison is no more than the rows that were compared.
    """
    if every is not None:
        inputs = inputs.join(every.select("ord", F.lit(True).alias("whole")), "ord", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    pairs = _similar(inputs, records, cuts[-1], "best")
    g = pairs.groupBy("ord").agg(F.max_by(F.struct("id", "similarity"), F.struct(F.round("similarity", 12), -F.col("born"))).alias("b"), F.collect_set("id").alias("found"))
    found = F.lit(None).cast("array<string>").alias("found")
    if every is None:
        return storage.written(g.select("ord", "b.id", "b.similarity", found), "best")
    return storage.written(g.join(every.select("ord", F.lit(True).alias("whole")).distinct(), "ord", "left").select("ord", "b.id", "b.similarity", F.when(F.col("whole"), F.col("found")).alias("found")), "best")


def candidate_cut(mode: str, threshold: float = THRESHOLD) -> float:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return CANDIDATE_SHARE * threshold if mode == "threshold" else EVALUATED


def decisions(inputs: DataFrame, records: DataFrame, mode: str = "threshold", threshold: float = THRESHOLD, prefix: int = 80) -> DataFrame:
    """What becomes of each input: ord, action (add, ignore, update, contradict), target, similarity.

    threshold: the best candidate from ``threshold`` on is overwritten. rules: ignore from 0.95, from 0.75 contradict where the input
    marks a change of state and shares 0.3 of its content's tokens, else update. conservative: ignore from 0.95, or where a candidate
    shares the head of a text with front matter.
    """
    cut = candidate_cut(mode, threshold)
    top = max(cut, threshold if mode == "threshold" else IGNORED)
    head = F.substring(T.normalize("content"), 1, prefix)
    front = F.startswith(T.trim("content"), F.lit("---")) & (F.length(head) >= prefix)
    every = inputs.filter(front).select("ord") if mode == "conservative" else None
    best = best_candidates(inputs, records, [top, cut], every)
    j = inputs.select("ord", "content").join(best.select("ord", F.col("id").alias("target"), "similarity"), "ord", "left")
    s = F.coalesce("similarity", F.lit(0.0))
    if mode == "threshold":
        action = F.when(s >= threshold, "update").otherwise("add")
    elif mode == "rules":
        j = j.join(records.select(F.col("id").alias("target"), F.col("content").alias("old")), "target", "left")
        changed = F.col("content").rlike(T.TEMPORAL) & (T.overlap(T.unique_tokens("content"), T.unique_tokens("old")) >= 0.3)
        action = F.when(s >= IGNORED, "ignore").when((s >= 0.75) & changed, "contradict").when(s >= 0.75, "update").otherwise("add")
    else:
        seen = best.select("ord", F.explode("found").alias("id")).join(records.select("id", F.substring(T.normalize("content"), 1, prefix).alias("head")), "id")
        same = inputs.filter(front).select("ord", head.alias("head")).join(seen, ["ord", "head"]).select("ord", F.lit(True).alias("same")).distinct()
        j = j.join(same, "ord", "left")
        action = F.when(s >= IGNORED, "ignore").when(F.col("same"), "ignore").otherwise("add")
    return j.select("ord", action.alias("action"), F.when(action != "add", F.col("target")).alias("target"), "similarity")


def remembered(inputs: DataFrame, records: DataFrame, decided: DataFrame, now: Column, new_id: Column | None = None) -> DataFrame:
    """The records after the batch. Updates overwrite text and keep the greater scores, contradictions set the scores and keep the old
    text, ignored inputs leave their tags; new records get an id from their group, text and place."""
    hit = decided.filter("action <> 'add'").join(inputs.select("ord", F.col("content").alias("i_content"), F.col("importance").alias("i_importance"), F.col("confidence").alias("i_confidence"), T.tags("tags").alias("i_tags")), "ord")
    last = hit.groupBy(F.col("target").alias("id")).agg(
        F.max_by("action", F.when(F.col("action") != "ignore", F.col("ord"))).alias("act"), F.max_by("i_content", F.when(F.col("action") != "ignore", F.col("ord"))).alias("i_content"),
        F.max(F.when(F.col("action") == "update", F.coalesce("i_importance", F.lit(0.5)))).alias("up_i"), F.max(F.when(F.col("action") == "update", F.coalesce("i_confidence", F.lit(0.7)))).alias("up_c"),
        F.max_by("i_importance", F.when(F.col("action") == "contradict", F.col("ord"))).alias("con_i"), F.max_by("i_confidence", F.when(F.col("action") == "contradict", F.col("ord"))).alias("con_c"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "i_tags"))), lambda x: x.i_tags))).alias("i_tags"), F.lit(True).alias("hit"), F.max(F.when(F.col("action") == "contradict", F.col("ord"))).alias("con_ord"),
    )
    j = records.join(last, "id", "left")
    text = F.coalesce(T.trim("i_content"), F.col("content"))
    contra = F.coalesce(F.col("act") == "contradict", F.lit(False))
    old = F.when(F.col("con_ord").isNotNull(), F.col("content"))
    out = j.withColumn("previous_content", old).withColumn("summary", F.when(F.col("i_content").isNotNull(), T.summarize(text)).otherwise(F.col("summary"))).withColumn("content", text)
    out = out.withColumn("importance", T.clamp(F.when(contra, F.coalesce("con_i", F.lit(0.5))).otherwise(F.greatest("importance", F.coalesce("up_i", F.lit(0.0)))), 0, 1))
    out = out.withColumn("confidence", T.clamp(F.when(contra, F.coalesce("con_c", F.lit(0.7))).otherwise(F.greatest("confidence", F.coalesce("up_c", F.lit(0.0)))), 0.05, 1))
    out = out.withColumn("tags", F.array_union("tags", F.coalesce("i_tags", F.array().cast("array<string>")))).withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at")))
    ident = new_id if new_id is not None else F.sha2(F.concat_ws("|", "scope_key", "kind", "content", F.col("ord").cast("string")), 256)
    added = inputs.join(decided.filter("action = 'add'").select("ord"), "ord", "left_semi").select(
        ident.alias("id"), "scope_type", "scope_id", "scope_key", "kind", T.trim("content").alias("content"), F.when(F.coalesce(T.trim("summary"), F.lit("")) != "", T.trim("summary")).otherwise(T.summarize("content")).alias("summary"),
        T.clamp(F.coalesce("confidence", F.lit(0.7)), 0.05, 1).alias("confidence"), T.clamp(F.coalesce("importance", F.lit(0.5)), 0, 1).alias("importance"), T.tags("tags").alias("tags"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("previous_content"),
    )
    keep = ["id", "scope_type", "scope_id", "scope_key", "kind", "content", "summary", "confidence", "importance", "tags", "created_at", "updated_at", "previous_content"]
    return out.select(*keep).unionByName(added.select(*keep))


# -- a batch in its order


def _object(text: str | None) -> dict | None:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _strings(value) -> list[str]:
    return [x for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else []


def marked(metadata: dict | None, source: str | None, tags: list[str], given: dict | None, given_source: str | None) -> dict | None:
    """A record's metadata after an input's markers: keys that it lacks are taken over, what differs goes to ``markerHistory``, and another
    source to ``sourceHistory``; nothing that it has is lost."""
    other = bool(given_source) and given_source != source
    if given is None and not other:
        return metadata
    before = metadata or {}
    out = {**{k: v for k, v in (given or {}).items() if k not in before}, **before}
    out = {k: out[k] for k in [*before, *(k for k in given or {} if k not in before)]}
    conflict = any(k in before and json.dumps(before[k]) != json.dumps(v) for k, v in (given or {}).items())
    if other:
        history = [source, *_strings(before.get("sourceHistory")), *_strings((given or {}).get("sourceHistory")), given_source]
        out["sourceHistory"] = [*dict.fromkeys(x for x in history if x)]
    if other or conflict:
        kept = [x for x in before.get("markerHistory") or [] if isinstance(x, dict)] if isinstance(before.get("markerHistory"), list) else []
        out["markerHistory"] = [*kept, {"source": given_source or "manual", "tags": tags, "metadata": given or {}}]
    return out


def contradicted(metadata: dict | None, content: str, date: str) -> dict:
    """A record's metadata after a contradiction: the old content and an entry in the changelog, all else as it was."""
    before = metadata or {}
    log = before["changelog"] if isinstance(before.get("changelog"), list) else []
    return {**before, "contradicted": True, "previousContent": content, "changelog": [*log, {"date": date, "action": "contradict", "reason": "contradicted by a later input; the content before is kept"}]}


def _summary(content: str) -> str:
    s = _folded(content)
    return s if len(s) <= 120 else s[:117] + "..."


def _folded(text: str) -> str:
    return regex.sub(f"{T.WS}+", " ", text).strip(T.BLANKS)


def _tags(tags: list[str] | None) -> list[str]:
    return [*dict.fromkeys(x for x in (_folded(t.lower()) for t in tags or ()) if x)]


def _clamp(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


ROW = ["id", "scope_type", "scope_id", "scope_key", "kind", "content", "summary", "confidence", "importance", "source", "tags", "metadata", "created_at", "updated_at"]


class Fold:
    """The records of one group while inputs are written to it in their order; what similarity needs of them is held in arrays, in which a write finds its best record as in a block (``Meeting``)."""

    def __init__(self, mode: str, threshold: float, prefix: int, now: datetime):
        self.mode, self.threshold, self.prefix, self.now = mode, threshold, prefix, now
        self.cut = candidate_cut(mode, threshold)
        self.temporal = regex.compile(T.TEMPORAL)
        self.rows: list[dict] = []
        self.tokens: list[np.ndarray] = []
        self.kinds: dict[tuple, int] = {}
        self.v, self.norm, self.size, self.of = np.zeros((64, DIMS), np.float32), np.zeros(64), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.mark = np.zeros(1 << 16, bool)

    @staticmethod
    def text(r: dict) -> str:
        return "\n".join(x for x in (r["kind"], r["summary"], r["content"], " ".join(r["tags"] or ()), r["scope_type"], r["scope_id"]) if x)

    def made(self, rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The tokens and vectors of some rows at once, as ``put`` and ``write`` take them."""
        return [*zip(*token_sets([self.text(r) for r in rows]))]

    def put(self, r: dict, at: int | None = None, made: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        ids, v = made or self.made([r])[0]
        if at is None:
            at = len(self.rows)
            self.rows.append(r), self.tokens.append(ids)
            if at == len(self.v):
                self.v, self.norm, self.size, self.of = (np.concatenate([x, np.zeros_like(x)]) for x in (self.v, self.norm, self.size, self.of))
        self.tokens[at], self.v[at], self.size[at] = ids, v, len(ids)
        self.norm[at] = np.sqrt(np.square(v, dtype=float).sum())
        self.of[at] = self.kinds.setdefault((r["scope_key"], r["kind"]), len(self.kinds))

    def candidates(self, r: dict, every: bool = True, made: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[float, int]]:
        """The records of the input's scope and kind from the cut on, the most similar first; all of them, or some with the first."""
        ids, v = made or self.made([r])[0]
        n, kind = len(self.rows), self.kinds.get((r["scope_key"], r["kind"]))
        if kind is None or not len(ids):
            return []
        norm = np.sqrt(np.square(v, dtype=float).sum())
        length = self.norm[:n] * norm
        cosine = np.divide(self.v[:n] @ v, length, out=np.zeros(n), where=length > 0)
        bound = np.where(self.of[:n] == kind, 0.5 * np.minimum(self.size[:n] / len(ids), 1) + 0.25 * (cosine + 1), -1)

        def exact(at: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(at))
            for part in _spans(self.size[at], COUNTED):
                theirs, sizes = np.concatenate([self.tokens[k] for k in at[part].tolist()]), self.size[at[part]]
                like = np.flatnonzero(self.mark[theirs & 0xFFFF])
                hit = like[ids[np.minimum(np.searchsorted(ids, theirs[like]), len(ids) - 1)] == theirs[like]]
                sums[part] = np.bincount(np.searchsorted(np.cumsum(sizes), hit, "right"), minlength=len(sizes))
            dot = self.v[at].astype(float) @ v.astype(float)
            return 0.5 * (sums / len(ids)) + 0.5 * np.clip((np.divide(dot, length[at], out=np.zeros(len(at)), where=length[at] > 0) + 1) / 2, 0, 1)

        self.mark[ids & 0xFFFF] = True
        floor = self.cut if every else max(self.cut, float(exact(bound.argmax()[None])[0]))
        at = np.flatnonzero(bound >= floor - SLACK)
        s = exact(at)
        self.mark[ids & 0xFFFF] = False
        out = [(x, k) for x, k in zip(s.tolist(), at.tolist()) if x >= self.cut - 1e-12]
        return sorted(out, key=lambda x: (-round(x[0], 12), x[1]))

    def action(self, r: dict, found: list[tuple[float, int]]) -> str:
        s, best = found[0]
        if self.mode == "threshold":
            return "update" if s >= self.threshold else "add"
        if s >= IGNORED:
            return "ignore"
        if self.mode == "conservative":
            head = _folded(r["content"].lower())[: self.prefix]
            heads = {_folded(self.rows[i]["content"].lower())[: self.prefix] for _, i in found}
            return "ignore" if r["content"].strip(T.BLANKS).startswith("---") and len(head) >= self.prefix and head in heads else "add"
        if s < 0.75:
            return "add"
        if not self.temporal.search(r["content"]):
            return "update"
        mine, theirs = ({*scaled(x)[0].tolist()} for x in (r["content"], self.rows[best]["content"]))
        return "contradict" if mine and len(mine & theirs) / len(mine) >= 0.3 else "update"

    def write(self, r: dict, made: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        found = self.candidates(r, self.mode == "conservative" and r["content"].strip(T.BLANKS).startswith("---"), made)
        action = self.action(r, found) if found else "add"
        importance, confidence = (d if r[k] is None else r[k] for k, d in (("importance", 0.5), ("confidence", 0.7)))
        tags, given, source = _tags(r["tags"]), _object(r["metadata"]), (r["source"] or "").strip(T.BLANKS) or None
        content = r["content"].strip(T.BLANKS)
        summary = (r["summary"] or "").strip(T.BLANKS) or _summary(content)
        if action == "add":
            new = {**r, "content": content, "summary": summary, "confidence": _clamp(confidence, 0.05, 1), "importance": _clamp(importance, 0, 1), "source": source or "manual", "tags": tags, "created_at": self.now, "updated_at": self.now}
            self.put(new)
            return
        at = found[0][1]
        old = self.rows[at]
        meta = _object(old["metadata"])
        if action == "contradict":
            meta = contradicted(meta, old["content"], self.now.strftime("%Y-%m-%dT%H:%M:%S.000Z"))
            old.update(importance=_clamp(importance, 0, 1), confidence=_clamp(confidence, 0.05, 1))
        elif action == "update":
            old.update(importance=_clamp(max(old["importance"], importance), 0, 1), confidence=_clamp(max(old["confidence"], confidence), 0.05, 1))
        if action != "ignore":
            old.update(content=content, summary=summary if self.mode == "threshold" else _summary(content))
        after = marked(meta, old["source"], tags, given, source)
        if action == "contradict" or after is not meta:
            old["metadata"] = json.dumps(after, ensure_ascii=False, separators=(",", ":"))
        old.update(tags=[*dict.fromkeys([*(old["tags"] or ()), *tags])], updated_at=self.now)
        self.put(old, at)


def remember(inputs: DataFrame, records: DataFrame, now: Column, mode: str = "threshold", threshold: float = THRESHOLD, prefix: int = 80) -> DataFrame:
    """The records (columns of ``ROW``) after the inputs (ord, and the columns of a record; id, times and null scores are made) were written one after the other.

    Equal texts are one node while links are looked for, so copies link nothing but themselves. A group's rows are streamed in order; its
    records are held. Records are looked up in the order of their creation, new ones last. Links go by the texts as they are
    given and stored: tags and texts that a write moves from one input to a record count within a group only.
    """
    cut = candidate_cut(mode, threshold)
    for c, kind in (("source", "string"), ("metadata", "string"), ("importance", "double"), ("confidence", "double"), ("summary", "string")):
        inputs = inputs if c in inputs.columns else inputs.withColumn(c, F.lit(None).cast(kind))
    inputs = inputs.withColumn("scope_key", T.scope_key()).withColumn("mark", F.sha2(F.concat_ws("|", T.scope_key(), "kind", T.search_text()), 256))
    inputs = storage.written(inputs.withColumn("id", F.sha2(F.concat_ws("|", "scope_key", "kind", "content", F.col("ord").cast("string")), 256)), "batch")
    first = storage.written(inputs.groupBy("mark").agg(F.min_by(F.struct("ord", "scope_type", "scope_id", "scope_key", "kind", "content", "summary", "tags"), "ord").alias("r"), F.count(F.lit(1)).alias("n")).select("mark", "n", "r.*"), "texts")
    node = F.concat(F.lit("i:"), "ord")
    texts = ("scope_type", "scope_id", "scope_key", "kind", "content", "summary", "tags")
    both = records.select(F.concat(F.lit("r:"), "id").alias("id"), *texts).unionByName(first.select(node.alias("id"), *texts))
    met = _similar(first, both, cut, "links").select(node.alias("u"), F.col("id").alias("v"))
    copies = first.filter("n > 1").select(node.alias("u"), F.concat(F.lit("c:"), "ord").alias("v"))
    linked = storage.written(groups(met.unionAll(copies)), "groups")

    of_inputs = inputs.join(first.select("mark", node.alias("node")), "mark").join(linked, "node", "left")
    of_records = records.select(*ROW).join(linked.filter("node like 'r:%'").select(F.substring("node", 3, 1 << 20).alias("id"), "group"), "id", "left")
    when = now.cast("timestamp")
    order = F.struct(F.col("ord").isNotNull().alias("input"), F.col("ord"), F.when(F.col("ord").isNull(), F.col("created_at")).alias("at"), "id")
    times = [F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "updated_at")]
    rows = of_records.filter("group is not null").select("group", F.lit(None).cast("long").alias("ord"), *ROW).unionByName(of_inputs.filter("group is not null").select("group", F.col("ord").cast("long"), *[c for c in ROW if not c.endswith("_at")], *times)).withColumn("now", when)
    schema = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in ROW)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kinds = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                for lo in range(0, len(state.rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in state.rows[lo : lo + 500]], kinds.field(c).type) for c in ROW], ROW)

        for b in batches:
            kinds = b.schema
            listed = b.to_pylist()
            for lo in range(0, len(listed), SLICE_ROWS):
                part = listed[lo : lo + SLICE_ROWS]
                for r, made in zip(part, zip(*token_sets([Fold.text(r) for r in part]))):
                    if r["group"] != at:
                        yield from done()
                        at, state = r["group"], Fold(mode, threshold, prefix, r["now"])
                    row = {c: r[c] for c in ROW}
                    if r["ord"] is None:
                        state.put(row, made=made)
                    else:
                        state.write(row, made)
        yield from done()

    folded = rows.repartition(_parts(rows), "group").sortWithinPartitions("group", order).mapInArrow(fold, schema)
    alone = of_inputs.filter("group is null")
    source = F.coalesce(F.when(T.trim("source") != "", T.trim("source")), F.lit("manual"))
    added = alone.select(
        "id", "scope_type", "scope_id", "scope_key", "kind", T.trim("content").alias("content"), F.when(F.coalesce(T.trim("summary"), F.lit("")) != "", T.trim("summary")).otherwise(T.summarize("content")).alias("summary"),
        T.clamp(F.coalesce("confidence", F.lit(0.7)), 0.05, 1).alias("confidence"), T.clamp(F.coalesce("importance", F.lit(0.5)), 0, 1).alias("importance"), source.alias("source"), T.tags("tags").alias("tags"), "metadata", when.alias("created_at"), when.alias("updated_at"),
    )
    return of_records.filter("group is null").select(*ROW).unionByName(folded).unionByName(added)

"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words is one window).
A document contains a window only if it contains all of the window's shingles, so one necessary shingle is enough as
the join prefix: the rarest, by document frequency over the whole corpus. Documents are matched on prefix
shingles, candidates must satisfy the length and positional bounds (the window must fit around the shingle's
place), and what is left is compared word by word.

A benchmark of at most ``BLOCK_BYTES`` of text goes to all executors as one index, and documents aren't shuffled. A larger one stays
distributed, and the same join is made by shuffles: windows and their shingles are tables, a bitmap of fixed size says which shingles
of a document can matter, frequencies are counted, prefixes chosen and candidates found by equi-joins on shingle hashes, and
candidates meet their documents for the check of bounds and words. Results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common
from engram.llm.shingles import mix, word_hashes

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4_000_000
#: Bits of the filter for the shingles of a distributed benchmark (16 MB).
FILTER_BITS = 27
#: Lower-cases A-Z and turns all that is no word character into spaces: words are of [0-9a-z] and non-ASCII bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of one block of items, with vocabulary, shingles and a shingle's place in its windows."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW, shingle: int = SHINGLE):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        owners: list[set] = []
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text or b"")]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                key = tuple(ids[i : i + window])
                if key not in seen:
                    seen[key] = len(owners)
                    owners.append(set())
                owners[seen[key]].add(item)
        self.owners = owners
        self.words = [*seen]
        self.base = len(self.vocab) + 1
        assert self.base < 1 << 21  # BLOCK_BYTES hold fewer different words, so three fit a key
        #: By shingle length: sorted keys of all shingles.
        self.q = {w: min(shingle, len(k)) for w, k in enumerate(self.words)}
        self.keys = {q: np.unique([self.key(k[o : o + q]) for w, k in enumerate(self.words) if self.q[w] == q for o in range(len(k) - q + 1)]).astype(np.int64) for q in sorted({*self.q.values()})}

    def key(self, ids) -> int:
        return reduce(lambda k, i: k * self.base + i + 1, ids, 0)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words], np.int64)

    def shingles(self, ids: np.ndarray, q: int) -> np.ndarray:
        """The key of the ``q`` words from each place on; 0 where one of them is unknown."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for o in range(q):
            part = ids[o : o + n]
            key = key * self.base + part + 1
            known &= part >= 0
        return np.where(known, key, 0)

    def found(self, ids: np.ndarray, q: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places with a shingle of the sorted ``table``, and its row there."""
        keys = self.shingles(ids, q)
        places = np.flatnonzero(keys)
        rows = np.searchsorted(table, keys[places])
        hit = (rows < len(table)) & (table[np.minimum(rows, len(table) - 1)] == keys[places])
        return places[hit], rows[hit]

    def choose(self, df: dict[tuple[int, int], int]) -> None:
        """The prefix: for each window its rarest shingle (ties: the smaller key, then the first place)."""
        groups: dict[int, dict[int, list[tuple[int, int]]]] = {q: {} for q in self.keys}
        for w, k in enumerate(self.words):
            q = self.q[w]
            _, key, o = min((df.get((q, key := self.key(k[o : o + q])), 0), key, o) for o in range(len(k) - q + 1))
            groups[q].setdefault(key, []).append((w, o))
        self.prefix = {}
        for q, g in groups.items():
            keys = sorted(g)
            ends = np.cumsum([0, *(len(g[k]) for k in keys)])
            flat = np.array([x for k in keys for x in g[k]], np.int64).reshape(-1, 2)
            self.prefix[q] = np.array(keys, np.int64), ends, flat[:, 0], flat[:, 1]
        self.sizes = np.array([len(k) for k in self.words], np.int64)
        self.table = np.full((len(self.words), self.window), -2, np.int64)
        for w, k in enumerate(self.words):
            self.table[w, : len(k)] = k

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur in a document and where they start: candidates by prefix, bounds, exact check."""
        out_w, out_s, n = [], [], len(ids)
        for q, (keys, ends, wins, offs) in self.prefix.items():
            places, rows = self.found(ids, q, keys)
            if not len(places):
                continue
            counts = ends[rows + 1] - ends[rows]
            at = np.repeat(places, counts)
            entry = np.repeat(ends[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            win, start = wins[entry], at - offs[entry]
            size = self.sizes[win]
            ok = (start >= 0) & (start + size <= n)
            win, start, size = win[ok], start[ok], size[ok]
            for lo in range(0, len(win), 65536):
                w, s, z = win[lo : lo + 65536], start[lo : lo + 65536], size[lo : lo + 65536]
                cols = np.arange(self.window)
                same = (ids[np.minimum(s[:, None] + cols, n - 1)] == self.table[w]) | (cols >= z[:, None])
                same = same.all(1)
                out_w.append(w[same]), out_s.append(s[same])
        if not out_w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_w), np.concatenate(out_s)


def _frequencies(docs: DataFrame, text_col: str, block) -> dict[tuple[int, int], int]:
    """In how many documents each of the block's shingles occurs, over all documents; as many rows as the block has shingles."""

    def tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = block.value
        counts = {q: np.zeros(len(k), np.int64) for q, k in win.keys.items()}
        for b in rows:
            for text in b.column(0).to_pylist():
                ids = win.ids(words_of(text))
                for q, keys in win.keys.items():
                    counts[q][np.unique(win.found(ids, q, keys)[1])] += 1
        for q, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(at), pa.array(c[at])], ["q", "k", "df"])

    rows = docs.select(common.utf8(text_col).alias("text")).mapInArrow(tally, "q int, k long, df long").groupBy("q", "k").agg(F.sum("df").alias("df")).collect()
    return {(r.q, int(block.value.keys[r.q][r.k])): r.df for r in rows}


def _folded(runs: list[int], items) -> tuple[int, int, str, bool, list[int]]:
    """Hit words, number and digest of the items, contaminated, merged runs."""
    spans: list[list[int]] = []
    for s, e in sorted(zip(runs[::2], runs[1::2])):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    ids = sorted({x for x in items if x is not None})
    hit = sum(e - s for s, e in spans)
    return hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, [x for span in spans for x in span]


RESULT = [("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("runs", pa.list_(pa.int64()))]
RESULT_TYPES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, runs array<long>"


def _matched(docs: DataFrame, id_col: str, text_col: str, block) -> DataFrame:
    """For each document: words, hit places of the index's windows as runs, and the items found."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = block.value
        for b in rows:
            n_words, runs, items = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                w, s = win.matches(win.ids(words))
                n_words.append(len(words)), runs.append(_runs(len(words), s, win.sizes[w]))
                items.append([*set().union(*(win.owners[x] for x in np.unique(w)))])
            cols = zip(*map(_folded, runs, items)) if runs else [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(cols, RESULT))], [id_col, "n_words", *(n for n, _ in RESULT)])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, common.utf8(text_col).alias("text")).mapInArrow(scan, f"`{id_col}` {id_type}, {RESULT_TYPES}")


def _runs(n_words: int, start: np.ndarray, size: np.ndarray) -> list[int]:
    """Begin and end words of the maximal runs that windows at these places cover."""
    hit = np.zeros(n_words + 1, np.int64)
    np.add.at(hit, start, 1)
    np.add.at(hit, start + size, -1)
    return np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))).tolist()


# -- the same join for a benchmark of any size, by shuffles


def _hashes(words: list[bytes], q: int) -> np.ndarray:
    """64-bit hashes of the ``q`` words from each place on."""
    n = len(words) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    out = np.full(n, q, np.uint64)
    for o in range(q):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[o : o + n])
    return out


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """Each window of each item: item_id, words (joined by blanks), size."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.string()), ("words", pa.binary()), ("size", pa.int32())])
        out: dict[str, list] = {f.name: [] for f in schema}
        for b in rows:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[i : i + window]
                    for c, v in zip(out.values(), (item, b" ".join(part), len(part))):
                        c.append(v)
                    yield from common.batches(out, schema, 5000)
        yield from common.batches(out, schema)

    return items.select("item_id", "text").mapInArrow(cut, "item_id string, words binary, size int")


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """The shingles of each window: words, size, s (hash), off (place in the window)."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, s, off = [], [], []
            for i, (words, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = _hashes(words.split(b" "), min(shingle, size))
                at += [i] * len(h)
                s += h.view(np.int64).tolist()
                off += range(len(h))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(s, pa.int64()), pa.array(off, pa.int32())], ["words", "size", "s", "off"])

    return windows.select("words", "size").mapInArrow(cut, "words binary, size int, s long, off int")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits with those of the hashes' first bits set: at most 2**(FILTER_BITS - 6) rows reach the driver, whatever the benchmark."""
    bit = F.shiftrightunsigned("s", 64 - FILTER_BITS)
    rows = shingles.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(s, {64 - FILTER_BITS}) & 63))")).alias("word")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["word"]
    return out.view(np.uint64)


def _document_shingles(docs: DataFrame, bitmap, lengths: list[int], places: bool) -> DataFrame:
    """Shingles of each document that may be in the bitmap's set: (s) once for each document, or (s, row_key, place, n_words) for each place."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in rows:
            s, key, at, size = [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                for q in lengths:
                    h = _hashes(words, q)
                    top = h >> np.uint64(64 - FILTER_BITS)
                    ok = np.flatnonzero((bits[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1))
                    s.append(h[ok].view(np.int64) if places else np.unique(h[ok]).view(np.int64))
                    if places:
                        key += [k] * len(ok)
                        at.append(ok)
                        size.append(np.full(len(ok), len(words)))
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in ((s, at, size) if places else (s,))]
            yield pa.RecordBatch.from_arrays([cols[0], pa.array(key, pa.string()), *cols[1:]], ["s", "row_key", "place", "n_words"]) if places else pa.RecordBatch.from_arrays(cols, ["s"])

    return docs.select("row_key", "text").mapInArrow(scan, "s long, row_key string, place long, n_words long" if places else "s long")


def _checked(docs: DataFrame, candidates: DataFrame, id_col: str) -> DataFrame:
    """Documents with their candidates compared word by word: row_key, id, n_words, runs, found (the windows that occur)."""
    listed = candidates.groupBy("row_key").agg(F.collect_set(F.struct("start", "size", "words")).alias("todo"))
    both = docs.join(listed, "row_key", "left").select("row_key", id_col, "text", "todo")

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n_words, runs, found = [], [], []
            for text, todo in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = words_of(text)
                hit = [t for t in todo or () if b" ".join(words[t["start"] : t["start"] + t["size"]]) == t["words"]]
                n_words.append(len(words)), runs.append(_runs(len(words), np.array([t["start"] for t in hit], np.int64), np.array([t["size"] for t in hit], np.int64)))
                found.append([*{t["words"] for t in hit}])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.binary()))], ["row_key", id_col, "n_words", "runs", "found"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(check, f"row_key string, `{id_col}` {id_type}, n_words long, runs array<long>, found array<binary>")


def _shuffled(docs: DataFrame, items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The prefix-filtered join with all tables distributed."""
    spark = docs.sparkSession
    docs = common.written(docs.select(F.col(id_col), common.utf8(text_col).alias("text"), F.expr("uuid()").alias("row_key")), "docs")
    owned = common.written(_item_windows(items, window).distinct(), "item-windows")
    lengths = sorted({min(shingle, r["size"]) for r in owned.select("size").distinct().collect()})  # at most as many as a window has words
    shingles = common.written(_window_shingles(owned.select("words", "size").distinct(), shingle), "window-shingles")
    every = spark.sparkContext.broadcast(_bitmap(shingles))
    frequency = _document_shingles(docs, every, lengths, False).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "s", "off")).alias("prefix")
    prefix = shingles.join(frequency, "s", "left").groupBy("words", "size").agg(rarest).select("words", "size", "prefix.s", "prefix.off")
    prefix = common.written(prefix, "prefixes")
    chosen = spark.sparkContext.broadcast(_bitmap(prefix))
    start = F.col("place") - F.col("off")
    candidates = _document_shingles(docs, chosen, lengths, True).join(prefix, "s").withColumn("start", start)
    candidates = candidates.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))).select("row_key", "start", "size", "words")
    checked = common.written(_checked(docs, candidates, id_col), "checked")
    of_doc = checked.select("row_key", F.explode("found").alias("words")).join(owned.select("words", "item_id"), "words").groupBy("row_key").agg(F.collect_set("item_id").alias("items"))
    return checked.join(of_doc, "row_key", "left").select(id_col, "n_words", "runs", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, runs (begin and end words of each hit run).

    Null and empty texts have no words and no hits; null or empty items have no windows; items with the same
    id count as one; an item without id has windows that hit but is no item in the count. Repeated rows give repeated rows. Ids of
    items are compared and sorted as strings.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), common.utf8("text").alias("text")).filter(F.octet_length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    if total > block_bytes:
        return _summary(_shuffled(docs, items, window, SHINGLE, id_col, text_col), id_col)
    win = Windows([(r.item_id, bytes(r.text)) for r in items.orderBy("item_id", "text").collect()], window)  # bounded by block_bytes
    win.choose(_frequencies(docs, text_col, spark.sparkContext.broadcast(win)) if win.words else {})
    return _matched(docs, id_col, text_col, spark.sparkContext.broadcast(win))


def _summary(found: DataFrame, id_col: str) -> DataFrame:
    """Runs merged and items put in order: a small fold over each document's own lists."""
    id_type = found.schema[id_col].dataType.simpleString()

    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            cols = zip(*map(_folded, b.column(2).to_pylist(), b.column(3).to_pylist())) if b.num_rows else [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, t) for c, (_, t) in zip(cols, RESULT))], [id_col, "n_words", *(n for n, _ in RESULT)])

    return found.select(id_col, "n_words", "runs", "items").mapInArrow(fold, f"`{id_col}` {id_type}, {RESULT_TYPES}")

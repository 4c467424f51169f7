"""Substring dedup by repeated-phrase automata.

A word goes where a window of ``WINDOW`` words that covers it also starts in a document with a smaller id; such a document with the
smallest id of all is the window's owner.

1. Anchors. Of the ``ANCHOR``-word phrases in a window the one of least hash (the last of equals) is the window's anchor, so equal windows have
   equal anchors wherever they stand. Neighbouring windows share their anchor and make a segment. Anchors are counted; one in a single
   document repeats nothing.
2. Confirmation. Where all segments of an anchor are the same words, the smallest id owns their windows. Otherwise their windows are
   counted one by one (128 bits: anchor and window), and the smallest id owns each.
3. Automata. The passages that an owner has are dealt to shards, as often as the number of parts that ask for them needs; each shard
   compiles them into an Aho-Corasick automaton of disjoint phrases of half a window, one of which lies whole in every window. What repeats anything
   in any document is streamed through the shards of its owners. A hit is extended to both sides, word by word; 50 words or more are an
   occurrence.

So hashes only choose what is looked for, and what goes has been compared. All groups are counted with map-side combining, joins that can
meet a hot anchor or window have plain exchanges on both sides, and a passage that a third of all documents repeat is in as many shards as they fill.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm import common
from engram.llm.shingles import mix, word_hashes

WINDOW, ANCHOR = 50, 12
#: Parts that one copy of an owner's passages serves, and bytes of passages of a shard.
PARTS, SHARD_BYTES = 200, 2_000_000
#: Words of which anchors are chosen at once; hashes of equal rank below this many are told apart by place.
CHUNK_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULT = np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 4096)
        for i, x in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x)])
    return _POWERS[0][:n], _POWERS[1][:n]


class Segments:
    """Of a text's words: anchors (place, hash), the first and last window of each, and hashes of any run of words."""

    def __init__(self, words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
        self.window, n = window, len(words)
        up, self.down = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes(words) * up[:n], out=self.prefix[1:])
        grams = mix((self.prefix[anchor:] - self.prefix[: n + 1 - anchor]) * self.down[: n + 1 - anchor])
        at = least_places(grams, window - anchor + 1)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.first, self.last = begin, np.r_[begin[1:], len(at)] - 1
        self.place = at[begin]
        self.hash = grams[self.place]

    def words(self, begin, end) -> np.ndarray:
        """Hashes of the words from ``begin`` to before ``end``."""
        return mix((self.prefix[end] - self.prefix[begin]) * self.down[begin])

    def contexts(self) -> np.ndarray:
        """Hashes of all words of each segment and of where its anchor lies in them."""
        shape = (self.place - self.first).astype(np.uint64) * _MULT + (self.last - self.first).astype(np.uint64)
        return mix(self.words(self.first, self.last + self.window) ^ mix(shape))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least by its upper 44 bits, the last of equals."""
    size = 1 << CHUNK_BITS
    out = []
    for o in range(0, len(values) - width + 1, size - width + 1):
        part = values[o : o + size]
        if len(part) < width:
            break
        low = np.uint64(size - 1)
        key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        step = 1
        while 2 * step <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if step < width:
            key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
        out.append((low - (key & low)).astype(np.int64) + o)
    return np.concatenate(out)


def runs(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Sorted intervals, merged where they meet."""
    out: list[list[int]] = []
    for a, b in zip(begin.tolist(), end.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _order(docs: DataFrame, id_col: str) -> tuple:
    """Documents' ids in an order that can be compared, and its type: numbers, or the bytes of other ids; a null id comes last."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "long"
    return F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1")), "string"


def _anchors(keyed: DataFrame, kind: str, window: int, anchor: int) -> DataFrame:
    """(h, ctx, ord) of all segments."""
    ids = pa.int64() if kind == "long" else pa.string()

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            hashes, contexts, doc = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = text.split()
                if len(words) >= window:
                    s = Segments(words, window, anchor)
                    hashes.append(s.hash), contexts.append(s.contexts()), doc.append(np.full(len(s.hash), i))
            if doc:
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (hashes, contexts)]
                yield pa.RecordBatch.from_arrays([*columns, b.column(0).cast(ids).take(pa.array(np.concatenate(doc)))], ["h", "ctx", "ord"])

    return keyed.select("ord", "text").mapInArrow(emit, f"h long, ctx long, ord {kind}")


def _packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with one text or binary column compressed, row by row, for a shuffle."""
    at = df.columns.index(column)
    types = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in rows:
            cols = list(b.columns)
            cols[at] = pa.array([None if x is None else c.compress(x) for x in cols[at].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(pack, types)


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _list(column: pa.Array, i: int) -> dict[str, np.ndarray]:
    """The structs of row ``i`` of a list column, by field."""
    x = column[i].values
    return {} if x is None else {x.type.field(k).name: x.field(k).to_numpy(zero_copy_only=False) for k in range(x.type.num_fields)}


def _repeating(docs: DataFrame, kind: str, window: int, anchor: int) -> DataFrame:
    """What repeats in each document, and the windows that need counting.

    docs: (ord, row, text packed, found: array of (h, first, same)). Rows of two kinds: ``part``s (ord, row, at, text, spans of windows with their owner)
    and ``window``s (ord, row, at of their part, h, w, s).
    """
    spans_type = f"array<struct<begin: int, end: int, owner: {kind}>>"
    ids = pa.int64() if kind == "long" else pa.string()
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("owner", ids)]))
    schema = pa.schema([("kind", pa.string()), ("ord", ids), ("row", pa.int64()), ("at", pa.int32()), ("text", pa.binary()), ("spans", span), ("h", pa.int64()), ("w", pa.int64()), ("s", pa.int32())])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out: dict[str, list] = {f.name: [] for f in schema}
            counted = []
            for i, (o, row, blob) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                words = _unpacked(blob).split()
                s = Segments(words, window, anchor)
                found = _list(b.column(3), i)
                known = found["h"].view(np.uint64)
                by = np.argsort(known, kind="stable")
                known = known[by]
                where = np.minimum(np.searchsorted(known, s.hash), len(known) - 1)
                hit = np.flatnonzero(known[where] == s.hash)
                if not len(hit):
                    continue
                owner, same = found["first"][by][where[hit]], found["same"][by][where[hit]].astype(bool)
                begin, last = s.first[hit], s.last[hit]
                parts = runs(begin, last + window)
                of = np.searchsorted([a for a, _ in parts], begin, "right") - 1
                for k, (a, z) in enumerate(parts):
                    mine = np.flatnonzero((of == k) & same)
                    out["kind"].append("part"), out["ord"].append(o), out["row"].append(row), out["at"].append(a), out["text"].append(b" ".join(words[a:z]))
                    out["spans"].append([{"begin": x, "end": y + 1, "owner": w} for x, y, w in zip(begin[mine].tolist(), last[mine].tolist(), owner[mine].tolist())])
                    out["h"].append(None), out["w"].append(None), out["s"].append(None)
                odd = np.flatnonzero(~same)
                if len(odd):
                    many = last[odd] - begin[odd] + 1
                    start = np.repeat(begin[odd] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                    at = np.repeat(np.array([a for a, _ in parts], np.int32)[of[odd]], many)
                    n = len(start)
                    counted.append(pa.RecordBatch.from_arrays([
                        pa.repeat(pa.scalar("window"), n), pa.repeat(pa.scalar(o, ids), n), pa.repeat(pa.scalar(row, pa.int64()), n), pa.array(at, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, span),
                        pa.array(np.repeat(s.hash[hit][odd], many).view(np.int64)), pa.array(s.words(start, start + window).view(np.int64)), pa.array(start, pa.int32()),
                    ], schema=schema))
                    if sum(x.num_rows for x in counted) > 50_000:
                        yield from counted
                        counted = []
            yield from common.batches(out, schema)
            yield from counted

    return docs.select("ord", "row", "text", "found").mapInArrow(cut, f"kind string, ord {kind}, row long, at int, text binary, spans {spans_type}, h long, w long, s int")


def _pieces(parts: DataFrame, kind: str, window: int) -> DataFrame:
    """Of each part, with the owners of its windows: passages that its document owns (``asks`` false), and what repeats an owner's (key: the owner)."""
    ids = pa.int64() if kind == "long" else pa.string()
    schema = pa.schema([("asks", pa.bool_()), ("key", ids), ("ord", ids), ("row", pa.int64()), ("at", pa.int32()), ("text", pa.binary())])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        for b in rows:
            for o, row, at, text, spans, more in zip(*(c.to_pylist() for c in b.columns)):
                of = defaultdict(list)
                for x in spans or ():
                    of[x["owner"]].append((x["begin"], x["end"] - 1 + window))
                for x in more or ():
                    of[x["owner"]].append((x["s"], x["s"] + window))
                if not of:
                    continue
                words = text.split(b" ")
                for owner, found in of.items():
                    found.sort()
                    for a, z in runs(*np.array(found).T):
                        out["asks"].append(owner != o), out["key"].append(owner), out["ord"].append(o), out["row"].append(row), out["at"].append(a)
                        out["text"].append(b" ".join(words[a - at : z - at]))
                yield from common.batches(out, schema, 2_000)
        yield from common.batches(out, schema)

    return parts.select("ord", "row", "at", "text", "spans", "more").mapInArrow(cut, f"asks boolean, key {kind}, ord {kind}, row long, at int, text binary")


class Automaton:
    """Passages, to be found in other texts wherever ``window`` words of one stand."""

    def __init__(self, passages: list[tuple[int | str, bytes]], window: int = WINDOW):
        """passages: (owner's id, words joined by blanks). Their phrases of half a window that begin at multiples of one word more than that: every window
        has a whole one."""
        self.window, self.block = window, window // 2
        self.owners = [o for o, _ in passages]
        self.words = [t.split(b" ") for _, t in passages]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for i in range(0, len(words) - self.block + 1, self.block + 1):
                places.setdefault((b" " + b" ".join(words[i : i + self.block]) + b" ").decode("latin-1"), []).append((k, i))
        self.trie = ahocorasick.Automaton()
        for phrase, where in places.items():
            self.trie.add_word(phrase, where)
        if places:
            self.trie.make_automaton()

    def occurrences(self, ord, text: bytes) -> list[tuple[int, int]]:
        """Merged runs of words of ``text`` that are ``window`` words or more of a passage of an owner before ``ord``."""
        if not len(self.trie):
            return []
        words = text.split(b" ")
        plain = b" " + text + b" "
        ends = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)  # of word k: ends[k + 1]
        covered = np.zeros(len(words), bool)
        block, n = self.block, len(words)
        for end, where in self.trie.iter(plain.decode("latin-1")):
            x = int(np.searchsorted(ends, end)) - block
            reach = slice(max(0, x + block - self.window), min(n, x + self.window))
            for k, i in where:
                if covered[reach].all():  # nothing that holds this phrase can add to it
                    break
                if self.owners[k] < ord:
                    a, z = _extended(words, x, self.words[k], i, block)
                    if z - a >= self.window:
                        covered[a:z] = True
        edge = np.flatnonzero(np.diff(np.r_[0, covered.view(np.int8), 0]))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _extended(a: list[bytes], i: int, b: list[bytes], j: int, size: int) -> tuple[int, int]:
    """The longest equal run around ``size`` equal words at ``a[i]`` and ``b[j]``, as places in ``a``: whole stretches are compared, doubled while equal."""
    end, most = size, min(len(a) - i, len(b) - j)
    step = size
    while end < most:
        step = min(step, most - end)
        if a[i + end : i + end + step] == b[j + end : j + end + step]:
            end += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    begin, most, step = 0, min(i, j), size
    while begin < most:
        step = min(step, most - begin)
        if a[i - begin - step : i - begin] == b[j - begin - step : j - begin]:
            begin += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return i - begin, i + end


def _located(pieces: DataFrame, kind: str, window: int) -> DataFrame:
    """(ord, row, begin, end): the places of all occurrences, by automata over shards of passages."""
    spark = pieces.sparkSession
    asks = pieces.filter("asks").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PARTS).cast("int").alias("copies"))
    copies = common.written(asks, "passage-copies")
    own = pieces.filter("not asks").join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asked = pieces.filter("asks").join(copies, "key").withColumn("copy", F.pmod(F.xxhash64("ord", "row", "at"), "copies").cast("int"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-size // SHARD_BYTES))
    ids = pa.int64() if kind == "long" else pa.string()
    schema = pa.schema([("ord", ids), ("row", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])
    both = own.unionByName(asked).withColumn("shard", F.pmod(F.xxhash64("key", "copy"), F.lit(shards)))

    def locate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        shard, passages, automaton = None, [], None
        for b in rows:
            for now, asks, key, o, row, at, text in zip(*(c.to_pylist() for c in b.columns)):
                if now != shard:
                    shard, passages, automaton = now, [], None
                if not asks:
                    passages.append((key, text))
                    continue
                if automaton is None:
                    automaton = Automaton(passages, window)
                for a, z in automaton.occurrences(o, text):
                    out["ord"].append(o), out["row"].append(row), out["begin"].append(at + a), out["end"].append(at + z)
            yield from common.batches(out, schema, 10_000)
        yield from common.batches(out, schema)

    dealt = both.repartition(min(shards, 10 * parts), "shard").sortWithinPartitions("shard", "asks")
    return dealt.select("shard", "asks", "key", "ord", "row", "at", "text").mapInArrow(locate, f"ord {kind}, row long, begin int, end int")


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, ``text_col`` as the kept words joined by one blank, plus n_words, n_removed and spans (begin, end: removed runs of words).

    Words are what blanks and the ASCII line and tab characters separate, unchanged. A word goes if a window of ``window`` words that covers it also
    starts in a document with a smaller id; windows are those of the input. A null text stays null and has no words; a text of fewer words than a window
    loses none. Rows that share an id are one document: none is before another. Ids that aren't integers are compared by the bytes of their strings; a null
    id comes after all others. A helper column's name is changed where ``docs`` has it already; a column named like one of the results is replaced.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_words", "n_removed", "spans"}])
    order, kind = _order(docs, id_col)
    row = F.xxhash64(F.col(text_col))
    keyed = docs.select(order.alias("ord"), row.alias("row"), common.utf8(text_col).alias("text")).filter(F.octet_length("text") >= 2 * window - 1)
    seen = common.written(_anchors(keyed, kind, window, anchor), "anchors")
    counted = seen.groupBy("h").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).filter("first < last")
    again = common.written(counted.select("h", "first", (F.col("c1") == F.col("c2")).alias("same")), "repeated-anchors")
    found = seen.select("h", "ord").join(again, "h").groupBy("ord").agg(F.collect_list(F.struct("h", "first", "same")).alias("found"))
    parts = common.written(_repeating(_packed(keyed, "text").join(found, "ord"), kind, window, anchor), "repeating-parts", "zstd")

    windows = parts.filter("kind = 'window'").select("h", "w", "ord", "row", "at", "s")
    owners = windows.groupBy("h", "w").agg(F.min("ord").alias("owner"), F.max("ord").alias("last")).filter("owner < last").select("h", "w", "owner")
    owned = windows.join(common.written(owners, "window-owners"), ["h", "w"]).groupBy("ord", "row", "at").agg(F.collect_list(F.struct("s", "owner")).alias("more"))
    whole = parts.filter("kind = 'part'").select("ord", "row", "at", "text", "spans").join(owned, ["ord", "row", "at"], "left")
    pieces = common.written(_pieces(whole, kind, window), "passages", "zstd")
    places = _located(pieces, kind, window).groupBy("ord", "row").agg(F.collect_list(F.struct("begin", "end")).alias("places"))

    o, r, at = common.fresh(docs, "ord", "row", "places")
    shape = _packed(docs.withColumn(o, order).withColumn(r, row), text_col).join(places.select(F.col("ord").alias(o), F.col("row").alias(r), F.col("places").alias(at)), [o, r], "left")
    text_at = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_words long, n_removed long, spans array<struct<begin: int, end: int>>"
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    names = [*docs.columns, "n_words", "n_removed", "spans"]

    def clean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts, n_words, n_removed, spans = [], [], [], []
            for i, blob in enumerate(b.column(text_at).to_pylist()):
                words = [] if blob is None else _unpacked(blob).split()
                found = _list(b.column(b.num_columns - 1), i)
                gone = []
                if found:
                    by = np.argsort(found["begin"], kind="stable")
                    gone = runs(found["begin"][by], found["end"][by])
                kept, done = [], 0
                for a, z in gone:
                    kept += words[done:a]
                    done = z
                kept += words[done:]
                texts.append(None if blob is None else b" ".join(kept).decode())
                n_words.append(len(words)), n_removed.append(len(words) - len(kept)), spans.append([{"begin": a, "end": z} for a, z in gone])
            cols = [*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span)]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return shape.select(*docs.columns, at).mapInArrow(clean, types)

"""Exact substring dedup: bytes covered by a repeated string of ``WINDOW`` bytes, by a hash-compared suffix sort.

Spread: every window of 200 bytes has an anchor, the k-gram in it with the least hash (leftmost of equals). Consecutive windows
with one anchor form a fragment of text. Equal windows have equal anchors at equal offsets, so windows of different
anchors never need to meet. Anchors are counted first, with combining before the shuffle: a fragment whose anchor is unique is not
repeated at all. The others are told apart by a 128-bit cryptographic digest of their bytes beside the anchor's hash: a fragment that
occurs twice is repeated as a whole, and each different fragment of an anchor goes once, from its first place, to have its text compared.

Sort: such fragments meet by anchor. Their suffixes are sorted by mergesort; two suffixes are compared by
binary search for their common extension over prefix polynomial hashes, so in a logarithmic number of steps. Windows are taken in
blocks of 16, then 4, then 1 offset before the anchor: a block's windows share a core of bytes, fragments whose cores
sort apart have no window in common there, and fragments that agree on the whole block repeat all of it. Whatever the hashes call
equal is compared byte by byte, so a collision never removes text; as the sort trusts the hashes, equal windows of a segment with a
64-bit collision may not lie side by side, and then stay.

Anchors with very many different fragments are dealt out by the digest of a block's core, or of the single window, so that no
group grows with the corpus. Only small rows and compressed texts are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common

WINDOW, GRAM = 200, 64
#: Different fragments of one anchor from which blocks, and from which single windows are dealt out.
MANY, VERY_MANY = 4096, 50_000
CHUNK = 1 << 19
BLOCKS = (16, 4, 1)
_INDEX = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 20, n + 1)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(b))], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Prefix polynomial hashes of a byte string: the hash of any part in constant time."""

    def __init__(self, text: bytes):
        self.bytes = np.frombuffer(text, np.uint8)
        power, self.inverse = powers(len(text))
        self.prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Common extension of the suffixes at a and b, up to ``most`` bytes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        same = self.of(a, a + most) == self.of(b, b + most)
        low[same] = most
        todo = np.flatnonzero(~same)
        high[todo] = most - 1
        while len(todo):
            mid = (low[todo] + high[todo] + 1) >> 1
            eq = self.of(a[todo], a[todo] + mid) == self.of(b[todo], b[todo] + mid)
            low[todo[eq]] = mid[eq]
            high[todo[~eq]] = mid[~eq] - 1
            todo = todo[low[todo] < high[todo]]
        return low

    def less(self, a: np.ndarray, b: np.ndarray, most: int, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b."""
        n = self.common(a, b, most)
        at = np.minimum(n, most - 1)
        return np.where(n >= most, or_equal, self.bytes[a + at] < self.bytes[b + at])


def fragments(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Fragments of a text: first window, number of windows, anchor's offset in the fragment, anchor hash."""
    parts = []
    grams = window - gram + 1
    for lo in range(0, max(0, len(text) - window + 1), CHUNK):
        h = Hashes(text[lo : lo + CHUNK + window - 1])
        n = len(h.bytes)
        g, wins = n - gram + 1, n - window + 1
        m = mix((h.prefix[gram:] - h.prefix[:-gram]) * h.inverse[:g])
        key = (m & ~_INDEX) | np.arange(g, dtype=np.uint64)  # place breaks ties: leftmost
        x = np.r_[key, np.full(-g % grams, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, grams)
        ahead = np.minimum.accumulate(x, 1).ravel()
        behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:wins], ahead[grams - 1 : grams - 1 + wins])
        at = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        anchor = (least[at] & _INDEX).astype(np.int64)
        count = np.diff(np.r_[at, wins])
        parts.append((at + lo, count, anchor - at, m[anchor]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def digests(text: bytes, at: np.ndarray, count: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """128-bit digests of the fragments' bytes and their anchor's offset, as two columns."""
    h = hashlib.blake2b
    return np.frombuffer(b"".join(h(text[a : a + n + window - 1], digest_size=16, salt=o.to_bytes(2, "big")).digest() for a, n, o in zip(at.tolist(), count.tolist(), off.tolist())), np.int64).reshape(-1, 2)


def merge_sort(h: Hashes, start: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes within sorted segments, by bottom-up mergesort: all pairs of runs are merged at once, each
    item's place being its own plus its rank in the other run, found by binary search."""
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[first, n])
    base, local, total = np.repeat(first, size), np.arange(n) - np.repeat(first, size), np.repeat(size, size)
    width = 1
    while width < (size.max() if n else 0):
        run = local // width
        odd = run % 2 == 1
        other = np.where(odd, run - 1, run + 1) * width
        act = np.flatnonzero(other < total)
        lo = (base + other)[act]
        hi = np.minimum(lo + width, (base + total)[act])
        begin, is_odd, mine = lo.copy(), odd[act], start[order[act]]
        live = np.arange(len(act))
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            before = h.less(start[order[mid]], mine[live], most, is_odd[live])
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]
            live = live[lo[live] < hi[live]]
        place = np.arange(n)
        pair = base[act] + (run[act] // 2) * 2 * width
        place[act] = pair + (local[act] - run[act] * width) + (lo - begin)
        new = np.empty_like(order)
        new[place] = order
        order = new
        width *= 2
    return order


def repeated_windows(texts: list[bytes], group: np.ndarray, anchor: np.ndarray, count: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the fragments that another fragment of the same group has too: fragment, first and last window.

    ``anchor`` is the anchor's place in a fragment, ``count`` its number of windows; groups are sorted. Fragments that are equal
    in full count as repeated.
    """
    h = Hashes(b"".join(texts))
    length = np.array([len(t) for t in texts], np.int64)
    place = np.r_[0, np.cumsum(length)[:-1]] + anchor
    most_d, least_d = anchor, anchor - count + 1
    out_f, out_a, out_b = [], [], []
    frag, d0, block = np.arange(len(texts)), None, BLOCKS[0]
    lo, hi = least_d // block, most_d // block
    n = hi - lo + 1
    frag = np.repeat(frag, n)
    d0 = (np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())) * block
    for level, block in enumerate(BLOCKS):
        _, segment = np.unique(np.stack([group[frag], d0], 1), axis=0, return_inverse=True)
        at = np.argsort(segment.ravel(), kind="stable")
        frag, d0, segment = frag[at], d0[at], segment.ravel()[at]
        core = window - block + 1
        start = place[frag] - d0
        order = merge_sort(h, start, segment, core)
        frag, d0, segment, start = frag[order], d0[order], segment[order], start[order]
        same = np.zeros(len(frag), bool)
        pair = np.flatnonzero(segment[1:] == segment[:-1])
        same[pair + 1] = h.of(start[pair], start[pair] + core) == h.of(start[pair + 1], start[pair + 1] + core)
        same = verified(h, start, same, core)
        run = np.cumsum(~same)
        from_d, to_d = np.maximum(d0, least_d[frag]), np.minimum(d0 + block - 1, most_d[frag])
        s, e = place[frag] - to_d, place[frag] - from_d + window
        digest = mix(h.of(s, e) + (from_d * 1024 + to_d).astype(np.uint64))
        at = np.lexsort((np.arange(len(frag)), digest, run))
        frag, d0, run, digest, s, e, from_d, to_d = (x[at] for x in (frag, d0, run, digest, s, e, from_d, to_d))
        again = np.r_[False, (run[1:] == run[:-1]) & (digest[1:] == digest[:-1])]
        for i in np.flatnonzero(again):  # whole blocks called equal: compare the bytes
            if h.bytes[s[i] : e[i]].tobytes() != h.bytes[s[i - 1] : e[i - 1]].tobytes():
                again[i] = False
        twin = again | np.r_[again[1:], False]
        out_f.append(frag[twin]), out_a.append(anchor[frag[twin]] - to_d[twin]), out_b.append(anchor[frag[twin]] - from_d[twin])
        if block == 1:
            break
        kept = ~again  # one of each kind goes on, where its run has several kinds
        kinds = np.bincount(run, kept, minlength=(run.max() + 1) if len(run) else 0)
        go = np.flatnonzero(kept & (kinds[run] > 1))
        frag, d0, from_d, to_d = frag[go], d0[go], from_d[go], to_d[go]
        small = BLOCKS[level + 1]
        subs = np.concatenate([np.stack([frag, d0 + o, from_d, to_d], 1) for o in range(0, block, small)])
        subs = subs[(subs[:, 1] <= subs[:, 3]) & (subs[:, 1] + small - 1 >= subs[:, 2])]
        frag, d0 = subs[:, 0], subs[:, 1]
        if not len(frag):
            break
    return tuple(np.concatenate(x) for x in (out_f, out_a, out_b))


def verified(h: Hashes, start: np.ndarray, same: np.ndarray, core: int) -> np.ndarray:
    """``same`` where the bytes agree with the item before; a hash collision is no equality."""
    at = np.flatnonzero(same)
    cols = np.arange(core)
    for lo in range(0, len(at), 8192):
        i = at[lo : lo + 8192]
        ok = (h.bytes[start[i][:, None] + cols] == h.bytes[start[i - 1][:, None] + cols]).all(1)
        same[i[~ok]] = False
    return same


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(texts: DataFrame, window: int) -> DataFrame:
    """How often each anchor hash occurs within a task: (h, n)."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def combined() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], ["h", "n"])

        for b in rows:
            for text in b.column(0).to_pylist():
                if len(text) >= window:
                    held.append(fragments(text, window)[3])
                    size += len(held[-1])
            if size > 400_000:
                yield from combined()
                held.clear()
                size = 0
        if held:
            yield from combined()

    return texts.select("text").mapInArrow(scan, "h long, n long")


PLACES = ["h", "f1", "f2", "k", "k2", "span"]


def _places(texts: DataFrame, window: int) -> DataFrame:
    """Every fragment with its anchor hash, digest, row key and place."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k, k2, text in zip(*(c.to_pylist() for c in b.columns)):
                if len(text) >= window:
                    at, count, off, h = fragments(text, window)
                    f = digests(text, at, count, off, window)
                    keys = (pa.array(np.full(len(at), x, np.int64)) for x in (k, k2))
                    yield pa.RecordBatch.from_arrays([_signed(h), pa.array(f[:, 0]), pa.array(f[:, 1]), *keys, pa.array((at << 20) | (off << 10) | (count - 1))], PLACES)

    return texts.select("k", "k2", "text").mapInArrow(scan, ", ".join(f"{n} long" for n in PLACES))


def _unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor offset, windows."""
    return span >> 20, (span >> 10) & 1023, (span & 1023) + 1


def _dealt(joined: DataFrame, window: int) -> DataFrame:
    """Fragments to compare, with text: (route, k, k2, first, off, count, bytes); many-fragment anchors cut into blocks, or windows."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("route", pa.int64()), ("k", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("off", pa.int32()), ("count", pa.int32()), ("bytes", pa.binary())])
        out: dict[str, list] = {f.name: [] for f in schema}
        last = None
        for b in rows:
            for k, k2, packed, todo in zip(*(c.to_pylist() for c in b.columns)):
                if (k, k2) == last:  # a copy of the row before has the same fragments
                    continue
                last = k, k2
                text = unpack(packed)
                for t in todo:
                    first, off, count = _unpacked(t["span"])
                    step = window if t["size"] == 0 else BLOCKS[0] if t["size"] == 1 else 1
                    for d0 in range((off - count + 1) // step * step, off + 1, step):
                        lo, hi = max(d0, off - count + 1), min(d0 + step - 1, off)
                        anchor = first + off
                        route = t["h"]
                        if step < window:
                            core = text[anchor - d0 : anchor - d0 - step + 1 + window]
                            route = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=d0.to_bytes(8, "big"), person=(t["h"] & (1 << 64) - 1).to_bytes(8, "big")).digest(), "big", signed=True)
                        for c, v in zip(out.values(), (route, k, k2, anchor - hi, hi, hi - lo + 1, text[anchor - hi : anchor - lo + window])):
                            c.append(v)
                yield from common.batches(out, schema, 5000)
        yield from common.batches(out, schema)

    return joined.mapInArrow(cut, "route long, k long, k2 long, first long, off int, count int, bytes binary")


def _kinds(rows: pa.Table) -> pa.Table:
    """The first row of each kind, so of equal windows at an equal anchor; rows of one kind are twins, and repeat as a whole."""
    numbered = rows.append_column("row", pa.array(np.arange(rows.num_rows)))
    first = numbered.group_by(["route", "off", "count", "bytes"]).aggregate([("row", "min")]).column("row_min").to_numpy()
    return rows.take(pa.array(np.sort(first)))


def _found(t: pa.Table, window: int) -> pa.RecordBatch:
    """Repeated windows of whole routes."""
    route, k, k2, first, off, count = (t.column(c).to_numpy().astype(np.int64) for c in ("route", "k", "k2", "first", "off", "count"))
    size = np.unique(route, return_inverse=True, return_counts=True)
    many = size[2][size[1]] > 1
    route, k, k2, first, off, count = (x[many] for x in (route, k, k2, first, off, count))
    if not len(k):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["k", "k2", "first", "last"])
    f, a, b = repeated_windows(t.column("bytes").filter(pa.array(many)).to_pylist(), route, off, count, window)
    return pa.RecordBatch.from_arrays([pa.array(k[f]), pa.array(k2[f]), pa.array(first[f] + a), pa.array(first[f] + b)], ["k", "k2", "first", "last"])


def search_routes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows among rows that come in the order of their routes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < 8000:
            continue
        t = pa.Table.from_batches(held)
        route = t.column("route").to_numpy()
        begin = int(np.searchsorted(route, route[-1]))
        if begin:
            yield _found(t.slice(0, begin), window)
            t = t.slice(begin)
        elif n > 4 * VERY_MANY:  # few kinds in very many places: one row of each kind stands for those before
            yield _found(t, window)
            t = _kinds(t)
        held, n = t.to_batches(), t.num_rows
    if held:
        yield _found(pa.Table.from_batches(held), window)


def _sorted(rows: DataFrame, window: int) -> DataFrame:
    """Repeated windows among fragments that share a route: (k, k2, first, last), the places of the first and the last."""
    return rows.mapInArrow(lambda batches: search_routes(batches, window), "k long, k2 long, first long, last long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and end bytes of each maximal removed run).

    Null and empty texts have 0 bytes. Matches never cross rows. A repeated row repeats its own text, so with ``window`` bytes or more
    both are removed whole. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    k1, k2 = common.row_key(id_col, text_col)
    keyed = docs.select(k1.alias("k"), k2.alias("k2"), F.col(id_col).alias("id"), common.utf8(text_col).alias("text"))

    repeated = common.written(_anchors(keyed, window).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "anchors")
    places = common.written(_places(keyed, window).join(repeated, "h"), "places")
    kinds = places.groupBy("h", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "k2", "span")).alias("source"))
    kinds = common.written(kinds, "fragments")
    per_anchor = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    size = F.when(F.col("kinds") <= MANY, 0).when(F.col("kinds") <= VERY_MANY, 1).otherwise(2)
    sent = kinds.join(per_anchor, "h").select("source.k", "source.k2", F.struct("h", "source.span", size.alias("size")).alias("one"))

    def squeeze(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in rows:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([pack(t) for t in b.column(3).to_pylist()], pa.binary())], ["k", "k2", "id", "packed"])

    packed = keyed.mapInArrow(squeeze, f"k long, k2 long, id {id_type}, packed binary")
    todo = sent.groupBy("k", "k2").agg(F.collect_list("one").alias("todo"))
    distinct = packed.select("k", "k2", "packed").join(todo, ["k", "k2"])
    dealt = _dealt(distinct.select("k", "k2", "packed", "todo"), window)
    found = _sorted(dealt.repartition("route").sortWithinPartitions("route", "k", "k2", "first"), window)

    twice = kinds.filter("n > 1").select("h", "f1", "f2")
    whole = places.join(twice, ["h", "f1", "f2"]).select("k", "k2", F.shiftright("span", 20).alias("first"), (F.shiftright("span", 20) + F.col("span").bitwiseAND(1023)).alias("last"))
    ranges = whole.unionAll(found).groupBy("k", "k2").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    joined = packed.join(ranges, ["k", "k2"], "left").select("id", "packed", "ranges")

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in rows:
            size, removed, n, digest, spans = [], [], [], [], []
            for packed_text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = unpack(packed_text)
                merged: list[list[int]] = []
                for s, e in sorted((r["first"], r["last"] + window) for r in ranges or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, last = hashlib.sha256(), 0
                for s, e in merged:
                    kept.update(text[last:s])
                    last = e
                kept.update(text[last:])
                size.append(len(text)), removed.append(sum(e - s for s, e in merged)), n.append(len(merged)), digest.append(kept.hexdigest()), spans.append([x for m in merged for x in m])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, n)), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(remove, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>").withColumnRenamed("id", id_col)

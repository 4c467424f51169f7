"""Near-duplicate documents by a multi-index Hamming join of b-bit minwise signatures.

A document's set of word shingles gives a signature of ``HASHES`` symbols of 16 bits. Sets with similarity s differ in
about (1 - s) of the symbols; pairs within a radius of differing symbols are candidates: the least at which a pair of exactly the
wanted similarity is beyond it with a probability below ``MISS``. Signatures are split into ``CHUNKS`` chunks. By the pigeonhole principle a pair within the radius agrees, up to the errors that a chunk is allowed,
in at least one chunk; allowed errors are enumerated by leaving out each choice of that many symbols. So every pair
within the radius shares a key. All links are confirmed on the full sets.

No bucket is expanded into pairs. Documents with equal sets are one class. First each class is compared with one
central member of its buckets (the one that shares most buckets); components of the confirmed links follow. Of buckets that still
hold several components, the large ones are dealt into blocks at random and searched block by block, after which a
dense group is one component. Then every bucket that holds several components is searched whole: what is outside its largest component
meets that and itself, in pieces of bounded size. What is found is confirmed and joined in.

A second sketch, the parities of how many shingles fall on each of ``PARITIES`` bits, spares most confirmations: two sets
differ in at least as many shingles as their parities, so a pair whose parities differ too often has no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common
from engram.llm.components import components
from engram.llm.shingles import mix, overlap, shingle_set

PERCENT = 85
HASHES, CHUNKS, MISS = 64, 13, 4e-4
#: Rows of a bucket that are compared with one another in one piece.
BLOCK = 2000
PARITIES = 1024
_RANDOM = np.random.default_rng(20240101)
_A = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@lru_cache
def radius_of(percent: int) -> int:
    """Differing symbols up to which pairs are candidates at this similarity."""
    differ = 1 - percent / 100
    at = [comb(HASHES, k) * differ**k * (1 - differ) ** (HASHES - k) for k in range(HASHES + 1)]
    return next(r for r in range(HASHES + 1) if sum(at[r + 1 :]) <= MISS)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of the least hash under each of ``HASHES`` permutations."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 4096):
        part = shingles[lo : lo + 4096]
        least = np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(1))
    return (mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def parities(shingles: np.ndarray) -> bytes:
    return np.packbits(np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def chunk_plan(hashes: int, radius: int, chunks: int) -> list[tuple[int, ...]]:
    """The symbols of each key: for every chunk, all ways to leave out as many symbols as it is allowed errors.

    With radius = e * chunks + a, were each of the first a + 1 chunks to differ in more than e symbols and each other in
    more than e - 1, the whole would differ in more than the radius.
    """
    errors, more = divmod(radius, chunks)
    bounds = [hashes * i // chunks for i in range(chunks + 1)]
    plan = []
    for i in range(chunks):
        symbols = range(bounds[i], bounds[i + 1])
        allowed = errors if i <= more else errors - 1
        if allowed >= 0:
            plan += [k for k in combinations(symbols, max(0, len(symbols) - allowed))]
    return plan


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n (set size), the set's 128-bit digest, its signature, and the text, compressed for the later check."""

    def sketch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in rows:
            n, digest, sig, packed = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s) + parities(s) if len(s) else None)
                packed.append(squeeze(text) if len(s) else None)
            half = lambda lo: pa.array([None if d is None else int.from_bytes(d[lo : lo + 8], "big", signed=True) for d in digest], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), half(0), half(8), pa.array(sig, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "n", "h1", "h2", "sig", "packed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.utf8(text_col).alias("text")).mapInArrow(sketch, "doc_id long, n long, h1 long, h2 long, sig binary, packed binary")


def _sketch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and parities, a row for each sketch."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, : 2 * HASHES]).view("<u2"), np.ascontiguousarray(raw[:, 2 * HASHES :]).view(np.uint64)


def possible(a, b, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches a and b of sets of these sizes are within the radius and their parities allow the similarity."""
    ok = (a[0] != b[0]).sum(1) <= radius_of(percent)
    apart = np.bitwise_count(a[1] ^ b[1]).sum(1, dtype=np.int64)
    return ok & (apart * (100 + percent) <= (100 - percent) * (n_a + n_b))


def bucket_keys(classes: DataFrame, percent: int) -> DataFrame:
    """One row (key, node) for every class and key of the plan."""
    plan = chunk_plan(HASHES, radius_of(percent), CHUNKS)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            s = _sketch(b.column(1))[0].astype(np.uint64)
            node = b.column(0).to_numpy()
            keys = np.empty((len(plan), len(node)), np.uint64)
            for k, symbols in enumerate(plan):
                x = np.full(len(node), k + 1, np.uint64)
                for i in symbols:
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
                keys[k] = x
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(node, len(plan)))], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(emit, "key long, node long")


def within_radius(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, ...) those whose sizes allow the similarity and whose signatures are within the radius."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    names = pairs.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                ok = possible(*(_sketch(b.column(len(names) + i)) for i in (0, 1)), *(b.column(len(names) + i).to_numpy() for i in (2, 3)), percent)
                yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names).filter(pa.array(ok))

    return both.select(*names, "sig_a", "sig_b", "n_a", "n_b").mapInArrow(near, types)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose full shingle sets have the similarity: u, v."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("packed").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, known = None, None
        for batch in rows:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x != last:
                    last, known = x, shingle_set(unpack(x))
                other = shingle_set(unpack(y))
                both_have = overlap(known, other)
                ok.append(100 * both_have >= percent * (len(known) + len(other) - both_have))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "u long, v long")


def mixed_buckets(buckets: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the bucket's size, its largest component and the rows outside that."""
    labelled = buckets.join(found.withColumnRenamed("component", "comp"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", (-F.col("comp")).alias("m"))).alias("top")).select("key", "c", (-F.col("top.m")).alias("main"), (F.col("c") - F.col("top.c")).alias("rest"))
    mixed = common.written(mixed.filter("rest > 0"), "mixed-keys")
    return labelled.join(mixed, "key").join(reps, "node")


def random_blocks(rows: DataFrame) -> DataFrame:
    """Buckets of more than a block dealt into blocks at random: each row goes to one piece."""
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / F.lit(BLOCK))).cast("int")
    return rows.filter(F.col("c") > BLOCK).withColumn("own", own).select("key", F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", "comp", "n", "sig")


def whole_buckets(rows: DataFrame) -> DataFrame:
    """Pieces in which all rows outside the largest component meet each other and that component: blocks i of the others with blocks j of
    the others or, numbered behind these, of the largest. A piece holds about two blocks at most."""
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    of_rest, of_main = blocks(F.col("rest")), blocks(F.col("c") - F.col("rest"))
    is_main, mark = F.col("comp") == F.col("main"), F.xxhash64("node")
    own = F.when(is_main, of_rest + F.pmod(mark, of_main)).otherwise(F.pmod(mark, of_rest)).cast("int")
    meets = F.sequence(F.lit(0), F.when(is_main, of_rest - 1).otherwise(of_rest + of_main - 1))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(meets))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "sig")


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within the radius in one piece (key, i, j) of a bucket; a in block i, b in block j."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            group = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            node, comp, n, own = (t.column(c).to_numpy() for c in ("node", "comp", "n", "own"))
            symbols, bits = _sketch(t.column("sig").combine_chunks())
            start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
            size = np.diff(np.r_[start, len(node)])
            gid = np.repeat(np.arange(len(start)), size)
            out_a, out_b = [], []
            for o in range(1, int(size.max()) if len(size) else 0):
                if not (size > o).any():
                    break
                a = np.flatnonzero(gid[:-o] == gid[o:])
                b = a + o
                cross = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((group[a, 1] == group[a, 2]) | (own[a] != own[b]))
                a, b = a[cross], b[cross]
                ok = possible((symbols[a], bits[a]), (symbols[b], bits[b]), n[a], n[b], percent)
                out_a.append(np.minimum(node[a[ok]], node[b[ok]])), out_b.append(np.maximum(node[a[ok]], node[b[ok]]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (out_a, out_b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        n_held = 0
        for b in batches:
            held.append(b)
            n_held += b.num_rows
            if n_held < 4 * BLOCK:
                continue
            t = pa.Table.from_batches(held)
            key = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            whole = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])[-1])
            if whole:
                yield found(t.slice(0, whole))
                t = t.slice(whole)
            held, n_held = t.to_batches(), t.num_rows
        if held:
            yield found(pa.Table.from_batches(held))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links, its own included), kept.

    Links join documents whose sets have 100 * intersection >= ``percent`` * union. Null and empty texts, and those without words, have the
    empty set and no links. Rows that share an id are one node with all their links; a null id is a node of its own
    unless an equal set has an id, and then belongs to that. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    all_rows = common.written(sketches(docs, id_col, text_col), "sketches")
    classes = common.written(all_rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    full = all_rows.filter("n > 0").select("doc_id", "n", "h1", "h2", "sig").join(classes, ["h1", "h2"])
    members = common.written(full.select("doc_id", "n", "node", F.when(F.col("doc_id") == F.col("node"), F.col("sig")).alias("sig")), "members")
    reps = members.filter("sig is not null").select("node", "n", "sig")
    keys = bucket_keys(reps, percent)
    shared = common.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared-keys")
    buckets = common.written(keys.join(shared, "key"), "buckets")

    central = common.written(buckets.groupBy("node").agg(F.sum("c").alias("s")), "central")
    top = buckets.join(central, "node").groupBy("key").agg(F.max(F.struct("s", (-F.col("node")).alias("m"))).alias("top"))
    top = common.written(top.select("key", F.col("top.s").alias("s"), (-F.col("top.m")).alias("a")), "tops")
    star = buckets.select("key", F.col("node").alias("b")).join(top, "key").filter("a <> b").select("a", "b", "s").distinct()
    first = within_radius(star, reps, percent).groupBy("b").agg(F.max(F.struct("s", (-F.col("a")).alias("m"))).alias("top")).select((-F.col("top.m")).alias("a"), "b")
    tried = common.written(first, "first-pairs")
    texts = all_rows.select("doc_id", "packed")
    links = common.written(confirmed(tried, texts, percent), "links")
    found = components(links)

    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    tried = tried.select(*pair)
    for pieces in (random_blocks, whole_buckets):
        untried = across(pieces(mixed_buckets(buckets, found, reps)), percent).join(tried, ["a", "b"], "left_anti")
        untried = common.written(untried, "later-pairs")
        if untried.isEmpty():
            continue
        tried = tried.unionAll(untried.select(*pair))
        links = links.unionAll(common.written(confirmed(untried, texts, percent), "links"))
        found = components(links)
    found = common.written(found, "components")

    out = members.select("doc_id", "n", "node").join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    alone = all_rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

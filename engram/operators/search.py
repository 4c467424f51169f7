"""Ranked search: many queries against all records, over an index of the records that is built once.

``index`` reads every text once and keeps of it, by record, the hashes of its tokens, its hashed vector and the hashes of its full-text terms in
their order. What else the score needs of a record stands beside it, so a pass over the index joins nothing.
Queries are few and records many, so a block of queries (``BLOCK`` of them, ``BLOCK_BYTES`` of text at most) goes to
every task, and each task scores its part of the index in whole arrays and keeps the best of each query; only those meet in a shuffle.
More queries take more blocks over the same index. A block's full-text ranks (``FTS_RANKS`` a query) go to every task too. BM25 needs corpus statistics first: document frequencies of the block's terms.
Where all queries of a block name scopes, only records in those are scored.

score = validity * (0.45 lexical + 0.35 hash + 0.08 recency + 0.07 importance + 0.05 scope + 0.18 entity + 0.22 fts + 0.10 principle)
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import storage
from engram.operators.records import past_validity
from engram.plans.views import hot_keys

BLOCK, BLOCK_BYTES = 512, 2_000_000
#: Records that are scored at once, and texts that are read at once, which bounds the arrays of a task.
SLICE, SLICE_BYTES = 512, 1_000_000
#: The signals' weights, the index's ranks and its constants.
WEIGHTS = {"lexical": 0.45, "hash": 0.35, "recency": 0.08, "importance": 0.07, "scope": 0.05, "entity": 0.18, "fts": 0.22, "principle": 0.10}
FTS_RANKS, FTS_STEP, FTS_LEAST = 30, 0.022, 0.3
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
DIMS = 128
WORD = regex.compile(r"[\p{L}\p{N}]+")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
PHRASE = re.compile(r"[a-z0-9][a-z0-9_.\-]+")
REASONS = ("lexical", "hash", "recency", "importance", "scope", "entity", "fts", "principle")


def words(text: str) -> list[str]:
    """The same tokens as ``engram.functions.text.tokens``."""
    found = WORD.findall(text.lower())
    if CJK.search(text):
        return [t for w in found for t in ([*w] if CJK.search(w) else [w] if len(w) > 1 else [])]
    return [w for w in found if len(w) > 1]


class _Hashed(dict):
    """Tokens' 32-bit FNV-1a over UTF-16 units, kept up to a bound."""

    def __missing__(self, token: str) -> int:
        h = 2166136261
        for unit in np.frombuffer(token.encode("utf-16-le"), "<u2").tolist():
            h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
        if len(self) > 50_000:
            self.clear()
        self[token] = h
        return h


HASHED = _Hashed()


def hash_vector(tokens: list[str], dims: int = DIMS) -> np.ndarray:
    h = np.array([HASHED[t] for t in tokens], np.int64)
    return np.bincount(h % dims, np.where(h % 2 == 0, 1.0, -1.0), dims) if len(h) else np.zeros(dims)


def terms(text: str) -> list[str]:
    """Terms of the full-text index: letters and digits, folded, without Latin diacritics."""
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", low)


def phrases(query: str) -> list[tuple[str, ...]]:
    """A query's ASCII tokens as phrases of terms."""
    out = dict.fromkeys(tuple(terms(m)) for m in dict.fromkeys(PHRASE.findall(query.lower())))
    return [p for p in out if p]


def word_id(token: str) -> int:
    """The 64-bit id of a token or term."""
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def _hashes(found: list[str]) -> np.ndarray:
    """``HASHED`` of many words at once, a UTF-16 unit of all of them a step; long ones on their own."""
    out = np.full(len(found), 2166136261, np.uint32)
    units = np.frombuffer("".join(found).encode("utf-16-le"), "<u2").astype(np.uint32)
    size = np.fromiter(map(len, found), np.int64, len(found))
    if size.sum() != len(units):
        size = np.array([len(w.encode("utf-16-le")) // 2 for w in found], np.int64)
    starts, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG_WORD]
    h, at, size_ = out[order], starts[order], size[order]
    for step in range(size_[0] if len(order) else 0):
        n = np.searchsorted(-size_, -step)  # as many as are longer
        h[:n] = (h[:n] ^ units[at[:n] + step]) * np.uint32(16777619)
    out[order] = h
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = HASHED[found[i]]
    return out.astype(np.int64)


class _Words:
    """What the index keeps of a word, in arrays by the word's number: its id, its place and sign in the vector, the id of its term, and whether it is a token.
    Kept up to a bound of words and letters, as new words never end."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.letters, self.table = 0, np.zeros((KEPT_WORDS, 5), np.int64)

    def of(self, found: list[str]) -> np.ndarray:
        """The number of each word, valid until the next call."""
        new = [*set(found).difference(self.numbers)]
        if len(self.numbers) + len(new) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self.numbers.clear()
            new, self.letters = [*set(found)], 0
            self.table = np.zeros((max(KEPT_WORDS, len(new)), 5), np.int64)
        if new:
            n, h = len(self.numbers), _hashes(new)
            ids = [word_id(w) for w in new]
            as_terms = [i if w.isascii() else word_id(w.translate(FOLDED) if max(w) <= "\xff" else "".join(terms(w))) for w, i in zip(new, ids)]
            self.table[n : n + len(new)] = np.stack([np.array(ids, np.int64), h % DIMS, np.where(h % 2 == 0, 1, -1), np.array(as_terms, np.int64), np.array([len(w) > 1 for w in new])], 1)
            self.numbers.update(zip(new, range(n, n + len(new))))
            self.letters += sum(map(len, new))
        return np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))


#: Bounds of what a task keeps of words, and the letters of a word that is hashed with others.
KEPT_WORDS, KEPT_LETTERS, LONG_WORD = 1 << 17, 1 << 21, 48
WORDS = _Words()
MARK = regex.compile(r"\p{M}")
#: Letters and digits of Latin-1: folded as terms are, and as they are with all else as blanks.
FOLDED = {c: "".join(terms(chr(c))) for c in range(128, 256) if WORD.match(chr(c))}
LATIN = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))
INDEX = "id string, tokens array<long>, vector array<float>, terms array<long>"


def _indexed_texts(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of each index text the ids of the distinct tokens, the vector and the ids of the terms; its words are those of the search text in another order."""
    found, ends, all_count, own_terms = [], [0], np.zeros(len(texts), bool), {}
    other_terms: list[tuple[int, list[str]]] = []
    for n, text in enumerate(texts):
        low = text.lower()
        try:
            found += low.encode("latin-1").translate(LATIN).decode("latin-1").split()
        except UnicodeEncodeError:
            of_text = WORD.findall(low)
            if MARK.search(text):  # a mark cuts words, but not terms
                own_terms[n] = np.array([word_id(t) for t in terms(text)], np.int64)
            if CJK.search(text):
                other_terms.append((n, of_text))
                of_text, all_count[n] = words(text), True
            found += of_text
        ends.append(len(found))
    for n, of_text in other_terms:
        if n not in own_terms:
            numbers = WORDS.of(of_text)
            own_terms[n] = WORDS.table[numbers, 3]
    numbers = WORDS.of(found)
    rows, of, size = WORDS.table[numbers], np.repeat(np.arange(len(texts)), np.diff(ends)), len(WORDS.table)
    token = (rows[:, 4] == 1) | all_count[of]
    vectors = np.bincount(of[token] * DIMS + rows[token, 1], rows[token, 2], len(texts) * DIMS).astype(np.float32).reshape(-1, DIMS)
    at, number = np.divmod(np.unique(of[token] * size + numbers[token]), size)
    ids = np.split(WORDS.table[number, 0], np.searchsorted(at, np.arange(1, len(texts))))
    for i in ids:
        i.sort()
    return ids, vectors, [own_terms[n] if n in own_terms else rows[ends[n] : ends[n + 1], 3] for n in range(len(texts))]


def _indexed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one text."""
    ids, vectors, term_ids = _indexed_texts([text])
    return ids[0], vectors[0], term_ids[0]


def index(records: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """The index of records: id, ids of the distinct tokens, the hashed vector, ids of the full-text terms in order, and the columns ``beside``. One pass over the
    texts."""
    names = [*(f.split(" ")[0] for f in INDEX.split(", ")), *beside]

    def lists(rows, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), kind))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < b.num_rows:  # as many texts as fit the bounds of a slice, and one at least
                fit = np.searchsorted(np.cumsum(sizes[begin : begin + SLICE]), SLICE_BYTES, "right")
                part = b.slice(begin, max(1, int(fit)))
                begin += part.num_rows
                found = _indexed_texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(lists(c, k) for c, k in zip(found, (pa.int64(), pa.float32(), pa.int64()))), *part.columns[2:]], names)

    kinds = "".join(f", `{c}` {records.schema[c].dataType.simpleString()}" for c in beside)
    return records.select("id", _index_text().alias("_text"), *beside).mapInArrow(read, INDEX + kinds)


def live(indexed: DataFrame, records: DataFrame) -> DataFrame:
    """Index rows of records that exist, without those of forgotten ones."""
    return indexed.join(records.select("id"), "id", "left_semi")


def reindexed(indexed: DataFrame, changed: DataFrame, ids: DataFrame) -> DataFrame:
    """The index after records were written (``changed``) or forgotten (``ids`` has both): theirs is made anew, all other rows stay."""
    return indexed.join(ids.select("id").distinct(), "id", "left_anti").unionByName(index(changed))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``SLICE`` rows."""
    return (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(ends))


class Lookup:
    """Places of ids among sorted known ones."""

    def __init__(self, ids: list[int]):
        self.order = np.argsort(np.array(ids, np.int64))
        self.sorted = np.array(ids, np.int64)[self.order]

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are known, and the place of each."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, values), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == values)
        return hit, self.order[at[hit]]


class Block:
    """What a task needs of a block of queries (id, text, scopes asked for)."""

    def __init__(self, rows: list[tuple[str, str, list[tuple[str, str, float]]]], scoped: bool):
        self.ids = [q for q, _, _ in rows]
        tokens = [[*dict.fromkeys(words(t.strip()))] for _, t, _ in rows]
        vocab = {t: i for i, t in enumerate(dict.fromkeys(t for q in tokens for t in q))}
        self.vocab = Lookup([word_id(t) for t in vocab])
        self.member = np.zeros((len(vocab), len(rows)), np.float32)
        for q, ts in enumerate(tokens):
            self.member[[vocab[t] for t in ts], q] = 1
        self.size = np.array([len(t) for t in tokens], float)
        v = np.stack([hash_vector(words(t.strip())) for _, t, _ in rows]) if rows else np.zeros((0, DIMS))
        self.vectors, self.norms = v, np.sqrt((v * v).sum(1))
        self.phrases = [phrases(t) for _, t, _ in rows]
        self.phrase_ids = {p: i for i, p in enumerate(dict.fromkeys(p for q in self.phrases for p in q))}
        single = [(p, i) for p, i in self.phrase_ids.items() if len(p) == 1]
        self.single, self.single_at = Lookup([word_id(p[0]) for p, _ in single]), np.array([i for _, i in single], np.int64)
        self.longer = [(np.array([word_id(t) for t in p], np.int64), i) for p, i in self.phrase_ids.items() if len(p) > 1]
        self.first = Lookup([*{int(p[0]) for p, _ in self.longer}])
        self.requested = [asked for _, _, asked in rows] if scoped else None
        self.scopes: dict[str, np.ndarray] = {}
        self.literal = None if not scoped else [{f"{t}:{i}" for t, i, _ in asked} for _, _, asked in rows]
        self.within: dict[str, np.ndarray] = {}

    def outside(self, scope: str) -> np.ndarray:
        """For which queries full-text ranks leave out records of ``scope`` (type:id): those that ask for scopes, but not literally for this one."""
        if scope not in self.within:
            if len(self.within) > 10_000:
                self.within.clear()
            self.within[scope] = np.array([bool(asked) and scope not in asked for asked in self.literal])
        return self.within[scope]

    def only(self) -> Column | None:
        """The scopes that can have hits; none where a query asks for all."""
        if self.requested is None or not all(self.requested):
            return None
        every = {x for asked in self.requested for x in asked}
        keys = {f"{t}:{i}".lower() for t, i, _ in every if i != "*"} | {f"{t}:{i}".lower() for t, i, _ in every}
        return F.col("scope_key").isin(*keys) | F.col("scope_type").isin(*{t for t, i, _ in every if i == "*"})

    def scope(self, kind: str, key: str) -> np.ndarray:
        """Each query's scope signal for a record's scope; NaN where it isn't asked for."""
        if self.requested is None:
            return np.full(len(self.ids), 0.5)
        if key not in self.scopes:
            out = np.full(len(self.ids), np.nan)
            for q, asked in enumerate(self.requested):
                if not asked:
                    out[q] = 0.5
                for t, i, w in asked:
                    if t == kind and (i == "*" or f"{t}:{i}".lower() == key):
                        out[q] = min(max(w, 0.0), 1.5) / 1.5
                        break
            if len(self.scopes) > 10_000:
                self.scopes.clear()
            self.scopes[key] = out
        return self.scopes[key]

    def frequencies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often phrases stand in rows of terms: row, phrase, count."""
        values, row = _flat(column)
        hit, at = self.single.find(values)
        rows, found = [row[hit]], [self.single_at[at]]
        if self.longer:
            starts, _ = self.first.find(values)
            by_first = values[starts]
            for phrase, i in self.longer:
                s = starts[by_first == phrase[0]]
                for o, term in enumerate(phrase[1:], 1):
                    s = s[s + o < len(values)]
                    s = s[(values[s + o] == term) & (row[s + o] == row[s])]
                rows.append(row[s]), found.append(np.full(len(s), i, np.int64))
        key, n = np.unique(np.concatenate(rows) * max(1, len(self.phrase_ids)) + np.concatenate(found), return_counts=True)
        return *np.divmod(key, max(1, len(self.phrase_ids))), n


def blocks(queries: DataFrame, requested: DataFrame | None) -> list[Block]:
    """Queries (query_id, text), with the scopes asked for, in blocks of bounded size; they are parameters, so they pass through the driver block by block."""
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "text").filter(T.trim("text") != "")
    if requested is not None:
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
        asked = requested.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "scope_type", T.trim("scope_id").alias("scope_id"), weight.alias("weight")))).alias("asked"))
        q = q.join(asked, "query_id", "left")
    out, rows, held = [], [], 0
    for r in q.orderBy("query_id").toLocalIterator():
        rows.append((r.query_id, r.text, [(x.scope_type, x.scope_id, x.weight) for x in r.asked or ()] if requested is not None else []))
        held += len(r.text)
        if len(rows) == BLOCK or held > BLOCK_BYTES:
            out.append(Block(rows, requested is not None))
            rows, held = [], 0
    return [*out, Block(rows, requested is not None)] if rows or not out else out


def _index_text() -> Column:
    return F.concat_ws("\n", "kind", "content", "summary", F.array_join("tags", " "), F.concat_ws(":", "scope_type", "scope_id"))


def full_text_ranks(indexed: DataFrame, block: Block, most: int = FTS_RANKS) -> DataFrame:
    """(query_id, id, rank from 0) of the best records by BM25 over the index; a query is the union of its phrases.

    A query that asks for scopes ranks the records of those only (``indexed`` then has their ``scope``, type:id), by statistics of the whole index. Scopes are
    compared as they are written: another case is another scope, and a wildcard finds nothing, so such a query has no full-text signal.
    """
    scoped = block.requested is not None
    shared = indexed.sparkSession.sparkContext.broadcast(block)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, length = np.zeros(len(shared.value.phrase_ids), np.int64), 0, 0
        for b in batches:
            df += np.bincount(shared.value.frequencies(b.column(0))[1], minlength=len(df))
            total, length = total + b.num_rows, length + len(b.column(0).flatten())
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *range(len(df))], pa.int64()), pa.array([total, length, *df], pa.int64())], ["p", "n"])

    stats = {r.p: r.n for r in indexed.select("terms").mapInArrow(tally, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()}  # as many rows as the block has phrases
    total, length = stats.get(-1, 0), stats.get(-2, 0) / max(1, stats.get(-1, 0))
    idf = [max(BM25_LEAST_IDF, math.log((total - stats.get(p, 0) + 0.5) / (stats.get(p, 0) + 0.5))) for p in range(len(block.phrase_ids))]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = shared.value
        weights = np.zeros((len(b_.phrase_ids), len(b_.ids)))
        for q, ps in enumerate(b_.phrases):
            for p in ps:
                weights[b_.phrase_ids[p], q] = idf[b_.phrase_ids[p]]
        best = _Best(b_.ids, most)
        for b in _slices(batches):
            row, phrase, n = b_.frequencies(b.column(1))
            size = np.diff(b.column(1).offsets.to_numpy())[row]
            tf = np.zeros((b.num_rows, len(b_.phrase_ids)))
            tf[row, phrase] = n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * size / max(length, 1e-9)))
            score = tf @ weights
            if scoped and b.num_rows:
                score[np.stack([b_.outside(x) for x in b.column(2).to_pylist()])] = 0
            best.add(np.where(score > 0, score, -np.inf), b.column(0).to_pylist(), None, lambda i, q: ())
        yield best.batch(["query_id", "id", "score"])

    found = indexed.select("id", "terms", *(["scope"] if scoped else [])).mapInArrow(rank, "query_id string, id string, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most).select("query_id", "id", "rank")


class _Best:
    """The best ``most`` records of each query so far, by score (to nine digits), then birth, then id: never more, however many are equal."""

    def __init__(self, ids: list[str], most: int):
        self.ids, self.most = ids, most
        self.rows: list[list[tuple]] = [[] for _ in ids]
        self.cuts = np.full(len(ids), -np.inf)

    def add(self, score: np.ndarray, keys: list, born: np.ndarray | None, extra) -> None:
        """score: a row for each record, a column for each query; extra(record, query) goes with it."""
        passing = (score >= self.cuts) & (score > -np.inf)
        for q in np.flatnonzero(passing.any(0)).tolist():
            at, kept = np.flatnonzero(passing[:, q]), self.rows[q]
            s = score[at, q]
            if len(at) > self.most:
                best = s >= np.partition(s, len(at) - self.most)[len(at) - self.most] - 1e-9
                at, s = at[best], s[best]
            for i, x in zip(at.tolist(), s.tolist()):
                kept.append((-round(x, 9), 0 if born is None else int(born[i]), keys[i], x, extra(i, q)))
            if len(kept) >= self.most:
                kept.sort(key=lambda r: r[:3])  # the last held is the worst, by which the next are cut
                del kept[self.most :]
                self.cuts[q] = -kept[-1][0] - 1e-9

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """What is held, as query_id, id, score and what goes with it; a column named born is the birth."""
        born = "born" in names
        cols = list(zip(*((i, key, *([at] if born else []), s, *extra) for q, i in enumerate(self.ids) for _, at, key, s, extra in self.rows[q]))) or [()] * len(names)
        kinds = [pa.string(), pa.string(), *([pa.int64()] if born else []), *[pa.float64()] * (len(names) - 2 - born)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _boosts(records: DataFrame, given: DataFrame | None, block: Block) -> DataFrame:
    """Records with a map of the boosts that the block's queries give them; ``given`` is (query_id, id, entity)."""
    if given is None:
        return records.withColumn("entity", F.lit(None).cast("map<string,double>"))
    by_id = given.filter(F.col("query_id").cast("string").isin(block.ids)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("query_id").cast("string"), F.col("entity").cast("double")))).alias("entity"))
    return records.join(by_id, "id", "left")


#: What stands beside a record's index while it is searched.
BESIDE = ("scope", "scope_type", "scope_key", "recency", "importance", "principle", "validity", "born")


def _beside(records: DataFrame, now: Column) -> DataFrame:
    """Records with the columns ``BESIDE``."""
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 86400
    r = hot_keys(records).withColumn("scope", F.concat_ws(":", "scope_type", "scope_id")).withColumn("recency", F.coalesce(1 / (1 + age / 30), F.lit(0.0)))
    r = r.withColumn("principle", (F.col("kind") == "principle").cast("double")).withColumn("validity", F.when(past_validity(now), 0.5).otherwise(1.0))
    return r.withColumn("born", F.unix_micros(F.col("created_at").cast("timestamp")))


def search(records: DataFrame, queries: DataFrame, now: Column, requested: DataFrame | None = None, entity: DataFrame | None = None, fts: bool = True, most: int = 8, least: float = 0.18, weights: dict | None = None, indexed: DataFrame | None = None, named: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best records of each query: query_id, rank, id, score and its eight signals.

    ``indexed`` is the index of the records, where one is kept; otherwise it is made for this search. ``requested`` has the
    scopes of each query (query_id, ord, scope_type, scope_id, weight); without it everything is in scope. Blank queries have no
    hits. Equal scores go by creation time, then id. Boosts by entity are given as rows (``entity``: query_id, id, entity) or, without a row for each query and
    record, as what names are worth and which of them records have (``named``, of ``capture.asked_links``).
    """
    r = _beside(records, now)
    ix = index(r, BESIDE) if indexed is None else r.select("id", *BESIDE).join(indexed, "id")  # index rows of forgotten records stay behind
    ix = storage.written(ix, "index")
    found = [_search(ix, b, entity, named, fts, most, least, WEIGHTS | (weights or {})) for b in blocks(queries, requested)]
    out = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "born", "id")
    best = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return best.select("query_id", "rank", "id", "score", *REASONS)


def _search(ix: DataFrame, block: Block, entity: DataFrame | None, named: tuple[DataFrame, DataFrame] | None, fts: bool, most: int, least: float, w: dict) -> DataFrame:
    spark = ix.sparkSession
    shared = spark.sparkContext.broadcast(block)
    place = {q: i for i, q in enumerate(block.ids)}
    ranked: dict[str, list[tuple[int, float]]] = {}
    for r in full_text_ranks(ix, block).collect() if fts and block.phrase_ids else ():  # FTS_RANKS rows a query of the block at most
        ranked.setdefault(r.id, []).append((place[r.query_id], max(FTS_LEAST, 1 - r["rank"] * FTS_STEP)))
    ranks = spark.sparkContext.broadcast(ranked)
    only = block.only()
    r = _boosts(ix if only is None else ix.filter(only), entity, block)
    if named is None:
        names, worth = {}, np.zeros((0, len(block.ids)))
        r = r.withColumn("names", F.lit(None).cast("array<string>"))
    else:
        asked = named[0].filter(F.col("query_id").cast("string").isin(block.ids)).collect()  # as many rows as the block's queries have names
        names = {n: i for i, n in enumerate(sorted({x.name_key for x in asked}))}
        worth = np.zeros((len(names), len(block.ids)))
        for x in asked:
            worth[names[x.name_key], place[str(x.query_id)]] = x.b
        r = r.join(named[1], "id", "left")
    r = r.select("id", "tokens", "vector", "entity", "names", *BESIDE[1:])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = shared.value
        at = {q: i for i, q in enumerate(b_.ids)}
        best = _Best(b_.ids, most)
        for b in _slices(batches):
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            n = b.num_rows
            has = np.zeros((n, len(b_.member)), np.float32)
            values, row = _flat(c["tokens"])
            hit, known = b_.vocab.find(values)
            has[row[hit], known] = 1
            vec = c["vector"].flatten().to_numpy(zero_copy_only=False).reshape(n, DIMS).astype(float)
            lexical = (has @ b_.member) / np.maximum(b_.size, 1)
            norm = np.sqrt((vec * vec).sum(1))[:, None] * b_.norms
            hashed = np.clip(np.divide(vec @ b_.vectors.T, norm, out=np.zeros_like(norm), where=norm > 0), 0, 1)
            scope = np.full((n, len(b_.ids)), 0.5) if b_.requested is None else np.stack([b_.scope(k, s) for k, s in zip(c["scope_type"].to_pylist(), c["scope_key"].to_pylist())]) if n else np.zeros((0, len(b_.ids)))
            boost = {k: np.zeros((n, len(b_.ids))) for k in ("entity", "fts")}
            for i, pairs in enumerate(c["entity"].to_pylist()):
                for q, v in pairs or ():
                    boost["entity"][i, at[q]] = v
            if names:
                has_name = np.zeros((n, len(names)))
                for i, held in enumerate(c["names"].to_pylist()):
                    has_name[i, [names[x] for x in held or () if x in names]] = 1
                boost["entity"] = np.minimum(boost["entity"] + has_name @ worth, 1.0)
            for i, key in enumerate(c["id"].to_pylist()):
                for q, v in ranks.value.get(key, ()):
                    boost["fts"][i, q] = v
            flat = {k: np.broadcast_to(c[k].to_numpy(zero_copy_only=False)[:, None], lexical.shape) for k in ("recency", "importance", "principle")}
            all_of = {"lexical": lexical, "hash": hashed, "scope": scope, **flat, **boost}
            total = sum(w[k] * all_of[k] for k in REASONS) * c["validity"].to_numpy(zero_copy_only=False)[:, None]
            total = np.where(np.isnan(scope) | (total < least), -np.inf, total)
            born = c["born"].fill_null(1 << 62).to_numpy()
            best.add(total, c["id"].to_pylist(), born, lambda i, q: tuple(float(all_of[k][i, q]) for k in REASONS))
        yield best.batch(["query_id", "id", "born", "score", *REASONS])

    return r.mapInArrow(score, "query_id string, id string, born long, score double, " + ", ".join(f"{k} double" for k in REASONS))


def with_snippets(hits: DataFrame, records: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with a snippet around the first query token found and the pointers for exact reads."""
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), T.unique_tokens("text").alias("qt"))
    j = hits.join(records.select("id", "content", "metadata"), "id").join(q, "query_id")
    task = F.get_json_object("metadata", "$.taskId")
    tools = F.array_join(F.array_compact(F.array(F.concat(F.lit("get:"), "id"), F.when(task.isNotNull(), F.concat(F.lit("task_window:"), task)))), ";")
    names = [*hits.columns, "snippet", "evidence"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields) + ", snippet string, evidence string"

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = [snippet(t, q) for t, q in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(texts, pa.string()), b.column(b.num_columns - 3)], names)

    return j.select(*hits.columns, tools.alias("evidence"), "content", "qt").mapInArrow(cut, types)


BLANK_RUN = re.compile(f"[{re.escape(T.BLANKS)}]+")


def snippet(content: str, tokens: list[str]) -> str:
    """A text of at most 220 characters whole, else a cut around the first query token found in it, else its head."""
    s = BLANK_RUN.sub(" ", content).strip(T.BLANKS)
    if len(s) <= 220:
        return s
    low = s.lower()
    at = next((low.index(t) for t in tokens if t in low), None)
    if at is None:
        return s[:217] + "..."
    start, end = max(0, at - 90), min(len(s), at + 130)
    return ("..." if start else "") + s[start:end] + ("..." if end < len(s) else "")


def containing(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, id) of records whose content contains the query's text, by an equi-join on the rarest word inside each text.

    Words are what single blanks separate; those at the ends may be cut, so texts of fewer than three words have none inside and are
    compared with every record.
    """
    q = queries.select("query_id", "text").filter("text <> ''").withColumn("inner", F.array_distinct(F.slice(F.split("text", " "), 2, F.greatest(F.size(F.split("text", " ")) - 2, F.lit(0)))))
    asked = q.select("query_id", F.explode("inner").alias("w"))
    held = records.select("id", F.explode(F.array_distinct(F.split("content", " "))).alias("w"))
    df = held.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(df, "w").groupBy("query_id").agg(F.min(F.struct("df", "w")).alias("r"), F.count(F.lit(1)).alias("n"))
    whole = rarest.join(q.select("query_id", "text", F.size("inner").alias("size")), "query_id").filter("n = size").select("query_id", "text", F.col("r.w").alias("w"))
    near = storage.written(storage.written(whole, "rarest").join(held, "w").select("query_id", "text", "id"), "near")  # written, so that a join knows how small they are and needs no contents shuffled
    met = near.join(records.select("id", "content"), "id").filter(F.contains("content", F.col("text"))).select("query_id", "id")
    short = q.filter(F.size("inner") == 0).select("query_id", "text").join(records.select("id", "content"), F.contains("content", F.col("text"))).select("query_id", "id")
    return met.unionAll(short)


# -- recall


def recall_query(query: Column, recent: Column, most: int = 1200) -> Column:
    """The query and recent messages, blank ones left out, cut to ``most``."""
    parts = F.filter(F.transform(F.concat(F.array(query), F.coalesce(recent, F.array().cast("array<string>"))), T.trim), lambda x: x != "")
    return F.substring(F.array_join(parts, "\n\n"), 1, most)


def recall_context(hits: DataFrame, records: DataFrame, most: int = 4000, head_chars: int | None = None) -> DataFrame:
    """The text that a recall injects: a head, then blocks by rank until the first that would not fit. The head counts with its own characters, or as ``head_chars``."""
    head = "Relevant long-term memory:\nUse these memories as supporting context.\n"
    j = storage.written(hits.select("query_id", "rank", "id", "score"), "hits").join(records.select("id", "kind", "scope_type", "scope_id", "source", "tags", "metadata", "content"), "id")
    marks = F.concat_ws("; ", F.concat(F.lit("id: "), "id"), F.concat(F.lit("source: "), "source"), F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", "))), F.when(F.col("metadata").isNotNull(), F.concat(F.lit("metadata: "), "metadata")))
    block = F.concat(F.lit("- ["), "kind", F.lit("] "), "scope_type", F.lit(":"), "scope_id", F.lit(" (score "), F.format_string("%.2f", "score"), F.lit(")\n  markers: "), marks, F.lit("\n  "), T.trim("content"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    b = j.withColumn("block", block).withColumn("used", F.lit(len(head) if head_chars is None else head_chars) + F.sum(F.length("block") + 1).over(w)).withColumn("over", F.max((F.col("used") > most).cast("int")).over(w))
    lines = b.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("over") == 0, F.struct("rank", "block")))).alias("bs"), F.count_if(F.col("over") == 0).alias("blocks"))
    return lines.select("query_id", "blocks", F.array_join(F.concat(F.array(F.lit(head)), F.transform("bs", lambda x: x.block)), "\n").alias("context"))


def navigation(records: DataFrame, items: int = 6, most: int = 1200) -> DataFrame:
    """Per scope the weightiest records with pointers, until the first line that would not fit; nothing below 120 characters."""
    w = Window.partitionBy("scope_key").orderBy(F.col("importance").desc(), F.col("updated_at").desc(), "created_at", "id")
    task = F.get_json_object("metadata", "$.taskId")
    line = F.concat(F.lit("- "), "kind", F.lit(" "), "scope_type", F.lit(":"), "scope_id", F.lit(" id="), "id", F.coalesce(F.concat(F.lit(" task="), task), F.lit("")), F.lit(" summary="), F.regexp_replace(F.coalesce("summary", "content"), f"{T.WS}+", " "))
    top = records.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= items).withColumn("line", line)
    run = Window.partitionBy("scope_key").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    b = top.withColumn("used", F.lit(19) + F.sum(F.length("line") + 1).over(run)).withColumn("over", F.max((F.col("used") > most).cast("int")).over(run)).filter((F.col("over") == 0) & F.lit(most >= 120))
    return b.groupBy("scope_key").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.concat(F.array(F.lit("Memory navigation:")), F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x.line)), "\n").alias("navigation"))


# -- vectors


def vector_search(vectors: DataFrame, queries: DataFrame, most: int = 10, least: float = 0.0, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Exact cosine search: query_id, rank, id, score clamped to 0..1. Queries (query_id, vector) go to the tasks in blocks."""
    spark = vectors.sparkSession
    found, rows = [], []

    def one(rows_: list) -> DataFrame:
        ids = [r[0] for r in rows_]
        matrix = np.array([r[1] for r in rows_], float)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            best = _Best(names, most)
            for b in _slices(batches):
                b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), m.shape[1]), False))
                if not b.num_rows:
                    continue
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                s = np.clip(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0) @ m.T, 0, 1)
                best.add(np.where(s >= least, s, -np.inf), b.column(0).to_pylist(), None, lambda i, q: ())
            yield best.batch(["query_id", "id", "score"])

        return vectors.select(F.col(id_col).cast("string").alias("id"), vector_col).mapInArrow(score, "query_id string, id string, score double")

    for r in queries.select(F.col("query_id").cast("string"), "vector").orderBy("query_id").toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == BLOCK:
            found.append(one(rows))
            rows = []
    if rows or not found:
        found.append(one(rows))
    out = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "id", "score")


def merged_scopes(hits: DataFrame, most: int) -> DataFrame:
    """Hits found in several scopes (query_id, id, score), each once with its best score, ranked anew."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def fused(base: DataFrame, semantic: DataFrame, share: float = 0.35) -> DataFrame:
    """Base scores mixed with embedding similarities (query_id, id, similarity)."""
    j = base.join(semantic, ["query_id", "id"], "left")
    return j.withColumn("score", (1 - share) * F.col("score") + share * T.clamp(F.coalesce("similarity", F.lit(0.0)), 0, 1)).drop("similarity")


def reranked(hits: DataFrame, scores: DataFrame, pool: int = 40, least: int = 3) -> DataFrame:
    """The first ``pool`` hits by 0.6 reranker score + 0.4 base score over its greatest; fewer than ``least`` hits stay as they are; pairs
    without a score count as -1."""
    w = Window.partitionBy("query_id")
    p = hits.withColumn("n", F.count(F.lit(1)).over(w)).filter((F.col("rank") <= pool) | (F.col("n") < least))
    top = F.greatest(F.max("score").over(w), F.lit(1e-12))
    j = p.join(scores.select("query_id", "id", "rerank"), ["query_id", "id"], "left").withColumn("fused", F.when(F.col("n") < least, F.col("score")).otherwise(0.6 * F.coalesce("rerank", F.lit(-1.0)) + 0.4 * F.col("score") / top))
    order = Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "rank")
    return j.withColumn("new_rank", F.row_number().over(order)).select("query_id", "id", F.col("new_rank").alias("rank"), F.col("fused").alias("score"))

"""Phrase collocation mining by Suffix-sigma.

Each word position of a text gives one suffix: the words from there to the end of its piece, ``max_n`` at most. Suffixes are dealt by language and
first word and sorted in reverse order within a task, so that all suffixes with a common beginning lie together, the beginning
itself last; one stack of at most ``max_n`` words then counts the prefixes of all of them in one pass, that is, all phrases. The parts of a phrase are
phrases too, so their counts are joined afterwards.

Two passes come before. The first counts words, which are the phrases of one word. The second counts hashed pairs of neighbours: a phrase can't be more
frequent than its pairs, so a suffix ends before the first pair that is too rare for any phrase, and one that ends after a word isn't sent at all. The
frequent pairs are a bitmap of fixed size, whatever the corpus; what shares a bit with one is sent too, and counted, so nothing is lost or added.

Equal suffixes of a map task are combined before they are shuffled. A word of which there are more than a quarter of
a task's share is dealt to several tasks by its whole suffix: the counts of its shorter phrases are then partial, and summed at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import common
from engram.llm.shingles import mix, word_hash, word_hashes
from engram.operators.numbering import numbered

MAX_N, LEAST, CONTAINED, TOP = 3, 10, 50, 2000
#: Suffixes that a map task holds before it hands them on, and rows of a batch that counting hands on.
HELD, ROWS = 800_000, 50_000
#: Pairs that a map task holds, and bits of the bitmap of frequent pairs (16 MB).
PAIRS, FILTER_BITS = 5_000_000, 27
#: Pieces end at any of ``.,;:!?`` and line ends, which all become a dot; words end at blanks and tabs.
_ENDS = bytes.maketrans(b"\t,;:!?\n\v\f\r", b" .........")
SEP = b"\t"
#: What sorts below the separator would part a phrase from its longer ones, so it is written as a line end (in no word) and a letter.
_LOW = re.compile(rb"[\x00-\x08]")


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a dot, which is no word, at the ends of pieces."""
    plain = text.lower().translate(_ENDS)
    found = plain.replace(b".", b" . ").split()
    return [_LOW.sub(lambda m: b"\n" + bytes([65 + m[0][0]]), w) for w in found] if _LOW.search(plain) else found


def pairs(words: list[bytes], lang: str) -> np.ndarray:
    """A hash for each word and its next, in that language; 0 where one of them is the end of a piece."""
    h = word_hashes(words)
    out = mix((h[:-1] ^ np.uint64(xxhash.xxh3_64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15) + h[1:]) | np.uint64(1)
    end = h == np.uint64(word_hash(b"."))
    out[end[:-1] | end[1:]] = 0
    return out


def suffixes(words: list[bytes], good: np.ndarray, max_n: int) -> list[bytes]:
    """From each word that has a good pair with the next: words as long as their pairs are good, ``max_n`` at most, joined by tabs."""
    length = good.astype(np.int64)
    on = good.copy()
    for o in range(1, max_n - 1):
        on[: len(good) - o] &= good[o:]
        on[len(good) - o :] = False
        length += on
    at = np.flatnonzero(length)
    return [SEP.join(words[i : i + n]) for i, n in zip(at.tolist(), (length[at] + 1).tolist())]


def _shown(phrase: str) -> Column:
    """A phrase with blanks between its words, as they stood."""
    out = F.translate(phrase, SEP.decode(), " ")
    for low in range(9):
        out = F.replace(out, F.lit("\n" + chr(65 + low)), F.lit(chr(low)))
    return out


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), common.utf8(text_col).alias("text")).filter(F.octet_length("text") > 0)


def _pairs(texts: DataFrame) -> DataFrame:
    """(h, n): pairs counted within tasks, as far as ``PAIRS`` allows."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

        for b in rows:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                if len(words) > 1:
                    found = pairs(words, lang)
                    held.append(found[found != 0])
                    size += len(held[-1])
                if size > PAIRS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(emit, "h long, n int")


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits set for the hashes (h): at most 2 ** (FILTER_BITS - 6) rows reach the driver, whatever the corpus."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = frequent.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63))")).alias("word")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return out


def _mapped(texts: DataFrame, max_n: int, frequent=None) -> DataFrame:
    """(lang, suffix, n), combined within a task as far as ``HELD`` allows: words, or with a broadcast bitmap of frequent pairs the suffixes of two words and more."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                found.pop(b".", None)
                if found:
                    keys = pa.array(list(found), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(found)), keys, pa.array(list(found.values()), pa.int64())], ["lang", "suffix", "n"])
            held.clear()

        for b in rows:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                if frequent is not None:
                    if len(words) < 2:
                        continue
                    h = pairs(words, lang)
                    bit = h >> np.uint64(64 - FILTER_BITS)
                    good = (h != 0) & ((frequent.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
                    words = suffixes(words, good, max_n)
                held.setdefault(lang, Counter()).update(words)
                if len(held[lang]) > HELD:
                    yield from flush()
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(emit, "lang string, suffix string, n long")


def prefix_counts(rows: Iterator[tuple], max_n: int, least: int, shortest: int = 1) -> Iterator[tuple]:
    """(lang, phrase, count) of all prefixes, of ``shortest`` words or more, of reverse-sorted (lang, suffix, count, dealt) with one stack.

    ``dealt``: the first word is spread over tasks, so what is shorter than ``max_n`` is handed on whatever its count; anything else is complete
    and is dropped below ``least``.
    """
    stack: list[bytes] = []  # prefixes, each with a tab behind, and how often each was met so far
    counts: list[int] = []
    now, spread, before = None, False, None
    for lang, suffix, n, dealt in rows:
        if suffix == before and lang == now:
            counts[-1] += n
            continue
        whole = suffix + SEP
        while stack and (lang != now or not whole.startswith(stack[-1])):
            size, phrase, met = len(stack), stack.pop(), counts.pop()
            if size >= shortest and (met >= least or (spread and size < max_n)):
                yield now, phrase[:-1], met
            if counts:
                counts[-1] += met
        now, spread, before = lang, dealt, suffix
        at, end = len(stack[-1]) if stack else 0, len(whole)
        while at < end:
            at = whole.find(SEP, at) + 1
            stack.append(whole[:at])
            counts.append(0)
        counts[-1] += n
    while stack:
        size, phrase, met = len(stack), stack.pop(), counts.pop()
        if size >= shortest and (met >= least or (spread and size < max_n)):
            yield now, phrase[:-1], met
        if counts:
            counts[-1] += met


def _counted(suffix: DataFrame, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, n) of sorted suffixes (lang, suffix, n, dealt)."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"lang": [], "phrase": [], "n": []}
        for lang, phrase, n in prefix_counts(rows_of(batches), max_n, least, 2):
            out["lang"].append(lang), out["phrase"].append(phrase.decode()), out["n"].append(n)
            yield from common.batches(out, schema, ROWS)
        yield from common.batches(out, schema)

    return suffix.mapInArrow(count, "lang string, phrase string, n long")


def phrases(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``max_n`` words with ``least`` occurrences or more (lang, phrase with tabs, f), and the number of words by language (lang, n)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    texts = _texts(docs, lang_col, text_col)
    words = common.written(_mapped(texts, 1).groupBy("lang", "suffix").agg(F.sum("n").alias("n")), "words")
    totals = common.written(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    single = words.filter(F.col("n") >= least).select("lang", F.col("suffix").alias("phrase"), F.col("n").alias("f"))
    frequent = spark.sparkContext.broadcast(_bitmap(_pairs(texts).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hot = words.filter(F.col("n") > share).select("lang", F.col("suffix").alias("first"), F.ceil(F.col("n") / share).cast("int").alias("tasks"))  # 4 * parts rows at most
    first = F.substring_index("suffix", SEP.decode(), 1)
    found = _mapped(texts, max_n, frequent).withColumn("first", first).join(F.broadcast(hot), ["lang", "first"], "left").select("lang", "suffix", "n", "tasks")
    salt = F.when(F.col("tasks").isNotNull(), F.pmod(F.xxhash64("suffix"), "tasks"))
    dealt = found.repartition(F.col("lang"), first, salt).select("lang", "suffix", "n", F.col("tasks").isNotNull().alias("dealt")).sortWithinPartitions("lang", F.desc("suffix"))
    f = _counted(dealt, max_n, least).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return common.written(single.unionByName(f), "phrases"), totals


def collocations(
    docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, contained: int = CONTAINED, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The best phrases of 2 to ``max_n`` words of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    a: occurrences, ``least`` or more; of all cuts in two the one with the lowest floor(1,000,000 a a / (l r)), the first of equals, where l and r are
    the occurrences of its parts; n: words of the language. A phrase within a longer one with at least ``contained`` percent of its
    occurrences is left out. ``top`` ranks of a language are returned (None: all), by score, a and the phrase's bytes. Products are decimals of 38 digits, exact for
    counts below 10 ** 15.

    Null texts are empty, a null language is ``und``; rows are counted as often as they stand, whatever their ids; columns besides the two
    that are named aren't read. An empty table has no phrases.
    """
    f, totals = phrases(docs, max_n, least, lang_col, text_col)
    tab = SEP.decode()
    words = F.split("phrase", tab)
    long = f.withColumn("words", words).withColumn("m", F.size("words")).filter("m >= 2").withColumnRenamed("f", "a")
    cuts = long.select("lang", "phrase", "a", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "a", "k", F.expr(f"substring_index(phrase, '{tab}', k)").alias("first"), F.expr(f"substring_index(phrase, '{tab}', k - m)").alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("phrase", F.concat_ws(tab, "first", "rest"))
    exact = lambda c: f"cast({c} as decimal(15, 0))"
    score = F.expr(f"({exact('a')} * {exact('a')} * cast(1000000 as decimal(7, 0))) div ({exact('l')} * {exact('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, m - 1), j -> transform(sequence(0, m - j), i -> array_join(slice(words, i + 1, j), '" + tab + "'))))")
    within = long.filter("m >= 3").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    shown = kept.select("lang", _shown("phrase").alias("phrase"), "a", "cut.l", "cut.r", F.col("cut.score").alias("score"))
    ranked = numbered(shown, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank")
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Token counts by prefix dynamic programming.

A byte-level BPE splits a text into pieces by a fixed pattern and merges within a piece. For every
prefix of a piece exactly one token can end it: the token ``t`` for which the encoding of what stands
before ``t`` may be followed by ``t``, that is, for which the pair (last token before, ``t``) encodes to
itself. So one pass over a piece gives the last token and the exact count at each of its prefixes.

The counts of all prefixes of a text are stored with its row, as differences from character to character (a byte each,
compressed). Limits, truncation points and budgets are read from them; nothing is encoded again. Pieces
repeat, so their differences are kept in a bounded cache of each worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common

#: Entries of pieces and of pairs that a worker adds before it lets go of those not used since as many were added.
CACHE = 400_000
#: Bytes up to which the prefixes of a piece are kept for others that begin alike.
SHORT = 64
#: Fixed value: the pattern by which byte-level BPE of this family splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pieces of three characters whose first two are two pieces.
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class _Cache(dict):
    """A bounded dict that computes what it misses; what is used again survives a change of generation."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes under one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        added = [a["content"] for a in spec.get("added_tokens", [])]
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        merged = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for r, (a, b) in enumerate(merged):
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.rank[a, b] = r
            self.halves.setdefault(a + b, (a, b))
        self.longest = max(map(len, self.ids))
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[-3:], {1, 2} if token[-2:] in self.ids else {1}).add(len(token))
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items()}
        self.split = regex.compile(PATTERN)
        self.gap = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.left_edge = _Cache(lambda token: self.edge(token, 0))
        self.right_edge = _Cache(lambda token: self.edge(token, 1))
        self.fits = _Cache(self.pair_stays)
        self.steps = _Cache(self.piece_steps)
        self.context: dict[tuple[bytes, bytes], int] = {}
        self.known: dict[bytes, tuple[int, bytes]] = {}  # prefixes of short pieces: count and last token

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token that stand at its left (0) or right (1) edge as it is merged, each with the rank of the merge that ends it."""
        out, ends = [(token, 1 << 60)], 0
        while token in self.halves:
            pair = self.halves[token]
            ends, token = self.rank[pair], pair[side]
            out.append((token, ends))
        return out

    def pair_stays(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two tokens side by side encode to themselves: no merge across their border comes before both sides have moved on.

        Of merges of equal rank the left one comes first.
        """
        rank = self.rank
        for a, a_ends in self.right_edge[pair[0]]:
            for b, b_ends in self.left_edge[pair[1]]:
                r = rank.get((a, b))
                if r is not None and r < a_ends and r <= b_ends:
                    return False
        return True

    def piece_table(self, piece: bytes) -> list[int]:
        """Token counts of all byte prefixes of a piece, from the empty one on.

        The last token at a place hangs on the bytes and last tokens of a bounded stretch before it, so in a long piece
        a stretch that was met before (as in long runs) is looked up.
        """
        ids, fits, lengths, context, reach = self.ids, self.fits, self.lengths, self.context, self.longest
        last = bytearray(len(piece) + 1)  # length of the last token
        count = [0] * (len(piece) + 1)
        known_from = 2 * reach if len(piece) > 4 * reach else len(piece) + 1
        for end in range(1, len(piece) + 1):
            length = key = None
            if end >= known_from:
                key = piece[end - 2 * reach : end], bytes(last[end - reach : end])
                length = context.get(key)
            if length is None:
                for length in lengths.get(piece[max(0, end - 3) : end], (2, 1)):
                    start = end - length
                    if start >= 0 and (token := piece[start:end]) in ids and (not start or fits[piece[start - last[start] : start], token]):
                        break
                else:
                    raise ValueError("a prefix has no encoding under this vocabulary")
                if key:
                    if len(context) >= CACHE // 10:
                        context.clear()
                    context[key] = length
            last[end] = length
            count[end] = count[end - length] + 1
        return count

    def short_table(self, piece: bytes) -> list[int]:
        """The same for a short piece, with what is known of its prefixes."""
        ids, fits, lengths, known = self.ids, self.fits, self.lengths, self.known
        if len(known) > 2 * CACHE:
            known.clear()
        count, last = [0], [b""]
        for end in range(1, len(piece) + 1):
            found = known.get(prefix := piece[:end])
            if found is None:
                for length in lengths.get(piece[max(0, end - 3) : end], (2, 1)):
                    start = end - length
                    if start >= 0 and (token := piece[start:end]) in ids and (not start or fits[last[start], token]):
                        break
                else:
                    raise ValueError("a prefix has no encoding under this vocabulary")
                found = known[prefix] = count[start] + 1, token
            count.append(found[0]), last.append(found[1])
        return count

    def piece_steps(self, piece: str) -> bytes:
        """By how much the count changes with each character of a piece, a signed byte each (a token of up to 128 bytes can replace as many)."""
        raw = piece.encode()
        table = self.short_table(raw) if len(raw) <= SHORT else self.piece_table(raw)
        if piece in CONTRACTIONS:
            table[2] = 2
        if len(raw) > len(piece):  # only the ends of characters count
            table = [n for n, byte in zip(table, [*raw, 0]) if byte & 0xC0 != 0x80]
        return bytes([b - a & 255 for a, b in pairwise(table)])

    def total(self, piece: str) -> int:
        return int(np.frombuffer(self.steps[piece], np.int8).sum(dtype=np.int64))

    def plain_steps(self, text: str) -> np.ndarray:
        """The steps of a text without special strings.

        A run of white space before a word gives its last character to the next piece, but is one piece where a cut
        ends the text behind it: that one count is set apart.
        """
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, self.split.findall(text))), np.int8)
        off = [(m.end(), self.total(run := m.group()) - self.total(run[:-1]) - self.total(run[-1])) for m in self.gap.finditer(text)]
        if any(d for _, d in off):
            steps = steps.copy()
            at, by = np.array(off, np.int64).T
            steps[at - 1] += by.astype(np.int8)
            steps[at] -= by.astype(np.int8)
        return steps

    def text_steps(self, text: str) -> np.ndarray:
        """By how much the count changes with each character: their sums are the exact counts of ``text[:i]`` for every i.

        A special string is one token once it is complete; cut within, it is ordinary text.
        """
        if self.specials is None or not any(s in text for s in self.special):
            return self.plain_steps(text)
        out, before = [], ""
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                inside = self.plain_steps(before + part[:-1])[len(before) :].astype(np.int64)
                out.append(np.r_[inside, 1 - inside.sum()].astype(np.int8))
                before = ""
            else:
                before = part
                out.append(self.plain_steps(part))
        return np.concatenate(out)

    def count(self, text: str) -> int:
        return int(self.text_steps(text).sum(dtype=np.int64))

    def prefix_table(self, text: str) -> list[int]:
        """Exact counts of ``text[:i]`` for every i."""
        return [0, *np.cumsum(self.text_steps(text), dtype=np.int64).tolist()]


def stored_counts(steps: bytes) -> np.ndarray:
    """The counts of all prefixes, from the empty one on, of a stored table."""
    raw = zstandard.ZstdDecompressor().decompress(steps) if steps else b""
    return np.r_[0, np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64)]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text, whether the tokens exceed ``limit``, and the counts of all its prefixes: no shuffle, one pass.

    A null or empty text has 0 bytes and 0 tokens and an empty table; a null id stays null; repeated rows give repeated rows; other
    columns are not read; an empty table gives no rows. ``path`` names a byte-level BPE vocabulary in the ``tokenizers`` JSON
    format, which every executor must have. Returns id, n_bytes, n_tokens, over_limit, prefix_steps (the table: see ``stored_counts``).
    """
    common.small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_of, pack = counter(path).text_steps, zstandard.ZstdCompressor(level=1).compress
        for b in rows:
            n, tables = [], []
            for t in b.column(2).to_pylist():
                steps = steps_of(t)
                n.append(int(steps.sum(dtype=np.int64))), tables.append(pack(steps.tobytes()) if t else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(tables, pa.binary())], [id_col, "n_bytes", "n_tokens", "prefix_steps"])

    out = kept.mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, prefix_steps binary")
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "prefix_steps")


def budget_points(counted: DataFrame, budget: int, at_char: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """What the stored tables say of a budget, without the texts: id, n_chars (of the longest prefix with at most ``budget`` tokens), its
    n_tokens, and tokens_at (those of the first ``at_char`` characters, or of all where there are fewer; null without ``at_char``).

    A null or empty table has 0 of all.
    """
    common.small_batches(counted.sparkSession)
    id_type = counted.schema[id_col].dataType.simpleString()

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            chars, tokens, at = [], [], []
            for steps in b.column(1).to_pylist():
                counts = stored_counts(steps)
                chars.append(int(np.flatnonzero(counts <= budget)[-1])), tokens.append(int(counts[chars[-1]]))
                at.append(None if at_char is None else int(counts[min(at_char, len(counts) - 1)]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (chars, tokens, at))], [id_col, "n_chars", "n_tokens", "tokens_at"])

    return counted.select(id_col, "prefix_steps").mapInArrow(read, f"`{id_col}` {id_type}, n_chars long, n_tokens long, tokens_at long")

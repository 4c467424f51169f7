"""Best-fit packing of token ids into fixed-length sequences.

Bounded-space online best-fit: a packer keeps at most ``OPEN_BINS`` open
sequences in a bitset with one bit for each amount of free space, so the fullest sequence that still holds
a piece is the lowest set bit at or above its length; when too many are open, the fullest closes first. Pieces arrive in random runs of
about ``RUN_PIECES``, longest first within a run, so that the open sequences of one run are filled by the short pieces at its end. Texts
are tokenised once; only piece lengths travel to the packers.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm import common
from engram.llm.tokens import PATTERN, byte_letters

#: Open sequences of a packer, pieces that arrive in one descending run, and the pieces that one packer takes.
OPEN_BINS, RUN_PIECES = 1024, 4096
PACKER_PIECES = 100_000
_ENCODERS: dict[str, tiktoken.Encoding] = {}
_LIBRARY: dict[str, Tokenizer] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """A fast encoder with the vocabulary of a byte-level BPE JSON file; ids are its merge order."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def token_ids(path: str, text: str) -> list[int]:
    """The ids of a text under the vocabulary, special strings as the vocabulary's library takes them.

    The fast encoder's pattern search runs out of stack on very long runs of white space; such a text goes to the library itself.
    """
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        if path not in _LIBRARY:
            _LIBRARY[path] = Tokenizer.from_file(path)
        return _LIBRARY[path].encode(text, add_special_tokens=False).ids


class BestFit:
    """Online best-fit over at most ``open_bins`` open sequences of ``size`` tokens."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: a sequence with f free tokens is open
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open = self.n_sequences = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset for a piece of 1 to ``size`` tokens."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            seq = self._take(room)
        else:
            room, seq = self.size, self.n_sequences
            self.n_sequences += 1
        if left := room - length:
            self.bins[left].append(seq)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
        return seq, self.size - room

    def _take(self, room: int) -> int:
        seq = self.bins[room].pop()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        self.n_open -= 1
        return seq


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: its ids, then ``end_id``; longer ones cut into ``size``, the first may be shorter."""
    common.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(np.asarray(token_ids(path, text), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                n, s, k = len(ids), 0, 0
                e = n if n <= size else n % size or size
                while s < n:
                    at.append(i), piece.append(k), start.append(s), length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
                    s, e, k = e, e + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    return kept.mapInArrow(cut, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """Pack all documents: id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    Null and empty texts are the end id alone, one piece of one token. Repeated rows are packed as often as
    they occur. An empty table gives no rows. Special strings in a text become their ids, as the
    vocabulary's library does by default. The packers' number follows the number of pieces, so no task holds more
    than about ``packer_pieces`` rows of a few bytes each. A sequence that closes part-filled, because more than ``open_bins`` are open,
    costs what it leaves free.
    """
    spark = docs.sparkSession
    cut = common.written(pieces(docs, path, size, end_id, id_col, text_col), "pieces")
    n = cut.count()
    packers = max(1, -(-n // packer_pieces))
    runs = max(1, n // packers // RUN_PIECES)
    id_type = docs.schema[id_col].dataType.simpleString()

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for b in rows:
            put = [fit.place(n) for n in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([first + s for s, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    mark = F.xxhash64("ids_crc32", id_col, "piece")
    dealt = cut.repartition(packers).sortWithinPartitions(F.pmod(mark, F.lit(runs)), F.col("length").desc(), mark, F.col(id_col), "piece")
    return dealt.mapInArrow(place, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

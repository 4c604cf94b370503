"""Byte-level BPE by a rank file: encoding with a hierarchical-bitmap rank queue, and decoding.

A text falls into pre-tokens by a pattern, each of which is merged by itself: again and again the adjacent
pair of least rank, of those the leftmost, becomes one symbol. The pairs wait in buckets, one for each rank,
which hold places in a linked list of symbols. A bitmap of three levels tells which buckets hold anything, and
find-first-set on each level picks the next rank in a constant number of steps. Entries whose pair is gone by
then are skipped. So a pre-token of n bytes costs n times the cost of a bucket, however long it is.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tamarack.llm import common
from tamarack.session import ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Most bytes of a rank file, as it is sent to every executor.
MOST_BYTES = 64 << 20
#: Characters of a text that are split at once, and the pre-tokens remembered in a task.
STRETCH = 1 << 20
SHORT = 64
REMEMBERED = 1 << 20

_CUT = regex.compile(r"(?<=\S)\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each symbol in a file of lines ``base64 rank``; every single byte has to be a symbol."""
    if (size := Path(path).stat().st_size) > MOST_BYTES:
        raise ValueError(f"{path}: {size} bytes, more than {MOST_BYTES}")
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    ranks = {base64.b64decode(symbol): int(rank) for symbol, rank in lines}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not every byte is a symbol")
    return ranks


class RankQueue:
    """Places by rank: a bucket for each rank, and a bitmap of three levels over the buckets that are not empty."""

    __slots__ = ("low", "middle", "top", "buckets")

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def fill(self, ranks: list[int | None]) -> int:
        """Push each place with its rank, where it has one, in order; returns how many have one."""
        buckets, low, middle, top, n = self.buckets, self.low, self.middle, self.top, 0
        for place, rank in enumerate(ranks):
            if rank is None:
                continue
            n += 1
            if rank in buckets:
                heappush(buckets[rank], place)
            else:
                buckets[rank] = [place]
                word = rank >> 6
                low[word] |= 1 << (rank & 63)
                middle[word >> 6] |= 1 << (word & 63)
                top |= 1 << (word >> 6)
        self.top = top
        return n

    def pop(self) -> tuple[int, int]:
        """The least rank and its leftmost place; only while ``top`` is not 0."""
        a = (self.top & -self.top).bit_length() - 1
        bits = self.middle[a]
        b = a << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[b]
        rank = b << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        bits &= bits - 1
        self.low[b] = bits
        if not bits:
            bits = self.middle[a]
            bits &= bits - 1
            self.middle[a] = bits
            if not bits:
                self.top &= self.top - 1
        return rank, bucket[0]

    def clear(self) -> None:
        for rank in self.buckets:
            self.low[rank >> 6] = self.middle[rank >> 12] = 0
        self.buckets.clear()
        self.top = 0


class Encoder:
    """Ids of pre-tokens and of texts under one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.packed = _Packed(self)
        #: symbol of each byte, and of each pair of bytes that is one
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.double = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is a symbol is that symbol."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        n, push, pop = len(piece), self.queue.push, self.queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n))
        #: the symbol at each place, and the one that it makes with the next, of which ``live`` are left
        symbol, double = [self.single[b] for b in piece], self.double
        pair = [double[a][b] for a, b in zip(piece, piece[1:])]
        pair.append(None)
        live = self.queue.fill(pair)
        while live:
            rank, i = pop()
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[j]
            after[i] = end
            before[end] = i
            symbol[i] = rank
            live -= 1
            if pair[j] is not None:
                pair[j] = None
                live -= 1
            if end < n and (rank := rank_of(piece[i : after[end]])) is not None:
                pair[i] = rank
                live += 1
                push(rank, i)
            else:
                pair[i] = None
            if (h := before[i]) >= 0:
                if pair[h] is not None:
                    live -= 1
                if (rank := rank_of(piece[h:end])) is not None:
                    live += 1
                    push(rank, h)
                pair[h] = rank
        self.queue.clear()
        out, i = [], 0
        while i < n:
            out.append(symbol[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        packed = self.packed.__getitem__
        return b"".join(b"".join(map(packed, self.split(part))) for part in _stretches(text))


class _Packed(dict):
    """Packed ids of the short pre-tokens met since it was last full, of a bounded number of them."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.merge(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


#: The encoder that a Python worker used last, so that its next task finds the pre-tokens it knows.
_LAST: list[Encoder] = []


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    if not (_LAST and _LAST[0].ranks is ranks and _LAST[0].pattern == pattern):
        _LAST[:] = [Encoder(ranks, pattern)]
    return _LAST[0]


def _stretches(text: str) -> Iterator[str]:
    """Parts of a long text, cut only before white space that follows something else, where a pre-token begins in any case."""
    at = 0
    while len(text) - at > STRETCH and (cut := _CUT.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _encode(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch, texts in common.sliced(batches, "text", STRETCH):
            ids = [encoder.encode(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = {rank: symbol for symbol, rank in ranks.value.items()}.__getitem__
        for batch, ids in common.sliced(batches, "ids", STRETCH):
            nulls = batch.column("ids").is_null().to_pylist()
            out = [None if null else b"".join(map(symbol, np.frombuffer(x, "<u4").tolist())) for x, null in zip(ids, nulls)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id`` and ``ids``, the ids of its text as little-endian unsigned 32-bit integers.

    ``path`` is a rank file of at most ``MOST_BYTES``, ``pattern`` what its texts are split by; a match has to begin at
    each white space that follows something else, as texts longer than ``STRETCH`` are split part by part there.
    Null and empty texts have no ids. Bytes that are no UTF-8 count as U+FFFD. Texts are encoded whole; a pre-token
    costs time and memory in proportion to its length. Repeated rows get equal answers; other columns are not
    read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(ranks, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the bytes that its ``ids`` stand for; an earlier ``decoded`` is replaced.

    Null ids give null, no ids no bytes. An id that is not in the rank file, or a number of bytes that four does not
    divide, is an error.
    """
    ship(encoded.sparkSession)
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = encoded.drop("decoded")
    return rows.mapInArrow(_decode(ranks), StructType([*rows.schema, StructField("decoded", BinaryType())]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text of ``documents`` and of what they decode to; see ``encode`` and ``decode``."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    decoded = decode(encode(common.load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

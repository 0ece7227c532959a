"""Operator 6: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prosegauge.llm.common import blocks, mix, span_hashes, text_bytes

#: Pieces up to so many bytes are remembered by a Python worker, up to so many pieces; then it starts anew.
CACHED_BYTES, CACHED_PIECES = 48, 200_000
#: Bytes of text that are encoded at a time: a step holds about a hundred bytes of memory for each of them.
STEP_BYTES = 250_000
_WIDTH = 8  # bits of a rank that pick the bit within a word of the bitmap
_PACK = 24  # bits of an id in the key of a pair
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def merges_of(path: str) -> dict[int, int]:
    """Rank of the joined token for each two tokens whose bytes join to a token; the two ids are packed in the key."""
    ranks = ranks_of(path)
    return {
        ranks[token[:cut]] << _PACK | ranks[token[cut:]]: rank
        for token, rank in ranks.items() for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    }


class RankQueue:
    """Linked-list positions by merge rank. A bitmap of words, and above it a bitmap of the words that are not zero,
    lead to the lowest rank that has a bucket by two find-first-set steps."""

    __slots__ = ("buckets", "words", "summary")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.summary = 0

    def open(self, rank: int, bucket: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = bucket
        word = rank >> _WIDTH
        self.words[word] = self.words.get(word, 0) | 1 << (rank & (1 << _WIDTH) - 1)
        self.summary |= 1 << word

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its bucket, leftmost position first; -1 when nothing is left."""
        if not self.summary:
            return -1, []
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits ^ low
        if bits == low:
            self.summary ^= 1 << word
        rank = word << _WIDTH | low.bit_length() - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int], merges: dict[int, int]) -> list[bytes]:
    """Ids of each piece as native 32-bit integers: always the pair of lowest rank merges, the leftmost of equals.

    All pieces share one linked list, with a stop between them that joins nothing, and one queue. An entry is stale
    when its position's pair has changed since. If a merge makes a pair of a lower rank, the rest of the bucket waits,
    so the order inside each piece is that of merging it alone. Linear in the bytes, but for sorting buckets.
    """
    stop = (1 << _PACK) - 1
    single = np.array([ranks[bytes([b])] for b in range(256)] + [stop], np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(lengths.sum()) + len(pieces)
    codes = np.full(total, 256, np.int64)
    stops = np.cumsum(lengths + 1) - 1
    inside = np.ones(total, bool)
    inside[stops] = False
    codes[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    single = single[codes]
    two, which = np.unique(single[:-1] << _PACK | single[1:], return_inverse=True)
    first = np.append(np.array([merges.get(x, -1) for x in two.tolist()], np.int64)[which], -1)
    ids, pair = single.tolist(), first.tolist()
    after, before = list(range(1, total + 1)), list(range(-1, total - 1))
    queue = RankQueue()
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0):]
    if len(order):
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        for group in np.split(order, cuts):
            queue.open(int(first[group[0]]), group.tolist())
    buckets, rank_of = queue.buckets, merges.get
    while True:
        rank, bucket = queue.pop()
        if rank < 0:
            break
        for n, i in enumerate(bucket):
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            before[end] = i
            ids[i], ids[gone], pair[gone] = rank, -1, -1
            right = rank_of(rank << _PACK | ids[end], -1)
            pair[i] = right
            if right >= 0:
                if (own := buckets.get(right)) is None:
                    queue.open(right, [i])
                else:
                    own.append(i)
            left, j = -1, before[i]
            if j >= 0:
                left = rank_of(ids[j] << _PACK | rank, -1)
                if left != pair[j]:
                    pair[j] = left
                    if left >= 0:
                        if (own := buckets.get(left)) is None:
                            queue.open(left, [j])
                        else:
                            own.append(j)
            if -1 < right < rank or -1 < left < rank:
                if n + 1 < len(bucket):
                    queue.open(rank, bucket[n + 1:])
                break
    alive = np.array(ids, np.int64)
    keep = (alive >= 0) & (alive != stop)
    flat = alive[keep].astype(np.uint32).tobytes()
    ends = (np.cumsum(keep)[stops] * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = _LETTER
        elif first == "N":
            kinds[code] = _DIGIT
    kinds[_SPACES] = _SPACE
    return kinds


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the split pattern start in code points of texts in a row; ``first`` marks text starts.

    The pattern takes a contraction, else a run of letters, digits or other signs with one blank before it, else white
    space. So pieces start where runs of a class start, but a run's last blank goes to what follows, and white space
    of two or more before something else leaves its last character apart.
    """
    n = len(points)
    kind = _classes()[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.zeros(n, bool)  # the last white space before something else in the same text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    at = np.flatnonzero(last)
    start[at] = True
    start[at[points[at] == 0x20] + 1] = False
    quote = np.flatnonzero(start & (points == 0x27))
    letters = np.append(points, np.zeros(3, points.dtype))
    ends = np.append(first, np.ones(3, bool))
    one, two = letters[quote + 1], letters[quote + 2]
    near, next_too = ~ends[quote + 1], ~ends[quote + 1] & ~ends[quote + 2]
    short = near & np.isin(one, [ord(c) for c in "stmd"])
    long = next_too & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    for found, size in ((quote[short], 2), (quote[long], 3)):
        rest = found + size
        rest = rest[rest < n]
        # what follows the contraction begins a piece, but for a run that a blank has already begun
        start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes texts in blocks: equal pieces of a block are merged once."""

    def __init__(self, path: str) -> None:
        self.ranks, self.merges = ranks_of(path), merges_of(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces. A piece that is a token itself is that token."""
        if len(self.cache) >= CACHED_PIECES:
            self.cache.clear()
        ids = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(ids) if x is None]
        whole = [self.ranks.get(pieces[i]) for i in new]
        merged = iter(encode_pieces([pieces[i] for i, x in zip(new, whole, strict=True) if x is None], self.ranks,
                                    self.merges)) if None in whole else iter(())
        for i, x in zip(new, whole, strict=True):
            ids[i] = next(merged) if x is None else x.to_bytes(4, sys.byteorder)
            if len(pieces[i]) <= CACHED_BYTES:
                self.cache[pieces[i]] = ids[i]
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # byte where each code point starts
        first = np.zeros(len(points), bool)
        first[np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
        begin = at[piece_starts(points, first)]
        end = np.append(begin[1:], len(data))
        keys = span_hashes(data, begin, end) ^ mix((end - begin).astype(np.uint64))
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        parts = self.pieces([raw[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, base = np.frombuffer(b"".join(parts), np.uint32), np.cumsum(sizes) - sizes
        count = sizes[which]
        stop = np.cumsum(count)
        ids = flat[np.arange(stop[-1]) - np.repeat(stop - count - base[which], count)]
        return ids, np.append(0, stop)[np.searchsorted(begin, offsets)]

    def steps(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows of a batch, some at a time, their ids and where each row's ids start."""
        for a, b in blocks(batch, size=STEP_BYTES):
            part = batch.slice(a, b - a)
            yield part, *self.encode(part.column("text"))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole ``text`` (null: empty) and the text that they decode to.

    One row for each input row, in one narrow stage: doc_id (null stays null), n_tokens, ids_sha256 (ids as
    little-endian 32-bit integers), decoded_sha256, and with ``with_ids`` the ids (array<long>). Empty texts have no
    ids. Repeated rows give repeated rows. Other columns are not read.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path)
        for batch in batches:
            for part, ids, bounds in own.steps(batch):
                each = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [
                    part.column("doc_id"), pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in each], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)

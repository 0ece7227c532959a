"""Operator 12: language-model scoring by a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm import grams
from prosegauge.llm.common import blocks, dropped, mix, saved, span_hashes, text_bytes, words_of

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 4_000_000
#: Most bytes of the filter that are broadcast at a time; a larger filter is broadcast in parts, one after the other.
BROADCAST = 24 << 20
#: Ratio of the counts of neighbouring levels; bits of the filter for each level of each pair, and probes of a level, which
#: all fall into one pair of 64-bit words, half of them into each.
RATIO, BITS, PROBES = 1.5, 16, 8
#: Parts in which blocks meet their words' counts and are dealt, one after the other, to hold less on disk.
TURNS = 3
#: Every how many documents, by crc32 of the id, are held out, and at which remainder.
FOLDS, FOLD = 7, 2
_LOWS = np.unique([math.ceil(RATIO**i) for i in range(100)])
_MEANS = np.append(0.0, (_LOWS[:-1] + _LOWS[1:] - 1) / 2)
#: Levels of how often a context occurs, told apart in the last bits of a pair's key.
_CONTEXTS = 64
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_START, _END = mix(np.array([11, 13], np.uint64))
_BLOCKS = "docs array<struct<id:bigint,held:boolean,size:int>>, words binary, tokens binary"


def held_out(doc_id: Column) -> Column:
    """Whether a document trains nothing; null without an id, and it trains nothing either."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD


def _planes(places: np.ndarray) -> bytes:
    """Small numbers byte by byte: first the low bytes of all, then the next. Frequent words have small places, so high
    bytes are mostly zeros, which files and shuffles compress."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places_of(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def tokenised(docs: DataFrame) -> DataFrame:
    """Whole texts in blocks: documents (id, held, size), hashes of the block's different words, frequent ones first, and
    each token's place among them. Each document ends with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch, size=BLOCK):
                part = batch.slice(a, b - a)
                data, starts = text_bytes(part.column("text"))
                data = _FOLDED[data]
                begin, end, text = words_of(data, starts)
                size = np.bincount(text, minlength=len(part)) + 1
                last = np.cumsum(size) - 1
                token = np.full(int(size.sum()), _END, np.uint64)
                inner = np.ones(len(token), bool)
                inner[last] = False
                token[inner] = span_hashes(data, begin, end)
                words, place, times = np.unique(token, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                row = pa.StructArray.from_arrays(
                    [part.column("doc_id"), part.column("held"), pa.array(size.astype(np.int32))], ["id", "held", "size"])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), pa.array([words[order].tobytes()], pa.binary()),
                     pa.array([_planes(rank[place])], pa.binary())], ["docs", "words", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return rows.mapInArrow(run, _BLOCKS).withColumn("block", F.monotonically_increasing_id())


class Block:
    """A row of ``tokenised``; the words' counts too, once they are known."""

    def __init__(self, row: pa.RecordBatch) -> None:
        self.number = row.column("block")[0].as_py()
        docs = row.column("docs").flatten()
        self.id, self.held = docs.field("id"), docs.field("held")
        self.size = docs.field("size").to_numpy()
        self.words = np.frombuffer(row.column("words")[0].as_buffer(), np.uint64)
        self.tokens = _places_of(row.column("tokens")[0].as_buffer())
        if "counts" in row.schema.names:
            self.counts = np.frombuffer(row.column("counts")[0].as_buffer(), np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        # a null is no false: such a row trains nothing
        self.trains = ~self.held.fill_null(True).to_numpy(zero_copy_only=False).astype(bool)[self.doc]

    def pairs(self, begins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's words with the start token last, their counts, and the places of each token's context and word."""
        context = np.append(len(self.words), self.tokens[:-1])
        context[np.cumsum(self.size)[:-1]] = len(self.words)
        return np.append(self.words, _START), np.append(self.counts, begins), context, self.tokens


def _each(table: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from make(batch.slice(i, 1))

    return table.mapInArrow(run, schema)


def uses(table: DataFrame) -> DataFrame:
    """``block``, ``at`` (the word's place), ``word``, and ``n``: its occurrences in the block's training documents."""

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = Block(row)
        n = np.bincount(block.tokens[block.trains], minlength=len(block.words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), block.number)), pa.array(np.arange(len(n), dtype=np.int32)),
             pa.array(block.words.view(np.int64)), pa.array(n)], ["block", "at", "word", "n"])

    return _each(table, "block long, at int, word long, n long", make)


def pair_keys(words: np.ndarray, counts: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A key of each pair; its last bits tell how often its context occurs."""
    level = (np.frexp(np.maximum(counts, 1))[1] - 1).astype(np.uint64)
    key = mix((mix(words) * np.uint64(3))[context] + words[word])
    return (key & ~np.uint64(_CONTEXTS - 1)) | level[context]


def _probes(keys: np.ndarray, level: int, pairs: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair of words that a level of each key belongs to, of so many, and the bits to probe in either."""
    code = mix(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    place = (((code >> np.uint64(32)) * pairs) >> np.uint64(32)).astype(np.int64)
    code = mix(code)
    masks = []
    for half in range(2):
        mask = np.zeros(len(keys), np.uint64)
        for probe in range(PROBES // 2):
            mask |= np.uint64(1) << ((code >> np.uint64(6 * (half * PROBES // 2 + probe))) & np.uint64(63))
        masks.append(mask)
    return place, masks[0], masks[1]


def filter_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A Bloom filter that holds each key at every level from 1 to that of its count."""
    levels = np.searchsorted(_LOWS, counts, "right")
    pairs = max(1, math.ceil(int(levels.sum()) * BITS / 128))
    words = np.zeros((pairs, 2), np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        place, low, high = _probes(keys[levels >= level], level, np.uint64(pairs))
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        for half, mask in enumerate((low, high)):
            words[place[first], half] |= np.bitwise_or.reduceat(mask[order], first)
    return words.tobytes()


class Filter:
    """Some slices of the filter, in order, side by side."""

    def __init__(self, first: int, slices: list[bytes]) -> None:
        self.first = first
        self.pairs = np.array([len(x) // 16 for x in slices], np.uint64)
        self.base = np.append(0, np.cumsum(self.pairs.astype(np.int64)))
        self.words = np.frombuffer(b"".join(slices), np.uint64).reshape(-1, 2)

    def counts(self, keys: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """The mean of the counts of each key's level; 0: it has none."""
        return _MEANS[self.levels(keys, slices)]

    def levels(self, keys: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """The highest level up to which all levels of a key are in the filter; 0: none is."""
        levels = np.zeros(len(keys), np.int8)
        left, level = np.arange(len(keys)), 0
        slot = slices - self.first
        while len(left) and level < len(_LOWS):
            level += 1
            place, low, high = _probes(keys[left], level, self.pairs[slot])
            words = self.words[place + self.base[slot]]
            fine = ((words[:, 0] & low) == low) & ((words[:, 1] & high) == high)
            left, slot = left[fine], slot[fine]
            levels[left] = level
        return levels


def _slices(table: DataFrame, begins: int, buckets: int) -> DataFrame:
    """The filter of all pairs of training documents, slice by slice: ``slice``, ``bits``, and for each context level how
    many tokens occur with their context once and how many in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for i in range(len(batch)):
                    block = Block(batch.slice(i, 1))
                    words, counts, context, word = block.pairs(begins)
                    yield pair_keys(words, counts, context[block.trains], word[block.trains]),

        yield from grams.tallied(found(), buckets)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts, _ = grams.merged(rows)
        context = (keys & np.uint64(_CONTEXTS - 1)).astype(np.int64)
        once = np.bincount(context[counts == 1], minlength=_CONTEXTS)
        every = np.bincount(context, weights=counts, minlength=_CONTEXTS).astype(np.int64)
        return pd.DataFrame({"slice": [rows["bucket"].iloc[0]], "bits": [filter_of(keys, counts)],
                             "once": [once.tolist()], "every": [every.tolist()]})

    return table.mapInArrow(run, grams.PACKED).groupBy("bucket").applyInPandas(
        build, "slice long, bits binary, once array<long>, every array<long>")


def _asked(words: np.ndarray, counts: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose pair the filter may hold, as its parts occur, and their pairs' keys."""
    may = np.flatnonzero((counts[context] > 0) & (counts[word] > 0))
    return may, pair_keys(words, counts, context[may], word[may])


def _dealt(table: DataFrame, begins: int, buckets: int, per: int) -> DataFrame:
    """Each block's different pairs, in order, by the part of the filter that they are in: ``part``, ``block``, ``keys``."""

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = Block(row)
        keys = np.unique(_asked(*block.pairs(begins))[1])
        part = grams.bucket_of(keys, buckets) // per
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        cut = np.append(first, len(keys)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[first]), pa.array(np.full(len(first), block.number)),
             pa.array([keys[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["part", "block", "keys"])

    return _each(table, "part long, block long, keys binary", make)


def _looked_up(table: DataFrame, slices: DataFrame, part: int, buckets: int) -> DataFrame:
    """The level of each pair of one part, whose slices of the filter are broadcast: a byte a pair, in the order of the keys."""
    held = {number: bytes(bits) for number, bits in slices.select("slice", "bits").toLocalIterator()}
    first = min(held, default=0)
    empty = bytes(16)
    sent = slices.sparkSession.sparkContext.broadcast(Filter(first, [held.get(i, empty) for i in range(first, max(held, default=0) + 1)]))

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = np.frombuffer(row.column("keys")[0].as_buffer(), np.uint64)
        slots = grams.bucket_of(keys, buckets)
        # slices that are not here hold nothing
        here = (slots >= first) & (slots < first + len(sent.value.pairs))
        levels = np.zeros(len(keys), np.int8)
        levels[here] = sent.value.levels(keys[here], slots[here])
        yield pa.RecordBatch.from_arrays(
            [row.column("block"), pa.array([part], pa.int64()), pa.array([levels.tobytes()], pa.binary())], ["block", "part", "levels"])

    found = saved(_each(table.where(F.col("part") == part), "block long, part long, levels binary", make), "levels")
    sent.destroy()
    return found


def _scored(table: DataFrame, begins: int, weights: list[float], total: int, kinds: int) -> DataFrame:
    """Sums over each document's tokens, of blocks with the levels of their pairs (``found``)."""

    def make(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = Block(row)
        words, counts, context, word = block.pairs(begins)
        base = (counts[word] + 1) / (total + kinds + 1)
        before = counts[context]
        may, keys = _asked(words, counts, context, word)
        found = sorted(row.column("found")[0].as_py() or [], key=lambda f: f["part"])
        levels = np.frombuffer(b"".join(f["levels"] for f in found), np.int8)
        seen = np.zeros(len(word))
        seen[may] = _MEANS[levels][np.unique(keys, return_inverse=True)[1]]
        # a pair is as frequent as its parts at most
        seen = np.minimum(seen, np.minimum(before, counts[word]))
        weight = np.array(weights)[np.frexp(np.maximum(before, 1))[1] - 1] * (before > 0)
        chance = weight * seen / np.maximum(before, 1) + (1 - weight) * base
        starts = np.cumsum(block.size) - block.size
        sums = [pa.array(np.add.reduceat(x, starts)) for x in (
            (counts[word] > 0).astype(np.int64), np.log10(base), np.log10(chance))]
        yield pa.RecordBatch.from_arrays(
            [block.id, block.held, pa.array(block.size.astype(np.int64)), *sums],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return _each(table, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", make)


def score_documents(docs: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """Log10 probability of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words ``[^ \\\\t-\\\\r]+`` with A-Z lower-cased, and one end. All documents that are not held out are learned from.
    Counts of words are exact and give base_score, the sum of log10 of (c + 1) / (N + V + 1). Pairs of a token and the one
    before (the first: a start) go with quantised counts into a log-frequency Bloom filter. A token's probability is
    w * pair / context + (1 - w) * its base probability, where the pair's count comes from probes of one level after the
    other and w, the Good-Turing share of pairs that are not new, from all training tokens whose contexts occur about as
    often as this one. So a text's score is near or above its base_score.

    The filter grows with the pairs. It is made in slices, each by a task; slices of at most ``limit`` bytes in all are
    broadcast at a time, and only blocks' pairs that are in them are read then and answered with a byte each, so the work
    stays in proportion. Documents are summed once, when their block has the levels of all its pairs.

    One row for each input row, repeated rows too. Null and empty texts have their end only. Rows without doc_id are
    scored, train nothing and have held_out null. An empty table gives no rows; where nothing trains, scores are 0. Other
    columns are not read.
    """
    table = saved(tokenised(docs), "blocks")
    counts = saved(uses(table).where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == int(_END.view(np.int64))).first()
    begins = ends["c"] if ends else 0  # each training document has one end, and one start

    def known(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = row.column("found").flatten()
        c = np.zeros(len(row.column("words")[0].as_buffer()) // 8, np.int64)
        c[found.field("at").to_numpy()] = found.field("c").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [*(row.column(c) for c in ("block", "docs", "words", "tokens")), pa.array([c.tobytes()], pa.binary())],
            ["block", "docs", "words", "tokens", "counts"])

    found = saved(uses(table).join(counts, "word").groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("found")), "found")
    schema = f"block long, {_BLOCKS}, counts binary"
    own = lambda turn: F.pmod(F.xxhash64("block"), F.lit(TURNS)) == turn
    whole = [saved(_each(table.where(own(turn)).join(found.where(own(turn)), "block", "left"), schema, known), "known")
             for turn in range(TURNS)]
    for used in (table, counts, found):
        dropped(used)
    buckets = grams.buckets_for(total)
    slices = saved(_slices(reduce(DataFrame.unionByName, whole), begins, buckets), "slices")
    once, every = (np.array([r[0] for r in slices.select(F.posexplode(name).alias("k", "v")).groupBy("k").agg(
        F.sum("v").alias("v")).orderBy("k").select("v").collect()] or [0] * _CONTEXTS) for name in ("once", "every"))
    weights = (every - once) / (every + 1)
    widest = slices.agg(F.max(F.length("bits"))).first()[0] or 1
    per = max(1, limit // widest)
    parts = math.ceil(buckets / per)
    # in files by part of the filter: a pass reads those of its own
    dealt = [saved(_dealt(part, begins, buckets, per), "dealt", "part") for part in whole]
    pairs = reduce(DataFrame.unionByName, dealt)
    levels = [_looked_up(pairs, slices.where(F.floor(F.col("slice") / per) == part), part, buckets) for part in range(parts)]
    for used in (*dealt, slices):
        dropped(used)
    # a block's levels come back to it, so rows are its documents' however many parts there are
    answers = reduce(DataFrame.unionByName, levels).groupBy("block").agg(F.collect_list(F.struct("part", "levels")).alias("found"))
    scores = []
    for turn, part in enumerate(whole):
        scores.append(saved(_scored(part.join(answers.where(own(turn)), "block", "left"), begins, weights.tolist(), total, kinds), "scores"))
        dropped(part)
    for used in levels:
        dropped(used)
    return reduce(DataFrame.unionByName, scores).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

"""Operator 13: phrase collocations over a prefix-free parse."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm import grams
from prosegauge.llm.common import blocks, dropped, mix, saved, span_hashes, text_bytes, words_of
from prosegauge.operators.scale import top_per_group

#: Most words of a phrase, and least times that it occurs.
LONGEST, TIMES = 5, 100
#: Words of the window whose hash opens a chunk: with these behind its own words, a chunk holds all phrases that start in it.
WINDOW = LONGEST - 1
#: One window in so many opens a chunk; and most words of its own that a chunk has.
EVERY, OWN = 16, 64
#: Phrases of each language in the result; share of a phrase's occurrences, in percent, that a longer one must cover.
TOP, COVERED = 2000, 100
#: Bits of a set of frequent keys. The set has this size whatever the input; where it is crowded it lets more keys pass,
#: which are counted and then left out.
BITS, SLICE = 1 << 27, 1 << 20
#: Copies of a frequent part's count, and of its rows' dealing: a word may be a part of a third of all phrases.
SALTS = 8

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans in a row, and where each starts (one more entry at the end)."""
    at = np.append(0, np.cumsum(length))
    return data[np.repeat(start - at[:-1], length) + np.arange(at[-1])], at


def chain(word: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    out = word
    for k in range(1, size):
        out = mix(out[: len(word) - k] * np.uint64(3) + word[k:])
    return out


def parse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The prefix-free parse of every whole text: for each chunk its text, how many words are its own, and the chunk.

    A chunk opens where a piece does and at each window of ``WINDOW`` words whose hash is a multiple of ``EVERY``; after
    ``OWN`` words one opens in any case, so equal passages have equal chunks but for their ends. A chunk has its own words,
    up to where the next one opens, and the ``WINDOW`` words behind them as far as the piece goes, joined by spaces.
    """
    data, starts = text_bytes(texts)
    data = _FOLD[data]
    begin, end, text = words_of(data, starts, _APART)
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    breaks = np.append(0, np.cumsum(_BREAK[data]))
    fresh = np.append(True, (text[1:] != text[:-1]) | (breaks[begin[1:]] != breaks[end[:-1]]))
    piece = np.cumsum(fresh) - 1
    close = np.append(np.flatnonzero(fresh)[1:], n)[piece]  # where each word's piece ends
    opens = fresh.copy()
    if n >= WINDOW:
        window = chain(span_hashes(data, begin, end), WINDOW)
        opens[: len(window)] |= (window % np.uint64(EVERY) == 0) & (piece[: len(window)] == piece[WINDOW - 1:])
    at = np.flatnonzero(opens)
    more = np.diff(np.append(at, n)) - 1
    steps = more // OWN
    at = np.repeat(at, steps + 1)
    at = at + OWN * (np.arange(len(at)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1))
    own = np.diff(np.append(at, n))
    stop = np.minimum(at + own + WINDOW, close[at])
    length = end - begin
    spaced = np.append(0, np.cumsum(length + 1))  # where each word starts once one space follows each
    line = np.full(int(spaced[-1]), 0x20, np.uint8)
    flat, flat_at = _gathered(data, begin, length)
    line[np.repeat(spaced[:-1] - flat_at[:-1], length) + np.arange(len(flat))] = flat
    chars, offsets = _gathered(line, spaced[at], spaced[stop] - 1 - spaced[at])
    chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars))
    return text[at], own, chunks


def dictionary(docs: DataFrame) -> DataFrame:
    """Different chunks of all texts of each lang: lang, own, chunk, and ``n``, how often the parse holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch):
                part = batch.slice(a, b - a)
                text, own, chunks = parse(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(text)), pa.array(own.astype(np.int32)), chunks], ["lang", "own", "chunk"])

    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return docs.mapInArrow(run, "lang string, own int, chunk string").groupBy("lang", "own", "chunk").agg(F.count("*").alias("n"))


def _opened(sets: dict[int, bytes]) -> dict[int, np.ndarray]:
    return {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in sets.items()}


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = (keys >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


class _Part:
    """Words of some rows of the dictionary, their keys, and which phrases may be frequent."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.data, starts = text_bytes(rows.column("chunk"))
        self.begin, self.end, self.row = words_of(self.data, starts, _APART)
        langs = rows.column("lang").dictionary_encode()
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in langs.dictionary.to_pylist()],
                         np.uint64)
        seed = seeds[langs.indices.to_numpy()] if len(rows) else seeds
        self.word = mix(span_hashes(self.data, self.begin, self.end) ^ seed[self.row])
        first = np.searchsorted(self.row, np.arange(len(rows)))
        self.number = np.arange(len(self.row)) - first[self.row]
        self.own = self.number < rows.column("own").to_numpy()[self.row]

    def key(self, size: int) -> np.ndarray:
        """A key of each ``size`` words in a row, of one chunk or not."""
        return mix(chain(self.word, size) + np.uint64(size))

    def keys(self, size: int, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the chunks' own phrases of a size, and where each starts. ``known``: sets of the keys of frequent words
        and pairs; a phrase with one that is in none cannot be frequent."""
        n = len(self.word) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        good = self.own[:n] & (self.row[:n] == self.row[size - 1:])
        part = min(size - 1, 2)
        if part in known:
            fine = _holds(known[part], self.key(part))
            for k in range(size - part + 1):
                good &= fine[k: k + n]
        at = np.flatnonzero(good)
        return self.key(size)[at], at


def _set_of(keys: Column, rows: DataFrame) -> bytes:
    """A bit for each frequent key, made slice by slice: ``BITS`` bits come to the driver, however many keys there are.
    Packed, as few are set where keys are few."""
    size = SLICE

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8)
        bits[rows["cell"].to_numpy() % size] = 1
        return pd.DataFrame({"slice": [rows["cell"].iloc[0] // size], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    cells = rows.select(F.shiftrightunsigned(keys, 64 - BITS.bit_length() + 1).alias("cell")).distinct()
    found = cells.groupBy(F.floor(F.col("cell") / size)).applyInPandas(one, "slice long, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for row in found.collect():
        out[row["slice"] * size // 8: (row["slice"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return zlib.compress(out.tobytes(), 1)


def frequent(entries: DataFrame, sizes: list[int], known: dict[int, bytes], total: int, times: int) -> DataFrame:
    """Keys of the phrases of some sizes that occur ``times`` times or more, ``f``, how often, and the ``number`` of the
    first entry that holds them.

    Phrases are counted inside different chunks, weighted by how often the parse holds the chunk, each where it starts.
    """
    sets = entries.sparkSession.sparkContext.broadcast(known)
    buckets = grams.buckets_for(total * len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(sets.value)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for a, b in blocks(batch, "chunk"):
                    rows = batch.slice(a, b - a)
                    part = _Part(rows)
                    weight, number = rows.column("n").to_numpy(), rows.column("number").to_numpy()
                    for size in sizes:
                        keys, at = part.keys(size, known)
                        yield keys, weight[part.row[at]], number[part.row[at]]

        yield from grams.tallied(found(), buckets)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys, f, number = grams.merged(rows)
        return pd.DataFrame({"key": keys[f >= times].view(np.int64), "f": f[f >= times], "number": number[f >= times]})

    counts = entries.mapInArrow(run, grams.PACKED).groupBy("bucket").applyInPandas(merge, "key long, f long, number long")
    out = saved(counts, "frequent")
    sets.destroy()
    return out


def _named(entries: DataFrame, keys: DataFrame, known: dict[int, bytes]) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of all frequent keys.

    A phrase is read where it occurs first. Entries that hold no first occurrence are passed over, by a set of the hashes
    of the numbers of those that do.
    """
    sets = entries.sparkSession.sparkContext.broadcast(known | {0: _set_of(F.xxhash64("number"), keys)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(sets.value)
        firsts = known.pop(0)
        for batch in batches:
            batch = batch.filter(pa.array(_holds(firsts, batch.column("hash").to_numpy().view(np.uint64))))
            for a, b in blocks(batch, "chunk"):
                rows = batch.slice(a, b - a)
                part = _Part(rows)
                for size in range(1, LONGEST + 1):
                    keys, at = part.keys(size, known)
                    fine = _holds(known[min(size, 3)], keys)
                    keys, at = keys[fine], at[fine]
                    chars, offsets = _gathered(part.data, part.begin[at], part.end[at + size - 1] - part.begin[at])
                    phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars))
                    row = pa.array(part.row[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), rows.column("number").take(row), rows.column("lang").take(row), phrase],
                        ["key", "number", "lang", "phrase"])

    found = entries.withColumn("hash", F.xxhash64("number")).mapInArrow(run, "key long, number long, lang string, phrase string")
    out = saved(found.distinct().join(keys, ["key", "number"]).select("lang", "phrase", "f"), "phrases")
    sets.destroy()
    return out


def phrase_counts(docs: DataFrame, times: int = TIMES) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase`` and ``f`` of all phrases of 1 to ``LONGEST`` words that occur ``times`` times or more, and
    ``lang``, ``words`` with the number of word occurrences.

    Words first, then pairs of frequent words, then longer phrases of frequent pairs: a phrase is at most as frequent as
    its parts. Phrases are counted by 64-bit keys and named in the end.
    """
    entries = saved(dictionary(docs).withColumn("number", F.monotonically_increasing_id()), "dictionary")
    words = saved(entries.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("words")), "words")
    total = entries.agg(F.sum("own")).first()[0] or 0
    known: dict[int, bytes] = {}
    tables = []
    for sizes in ([1], [2], list(range(3, LONGEST + 1))):
        tables.append(frequent(entries, sizes, known, total, times))
        known[sizes[0]] = _set_of(F.col("key"), tables[-1])
    keys = tables[0].unionByName(tables[1]).unionByName(tables[2])
    counts = _named(entries, keys, known)
    for used in (entries, *tables):
        dropped(used)
    return counts, words


def _rated(candidates: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the counts l and r of the parts at their lowest-scoring cut, n and the score there."""
    salted = counts.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    size = F.size("w")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    part = lambda at, length, side: F.struct(
        F.array_join(F.slice("w", at, length), " ").alias("part"), F.lit(side).alias("side"))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        part(F.lit(1), F.col("k"), "l"), part(F.col("k") + 1, size - F.col("k"), "r"))).alias("it")).select(
        "lang", "phrase", "a", "k", "it.*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    met = parts.join(salted, ["lang", "part", "salt"])
    whole = met.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    # products of up to 38 digits, divided without a remainder
    score = F.call_function("div", exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)"), exact("l") * exact("r"))
    scored = whole.join(words.withColumnRenamed("words", "n"), "lang").withColumn("score", score.cast("long"))
    return scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, times: int = TIMES, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are split at ``[.,;:!?\\n-\\r]`` and, with A-Z lower-cased, into words ``[^ \\t]+``. Candidates are phrases of 2 to
    ``LONGEST`` words that occur a >= ``times`` times; l and r are the counts of the two parts at the cut whose score,
    floor(1000 a n / (l r)), is lowest (ties: the first). A candidate goes if a longer one holds it and covers ``COVERED``
    percent of it. Ranked by score and a, descending, then phrase. Null and empty texts have no words; null lang counts as
    ``und``; a row that occurs again counts again; an empty table gives no rows. Other columns are not read.
    """
    counts, words = phrase_counts(docs, times)
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    size = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    covers = candidates.where(size > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("_most"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").where(
        f"_most IS NULL OR 100 * _most < {COVERED} * a").select("lang", "phrase", "a", "w")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = top_per_group(_rated(kept, counts, words), ["lang"], order, top, "rank")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

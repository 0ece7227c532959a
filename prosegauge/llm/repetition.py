"""Operator 3: quality rules with suffix-array repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prosegauge.llm.common import blocks, mix, span_hashes, text_bytes, words_of

#: A repeat counts from so many words; more than this percentage of words in repeats, or a longer repeat, fails.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 6, 45, 60
#: Fails with more than this percentage of words' code points in signs.
MAX_SYMBOLS = 10
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key as the place of its first equal in sorted order, and the sorted order."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return rank, order


def suffix_array(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of each text's words in order, texts one after the other, and the ranks after 1, 2, 4, ... words.

    ``word`` has equal numbers for equal words of a text and different ones across texts, so suffixes of different
    texts never share a word. Prefix doubling; a suffix that is alone with its rank is not touched again.
    """
    n = len(word)
    last = np.append(text[1:] != text[:-1], True) if n else np.zeros(0, bool)
    stop = np.flatnonzero(last)[np.cumsum(last) - last] + 1 if n else last
    rank, order = _dense(word)
    levels, step = [rank.astype(np.int32)], 1
    while n:
        ordered = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = ordered[1:] == ordered[:-1]
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        active = order[slots]
        ahead = active + step
        inside = ahead < stop[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        group = rank[active]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        order[slots] = active
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank.astype(np.int32))
        step *= 2
        if new.all():
            break
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Words that each suffix in order shares with the one before it."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    left, right = order[:-1].copy(), order[1:].copy()
    stop = np.searchsorted(text, text, "right")
    left_stop, right_stop = stop[left], stop[right]
    for k in range(len(levels) - 1, -1, -1):
        ok = (left < left_stop) & (right < right_stop)
        same = ok & (levels[k][np.minimum(left, n - 1)] == levels[k][np.minimum(right, n - 1)])
        # equal ranks after 2^k words mean 2^k equal words, or equal rests, which two places of a text never have
        step = same * (1 << k)
        shared[1:] += step
        left += step
        right += step
    return shared


def repeats(word: np.ndarray, text: np.ndarray, texts: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text inside a maximal repeat of ``least`` words or more, and each text's longest repeat.

    A longest-common-prefix interval of value l holds the places of a repeat of l words that cannot be extended to
    the right; the widest interval value at a place is the larger of the two prefixes shared with its neighbours.
    """
    order, levels = suffix_array(word, text)
    shared = common_prefixes(order, levels, text)
    n = len(word)
    best = np.zeros(n, np.int64)
    best[order] = np.maximum(shared, np.append(shared[1:], 0)) if n else 0
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text, best)
    counted = np.flatnonzero(best >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, counted, 1)
    np.add.at(edge, counted + best[counted], -1)
    covered = np.bincount(text, weights=np.cumsum(edge[:-1]) > 0, minlength=texts).astype(np.int64)
    return covered, longest


def measure(texts: pa.Array, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of whole texts, one entry for each."""
    data, starts = text_bytes(texts)
    n = len(texts)
    begin, end, text = words_of(data, starts)
    count = lambda at, weights=None: np.bincount(at, weights=weights, minlength=n).astype(np.int64)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    signs = np.append(0, np.cumsum(_SYMBOL[data]))
    out = {"n_words": count(text), "word_chars": count(text, points[end] - points[begin]),
           "n_symbols": signs[starts[1:]] - signs[starts[:-1]]}

    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    cut[np.flatnonzero(data == 0x0A) + 1] = True
    line_start = np.flatnonzero(cut)
    line = np.unique(np.searchsorted(line_start, begin, "right") - 1)  # lines with a word
    line_end = np.append(line_start[1:], len(data))[line]
    line_start = line_start[line]
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 0x0A)) if len(line) else line_end
    owner = np.searchsorted(starts, line_start, "right") - 1
    key = mix(span_hashes(data, line_start, line_end) ^ mix(owner.astype(np.uint64)))
    _, at = np.unique(key, return_index=True)
    out["n_dup_lines"] = count(owner) - count(owner[at])

    word = span_hashes(data, begin, end) ^ mix(text.astype(np.uint64) + np.uint64(1))
    window = np.zeros(len(word), bool)
    window[:-2] = text[2:] == text[:-2]
    at = np.flatnonzero(window)
    three = mix(mix(word[at] + mix(word[at + 1] if len(at) else word[at])) + mix(word[at + 2] if len(at) else word[at]))
    _, which, times = np.unique(three, return_inverse=True, return_counts=True)
    twice = at[times[which] > 1] if len(at) else at
    found = np.zeros(len(word), bool)
    for k in range(3):
        found[twice + k] = True
    out["n_repeat_words"] = count(text, found)
    out["covered"], out["longest"] = repeats(word, text, n, least)
    return out


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED,
                  max_repeat: int = MAX_REPEAT, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """Counts and verdict of every whole ``text`` (null: no words), one row for each input row, in one narrow stage.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed, at most ``max_covered``
    percent of words in repeats of ``min_repeat`` words or more, no repeat over ``max_repeat`` words and at most
    ``max_symbols`` signs for 100 code points of words; equality passes. Columns: doc_id (null stays null), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat. Empty texts
    have zeros and fail. Repeated rows give repeated rows; other columns are not read.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in longs],
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
        T.StructField("covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType()),
    ])

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch):
                part = batch.slice(a, b - a)
                m = measure(part.column("text"), min_repeat)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = (~failed & (100 * m["covered"] <= max_covered * m["n_words"]) & (m["longest"] <= max_repeat)
                        & (100 * m["n_symbols"] <= max_symbols * m["word_chars"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(m[c]) for c in longs], pa.array(failed), pa.array(kept),
                     pa.array(m["covered"]), pa.array(m["longest"])], schema.names)

    return docs.select("doc_id", "text").mapInArrow(rules, schema)

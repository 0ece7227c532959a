"""Counting 64-bit keys: tasks add up what they can hold and send it on packed by bucket, each bucket is merged once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Keys that a task holds before it sends them, and keys of a bucket, on average at most.
HELD, BUCKET = 1 << 22, 1 << 21
PACKED = "bucket long, keys binary, counts binary, least binary"
#: Keys, how often each occurs, and the least number that each occurs with, if numbers are given.
Tally = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def buckets_for(rows: int) -> int:
    """Buckets for so many keys, the repeated ones counted."""
    return max(1, math.ceil(rows / BUCKET))


def summed(keys: np.ndarray, counts: np.ndarray | None = None, least: np.ndarray | None = None) -> Tally:
    """Different keys in order, the sums of their counts (by default 1 each) and the least of their numbers."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), least
    if counts is None and least is None:
        keys = np.sort(keys)
    else:  # mostly runs in order: a stable sort merges them
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = None if counts is None else counts[order]
        least = None if least is None else least[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first),
            None if least is None else np.minimum.reduceat(least, first))


def _joined(parts: list[Tally]) -> Tally:
    keys, counts, least = zip(*parts, strict=True)
    return summed(np.concatenate(keys), np.concatenate(counts), None if least[0] is None else np.concatenate(least))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; buckets are ranges of keys."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def packed(tally: Tally, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that the keys of a tally meet."""
    keys, counts, least = tally
    bucket = bucket_of(keys, buckets)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    cut = np.append(first, len(keys)).tolist()

    def part(x: np.ndarray | None) -> pa.Array:
        return pa.array([None if x is None else x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())

    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first]), part(keys), part(counts.astype(np.int64)), part(least)], ["bucket", "keys", "counts", "least"])


def tallied(found: Iterator[tuple[np.ndarray | None, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed tallies of a task's keys (and counts, and numbers), of which ``HELD`` at most, and one step's, are held."""
    held: list[Tally] = []
    size = 0
    for step in found:
        held.append(summed(*step))
        size += len(held[-1][0])
        if size >= HELD:
            whole = _joined(held)
            if len(whole[0]) * 2 > HELD:
                yield packed(whole, buckets)
                held, size = [], 0
            else:
                held, size = [whole], len(whole[0])
    if size:
        yield packed(_joined(held), buckets)


def merged(rows: pd.DataFrame) -> Tally:
    """The tally of a bucket over all tasks."""
    keys, counts = np.frombuffer(b"".join(rows["keys"]), np.uint64), np.frombuffer(b"".join(rows["counts"]), np.int64)
    return summed(keys, counts, None if rows["least"].iloc[0] is None else np.frombuffer(b"".join(rows["least"]), np.int64))

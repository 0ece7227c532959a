"""Operator 1: removal of long repeated passages with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import blocks, gram_hashes, saved, text_bytes

#: Bytes of the grams that windows are dealt out by.
GRAM = 24
#: Contents of one task, and of one batch of its index.
TASK_CONTENTS, BATCH_CONTENTS = 6000, 512
#: A gram with more different contents than this is dealt out by window digests, about so many windows to a task.
HOT_CONTENTS, TASK_WINDOWS = 2000, 400_000


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_groups(data: np.ndarray, starts: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Windows of ``width`` bytes of every text, grouped by the place of their gram of least hash (the leftmost).

    Equal windows have their least gram at the same place, so they are in groups of the same gram hash. A group never
    holds two equal windows. Columns: text, start (in data), count (windows) and gram hash.
    """
    n = len(data) - width + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "count", "gram")}
    gram = gram_hashes(data, GRAM)
    ranked = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    anchor = (_sliding_least(ranked, width - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    inside = np.arange(n) + width <= starts[text + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    edge = np.flatnonzero(new | ~inside)
    stop = np.append(edge, n)[np.searchsorted(edge, first, "right")]
    return {"text": text[first], "start": first, "count": stop - first, "gram": gram[anchor[first]].view(np.int64)}


class LogIndex:
    """Suffix arrays of windows in levels of growing size.

    A new batch gets a suffix array (of its window starts, by the ``width`` bytes that follow). It is merge-scanned
    against each level for windows that are there already; new ones make a level, and while two levels are of
    similar size they are merged. A window is told the first time that another like it is seen, with both places.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows in order, their places, told
        self.found: list[np.ndarray] = []

    def add(self, windows: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(windows, kind="stable")
        windows, places = windows[order], places[order]
        same = np.zeros(len(windows), bool)
        same[1:] = windows[1:] == windows[:-1]
        told = same.copy()
        told[:-1] |= same[1:]
        for keys, own, known in self.levels:
            at = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
            hit = keys[at] == windows
            told |= hit
            again = np.unique(at[hit])
            self.found.append(own[again[~known[again]]])
            known[again] = True
            same |= hit
        self.found.append(places[told])
        self.levels.append((windows[~same], places[~same], told[~same]))
        self.levels = [level for level in self.levels if len(level[0])]
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            joined = [np.concatenate(pair) for pair in zip(self.levels[-2], self.levels[-1], strict=True)]
            order = np.argsort(joined[0], kind="stable")  # two sorted runs: a merge
            self.levels[-2:] = [tuple(x[order] for x in joined)]


def _windows(content: bytes, width: int) -> np.ndarray:
    n = len(content) - width + 1
    return np.lib.stride_tricks.as_strided(np.frombuffer(content, np.uint8), (n, width), (1, 1)).copy().view(f"S{width}")[:, 0]


def repeated_windows(contents: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Content number and offset of every window that is twice or more in ``contents``."""
    index = LogIndex(width)
    for at in range(0, len(contents), BATCH_CONTENTS):
        some = contents[at: at + BATCH_CONTENTS]
        sizes = np.array([len(c) - width + 1 for c in some])
        places = np.repeat((np.arange(len(some), dtype=np.int64) + at) << 32, sizes) + (
            np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        index.add(np.concatenate([_windows(c, width) for c in some]), places)
    places = np.sort(np.concatenate(index.found)) if index.found else np.zeros(0, np.int64)
    return places >> 32, places & 0xFFFFFFFF


def _runs(number: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of offsets in a row: number, first offset, one past the last."""
    if not len(number):
        return number, offset, offset
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(number)) - 1
    return number[first], offset[first], offset[last] + 1


_SPANS = "gram long, content long, first array<long>, last array<long>"


def _by_content(number: np.ndarray, offset: np.ndarray, gram: np.ndarray, content: np.ndarray) -> pd.DataFrame:
    """A row for each content with its runs of offsets."""
    number, first, last = _runs(number, offset)
    own, at = np.unique(number, return_index=True)
    at = at[1:]
    lists = {k: pd.Series(np.split(x, at) if len(own) else [], dtype=object) for k, x in (("first", first), ("last", last))}
    return pd.DataFrame({"gram": gram[own], "content": content[own], **lists})


#: Windows of one batch, for one bucket: digests, where they are, and the contents of the batch.
_DEALT = "bucket long, digests binary, number binary, offset binary, told binary, grams binary, contents binary"


def _deal(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Different window digests of each batch of contents, packed by bucket, so that a very common window leaves a batch
    once. Windows that are twice or more in the batch are told; their other places go along behind the digests."""
    names = [part.split()[0] for part in _DEALT.split(", ")]
    for batch in batches:
        contents = batch.column("bytes").to_pylist()
        if not contents:
            continue
        sizes = np.array([len(c) - width + 1 for c in contents])
        number = np.repeat(np.arange(len(contents)), sizes)
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        digests = np.frombuffer(b"".join(
            xxhash.xxh3_128_digest(view[i: i + width]) for c in contents for view in (memoryview(c),) for i in range(len(c) - width + 1)),
            "V16")
        low = digests.view(np.uint64)[1::2]
        order = np.lexsort((digests.view(np.uint64)[::2], low))
        pairs = digests.view(np.uint64).reshape(-1, 2)[order]
        same = np.zeros(len(order), bool)
        same[1:] = (pairs[1:] == pairs[:-1]).all(1)
        told = same.copy()
        told[:-1] |= same[1:]
        owns = [batch.column(c).to_numpy().astype(np.int64).tobytes() for c in ("gram", "content")]
        bucket = (low[order] % np.uint64(buckets)).astype(np.int64)
        for b in range(buckets):
            at = np.flatnonzero((bucket == b) & ~same)
            more = order[same & (bucket == b)]
            if len(at):
                where = np.concatenate([order[at], more])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b]), *[pa.array([x], pa.binary()) for x in (
                        digests[order[at]].tobytes(), number[where].astype(np.int64).tobytes(), offset[where].astype(np.int64).tobytes(),
                        told[at].tobytes(), *owns)]], names)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of a bucket that are in several batches, found by a ``LogIndex`` of their digests, or told by their batch."""
    index = LogIndex(16)
    grams, contents, numbers, offsets, known, at, base = [], [], [], [], [], 0, 0
    for row in rows.itertuples():
        digests = np.frombuffer(row.digests, np.uint8).reshape(-1, 16)
        # no byte is 0, which a fixed-width string would drop at its end: 16 bytes become 32 of 1 to 16
        wide = (np.stack([digests >> 4, digests & 15], 2) + 1).astype(np.uint8).reshape(-1, 32)
        places = np.frombuffer(row.number, np.int64)
        index.add(np.ascontiguousarray(wide).view("S32")[:, 0], np.arange(at, at + len(digests)))
        told = np.ones(len(places), bool)
        told[: len(digests)] = np.frombuffer(row.told, bool)
        known.append(told)
        numbers.append(places + base)
        offsets.append(np.frombuffer(row.offset, np.int64))
        grams.append(np.frombuffer(row.grams, np.int64))
        contents.append(np.frombuffer(row.contents, np.int64))
        # places of a batch: its digests first, then the told ones; the index numbers all places alike
        at += len(places)
        base += len(grams[-1])
    told = np.concatenate(known)
    if index.found:
        told[np.concatenate(index.found)] = True
    number, offset = np.concatenate(numbers)[told], np.concatenate(offsets)[told]
    order = np.lexsort((offset, number))
    return _by_content(number[order], offset[order], np.concatenate(grams), np.concatenate(contents))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def remove_repeats(docs: DataFrame, width: int = 200, with_text: bool = False) -> DataFrame:
    """Texts without the bytes that lie in a string of ``width`` bytes which also starts anywhere else, in any text.

    Windows are grouped by their least gram (``window_groups``), so that only groups of a gram that occurs again can hold
    repeats. A group whose whole content occurs again is covered. For the other contents of such a gram, each once
    however often it occurs, tasks build a ``LogIndex``; grams with very many contents are compared by 128-bit window
    digests instead, dealt out one by one. Rows are known by a hash of id and text, so repeated rows count as places of
    their own and get the same result.

    One row for each input row: doc_id (null stays null), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (of the remaining bytes) and, with ``with_text``, kept (binary: a cut may fall inside a character). Null is empty.
    Texts under ``width`` bytes stay whole. Other columns are not read.
    """
    keyed = docs.select("doc_id", "text", _row_key().alias("row"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch):
                part = batch.slice(a, b - a)
                data, starts = text_bytes(part.column("text"))
                g = window_groups(data, starts, width)
                view = memoryview(np.ascontiguousarray(data))
                stop = (g["start"] + g["count"] + width - 1).tolist()
                content = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(g["start"].tolist(), stop, strict=True)),
                                      np.uint64, len(stop)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g["gram"]), pa.array(content), part.column("row").take(pa.array(g["text"])),
                     pa.array((g["start"] - starts[g["text"]]).astype(np.int64)), pa.array(g["count"].astype(np.int32))],
                    ["gram", "content", "row", "start", "count"])

    groups = saved(keyed.mapInArrow(group, "gram long, content long, row long, start long, count int"), "groups")
    again = groups.groupBy("gram").agg(F.count("*").alias("n"), F.min("content").alias("_l"), F.max("content").alias("_h")).where(
        "n > 1").select("gram", (F.col("_l") != F.col("_h")).alias("differs"))
    # written first, so that the join has plain shuffles on both sides and a hot gram can be split
    shared = saved(groups.join(saved(again, "again"), "gram"), "shared")

    # contents of grams that have several, each with one place
    contents = shared.where("differs").groupBy("gram", "content").agg(
        F.count("*").alias("times"), F.min(F.struct("row", "start", "count")).alias("at"))
    contents = saved(contents.select("gram", "content", "times", "at.*"), "contents")
    wanted = contents.groupBy("row").agg(F.collect_list(F.struct("gram", "content", "start", "count")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
                raw = text.as_buffer()
                view = memoryview(raw) if raw is not None else memoryview(b"")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["gram"] for c in cuts], pa.int64()), pa.array([c["content"] for c in cuts], pa.int64()),
                     pa.array([bytes(view[c["start"]: c["start"] + c["count"] + width - 1]) for c in cuts], pa.binary())],
                    ["gram", "content", "bytes"])

    texts = keyed.join(wanted, "row").select("text", "cuts").mapInArrow(cut, "gram long, content long, bytes binary")
    texts = saved(texts.dropDuplicates(["gram", "content"]), "texts")
    many = texts.groupBy("gram").count().where(F.col("count") > HOT_CONTENTS).select("gram")
    tasks = max(1, math.ceil(texts.count() / TASK_CONTENTS))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(rows["bytes"].tolist(), width)
        return _by_content(*found, rows["gram"].to_numpy(), rows["content"].to_numpy())

    few = texts.join(many, "gram", "left_anti").groupBy(F.pmod("gram", F.lit(tasks)).alias("_task")).applyInPandas(index, _SPANS)
    hot = saved(texts.join(many, "gram", "left_semi"), "hot")
    deal = max(1, math.ceil((hot.agg(F.sum(F.octet_length("bytes") - width + 1)).first()[0] or 0) / TASK_WINDOWS))
    dealt = hot.mapInArrow(lambda batches: _deal(batches, width, deal), _DEALT).groupBy("bucket").applyInPandas(_meet, _SPANS)
    parts = saved(few.unionByName(dealt), "parts")

    place = shared.select("gram", "content", "row", "start", "count", "differs")
    whole = place.where("NOT differs").unionByName(place.where("differs").join(
        contents.where("times > 1").select("gram", "content"), ["gram", "content"], "left_semi"))
    span = lambda first, last: F.struct(
        (F.col("start") + first).alias("start"), (F.col("start") + last - 1 + width).alias("stop"))
    covered = whole.select("row", F.array(span(F.lit(0), F.col("count"))).alias("some")).unionByName(
        place.where("differs").join(parts, ["gram", "content"]).select(
            "row", F.zip_with("first", "last", span).alias("some")))
    covered = covered.groupBy("row").agg(F.flatten(F.collect_list("some")).alias("spans"))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_buffer()
                view = memoryview(raw) if raw is not None else memoryview(b"")
                at, kept, removed, runs = 0, [], 0, 0
                for x, y in sorted((s["start"], s["stop"]) for s in found.as_py() or ()):
                    if x > at or not runs:
                        kept.append(view[at:x])
                        runs += 1
                        removed += y - x
                        at = y
                    elif y > at:
                        removed += y - at
                        at = y
                kept.append(view[at:])
                left = b"".join(kept)
                out.append((len(view), removed, runs, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays) + 1])

    joined = keyed.withColumn("doc_id", F.col("doc_id").cast("long")).join(covered, "row", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(remove, schema)

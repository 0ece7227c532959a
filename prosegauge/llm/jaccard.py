"""Operator 7: n-gram Jaccard join by universe partition and the pigeonhole principle."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import blocks, dropped, mix, saved, span_hashes, text_bytes, words_of
from prosegauge.llm.graph import components

#: Ratio of the sizes that share a band.
BAND = 1.25
#: Parts of the keys that are indexed one after the other.
PASSES = 3
#: Most tokens and sets of a block of a family, on average.
BLOCK_TOKENS, BLOCK_SETS = 1_000_000, 2048
#: Cost of a chance meeting, in index rows. It is a meeting of two sets that share a fifth of their tokens: per token of
#: theirs in a segment they differ in so many.
MEETING, APART = 30.0, 4 / 3
#: Partitions that are tried for sets with more empty segments than spared, before empty segments are indexed.
TRIES = 12
#: Most members of a key that are compared with each other before their tokens are read.
MEMBERS = 2048
#: Members of keys that a task compares, on average at most.
MEMBER_ROWS = 30_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@functools.cache
def edges(limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return np.array(out)


def _choices(limit: int) -> list[int]:
    """0 to 16, then numbers in steps of a fifth, up to a limit."""
    steps = [round(16 * 1.2**i) for i in range(200)]
    return [i for i in [*range(16), *steps] if i < limit] + [limit]


@functools.cache
def allocation(band: int, percent: int) -> tuple[int, int, int]:
    """Segments of a band: how many are matched as they are, how many also with one token left out, and the spare weight.

    Two sets that link and whose larger one is in the band differ in at most k tokens. A segment matched as it is
    accounts for one difference, one matched but for a token for two; this is its weight. If all segments failed, there
    would be more than k differences once the weights come to k + 1; with ``spare`` more, segments of a weight above
    ``spare`` agree. A segment is weak if it is empty, or matched but for a token and has only one: its key would tell
    nothing. So sets whose weak segments weigh no more than ``spare`` need not meet in them; others are dealt to segments
    anew. Among the allocations the cheapest is taken: index rows, of all tries, and chance meetings.
    """
    low = max(1, math.floor(int(edges()[band]) * percent / 100))
    high = int(edges()[band + 1]) - 1
    k = 2 * high * (100 - percent) // (100 + percent)
    usual = (low + high) / 2
    best: tuple[float, tuple[int, int, int]] | None = None
    for deleted in _choices((k + 1) // 2):
        for spare in _choices(k + 8):
            plain = max(0, k + 1 + spare - 2 * deleted)
            segments = plain + deleted
            share = usual / segments
            none = math.exp(-share)
            mean, spread = (plain * none + w * deleted * (1 + share) * none for w in (2, 4))
            over = math.erfc((spare + 0.5 - mean) / math.sqrt(2 * spread + 1e-9)) / 2
            rows = (plain + deleted * (1 + share)) * (1 - over**TRIES) / (1 - min(over, 0.999999))
            far = APART * share
            chance = plain * math.exp(-far) + deleted * (1 + far) * math.exp(-far)
            # what the last try leaves meets all its kind by chance
            cost = rows + MEETING * chance + 1e6 * over**TRIES
            if best is None or cost < best[0]:
                best = cost, (plain, deleted, spare)
    assert best is not None
    return best[1]


def reach(percent: int) -> int:
    """How many bands up the larger of two sets that link may be."""
    return math.ceil(math.log(100 / percent) / math.log(BAND) + 1e-9)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each whole text, and the text of each, in order. ASCII letters are lower-cased; a text with
    fewer words is one shingle; without words it has none."""
    data, starts = text_bytes(texts)
    begin, end, text = words_of(data, starts)
    word = span_hashes(_FOLD[data], begin, end)
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = np.searchsorted(text, text, "right")
    at = np.arange(n)
    first = np.append(True, text[1:] != text[:-1])
    opens = (at + words <= stop) | first
    opens = at[opens]
    token = np.full(len(opens), words, np.uint64)
    for k in range(words):
        inside = opens + k < stop[opens]
        ahead = word[np.minimum(opens + k, n - 1)]
        token = np.where(inside, mix(token * np.uint64(3) + ahead), mix(token + np.uint64(7)))
    _, where = np.unique(mix(token ^ mix(text[opens].astype(np.uint64))), return_index=True)
    where.sort()
    return token[where], text[opens][where]


def set_ids(token: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set and a 64-bit id of it (equal sets: equal ids)."""
    size = np.bincount(text, minlength=texts)
    total, twist = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    if len(token):
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        total[text[first]] = np.add.reduceat(mix(token), first)
        twist[text[first]] = np.bitwise_xor.reduceat(mix(token + np.uint64(0x51ED2701)), first)
    return size, mix(total + mix(twist ^ size.astype(np.uint64))).view(np.int64)


def signatures(token: np.ndarray, text: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of every text's set, and the text of each key: in its band and in those above in which a larger partner
    may be.

    A set whose weak segments weigh more than its band spares is dealt to segments again, by another hash, together with
    all others of this kind: of two such sets one may have fewer there. What is left after ``TRIES`` partitions has its
    weak segments indexed too.
    """
    keys, owners = [], []
    bounds = edges()
    band = np.searchsorted(bounds, size, "right") - 1
    for up in range(reach(percent) + 1):
        goes = (size > 0) & (100 * size >= percent * bounds[band + up] if up else True)
        for b in np.unique(band[goes]).tolist():
            plain, deleted, spare = allocation(b + up, percent)
            segments = plain + deleted
            mine = goes & (band == b)
            for turn in range(TRIES):
                own = mine[text]
                t, x = text[own], token[own]
                number = np.cumsum(mine) - 1
                seed = np.uint64(((b + up + 1) * TRIES + turn) * 0x9E3779B97F4A7C15 % 2**64)
                code = mix(x + seed)
                segment = ((code >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)
                slot = number[t] * segments + segment
                order = np.argsort(slot, kind="stable")
                slot, code = slot[order], mix(code[order])
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                sums = np.zeros(int(mine.sum()) * segments, np.uint64)
                sums[slot[first]] = np.add.reduceat(code, first)
                held = np.bincount(slot, minlength=len(sums))
                row, column = np.divmod(np.arange(len(sums)), segments)
                near = column >= plain  # matched but for a token
                weak = np.where(near, 2 * (held < 2), held < 1)
                over = np.bincount(row, weights=weak, minlength=int(mine.sum())) > spare
                every = over[row] & (turn == TRIES - 1)
                use = (held > 0) | every
                who = np.flatnonzero(mine)
                keys.append(mix(sums[use] + mix(seed + column[use].astype(np.uint64))))
                owners.append(who[row[use]])
                out = (near & ((held > 1) | every))[slot]
                keys.append(mix(sums[slot[out]] - code[out] + mix(seed + column[slot[out]].astype(np.uint64))))
                owners.append(who[row[slot[out]]])
                mine = np.zeros(len(mine), bool)
                mine[who[over]] = True
                if not len(who[over]):
                    break
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _each_set(docs: DataFrame, words: int, schema: str, make: object) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch):
                part = batch.slice(a, b - a)
                token, text = shingle_sets(part.column("text"), words)
                size, ids = set_ids(token, text, len(part))
                yield make(part, token, text, size, ids)

    return docs.mapInArrow(run, schema)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every left with every right set. Tokens of many sets go through a matrix product,
    those of few through their pairs of places."""
    n, m = len(left), len(right)
    every = np.concatenate([*left, *right]) if n + m else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    _, token = np.unique(every, return_inverse=True)
    on_left = np.bincount(token[owner < n], minlength=token.max(initial=-1) + 1)
    on_right = np.bincount(token[owner >= n], minlength=len(on_left))
    out = np.zeros((n, m), np.float32)
    common = (on_left > 0) & (on_right > 0)
    dense = np.flatnonzero(common & (on_left * on_right > 1024))
    column = np.full(len(on_left), -1)
    column[dense] = np.arange(len(dense))
    place = column[token]
    for at in range(0, len(dense), 4096):
        some = (place >= at) & (place < at + 4096)
        hot = np.zeros((n + m, min(4096, len(dense) - at)), np.float32)
        hot[owner[some], place[some] - at] = 1
        out += hot[:n] @ hot[n:].T
    rare = (common & (on_left * on_right <= 1024))[token]
    order = np.argsort(token[rare], kind="stable")
    t, o = token[rare][order], owner[rare][order]
    a, b = (t[o < n], o[o < n]), (t[o >= n], o[o >= n] - n)
    low, high = np.searchsorted(b[0], a[0], "left"), np.searchsorted(b[0], a[0], "right")
    step = 1 << 22
    cuts = np.searchsorted(np.cumsum(high - low), np.arange(0, int((high - low).sum()) + step, step))
    for x, y in zip(cuts[:-1], cuts[1:] + 1, strict=True):
        x = x + 1 if x else 0
        times = (high - low)[x:y]
        if times.sum():
            to = np.repeat(low[x:y], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out += np.bincount(np.repeat(a[1][x:y], times) * m + b[1][to], minlength=n * m).reshape(n, m)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix."""
    out, open_ = [], np.ones(len(linked), bool)
    while open_.any():
        edge = [int(np.argmax(open_))]
        open_[edge[0]] = False
        while edge:
            i = edge.pop()
            new = np.flatnonzero(linked[i] & open_)
            open_[new] = False
            out += [(i, int(j)) for j in new]
            edge += new.tolist()
    return out


def sketches(token: np.ndarray, text: np.ndarray, size: np.ndarray) -> pa.Array:
    """How many tokens of each text fall into each cell, a byte each (255: or more). Cells are ranges of hashes, a power
    of two of them, about one for four tokens, 16 at least."""
    cells = 1 << np.maximum(np.frexp(np.maximum(size, 1))[1] - 2, 4).astype(np.int64)
    at = np.append(0, np.cumsum(cells))
    shift = (64 - np.frexp(cells)[1] + 1).astype(np.uint64)
    cell = (mix(token + np.uint64(0x6C62272E07BB0142)) >> shift[text]).astype(np.int64)
    counts = np.minimum(np.bincount(at[text] + cell, minlength=at[-1]), 255).astype(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(counts)])


def close_sets(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of all members of a key that may link, over the keys of ``rows`` (key, set, n, sketch).

    Two sets share at most the sum of their cells' smaller counts. Sets that are joined already are not compared.
    """
    rows = rows.sort_values("key", kind="stable")
    ids, who = np.unique(rows["set"].to_numpy(), return_inverse=True)
    root = np.arange(len(ids))
    size = rows["n"].to_numpy()
    key = rows["key"].to_numpy()
    cells = rows["sketch"].str.len().to_numpy()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    common = np.repeat(np.minimum.reduceat(cells, first), np.diff(np.append(first, len(key))))
    out: list[tuple[int, int]] = []
    for width in np.unique(common).tolist():
        mine = np.flatnonzero(common == width)
        counts, full = np.zeros((len(mine), width), np.uint16), np.zeros(len(mine), bool)
        for c in np.unique(cells[mine]).tolist():
            some = np.flatnonzero(cells[mine] == c)
            raw = np.frombuffer(b"".join(rows["sketch"].iloc[mine[some]]), np.uint8).reshape(len(some), width, c // width)
            counts[some] = raw.sum(2)
            full[some] = (raw == 255).any((1, 2))
        k, n, w = key[mine], size[mine], who[mine]
        left = np.arange(len(mine) - 1)
        lag = 1
        while len(left):
            left = left[left + lag < len(mine)]
            left = left[k[left] == k[left + lag]]
            apart = left[root[w[left]] != root[w[left + lag]]]
            a, b = n[apart], n[apart + lag]
            apart = apart[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
            for at in range(0, len(apart), max(1, (1 << 22) // width)):
                i = apart[at: at + max(1, (1 << 22) // width)]
                j = i + lag
                both = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64)
                both = np.where(full[i] | full[j], np.minimum(n[i], n[j]), both)
                fine = 100 * both >= percent * (n[i] + n[j] - both)
                if fine.any():
                    for x, y in zip(w[i[fine]].tolist(), w[j[fine]].tolist(), strict=True):
                        while root[x] != x:
                            x = root[x]
                        while root[y] != y:
                            y = root[y]
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            out.append((ids[x], ids[y]))
                    while (deeper := root[root]).tolist() != root.tolist():
                        root = deeper
            lag += 1
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    both = shared_counts(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * both >= percent * (sizes - both)


def _verified(plan: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the sets of each block, or of each two blocks, as far as sets link.

    ``plan``: task, family, i, j (the blocks), side (which of the two), set. A task holds one pair of blocks of a large
    family or some small families; a set's tokens come to it once.
    """

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in rows.groupby(["family", "i", "j"], sort=False):
            part = part[~part.duplicated(["side", "set"])]
            ids, tokens, side = part["set"].to_numpy(), part["tokens"].tolist(), part["side"].to_numpy()
            if i == j:
                out += [(ids[a], ids[b]) for a, b in forest(_linked(tokens, tokens, percent))]
                continue
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(left) and len(right):
                cross = np.zeros((len(ids), len(ids)), bool)
                cross[np.ix_(left, right)] = _linked([tokens[k] for k in left], [tokens[k] for k in right], percent)
                out += [(ids[a], ids[b]) for a, b in forest(cross | cross.T)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return plan.join(sets, "set").groupBy("task").applyInPandas(verify, "a long, b long")


def _parts(size: Column, rows: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK_TOKENS), F.ceil(rows / BLOCK_SETS)).cast("int")


def _first_plan(families: DataFrame) -> DataFrame:
    """Each family in as many blocks as its size asks for; each block with itself. Small families share tasks."""
    parts = families.groupBy("family").agg(_parts(F.sum("n"), F.count("*")).alias("parts"))
    tasks = max(1, math.ceil((families.agg(F.sum("n")).first()[0] or 0) / BLOCK_TOKENS))
    block = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")
    return families.join(parts, "family").select(
        F.when(F.col("parts") > 1, F.xxhash64("family", block)).otherwise(F.pmod(F.xxhash64("family"), F.lit(tasks))).alias("task"),
        "family", block.alias("i"), block.alias("j"), F.lit(0).alias("side"), "set")


def _second_plan(families: DataFrame) -> DataFrame:
    """Families of more than one block again: blocks hold sets of one large component, or small components whole, and
    meet unless they are of the same component."""
    large = families.groupBy("family").agg(_parts(F.sum("n"), F.count("*")).alias("_p"), F.min("root").alias("_l"),
                                           F.max("root").alias("_h")).where("_p > 1 AND _l != _h").select("family")
    families = families.join(large, "family", "left_semi")
    roots = families.groupBy("family", "root").agg(F.sum("n").alias("n"), F.count("*").alias("sets")).withColumn(
        "parts", _parts(F.col("n"), F.col("sets")))
    pool = roots.where("parts = 1").groupBy("family").agg(_parts(F.sum("n"), F.sum("sets")).alias("pools"))
    roots = roots.join(pool, "family", "left").select(
        "family", "root", "parts", F.when(F.col("parts") > 1, F.col("root")).otherwise(
            F.pmod(F.xxhash64("root"), F.col("pools"))).alias("pool"), (F.col("parts") > 1).alias("alone"))
    placed = families.join(roots, ["family", "root"]).select(
        "family", "set", "pool", "alone", F.when(F.col("alone"), F.pmod(F.xxhash64("set"), F.col("parts"))).otherwise(
            F.lit(0)).cast("int").alias("part"))
    blocks_ = placed.select("family", "alone", "pool", "part").distinct().withColumn("block", F.xxhash64("alone", "pool", "part"))
    one = blocks_.select("family", F.col("block").alias("i"), F.col("alone").alias("_a"), F.col("pool").alias("_p"))
    two = blocks_.select("family", F.col("block").alias("j"), F.col("alone").alias("_b"), F.col("pool").alias("_q"))
    meet = one.join(two, "family").where("i < j AND NOT (_a AND _b AND _p = _q) OR i = j AND NOT _a").select("family", "i", "j")
    placed = placed.select("family", "set", F.xxhash64("alone", "pool", "part").alias("block"))
    side = lambda k, s: meet.withColumn("block", F.col(k)).join(placed, ["family", "block"]).select(
        F.xxhash64("family", "i", "j").alias("task"), "family", "i", "j", F.lit(s).alias("side"), "set")
    return side("i", 0).unionByName(side("j", 1).where("i != j"))


def _candidates(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that join all sets that share a key of the index and may link by their sketches."""
    shared = saved(index.groupBy("key").agg(F.min("set").alias("head"), F.max("set").alias("tail"), F.count("*").alias("m")).where(
        "head != tail").drop("tail"), "shared")
    members = saved(index.join(shared, "key"), "members")
    # a key with very many members joins them all: their tokens are compared in blocks
    large = members.where(f"m > {MEMBERS} AND set != head").select(F.col("head").alias("a"), F.col("set").alias("b")).distinct()
    small = members.where(f"m <= {MEMBERS}")
    # of keys with the same members one is enough, and keys with the same first member meet in one task, as far as it
    # holds them: so the sets of a family are joined in few tasks, and not once in every task that holds a key of theirs
    code = F.col("set")
    lists = small.groupBy("key", "head", "m").agg(
        F.sum(F.shiftright(code, 32)).alias("high"), F.sum(code.bitwiseAND(0xFFFFFFFF)).alias("low"))
    lists = saved(lists.groupBy("head", "m", "high", "low").agg(F.min("key").alias("key")).select("key", "head", "m"), "lists")
    tasks = max(1, math.ceil((lists.agg(F.sum("m")).first()[0] or 0) / MEMBER_ROWS))
    parts = lists.groupBy("head").agg(F.ceil(F.sum("m") / MEMBER_ROWS).alias("parts"))
    task = F.pmod(F.xxhash64("head", F.pmod(F.xxhash64("key"), "parts")), F.lit(tasks))
    dealt = lists.join(parts, "head").select("key", task.alias("task"))
    chosen = small.join(dealt, "key").select("task", "key", "set").distinct()

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(close_sets(rows, percent), columns=["a", "b"], dtype=np.int64)

    near_sets = chosen.join(sets, "set").groupBy("task").applyInPandas(near, "a long, b long")
    found = saved(near_sets.unionByName(large), "pairs")
    for used in (shared, members, lists):
        dropped(used)
    return found


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more are linked.

    Equal sets are one node from the start. Sets that link share an index key (see ``allocation``). Members of a key that
    may link by their sketches are joined; what is joined over all keys is a family, so it holds little but sets that
    link. Inside families all sets are compared exactly, as matrices of blocks: a family of one block at once, a larger one
    block by block, and then only blocks of different components with each other. Links leave a task as a spanning
    forest, so no pairs are listed.

    One row for each input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links). Null or empty
    texts and texts without words have n_shingles 0 and are linked with nothing; rows without doc_id get a null
    component and link nothing; repeated rows give repeated rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def ids(part: pa.RecordBatch, token: np.ndarray, text: np.ndarray, size: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(size), pa.array(own), sketches(token, text, size)], ["doc_id", "n", "set", "sketch"])

    def keys(turn: int) -> Callable[..., pa.RecordBatch]:
        def make(part: pa.RecordBatch, token: np.ndarray, text: np.ndarray, size: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            valid = ~part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            found, owner = signatures(token, text, np.where(valid, size, 0), percent)
            mine = found % PASSES == turn
            return pa.RecordBatch.from_arrays([pa.array(found[mine]), pa.array(own[owner[mine]])], ["key", "set"])

        return make

    def tokens(part: pa.RecordBatch, token: np.ndarray, text: np.ndarray, size: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        bounds = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(token.view(np.int64)))
        chosen = pa.array(own == part.column("wanted").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(own), lists], ["set", "tokens"]).filter(chosen)

    every = saved(_each_set(docs, words, "doc_id long, n long, set long, sketch binary", ids), "sets")
    one = every.where("doc_id IS NOT NULL").groupBy("set").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    parts = []
    for turn in range(PASSES):  # each over a part of all keys, so that only a part of the index is on disk
        index = saved(_each_set(docs, words, "key long, set long", keys(turn)), "index")
        parts.append(_candidates(index, one, percent))
        dropped(index)
    pairs = reduce(DataFrame.unionByName, parts)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    # one document stands for each set; repeated rows of it give the set again, which the verification drops
    chosen = every.where("doc_id IS NOT NULL").join(wanted, "set").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    some = docs.join(chosen.select("doc_id", F.col("set").alias("wanted")), "doc_id")
    sets = saved(_each_set(some, words, "set long, tokens array<long>", tokens), "tokens")
    sizes = every.groupBy("set").agg(F.max("n").alias("n"))
    joined = components(pairs)
    families = saved(joined.select(F.col("node").alias("set"), F.col("root").alias("family")).join(sizes, "set"), "families")
    for used in (joined, *parts):
        dropped(used)
    links = saved(_verified(_first_plan(families), sets, percent), "links")
    roots = components(links)
    apart = families.join(roots, families["set"] == roots["node"], "left").select(
        "set", "family", "n", F.coalesce("root", "set").alias("root"))
    late = saved(_verified(_second_plan(apart), sets, percent), "links")
    if not late.isEmpty():
        dropped(roots)
        roots = components(links.unionByName(late))
    for used in (sets, families, links, late):
        dropped(used)
    named = every.join(roots, every["set"] == roots["node"], "left").select(
        "doc_id", "n", F.coalesce("root", "set").alias("root"))
    least = named.where("n > 0 AND doc_id IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias("component_id"))

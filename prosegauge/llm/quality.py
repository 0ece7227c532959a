"""Operator 8: a quality classifier by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegauge.llm.common import blocks, mix, span_hashes, text_bytes, words_of
from prosegauge.llm.mixing import word_count

#: Words of a passage.
PASSAGE = 64
#: The fit reads at most so many labelled rows of each label, those of least hash, with all their passages; fewer rows if
#: their passages would come to more than so many of each label (one row at least).
FIT_ROWS, FIT_PASSAGES = 1500, 100_000
THRESHOLD = 0.7
_HASHED = 24
_SETS = [b"#*$%&|<>", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 192)), b"\n"]
FEATURES = len(_SETS) + 6 + _HASHED


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of whole texts, and the text of each. A text without words has one of zeros.

    Shares of kinds of bytes, word length, share of different words, words in three-word windows that the text repeats,
    fill of the passage, and signed hashed word frequencies.
    """
    data, starts = text_bytes(texts)
    n = len(texts)
    begin, end, text = words_of(data, starts)
    first = np.searchsorted(text, np.arange(n))
    number = np.arange(len(begin)) - first[text]  # of the word in its text
    opens = number % PASSAGE == 0
    passage = np.cumsum(opens) - 1
    count = int(passage[-1]) + 1 if len(passage) else 0
    if not count:
        return np.zeros((n, FEATURES), np.float32), np.arange(n)
    sums = lambda weights=None: np.bincount(passage, weights=weights, minlength=count)
    words = sums()
    limits = np.append(begin[opens], len(data))
    out = np.zeros((count, FEATURES), np.float32)
    size = np.diff(limits)
    for j, members in enumerate(_SETS):
        member = np.zeros(256, np.int64)
        member[list(members)] = 1
        total = np.append(0, np.cumsum(member[data]))
        out[:, j] = (total[limits[1:]] - total[limits[:-1]]) / size
    word = span_hashes(data, begin, end)
    at = len(_SETS)
    out[:, at] = sums(end - begin) / words / 10
    own = mix(word ^ mix(passage.astype(np.uint64)))
    _, where = np.unique(own, return_index=True)
    out[:, at + 1] = np.bincount(passage[where], minlength=count) / words
    keyed = mix(word ^ mix(text.astype(np.uint64) + np.uint64(1)))
    window = np.flatnonzero(np.append(text[2:] == text[:-2], [False, False])[: len(text)]) if len(text) > 2 else np.zeros(0, np.int64)
    found = np.zeros(len(word), bool)
    if len(window):
        three = mix(mix(keyed[window] + mix(keyed[window + 1])) + mix(keyed[window + 2]))
        _, which, times = np.unique(three, return_inverse=True, return_counts=True)
        for k in range(3):
            found[window[times[which] > 1] + k] = True
    out[:, at + 2] = sums(found) / words
    out[:, at + 3] = words / PASSAGE
    out[:, at + 4] = np.minimum(size / words / 20, 3)
    out[:, at + 5] = 1
    slot = (word % np.uint64(_HASHED)).astype(np.int64)
    sign = np.where((word >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(passage * _HASHED + slot, weights=sign, minlength=count * _HASHED).reshape(count, _HASHED)
    out[:, at + 6:] = hashed / words[:, None]
    owner = text[opens]
    bare = np.setdiff1d(np.arange(n), owner)
    if len(bare):
        owner = np.concatenate([owner, bare])
        out = np.concatenate([out, np.zeros((len(bare), FEATURES), np.float32)])
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return out, owner


@dataclass
class Model:
    """Passages h = tanh(E x), weights softmax(w (tanh(V h) * sigmoid(U h))) over a text, score sigmoid(c . z + b)."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        """``owner``: the texts 0, 1, ... of the passages, in order, each with one passage at least."""
        p = self.parts
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (v * u) @ p["w"]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        top = np.maximum.reduceat(logit, first)
        weight = np.exp(logit - top[owner])
        weight /= np.add.reduceat(weight, first)[owner]
        z = np.add.reduceat(weight[:, None] * h, first)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "weight": weight, "z": z, "score": score, "first": first}

    def gradient(self, f: dict[str, np.ndarray], owner: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """``off``: the derivative of the loss by each text's logit."""
        p = self.parts
        dz = off[:, None] * p["c"]
        dh = f["weight"][:, None] * dz[owner]
        inner = (f["h"] * dz[owner]).sum(1)
        dlogit = f["weight"] * (inner - np.add.reduceat(f["weight"] * inner, f["first"])[owner])
        dgate = dlogit[:, None] * p["w"]
        dv, du = dgate * f["u"] * (1 - f["v"] ** 2), dgate * f["v"] * f["u"] * (1 - f["u"])
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ off, "b": off.sum(), "w": (f["v"] * f["u"]).T @ dlogit, "V": f["h"].T @ dv,
                "U": f["h"].T @ du, "E": f["x"].T @ dh, "e": dh.sum(0)}


def train(x: np.ndarray, owner: np.ndarray, label: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 300,
          seed: int = 5) -> Model:
    """Adam on the whole sample; both labels weigh the same. Without both labels every score is the one label's."""
    draw = np.random.default_rng(seed)
    n = x.shape[1]
    shapes = {"E": (n, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": ()}
    parts = {k: np.asarray(draw.normal(size=s) * (0.3 if k in "EVUwc" else 0.0)) for k, s in shapes.items()}
    if len(np.unique(label)) < 2:
        parts["c"] = np.zeros(hidden)
        parts["b"] = np.asarray(10.0 if not len(label) or label[0] else -10.0)
        return Model(np.zeros(n), np.ones(n), parts)
    model = Model(x.mean(0), x.std(0) + 0.02, parts)
    share = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    one, two = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    for t in range(1, steps + 1):
        f = model.forward(x, owner)
        slope = model.gradient(f, owner, share * (f["score"] - label))
        for k, g in slope.items():
            g = g + (2e-4 * parts[k] if k != "b" else 0)
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            parts[k] = parts[k] - 0.03 * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Train on up to ``FIT_ROWS`` rows of each label that are not held out, on whole texts as they are scored. Null labels
    and ids are left out; rows that agree in id and text count once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col(label).alias("label")).distinct()
    order = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    some = known.where("label = 0").orderBy(*order).limit(FIT_ROWS).unionByName(
        known.where("label = 1").orderBy(*order).limit(FIT_ROWS))
    # at most 2 * FIT_ROWS ids
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # a row for each id: how many passages it brings
    size = F.greatest(F.ceil(word_count(F.col("text")) / PASSAGE), F.lit(1))
    sizes = rows.groupBy("doc_id", "label").agg(F.sum(size).alias("n")).orderBy("label", *order).collect()
    left, chosen = {}, []
    for r in sizes:
        room = left.get(r["label"], FIT_PASSAGES)
        if room >= r["n"] or r["label"] not in left:
            chosen.append((r["doc_id"], r["label"]))
        else:
            room = 0  # the rows after it are out too: none is chosen for being short
        left[r["label"]] = room - r["n"]
    if len(chosen) < len(sizes):
        kept = docs.sparkSession.createDataFrame(chosen, some.schema)
        rows = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    rows = rows.withColumn("own", F.xxhash64("text"))
    schema = "doc_id long, label int, own long, x array<float>, n long"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch):
                part = batch.slice(a, b - a)
                x, owner = passages(part.column("text"))
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)).cast(pa.int64()),
                     part.column("label").take(pa.array(owner)).cast(pa.int32()), part.column("own").take(pa.array(owner)),
                     pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))), pa.array(number)],
                    ["doc_id", "label", "own", "x", "n"])

    got = rows.mapInArrow(encode, schema).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "label", "own", "n")])
    if not got.num_rows:
        return train(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, FEATURES).astype(np.float64)
    keys = np.stack([got.column(c).to_numpy() for c in ("doc_id", "label", "own", "n")])
    first = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))  # repeated rows bring their passages again
    x, number = x[first], keys[3, first]
    owner = np.cumsum(number == 0) - 1
    label_of = keys[1, first][np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))]
    return train(x, owner, label_of.astype(np.float64))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of every whole text, in one narrow stage; a score column of ``docs`` is replaced.

    Null and empty texts are one passage of zeros and get its score. One row for each input row.
    """
    kept = [c for c in docs.columns if c.lower() != "score"]
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch):
                part = batch.slice(a, b - a)
                x, owner = passages(part.column("text"))
                scores = model.forward(x.astype(np.float64), owner)["score"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], schema.names)

    return docs.select(*kept).mapInArrow(score, schema)

"""Language-model scores against a model with exact counts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from prosegauge.llm import scoring


def tokens_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^ \t-\r]+", text), None]


def held(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7 == 2


def quantised(count):
    lows = [int(x) for x in scoring._LOWS]
    k = max(i for i, low in enumerate(lows) if low <= count)
    return (lows[k] + lows[k + 1] - 1) / 2


def plain(rows):
    train = [tokens_of(t) for i, t in rows if held(i) is False]
    c = collections.Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t[:-1]], t, strict=True))
    context = collections.Counter(v for v, _ in pairs.elements())
    once, every = collections.Counter(), collections.Counter()
    for (v, _), n in pairs.items():
        level = context[v].bit_length()
        once[level] += n == 1
        every[level] += n
    out = []
    for i, t in rows:
        base = score = 0.0
        tokens = tokens_of(t)
        for v, w in zip(["<s>", *tokens[:-1]], tokens, strict=True):
            p = (c[w] + 1) / (total + kinds + 1)
            base += math.log10(p)
            if n := context[v]:
                weight = (every[n.bit_length()] - once[n.bit_length()]) / (every[n.bit_length()] + 1)
                seen = min(quantised(pairs[v, w]), n, c[w]) if pairs[v, w] else 0
                p = weight * seen / n + (1 - weight) * p
            score += math.log10(p)
        out.append((i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), total, base, score))
    return out


def same(got, want, near):
    key = lambda r: tuple("" if x is None else str(x) if not isinstance(x, float) else f"{x:.6f}" for x in r[:6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    # a pair that was not seen passes for one now and then
    assert np.mean([abs(a[6] - b[6]) > near * b[2] for a, b in zip(got, want, strict=True)]) < 0.02
    return got


def some_rows(n):
    draw = random.Random(9)
    words = [f"{draw.choice(['a', 'B', 'é'])}{i}" for i in range(120)]
    follow = {w: draw.sample(words, 4) for w in words}
    rows = []
    for i in range(n):
        word, text = draw.choice(words), []
        for _ in range(draw.randint(0, 80)):
            text.append(word)
            word = draw.choice(follow.get(word, words)) if draw.random() < 0.8 else draw.choice([*words, f"new{draw.random()}"])
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("limit", [scoring.BROADCAST, 700])
def test_scores_equal_exact_counts(spark, monkeypatch, limit):
    rows = some_rows(400)
    if limit < scoring.BROADCAST:  # many slices, broadcast part by part
        monkeypatch.setattr(scoring.grams, "BUCKET", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = same(scoring.score_documents(docs, limit).collect(), plain(rows), 0.02)
    late = [r for r in got if r[1]]
    assert len(late) > 30 and sum(r[6] for r in late) > sum(r[5] for r in late) + 0.2 * sum(r[2] for r in late)


def test_the_filter_keeps_levels_and_lets_little_through():
    draw = np.random.default_rng(1)
    keys, counts = np.unique(draw.integers(0, 2**63, 50_000).astype(np.uint64)), None
    counts = np.minimum(draw.zipf(1.6, len(keys)), 10**9)
    held = scoring.Filter(3, [scoring.filter_of(keys, counts)])
    got = held.counts(keys, np.full(len(keys), 3))
    want = scoring._MEANS[np.searchsorted(scoring._LOWS, counts, "right")]
    assert (got >= want).all() and np.mean(got > want) < 0.01  # never too few
    other = mixed = draw.integers(2**63, 2**64 - 1, 50_000, dtype=np.uint64)
    assert np.mean(held.counts(other, np.full(len(mixed), 3)) > 0) < 0.01


def test_odd_rows(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    same(scoring.score_documents(messy).collect(), plain(rows), 0.02)
    assert scoring.score_documents(empty).count() == 0


def test_nothing_trains(spark):
    late = next(i for i in range(100) if held(i))
    rows = scoring.score_documents(spark.createDataFrame([(late, "a b"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


@pytest.mark.parametrize("limit", [scoring.BROADCAST, 700])
def test_rows_do_not_grow_with_the_parts_of_the_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(scoring.grams, "BUCKET", 500)
    tables, save = [], scoring.saved
    monkeypatch.setattr(scoring, "saved", lambda df, name, *by: (tables.append((name, r := save(df, name, *by), r.count())), r)[1])
    docs = spark.createDataFrame(some_rows(400), "doc_id long, text string").repartition(6)
    assert scoring.score_documents(docs, limit).count() == 400
    blocks = sum(n for name, _, n in tables if name == "known")
    parts = sum(name in ("levels", "sums") for name, _, _ in tables)
    assert (parts > 10) == (limit == 700)
    # a part of the filter has a row a block, not a row a document
    assert all(n <= blocks for name, _, n in tables if name in ("levels", "sums"))
    assert sum(n for name, _, n in tables if name in ("scores", "sums")) <= 400

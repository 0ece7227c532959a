"""Phrase collocations against a plain version."""

import collections
import random
import re

import pyarrow as pa

from prosegauge.llm import phrases


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", text)]


def plain(rows, times, top):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, 6):
                f.update((lang, *w[i: i + n]) for i in range(len(w) - n + 1))
    good = {p: a for p, a in f.items() if len(p) > 2 and a >= times}
    gone = {(p[0], *p[i: j]) for p, a in good.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) - 1 and 100 * a >= 100 * f[(p[0], *p[i: j])]}
    out = collections.defaultdict(list)
    for p, a in good.items():
        if p not in gone:
            lang, n = p[0], total[p[0]]
            cuts = [(1000 * a * n // (f[p[: k + 1]] * f[(lang, *p[k + 1:])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1:])], n))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, found in out.items()
            for rank, (s, a, p, left, right, n) in enumerate(sorted(found)[:top], 1)}


def got(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def some_rows(draw, count):
    common = ["of the", "by way of example we", "On the other hand it is", "New York", "new\tyork city\vhall", "é漢 \U0001F600 x"]
    rows = []
    for _ in range(count):
        parts = [draw.choice([*common, *"a b c d e the of".split()]) for _ in range(draw.randint(0, 60))]
        rows.append((draw.choice(["en", "en", "de", None, ""]), "".join(p + draw.choice([" ", "  ", ". ", "\n", " \t", "; "]) for p in parts)))
    return rows


def test_collocations_equal_brute_force(spark):
    rows = some_rows(random.Random(5), 200)
    rows += [("en", "one two three four five six seven eight nine ten " * 40)] * 3 + [("de", "tick " * 1000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for times, top in ((5, 2000), (12, 7)):
        want = plain(rows, times, top)
        assert got(phrases.collocations(docs, times, top)) == want
    assert len(want) > 10


def test_crowded_sets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 1 << 6)
    monkeypatch.setattr(phrases, "SLICE", 1 << 4)
    rows = some_rows(random.Random(6), 80)
    docs = spark.createDataFrame(rows, "lang string, text string")
    known = plain(rows, 4, 100)
    assert got(phrases.collocations(docs, 4, 100)) == known and known


def test_every_phrase_has_one_chunk():
    draw = random.Random(7)
    texts = [t for _, t in some_rows(draw, 60)] + [None, "", "w " * 500, " ".join(str(i) for i in range(3000))]
    text, own, chunks = phrases.parse(pa.array(texts, pa.string()))
    found = [collections.Counter() for _ in texts]
    for i, k, chunk in zip(text.tolist(), own.tolist(), chunks.to_pylist(), strict=True):
        w = chunk.split(" ")
        assert 1 <= k <= phrases.OWN and len(w) <= k + phrases.WINDOW
        for n in range(1, 6):
            found[i].update(tuple(w[j: j + n]) for j in range(k) if j + n <= len(w))
    for i, t in enumerate(texts):
        want = collections.Counter()
        for w in pieces(t):
            for n in range(1, 6):
                want.update(tuple(w[j: j + n]) for j in range(len(w) - n + 1))
        assert found[i] == want


def test_equal_passages_share_chunks():
    draw = random.Random(8)
    passage = " ".join(f"w{draw.randrange(50)}" for _ in range(400))
    _, _, chunks = phrases.parse(pa.array([passage, "other words before it " + passage]))
    n = collections.Counter(chunks.to_pylist())
    assert sum(k == 2 for k in n.values()) >= 0.8 * len(n)


def test_odd_rows(messy, empty):
    rows = [(r.lang, r.text) for r in messy.select("lang", "text").collect()]
    assert got(phrases.collocations(messy, 2, 50)) == plain(rows, 2, 50)
    assert phrases.collocations(empty).count() == 0

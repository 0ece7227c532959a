"""Suffix dedup, Jaccard join, components, search, mix and personal data against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import jaccard, mixing, neighbours, pii, suffixes
from prosegauge.llm.graph import components


def removed(texts, width):
    texts = [(t or "").encode() for t in texts]
    times = collections.Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if times[t[i:i + width]] > 1:
                mark[i:i + width] = b"\1" * width
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        kept = bytes(x for x, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "width"), [(2000, 200), (3, 60)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, width):
    monkeypatch.setattr(suffixes, "HOT_CONTENTS", hot)
    if hot == 3:
        monkeypatch.setattr(suffixes, "TASK_CONTENTS", 40)
        monkeypatch.setattr(suffixes, "TASK_WINDOWS", 500)
        monkeypatch.setattr(suffixes, "BATCH_CONTENTS", 4)
    draw = random.Random(4)
    some = ["".join(draw.choice("abcdefgh é\n") for _ in range(draw.randint(150, 420))) for _ in range(12)]
    rows = [(i, "".join(draw.choice([draw.choice(some), "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 300)))])
                        for _ in range(draw.randint(0, 5)))) for i in range(120)]
    rows += [(900, "a" * 500), (901, "ab" * 300), (902, "x" * 199), (903, "y" * 200), (904, "y" * 200), (905, None),
             (None, "ab" * 300), (906, ""), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffixes.remove_repeats(docs, width).collect()]
    want = [(-1 if i is None else i, *w) for (i, _), w in zip(rows, removed([t for _, t in rows], width), strict=True)]
    assert sorted(got) == sorted(want)


def test_repeats_frame(messy, empty):
    rows = suffixes.remove_repeats(messy, 200, with_text=True).collect()
    assert len(rows) == 11 and all(r.n_bytes - r.n_removed == len(r.kept) for r in rows)
    assert {r.n_removed for r in rows if r.doc_id in (5, 6)} == {105_000, 100_000}
    assert suffixes.remove_repeats(empty).count() == 0


def test_log_index_levels_and_places():
    draw = random.Random(1)
    contents = ["".join(draw.choice("ab") for _ in range(draw.randint(12, 40))).encode() for _ in range(300)]
    number, offset = suffixes.repeated_windows(contents, 12)
    times = collections.Counter(c[i:i + 12] for c in contents for i in range(len(c) - 11))
    want = [(n, i) for n, c in enumerate(contents) for i in range(len(c) - 11) if times[c[i:i + 12]] > 1]
    assert list(zip(number.tolist(), offset.tolist(), strict=True)) == want
    index = suffixes.LogIndex(4)
    for i in range(64):
        index.add(np.array([f"{i:04d}".encode()], "S4"), np.array([i]))
    assert [len(level[0]) for level in index.levels] == [64]


def grouped(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j:j + words]) for j in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a & sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("words", "percent", "block", "members"), [
    (3, 90, 2048, 2048), (5, 80, 40, 2048), (5, 80, 40, 6), (2, 50, 60, 2048), (1, 60, 2048, 4), (1, 35, 2048, 2048)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, words, percent, block, members):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    draw = random.Random(5)
    vocabulary, rows = [f"w{i}" for i in range(60)], []
    for i in range(500):
        if rows and draw.random() < 0.6:
            text = draw.choice(rows)[1].split()
            for _ in range(draw.randint(0, 3)):
                if text:
                    text[draw.randrange(len(text))] = draw.choice(vocabulary).upper()
        else:
            text = [draw.choice(vocabulary) for _ in range(int(draw.expovariate(1 / 40)))]
        rows.append((i * 7 % 501, " ".join(text)))
    for i in range(40):  # a set and a part of it just large enough, or just too small, to link
        whole = [f"u{i}x{j}" for j in range(draw.randint(5, 300))]
        part = max(1, len(whole) * percent // 100 + draw.randint(0, 1))
        rows += [(1000 + 2 * i, " ".join(whole)), (1001 + 2 * i, " ".join(whole[:part]))]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None)], "doc_id long, text string")
    found = jaccard.similar_documents(docs, words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == grouped(rows, words, percent)
    assert [r.component_id for r in found if r.doc_id is None] == [None, None]


def test_jaccard_join_frame(messy, empty):
    rows = jaccard.similar_documents(messy).collect()
    assert len(rows) == 11
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (2, 3, 4)} == {(0, 2), (0, 3), (0, 4)}
    assert jaccard.similar_documents(empty).count() == 0


def test_sketches_bound_every_overlap():
    draw = np.random.default_rng(3)
    token = np.unique(draw.integers(0, 2**63, 4000).astype(np.uint64))
    for a, b, shared in ((300, 280, 270), (40, 40, 39), (3000, 2700, 2650), (9, 9, 9), (64, 52, 52)):
        first = token[:a]
        second = np.concatenate([token[:shared], token[-(b - shared):]]) if b > shared else token[:shared]
        text = np.repeat([0, 1], [a, b])
        size = np.array([a, b])
        cells = jaccard.sketches(np.concatenate([first, second]), text, size).to_pylist()
        rows = pd.DataFrame({"key": [7, 7], "set": [1, 2], "n": size, "sketch": cells})
        for percent in (50, 80, 90, 99):
            if 100 * shared >= percent * (a + b - shared):
                assert jaccard.close_sets(rows, percent) == [(1, 2)]
    # sets with nothing in common are told apart
    cells = jaccard.sketches(np.concatenate([token[:300], token[-300:]]), np.repeat([0, 1], 300), np.array([300, 300])).to_pylist()
    assert jaccard.close_sets(pd.DataFrame({"key": [7, 7], "set": [1, 2], "n": [300, 300], "sketch": cells}), 80) == []
    # a cell that counts no further bounds nothing
    full = [bytes([255] * 16), bytes([255] * 16)]
    assert jaccard.close_sets(pd.DataFrame({"key": [7, 7], "set": [1, 2], "n": [60000, 60000], "sketch": full}), 80) == [(1, 2)]


def test_sets_that_share_many_keys_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBER_ROWS", 100)
    family = [(s, s // 2) for s in range(400)] + [(s, 200 + s // 10) for s in range(400, 700)]
    keys = collections.defaultdict(list)
    for s, f in family:
        for k in range(40):  # pairs share all keys, in larger families each key lacks one set
            if f < 200 or s % 10 != k % 10:
                keys[f].append((f * 1000 + k, s))
    index = spark.createDataFrame([row for rows in keys.values() for row in rows], "key long, set long")
    sets = spark.createDataFrame([(s, 16, bytearray([1] * 16)) for s, _ in family], "set long, n long, sketch binary")
    found = jaccard._candidates(index, sets, 80)
    assert found.count() <= 200 + 30 * 2 * 9  # a larger family has at most two first members
    joined = {r.node: r.root for r in components(found).collect()}
    least = {}
    for s, f in family:
        least.setdefault(f, s)
    assert joined == {s: least[f] for s, f in family}


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_allocation_accounts_for_every_difference(percent):
    for band in range(40):
        plain, deleted, spare = jaccard.allocation(band, percent)
        high = int(jaccard.edges()[band + 1]) - 1
        assert plain + 2 * deleted >= 2 * high * (100 - percent) // (100 + percent) + 1 + spare


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 230)] + [(5, 229), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in (7, 200, 229)} == {5} and 3 not in got


def exact(vectors, k=10):
    out = {}
    for q, v in vectors:
        if q % 100 == 0:
            far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in vectors if i != q)
            out[q] = [(i, d) for d, i in far[:k]]
    return out


def test_search_recall_and_order(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    vectors = [(i, (centres[i % 40] + 0.3 * draw.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    vectors += [(i, vectors[5][1]) for i in range(3000, 3400)]
    rows = neighbours.search(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    found = collections.defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    want = exact(vectors)
    assert set(found) == set(want) and all(len(f) == 10 for f in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert all(f == sorted(f, key=lambda x: (x[1], x[0])) for f in found.values())
    assert found[3000] == want[3000]  # ties of equal vectors go to the smaller ids


def test_search_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (5, [1.0, None]), (None, [1.0, 1.0]), (6, [float("inf"), 1.0]), (100, [9.0, 9.0]), (7, [1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(data, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert neighbours.search(data.limit(0), F.lit(True)).count() == 0


def test_probes_come_in_order_of_success():
    index = neighbours.Index(np.zeros((1, 4, 2)), np.zeros((1, 4)), 1.0, 50)
    place = np.array([0.1, 0.5, 0.8, 0.45])
    steps = index.sequence(place, 60)
    cost = [sum((s - f if s > 0 else f - s - 1) ** 2 if s else 0 for s, f in zip(step, place, strict=True)) for step in steps]
    assert len(set(steps)) == 60 and cost == sorted(cost) and steps[0] == (0, 0, 0, 0)


def test_mix_targets_and_limits(spark):
    draw = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(draw.randint(1, 60))), draw.choice(["a", "b", "é", None]) if i % 9 else "a") for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, "w w", "a"), (700, None, "b"), (701, "", None)], "doc_id long, text string, source string")
    first = mixing.mix_sources(docs, F.array("source")).collect()
    sizes = collections.Counter()
    for r in first:
        sizes[r.sources[0]] += r.size
    goal = mixing.targets(sizes)
    taken = collections.Counter()
    for r in first:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and r.source_size == sizes[r.sources[0]]
        assert r.target == goal[r.sources[0]]
        taken[r.sources[0]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 1 for s in goal)
    again = mixing.mix_sources(docs.repartition(7), F.array("source")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, first)) == sorted(map(key, again))


def test_mix_of_overlapping_sources_uses_first_uses_first():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 10)]
    flow = mixing.route(patterns, {"a": 150, "b": 110})
    assert flow[0]["a"] + flow[1]["a"] == 150 and flow[1]["b"] + flow[2]["b"] == 110
    used = [sum(f.values()) for f in flow.values()]
    # 260 of 210 words: all first uses, then 50 second ones at the same cost wherever they are
    assert all(u >= s for u, (_, s) in zip(used, patterns, strict=True)) and sum(used) == 260


def test_targets_stop_at_three_times():
    got = mixing.targets({"a": 10, "b": 100, "c": 1000, None: 90})
    assert got["a"] == 30.0 and got["b"] == 300.0 and got[None] == 270.0 and got["c"] == pytest.approx(600.0)


def test_mix_frames(messy, empty):
    got = mixing.mix_sources(messy, F.array("source"))
    assert got.count() == 11 and mixing.mix_sources(empty, F.array("source")).count() == 0
    mixed = mixing.mixed_documents(messy, F.array("source"))
    assert mixed.columns == messy.columns and 0 < mixed.count() <= 33


def test_mix_of_more_patterns_than_are_broadcast(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, "w " * draw.randint(0, 40), [f"s{i % 150}"] if i % 5 else draw.sample(["é", "a", "b", "c", None, "s7"], draw.randint(1, 3)))
            for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own array<string>")
    before = sorted(map(str, mixing.mix_sources(docs, F.col("own")).collect()))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 20)
    got = mixing.mix_sources(docs, F.col("own")).collect()
    assert sorted(map(str, got)) == before and len(got) == 900
    sizes, patterns, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        patterns[tuple(r.sources)] += r.size
        taken[tuple(r.sources)] += r.taken
        for s in r.sources:
            sizes[s] += r.size
    goal = mixing.targets(sizes)
    assert all(r.target == goal[r.sources[0]] and r.source_size == sizes[r.sources[0]] for r in got)
    found = sorted(patterns.items(), key=lambda p: [(s is None, s or "") for s in p[0]])
    flow = mixing.route(found, {s: round(x) for s, x in goal.items()})
    alone = {s for s in sizes if not any(s in p and len(p) > 1 for p in patterns)}
    assert len(alone) > 100
    for i, (p, _) in enumerate(found):
        if p[0] in alone:
            assert abs(taken[p] - sum(flow[i].values())) <= 20
    both = [sum(f.values()) for f in flow.values()]
    assert abs(sum(taken.values()) - sum(both)) <= 0.02 * sum(both)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_personal_data_equals_the_plain_patterns(spark):
    draw = random.Random(3)
    parts = ["a@b.c", "x.y%d@e-f.g.h", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8",
             "+1 (988) 555-2485", "+49 30", "é", "\U0001F600", " ", "-", ".", "5", "+", "a", "%", "001.02.3.255", "\n", "(555) 123-4567",
             "joe (at) foo (dot) com", "999"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))) for i in range(600)]
    rows += [(-1, None), (-2, ""), (-3, "call a@b.co 1.2.3.4 " * 1500), (-4, "a" * 40_000 + "1" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    found = {r.doc_id: r for r in pii.find_personal_data(docs, model).collect()}
    for i, text in rows:
        base = personal(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[i].spans.split(",")) or not base
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]


def test_personal_data_is_native_and_redacts(spark, messy, empty):
    docs = spark.createDataFrame([(1, "mail a.b@c.de or +49 30 1234567, 4111 1111 1111 1111; v1.2.3.4 and 1.2.3.999"), (2, None)],
                                 "doc_id long, text string").withColumn("spans", F.lit(1))
    model = pii.fit(docs)
    plan = pii.find_personal_data(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns
    assert [r.text for r in clean.orderBy("doc_id").collect()] == [
        "mail <email> or <phone>, <card>; v<ip> and 1.2.3.999", None]
    assert pii.find_personal_data(messy, pii.fit(messy)).count() == 11
    assert pii.find_personal_data(empty, pii.fit(empty)).count() == 0 and pii.redact(messy, pii.fit(messy)).count() == 11


def test_redaction_covers_every_span_of_the_scan(spark):
    draw = random.Random(4)
    parts = ["+33.1.42.68.53.00", "a@b.c", "4111 1111 1111 1111", "1.2.3.4", "+49 30 1234567", "é", "\U0001F600", " ", ".", "x", "\n", "5"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))) for i in range(300)]
    rows += [(-1, "call +33.1.42.68.53.00 now"), (-2, None), (-3, "\U0001F600 to a@b.co 1.2.3.4\n" * 500), (-4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs, model).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    for i, text in rows:
        spans = sorted((int(a), -int(b), pii.KINDS.index(k)) for k, a, b in (x.split(":") for x in found[i].split(",") if x))
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += text[at:a] + f"<{pii.KINDS[k]}>"
            at = max(at, -b)
        assert clean[i] == (None if text is None else out + text[at:])
    assert clean[-1] == "call <phone> now"


def test_unreliable_labelers_lose_weight():
    digits = lambda *v: sum(x * 3 ** (4 - i) for i, x in enumerate(v))
    counts = {digits(1, 1, 1, 1, 1): 300, digits(1, 1, 0, 1, 1): 200, digits(2, 2, 0, 1, 1): 300, digits(2, 2, 2, 1, 1): 100}
    belief = pii.reliabilities(counts)
    assert belief[digits(1, 1, 0, 1, 1)] > 0.9 and belief[digits(2, 2, 0, 1, 1)] < 0.1
    score = pii.span_classifier(counts, belief)
    assert score[digits(1, 1, 1, 1, 1)] > 0.9 and score[digits(2, 2, 2, 1, 1)] < 0.1

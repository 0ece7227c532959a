"""Spelling groups against a plain version."""

import collections
import random
import re
import zlib

from prosegauge.llm import spelling


def plain_words(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def plain_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_groups_equal_brute_force_on_crowded_words(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        words = []
        for _ in range(draw.randint(0, 60)):
            word = "".join(draw.choice("aaabé") for _ in range(draw.choice([6, 7, 7, 7, 8, 8, 9])))
            word = draw.choice([word, word, word, "aaaaaaa" + "b" * draw.randint(0, 3), "Éaaaaaab", "AAAaaaab", "aaabbbbaaa"])
            words.append(word)
        rows.append((i, draw.choice([" ", "-", "3", "漢"]).join(words)))
    want = plain_groups(plain_words(rows))
    assert sum(r[4] > 3 for r in want) > 50 and any(r[1] for r in want)
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


def test_roots_follow_long_chains(spark):
    # each word is near the next and occurs a tenth as often, over four steps
    found = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "xbcdefghij": 20000, "abcdefgz": 3}
    near = spelling.neighbours(spark.createDataFrame(list(found.items()), "word string, n long"))
    want = {w: sum(one_edit(w, v) for v in found) for w in found}
    assert {r.word: r.n_near for r in near.collect()} == {w: k for w, k in want.items() if k}
    forms = near.join(spark.createDataFrame(list(found.items()), "word string, n long"), "word").where("-best.minus >= 10 * n")
    roots = {r.word: r.root for r in spelling._roots(forms.selectExpr("word", "best.word as form")).collect()}
    assert roots == {w: "xbcdefghij" for w in ("abcdefg", "abcdefgh", "abcdefghi", "abcdefghij")}


def test_ties_go_to_the_smallest_word(spark):
    rows = [(None, "abcdefg " * 2 + "abcdefgx " * 20 + "abcdefgé " * 20 + "abcdefga " * 20)]
    out = {r[0]: r for r in got(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert out["abcdefg"] == ("abcdefg", "abcdefga", "abcdefga", 2, 3, 20)
    assert out["abcdefga"][1] is None and out["abcdefga"][4] == 3


def test_odd_rows(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert got(spelling.spelling_groups(messy)) == plain_groups(plain_words(rows))
    assert spelling.spelling_groups(empty).count() == 0

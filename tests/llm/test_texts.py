"""Per-document operators against plain versions: BPE, repetition rules, secrets, quality."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import public_tokenizers
from pyspark.sql import functions as F
from prosegauge.llm import bpe, quality, repetition, secrets

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


def same_ids(plain, texts):
    own = bpe.encoder(RANKS)
    ids, at = own.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        got = ids[at[i]: at[i + 1]]
        assert got.tolist() == plain.encode_ordinary(text or "")
        assert own.decode(got) == (text or "").encode()


def test_bpe_equals_the_library_on_random_texts(plain):
    draw = random.Random(1)
    signs = "ab 's't're'll've'd'mr  \n\t é中\U0001F600!?12x'l'v'e<|endoftext|>"
    for _ in range(60):
        same_ids(plain, ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(30)])


def test_bpe_equals_the_library_on_all_kinds_of_code_points(plain):
    draw = random.Random(2)
    for _ in range(40):
        same_ids(plain, ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x20, 0x3000), draw.randrange(
            0x3000, 0xD7FF), draw.randrange(0xE000, 0x1FFFF)])) for _ in range(draw.randint(0, 60))) for _ in range(10)])


def test_bpe_long_pieces_and_empty_texts(plain):
    same_ids(plain, ["a" * 50_000, "ab" * 20_000, None, "", " " * 3000, "x"])


def test_bpe_memory_does_not_grow_with_the_batch(plain):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(2000)) for _ in range(600)]
    own = bpe.Encoder(RANKS)
    tracemalloc.start()
    got = []
    for _, ids, _ in own.steps(pa.record_batch({"text": pa.array(texts)})):
        got.append(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.concatenate(got).tolist() == [x for t in texts for x in plain.encode_ordinary(t)]
    assert peak < 80_000_000


def test_rank_queue_gives_lowest_rank_and_leftmost_place():
    queue = bpe.RankQueue()
    for rank in (70_000, 3, 256, 255):
        queue.open(rank, [9, 2])
    assert [queue.pop() for _ in range(5)] == [(3, [2, 9]), (255, [2, 9]), (256, [2, 9]), (70_000, [2, 9]), (-1, [])]


def test_bpe_frame(messy, empty):
    rows = bpe.encode_documents(messy, RANKS, with_ids=True).collect()
    assert len(rows) == 11 and sum(r.n_tokens == 0 for r in rows) == 3
    assert all(r.n_tokens == len(r.ids) for r in rows)
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {nothing} == {r.decoded_sha256 for r in rows if r.n_tokens == 0}
    assert bpe.encode_documents(empty, RANKS).count() == 0


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    three = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) for k in range(3) if three[tuple(words[i:i + 3])] > 1}
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best[i] = max(best[i], n)
    covered = {i + k for i, b in enumerate(best) if b >= 6 for k in range(b)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": lines, "n_repeat_words": len(repeated), "covered": len(covered), "longest": max(best, default=0)}


def test_repetition_counts_equal_brute_force():
    draw = random.Random(2)
    parts = ["a ", "b ", "c\n", "a b c d e f g\n", "é|", "#", "  ", "\t\x85 ", "zz "]
    for _ in range(80):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(8)] + [None, ""]
        got = repetition.measure(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert {k: int(v[i]) for k, v in got.items()} == measured(text)


def test_quality_rules_frame(spark, messy, empty):
    rows = {(r.doc_id, r.n_words): r for r in repetition.quality_rules(messy).collect()}
    assert not any(r.kept for r in rows.values())  # all short, or one line again and again
    assert rows[5, 21_000].covered_words == 21_000 and rows[5, 21_000].n_dup_lines == 2999
    assert repetition.quality_rules(messy).count() == 11 and repetition.quality_rules(empty).count() == 0
    fresh = " ".join(f"w{i}" for i in range(200))
    block = " ".join(f"v{i}" for i in range(70))
    docs = spark.createDataFrame([(1, fresh), (2, f"{block} {fresh} {block}"), (3, fresh + " #$%" * 40)], "doc_id long, text string")
    kept = {r.doc_id: (r.base_failed, r.kept, r.longest_repeat) for r in repetition.quality_rules(docs).collect()}
    assert kept[1] == (False, True, 0) and kept[2] == (False, False, 70) and kept[3][1] is False


@pytest.mark.parametrize(("text", "literals"), [
    ('x = "hunter2Xy9z"; db_password = x', ["hunter2Xy9z"]),
    ('auth_token => "q8Zx81KKa0" + "zz9"', ["q8Zx81KKa0", "zz9"]),
    ("export PWD_MAIN=Zx81kkAA\nfoo: bar", ["Zx81kkAA"]),
    ('cfg["apiKey"] = "A1b2C3d4E5"', ["A1b2C3d4E5"]),
    ("PASSWORD = '<your password>'", []), ('password_hint: "mother maiden 1"', []),
    ("the key: value of the secret life is short", []), ("", []),
])
def test_literals_reach_sensitive_names(text, literals):
    assert [text[a:b] for a, b in secrets.literals(text)] == literals


@pytest.mark.parametrize(("text", "literals"), [
    ('api_access = "A1b2C3d4E5f6G7"', ["A1b2C3d4E5f6G7"]), ("encryptionAccess: Zx81kkAA99pLq7", ["Zx81kkAA99pLq7"]),
    ('{"api access": "A1b2C3d4E5f6G7"}', ["A1b2C3d4E5f6G7"]), ('cfg["pass_word"] = "A1b2C3d4E5f6G7"', ["A1b2C3d4E5f6G7"]),
    ('blob = "q8Zx81KK"\nblob = ' + " + ".join(f'"a{i:02}Z"' for i in range(40)) + "\npassword = blob", [f"a{i:02}Z" for i in range(40)]),
    ('a = "q8Zx81KK"\n' + "".join(f'a = a + "x{i:02}"\n' for i in range(3000)) + "password = a", ["q8Zx81KK", *[f"x{i:02}" for i in range(3000)]]),
    ('a = "q8Zx"\n' + "a = a + a\n" * 3000 + "password = a", ["q8Zx"]),
    ('a = "x"\n' + "a = a + a\n" * 3000 + "password = a", []),
])
def test_prefilter_and_long_constants_lose_no_literal(text, literals):
    assert [text[a:b] for a, b in secrets.literals(text)] == literals


def test_prefilter_lets_every_sensitive_target_through():
    draw = random.Random(11)
    words = [*secrets.SENSITIVE, "Api", "ACCESS", "pass", "word", "x9", "_", "-", ".", " ", "é", "count", "'", '"', "]", "=", ":", "\n", "\t"]
    for _ in range(20_000):
        text = "".join(draw.choice(words) for _ in range(draw.randint(1, 9))) + draw.choice(["=", " = ", ": ", '": ', "'] ="]) + "'A1b2C3d4E5f6G7'"
        if any(secrets.name_score(target) >= 0.5 for target, _ in secrets.pairs(text)):
            assert secrets.may_hold(text), text


def test_value_scores_equal_those_of_the_joined_text():
    draw = random.Random(12)
    pieces = ["x", "abc", "Zx81", "aaaa", "<", ">", "your_", " two words ", "%(", "${", "}", "9", "é", "A1b2C3d4E5f6G7", "{{", "}}", "AAAA"]
    for _ in range(3000):
        parts = [draw.choice(pieces) for _ in range(draw.randint(1, 12))]
        text, at, value = "".join(parts), 0, secrets.Value()
        for i, x in enumerate(parts):
            value.parts.append((at, at + len(x), x))
            at += len(x)
            if i % 3 == 2:
                outer = secrets.Value()
                outer.parts.append(value)
                value = outer
        assert secrets.value_score(value) == pytest.approx(secrets.literal_score(text))


def base_of(text):
    found = []
    for kind, pattern, least, group in (
            (0, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
            (1, r"AKIA[A-Z0-9]+", 20, 0), (2, r"[0-9a-f]+", 24, 0)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def test_base_secrets_equal_the_plain_patterns(spark, messy, empty):
    draw = random.Random(3)
    parts = ["password=", "Token : 'abc", "api_key", "=", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", " ", '"', "x1"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(800)] + [None, ""]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        base = base_of(texts[row.doc_id])
        joined = ",".join(f"{secrets.BASE_KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert not joined or set(joined.split(",")) <= set(row.spans.split(","))
    assert secrets.find_secrets(messy).count() == 11 and secrets.find_secrets(empty).count() == 0


def test_attention_gradient_equals_differences():
    draw = np.random.default_rng(0)
    x, owner = draw.normal(size=(7, 5)), np.array([0, 0, 0, 1, 2, 2, 2])
    label = np.array([1.0, 0.0, 1.0])
    shapes = {"E": (5, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "b": ()}
    model = quality.Model(np.zeros(5), np.ones(5), {k: np.asarray(draw.normal(size=s)) for k, s in shapes.items()})

    def loss():
        s = model.forward(x, owner)["score"]
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).sum()

    f = model.forward(x, owner)
    slope = model.gradient(f, owner, f["score"] - label)
    for name, part in model.parts.items():
        for at in np.ndindex(part.shape):
            kept = float(part[at])
            part[at] = kept + 1e-6
            up = loss()
            part[at] = kept - 1e-6
            down = loss()
            part[at] = kept
            assert abs((up - down) / 2e-6 - np.asarray(slope[name])[at]) < 1e-4


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(
        quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right >= 0.95 * len(rows)


def test_quality_frames(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(messy, labels)
    got = quality.score_quality(messy, model)
    assert got.columns == [c for c in messy.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == 11
    alone = quality.fit(empty, labels.limit(0))
    assert quality.score_quality(empty, alone).count() == 0


def test_fit_reads_whole_texts(spark, monkeypatch):
    # good and bad texts agree in their first 5,000 words
    draw = random.Random(8)
    same = " ".join(f"w{draw.randint(0, 400)}" for _ in range(5000))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rows = [(i, same + (" #$%& ***" * 700 if i % 2 else " calm words" * 700)) for i in ids]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in ids], "doc_id long, quality int")
    bags, real = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, owner, label: bags.append((np.bincount(owner), label)) or real(x, owner, label))
    model = quality.fit(docs, labels)
    assert bags[0][0].tolist() == [100] * 40 and sum(bags[0][1]) == sum(1 - i % 2 for i in ids)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 2 == 0) for i in ids)
    # where memory is short there are fewer rows, each whole
    monkeypatch.setattr(quality, "FIT_PASSAGES", 550)
    quality.fit(docs, labels)
    assert set(bags[1][0].tolist()) == {100} and len(bags[1][0]) in (9, 10) and 0 < sum(bags[1][1]) < len(bags[1][1])


@pytest.mark.parametrize("line", [
    'password: str = "{}"', 'const secretKey: string = "{}"', 'db_password?: string = "{}"', 'let api_token: Option<String> = "{}"',
    'private static readonly authToken: string | null = "{}"', 'password: Optional[str]= "{}"'])
def test_typed_assignments_reach_their_names(line):
    text = "x = 1\n" + line.format("Xk9$2mQp7LzR!") + "\n"
    at = text.index("Xk9$")
    assert (at, at + 13) in secrets.literals(text)


def test_statements_are_no_types():
    assert secrets.literals('if password: label = "Xk9$2mQp7LzR!"') == []
    assert secrets.literals('colour: str = "Xk9$2mQp7LzR!"') == []


def test_broken_quotes_take_linear_time():
    import time

    started = time.perf_counter()
    text = 'token = "' + '\\"' * 500_000
    secrets.scan(text)
    assert time.perf_counter() - started < 10
    # a closed string behind an open quote of the other kind is still read
    assert secrets.literals("it's password = \"Xk9$2mQp7LzR!\"")

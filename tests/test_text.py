import pytest
from pyspark.sql import functions as F

from prosegauge.functions import numeric as nu, text as tx
from prosegauge.functions.models import score_columns, sentiment_name, tiebreak, with_embeddings, with_model_scores
from prosegauge.functions.vectors import cosine, prototype_similarity
from prosegauge.lexicons import LEXICON

c = F.col("text")


def values(frame, texts, expr):
    df = frame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r[0] for r in df.select(expr.alias("v"), "id").orderBy("id").collect()]


def test_noise_predicates(frame):
    texts = ["", "  \n", "https://a.b www.c", "#one #two", "#a#b", "RT @x hi", "rt @x: hi", "🎉 ☀", "Été", "?! @you #x"]
    assert values(frame, texts, tx.is_url_only(c)) == [False, False, True] + [False] * 7
    assert values(frame, texts, tx.is_hashtag_only(c)) == [False] * 3 + [True] + [False] * 6
    assert values(frame, texts, tx.is_hashtag_run(c)) == [True, True, False, True, True] + [False] * 5
    assert values(frame, texts, tx.is_symbol_only(c)) == [True, True, True, True, True, False, False, True, False, True]
    assert values(frame, texts, tx.is_repost(c)) == [False] * 5 + [True, True] + [False] * 3
    assert values(frame, texts, tx.is_repost(c, True)) == [False] * 5 + [True] + [False] * 4


def test_normalisation(frame):
    assert values(frame, [" a\n https://x.y  b "], tx.normalize_text(c)) == ["a b"]
    assert values(frame, ["V. Kohli  Jr"], tx.normalize_name(c)) == ["v kohli jr"]
    assert values(frame, ["  My Great!! Club--1 "], tx.slugify(c)) == ["my-great-club-1"]


def test_splitting(frame):
    text = "One. Two!\r\n\r\nThree? four  \n \n\n Five"
    assert values(frame, [text], tx.paragraphs(c)) == [["One. Two!", "Three? four", "Five"]]
    assert values(frame, ["A b. C d! e"], tx.sentences(c)) == [["A b.", "C d!", "e"]]
    assert values(frame, ["x while y; z but t"], tx.clauses(c)) == [["x", "y", "z", "t"]]
    assert values(frame, ["Don't stop2go"], tx.tokens(c)) == [["don't", "stop", "go"]]
    assert values(frame, ["a b c"], tx.ngrams(tx.tokens(c), 2)) == [["a b", "b c"]]
    assert values(frame, ["a"], tx.ngrams(tx.tokens(c), 3)) == [[]]


def test_markers_are_substrings_and_keywords_are_tokens(frame):
    assert values(frame, ["contribute"], tx.hits(c, ["but", "x"])) == [1]
    assert values(frame, ["contribute but"], tx.keyword_ratio(tx.tokens(c), ["but"])) == [0.5]
    assert values(frame, ["anything"], tx.contains_any(c, [])) == [False]


def test_quality_signals(frame):
    assert values(frame, ["a b c d e"], tx.repetition(tx.tokens(c))) == [0.0]
    # 8 tokens, 4 distinct; bigrams 7 -> 4 distinct; trigrams 6 -> 4 distinct
    rep = 2 * (0.35 * 4 / 8 + 0.4 * 3 / 7 + 0.25 * 2 / 6)
    assert values(frame, ["a b c d a b c d"], tx.repetition(tx.tokens(c)))[0] == pytest.approx(rep)
    assert values(frame, ["a b a b"], tx.lexical_diversity(tx.tokens(c)))[0] == pytest.approx(0.5 * (1 - 0.325))
    s = tx.sentences(c)
    variety = tx.sentence_variety(s, F.transform(s, tx.tokens), LEXICON["clause_words"])
    assert values(frame, ["", "One only."], variety) == [0.0, 0.35]
    # lengths 2 and 4: cv = 1/3; both shapes differ
    assert values(frame, ["A b. C d e f."], variety)[0] == pytest.approx(0.55 * 0.6 + 0.45)
    ev = tx.evidence_score(c, F.lower(c), LEXICON["evidence"])
    # 50, 2019 as numbers, 2019 as year, "runs", one two-word name
    assert values(frame, ["Virat Kohli made 50 runs in 2019"], ev)[0] == pytest.approx(5 / 8)


def test_signals_where_few_texts_have_what_a_match_needs(spark):
    texts = ["last 5 matches, better than 1999", "between 2001 and 2010 this season", "last laugh 20", "a b c d e f", "a b c d e",
             "the the the the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    c = F.col("c")
    rows = df.orderBy("i").select(
        (tx.evidence_score(c, c, []) * 8).alias("evidence"), tx.repetition(tx.tokens(c)).alias("repetition"),
        (tx.completeness(tx.sentences(c), c, [], [], []) * 3).cast("int").alias("six_words")).collect()
    assert [r.evidence for r in rows] == [5, 6, 1, 0, 0, 0]
    assert [r.six_words for r in rows] == [1, 1, 0, 1, 0, 1]
    assert rows[3].repetition == 0 and rows[5].repetition == 1


def test_numeric_helpers(frame):
    df = frame([("7.9",), ("x",), (None,), ("",)], "text string")
    got = df.select(nu.to_int0(c), nu.to_float0(c), nu.clamp(c, 20.0, 95.0, 50.0)).collect()
    assert [tuple(r) for r in got] == [(7, 7.9, 20.0), (0, 0.0, 50.0), (0, 0.0, 50.0), (0, 0.0, 50.0)]
    p = frame([(0.4, 0.4, 0.2), (0.0, 0.0, 0.0)], "a double, b double, c double")
    cols = [F.col(x) for x in "abc"]
    assert [r[0] for r in p.select(nu.argmax_label(list(zip("xyz", cols)))).collect()] == ["x", "x"]
    assert p.select(*nu.normalize_probs(cols)).collect()[1] == pytest.approx((1 / 3,) * 3)
    assert p.select(*nu.normalize_probs(cols, "zero")).collect()[1] == (0.0, 0.0, 0.0)
    assert p.select(nu.top_two(cols)[2]).first()[0] == 0.0


def test_vectors(frame):
    df = frame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5 ** 0.5)
    assert df.select(prototype_similarity(F.col("a"), [[1, 1], [0, 1]])).first()[0] == pytest.approx(
        (0.5 ** 0.5 - 0.15) / 0.65)


def test_model_adapters(frame):
    df = frame([([("Non-Toxic", 0.9), ("anger", 0.2)],), ([("toxic", 0.7), ("POSITIVE", 0.6)],)],
               "o array<struct<label:string,score:double>>")
    cols = score_columns(F.col("o"))
    rows = df.select(cols["toxic"], cols["anger"], cols["positive"]).collect()
    assert rows[0] == pytest.approx((0.1, 0.2, 0.0)) and rows[1] == pytest.approx((0.7, 0.0, 0.6))
    assert values(frame, ["2", "neutral_x", "bad"], sentiment_name(c)) == ["positive", "neutral", "negative"]
    t = frame([("A", 0.05, "B"), ("A", 0.2, "B"), ("A", 0.0, None)], "writer_type string, writer_gap double, h string")
    assert [r.writer_type for r in tiebreak(t, "h").collect()] == ["B", "A", "A"]


def test_model_hooks_run_in_tasks(frame):
    import pandas as pd

    df = frame([(1, "aa"), (2, None)], "doc_id int, text string")

    def make():
        return lambda texts: pd.DataFrame({"toxic": [len(t) / 10 for t in texts]})

    scored = with_model_scores(df, make, ["toxic"])
    assert {r.doc_id: r.toxic for r in scored.collect()} == {1: 0.2, 2: 0.0}
    vec = with_embeddings(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r.doc_id: r.embedding for r in vec.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}

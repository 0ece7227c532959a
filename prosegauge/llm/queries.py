"""Queries of the numbered operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import (
    bpe, chats, jaccard, mixing, neighbours, phrases, pii, quality, repetition, scoring, secrets, spelling,
    suffixes)
from prosegauge.llm.common import saved, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 200)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), F.array("source")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op4_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saved(chats.transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    return chats.parse(found, chats.fit(found)).drop("rendered")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_source_mix, op3_repetition_rules, op4_transcript_turns,
                            op5_personal_data, op6_bpe_roundtrip, op7_jaccard_join,
                            op8_quality_classifier, op9_multiprobe_search, op10_secret_scan, op11_spelling_groups, op12_language_model,
                            op13_phrase_collocations)
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 199)) AS i FROM docs)),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
marked AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS gap FROM windows SEMI JOIN again USING (w)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (
  SELECT doc_id, i, sum(coalesce(gap, FALSE)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(n_bytes) FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::INT, (2 * (b - a))::INT), '' ORDER BY a) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256 FROM docs JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op7_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id FROM (
  SELECT x AS doc_id, y FROM reach) LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n""",
    "op11_spelling_groups": r"""
WITH RECURSIVE steps AS (  -- the table of crc32, a byte at a time
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS t(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY doc_id, run),
codes AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2),
    lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS c FROM codes, steps),
slipped AS (SELECT n, CASE WHEN c % 31 = 0 THEN substr(run, 1, (c % length(run))::INT) || substr(run, (c % length(run))::INT + 2)
  ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.cut),
rated AS (SELECT near.word, near.other, w.n, o.n AS m, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, near.other) AS k,
  count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = near.other),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
  CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN rated r ON r.word = w.word AND r.k = 1),
ways(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word
JOIN forms e ON e.word = w.last WHERE e.form IS NULL""",
    "op13_phrase_collocations": r"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
size AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + s - 1] AS p FROM starts, range(1, 6) AS sizes(s) WHERE i + s - 1 <= len(w)),
counts AS (SELECT lang, p, count(*)::HUGEINT AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100),
candidates AS (SELECT lang, p, f AS a FROM counts WHERE len(p) > 1),
parts AS (SELECT lang, a, p[i:i + s - 1] AS p FROM (
  SELECT lang, a, p, unnest(range(1, len(p))) AS i FROM candidates), range(2, 5) AS sizes(s)
  WHERE i + s - 1 <= len(p) AND s < len(p)),
covered AS (SELECT lang, p, max(a) AS most FROM parts GROUP BY lang, p),
kept AS (SELECT c.* FROM candidates c LEFT JOIN covered v ON c.lang = v.lang AND c.p = v.p
         WHERE v.most IS NULL OR 100 * v.most < 100 * c.a),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, size.n, 1000 * c.a * size.n // (l.f * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:c.k]
  JOIN counts r ON r.lang = c.lang AND r.p = c.p[c.k + 1:] JOIN size ON size.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM lowest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000""",
}

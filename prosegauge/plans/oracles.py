"""DuckDB SQL for the queries of the catalog, written against the driver's views."""

from __future__ import annotations

from collections.abc import Sequence

from prosegauge.functions.text import NOT_WS, SPACES, WS
from prosegauge.lexicons import (
    ARCHETYPES, CALIBRATION_BANDS, COMPONENT_MAX, FLOOR_QUALITY_WEIGHTS, FUSION_BANDS, LABEL_BANDS, LEXICON,
    NON_BOWLER_WICKETS, REBALANCE_VARIANTS, STANCE_ANCHORS, STANCE_STRENGTH_BASE, STANCES, UPLIFT_WEIGHTS,
    WRITER_FLOORS, WRITER_PROFILES, WRITER_TYPES,
)
from prosegauge.operators.clean import TOPIC_GROUPS
from prosegauge.operators.stance import prob
from prosegauge.plans.demo import ABUSE, DEMO, WORDS

L, D = LEXICON, DEMO
ORACLES: dict[str, str] = {}


# --- SQL fragments ---------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: Sequence[str]) -> str:
    return "[" + ",".join(map(q, words)) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {q(SPACES)})"


def hits(x: str, words: Sequence[str]) -> str:
    return "(" + "+".join(f"contains({x},{q(w)})::INT" for w in words) + ")"


def anyof(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x},{q(w)})" for w in words) + ")"


def score(x: str, words: Sequence[str], norm: float) -> str:
    return f"least(1.0::DOUBLE, {hits(x, words)} / {norm}::DOUBLE)"


def pieces(arr: str) -> str:
    return f"list_filter(list_transform({arr}, lambda z: {strip('z')}), lambda z: z <> '')"


def sents(x: str) -> str:
    marked = f"regexp_replace({strip(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return pieces(f"string_split({marked}, chr(1))")


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z'']+')"


def unit(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def case(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


PARAS = f"""paras AS (
  SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS para_ix, unnest(p) AS text FROM (
    SELECT doc_id, {pieces("string_split(" + strip("replace(text, chr(13)||chr(10), chr(10))") + ", chr(10))")} AS p
    FROM documents))"""
TURNS = "turns AS (SELECT conv_id*1000+turn AS doc_id, conv_id, turn, role, text FROM conversations)"
LOWP = f"{PARAS}, lp AS (SELECT doc_id, para_ix, text, lower(text) AS low, {sents('text')} AS ss FROM paras)"


def letters(x: str) -> str:
    return f"translate(({x})::VARCHAR, '0123456789', 'abcdefghij')"


SUBS = """subs AS (SELECT event_id AS id, user_id, ts, event_type, value, user_id % 25 AS community_id,
  CASE WHEN event_type='view' THEN 'bqs' ELSE 'eqs' END AS model, event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN least(95.0, value) END AS eqs_score,
  ['analytical','balanced','other','emotional','unknown'][(event_id % 5 + 1)::INT] AS stance_label FROM events)"""
TOPIC5 = "['click','view','purchase','signup','error']"
COMM = f"""comm AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, lower(n_name) AS slug,
  {TOPIC5}[n_nationkey % 5 + 1] AS t1, {TOPIC5}[(n_nationkey + 1) % 5 + 1] AS t2,
  {TOPIC5}[(n_nationkey * 2) % 5 + 1] AS t3, CASE WHEN n_nationkey % 4 = 3 THEN 'private' ELSE 'public' END AS visibility,
  (n_nationkey * 7 % 11)::BIGINT AS member_count, n_nationkey AS created_at FROM nation)"""

# --- splitting and text signals -------------------------------------------------------

ORACLES["paragraph_split"] = f"WITH {PARAS} SELECT doc_id, para_ix, length(text)::INT AS n_chars, md5(text) AS h FROM paras"
ORACLES["sentence_split"] = f"""WITH {PARAS}, s AS (SELECT doc_id, unnest({sents('text')}) AS x FROM paras)
SELECT doc_id, count(*) AS n_sentences, max(length(x))::INT AS longest, min(md5(x)) AS h FROM s GROUP BY doc_id"""
ORACLES["clause_split"] = f"""WITH {TURNS}, s AS (SELECT doc_id, {pieces(
    "string_split(regexp_replace(regexp_replace(replace(text,' the ',' but '), '[^\\x00-\\x7F\\p{P}\\p{S}\\p{Z}\\p{C}]', '\\0'), '(?i)\\b(while|however|but)\\b|;', chr(1), 'g'), chr(1))")} AS p FROM turns)
SELECT doc_id, len(p)::INT AS n_clauses, md5(array_to_string(p,'|')) AS h FROM s"""
ORACLES["token_counts"] = f"""SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct,
len(regexp_extract_all(text, '{WS.replace("[", "[^", 1)}+'))::INT AS n_space_words, len(s)::INT AS n_sentences
FROM (SELECT doc_id, text, {toks('text')} AS t, {sents('text')} AS s FROM documents)"""
ORACLES["ngram_counts"] = f"""WITH {TURNS}, t AS (SELECT {toks('text')} AS t FROM turns),
g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) AS ngram FROM t)
SELECT ngram, count(*) AS n FROM g GROUP BY ngram"""
ORACLES["marker_scores"] = f"""WITH b AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT doc_id, {hits('low', D['supportive'])}::BIGINT AS h_supportive, {hits('low', D['attack'])}::BIGINT AS h_attack,
{hits('low', D['evidence'])}::BIGINT AS h_evidence, round({score('low', L['reasoning'], 4.0)}, 6) AS reasoning,
round({hits('low', ABUSE)} / {float(len(ABUSE))}::DOUBLE, 6) AS abuse_share FROM b"""
ORACLES["keyword_ratio"] = f"""WITH b AS (SELECT doc_id, {toks('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN len(t)=0 THEN 0.0 ELSE round(len(list_filter(t, lambda x: list_contains({sql_list(WORDS)}, x))) / len(t)::DOUBLE, 6) END AS common,
CASE WHEN len(t)=0 THEN 0.0 ELSE round(len(list_filter(t, lambda x: list_contains({sql_list(L['stopwords'])}, x))) / len(t)::DOUBLE, 6) END AS stop FROM b"""
# RE2 has ASCII word boundaries: letters beyond ASCII become "_", a word character that is no letter or digit
ASCII = "regexp_replace({x}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '_', 'g')"


def evidence(text: str, words: Sequence[str]) -> str:
    low, raw = ASCII.format(x=f"lower({text})"), ASCII.format(x=text)
    def n(p: str) -> str:
        return f"len(regexp_extract_all({low}, '{p}'))"
    names = f"len(list_filter(regexp_extract_all({raw}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,2}}\\b'), lambda m: regexp_matches(m, '\\s')))"
    found = " + ".join([n(r"\b\d+(?:\.\d+)?%?\b"), n(r"\b(?:19|20)\d{2}\b"), hits(f"lower({text})", words),
                        n(r"\b(better than|worse than|compared to|compared with)\b"),
                        n(r"\b(last\s+\d+\s+(?:matches?|innings?)|this\s+season|between\s+20\d{2}\s+and\s+20\d{2})\b"),
                        f"least({names}, 3)"])
    return f"least(1.0::DOUBLE, ({found}) / 8.0::DOUBLE)"


def diversity(t: str) -> str:
    ttr = f"(len(list_distinct({t})) / len({t})::DOUBLE)"
    return f"CASE WHEN len({t})=0 THEN 0.0 ELSE {ttr} * (1 - least(0.35, (1 - {ttr}) * 0.65)) END"


def repetition(t: str) -> str:
    bi = f"list_transform(range(1, len({t})), lambda i: {t}[i]||' '||{t}[i+1])"
    tri = f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i]||' '||{t}[i+1]||' '||{t}[i+2])"
    def rep(g: str, n: str) -> str:
        return f"(({n}) - len(list_distinct({g}))) / greatest(1, {n})::DOUBLE"
    return (f"CASE WHEN len({t}) < 6 THEN 0.0 ELSE {unit(f'2.0 * (0.35 * {rep(t, f'len({t})')} + 0.4 * {rep(bi, f'len({t}) - 1')} + 0.25 * {rep(tri, f'len({t}) - 2')})')} END")


def variety(s: str, words: Sequence[str]) -> str:
    lens = f"list_transform({s}, lambda z: len({toks('z')}))"
    shape = (f"list_transform(list_filter({s}, lambda z: len({toks('z')}) > 0), lambda z: {toks('z')}[1] || '|' || "
             f"list_has_any({toks('z')}, {sql_list(words)})::VARCHAR || '|' || regexp_matches(z, '\\p{{Nd}}')::VARCHAR || '|' || (len({toks('z')}) > 20)::VARCHAR)")
    cv = f"CASE WHEN list_sum({lens}) > 0 THEN list_stddev_pop({lens}) / list_avg({lens}) ELSE 0.0 END"
    share = f"len(list_distinct({shape})) / greatest(1, len({shape}))::DOUBLE"
    return (f"CASE WHEN len({s})=0 THEN 0.0 WHEN len({s})=1 THEN 0.35 ELSE "
            f"{unit(f'0.55 * {unit(f'1.8 * ({cv})')} + 0.45 * ({share})')} END")


def complete(s: str, low: str, lex: dict) -> str:
    first, last = f"lower({s}[1])", f"lower({s}[len({s})])"
    words = f"len(regexp_extract_all({first}, '{WS.replace('[', '[^', 1)}+'))"
    return (f"CASE WHEN len({s})=0 THEN 0.0 ELSE (({anyof(first, lex['intro'])} OR {words} >= 6)::INT + "
            f"{anyof(low, lex['argument'])}::INT + {anyof(last, lex['conclusion'])}::INT) / 3.0::DOUBLE END")


def content(t: str, lex: dict = L) -> str:
    ends = "(?:" + "|".join(lex["content_suffixes"]) + ")$"
    return (f"CASE WHEN len({t})=0 THEN 0.0 ELSE len(list_filter({t}, lambda x: NOT list_contains({sql_list(lex['stopwords'])}, x) "
            f"AND (length(x) >= 5 OR regexp_matches(x, '{ends}')))) / len({t})::DOUBLE END")


SPLITD = f"b AS (SELECT doc_id, text, lower(text) AS low, {toks('text')} AS t, {sents('text')} AS s FROM documents)"
ORACLES["evidence"] = f"SELECT doc_id, round({evidence('text', D['evidence'])}, 6) AS evidence FROM documents"
ORACLES["lexical_diversity"] = f"WITH {SPLITD} SELECT doc_id, round({diversity('t')}, 6) AS diversity FROM b"
ORACLES["repetition"] = f"WITH {SPLITD} SELECT doc_id, round({repetition('t')}, 6) AS repetition FROM b"
ORACLES["sentence_variety"] = f"WITH {SPLITD} SELECT doc_id, round({variety('s', WORDS[:5])}, 6) AS variety FROM b"
ORACLES["completeness"] = f"WITH {SPLITD} SELECT doc_id, round({complete('s', 'low', D)}, 6) AS completeness FROM b"
ORACLES["content_ratio"] = f"WITH {SPLITD} SELECT doc_id, round({content('t')}, 6) AS content FROM b"


def clear(n_words: str, n_sents: str, low: str) -> str:
    w = f"greatest(1, {n_words})::DOUBLE"
    per = f"({w} / greatest(1, {n_sents}))"
    flesch = f"(206.835 - 1.015 * {per} - 84.6 * (len(regexp_extract_all({low}, '[aeiouy]+')) / {w}))"
    return (f"CASE WHEN {n_sents} > 0 THEN "
            f"{unit(f'0.78 * {unit(f'({flesch} - 15.0) / 75.0')} + 0.22 * (1.0 - {unit(f'({per} - 30.0) / 22.0')})')} ELSE 0.0 END")


ORACLES["clarity"] = f"WITH {SPLITD} SELECT doc_id, round({clear('len(t)', 'len(s)', 'low')}, 6) AS clarity FROM b"

QUALITY = {
    "coherence_score": "0.5", "lexical_diversity_score": diversity("t"),
    "sentence_variety_score": variety("s", D["clause_words"]), "repetition_penalty": repetition("t"),
    "position_clarity_score": score("low", D["position"], 2.0),
    "counter_argument_score": score("low", D["counter_argument"], 2.0),
    "evidence_presence_score": evidence("text", D["evidence"]), "completeness_score": complete("s", "low", D),
    "information_density_score": content("t", D), "argument_logic_score": score("low", D["argument_logic"], 3.0),
}
W_IX = {"coherence_score": .15, "lexical_diversity_score": .1, "sentence_variety_score": .1,
        "argument_logic_score": .15, "evidence_presence_score": .15, "counter_argument_score": .1,
        "completeness_score": .1, "information_density_score": .15, "repetition_penalty": -.1}
ORACLES["writing_quality_doc"] = f"""WITH {PARAS}, b AS (SELECT doc_id, text, lower(text) AS low, {toks('text')} AS t, {sents('text')} AS s FROM paras),
x AS (SELECT doc_id, greatest(1, len(t)) AS w, {', '.join(f'{e} AS {n}' for n, e in QUALITY.items())} FROM b),
a AS (SELECT doc_id, {', '.join(f'round({unit(f"sum(w*{n})/sum(w)")}, 4) AS {n}' for n in QUALITY)} FROM x GROUP BY doc_id)
SELECT doc_id, {', '.join(f'round({n}, 3) AS {n}' for n in QUALITY)}, round(round(greatest(-10.0, least(15.0,
22.0 * ({' + '.join(f'{w}*{n}' for n, w in W_IX.items())}) - 7.0)), 4), 3) AS writing_quality_component FROM a"""

# --- cleaning and corpora ------------------------------------------------------------------

URL = "(?i)https?://" + WS.replace("[", "[^", 1) + "+|www\\." + WS.replace("[", "[^", 1) + "+"
UW = "[\\p{L}\\p{M}\\p{N}_]"
BARE = "regexp_replace(regexp_replace({x}, '" + URL + "', '', 'g'), '[@#]" + UW + "+', '', 'g')"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}" + WS[1:-1] + "]"


def flags(x: str) -> dict[str, str]:
    s = strip(x)
    return {
        "is_empty": f"{s} = ''",
        "is_url_only": f"({s} <> '' AND {strip(f'regexp_replace({x}, {q(URL)}, {q('')}, {q('g')})')} = '')",
        "is_hashtag_only": f"regexp_matches({s}, '^#{UW}+(?:{WS}+#{UW}+)*$')",
        "is_symbol_only": f"NOT regexp_matches({BARE.replace("{x}", x)}, '[\\p{{L}}\\p{{N}}]')",
        "is_emoji_only": f"regexp_replace({s}, '{EMOJI}', '', 'g') = ''",
        "is_repost": f"starts_with(lower({s}), 'rt @')",
        "is_bare_repost": f"(starts_with(lower({s}), 'rt @') AND NOT contains(lower({s}), ':'))",
    }


NOISE = ["  ", "https://a.b/c www.x.y", "#one #two", "RT @you hi", "☀ !? @me #x", "rt @you: hi", "#a#b", "Été"]
ORACLES["text_flags"] = f"""WITH {TURNS}, n AS (SELECT doc_id, text FROM turns UNION ALL
SELECT doc_id + 10000000, {sql_list(NOISE)}[(turn % 8 + 1)::INT] FROM turns)
SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in flags('text').items())} FROM n"""
_f = flags("x")
ORACLES["clean_corpus"] = f"""WITH b AS (SELECT doc_id, {strip('text')} AS x FROM documents),
k AS (SELECT * FROM b WHERE x <> '' AND NOT {_f['is_url_only']} AND NOT {_f['is_hashtag_only']} AND NOT ({_f['is_symbol_only']})
AND NOT {_f['is_repost']} AND {anyof('lower(x)', WORDS[:4])})
SELECT doc_id, md5(x) AS h FROM k QUALIFY row_number() OVER (PARTITION BY lower(x) ORDER BY doc_id) = 1"""
_g = sorted({w for i in range(len(TOPIC_GROUPS)) for w in WORDS[i:i + 2]})
ORACLES["collect_samples"] = f"""WITH {TURNS}, b AS (SELECT doc_id, {strip(f"regexp_replace(regexp_replace(text, 'https?://{WS.replace('[', '[^', 1)}+', ' ', 'g'), '{WS}+', ' ', 'g')")} AS x FROM turns),
k AS (SELECT * FROM b WHERE x <> '' AND NOT regexp_matches(x, '^(?:#{UW}+{WS}*)+$') AND NOT {_f['is_emoji_only']}
AND NOT {_f['is_bare_repost']} AND {anyof('lower(x)', _g)})
SELECT doc_id, 'twitter_like' AS source, md5(x) AS h FROM k QUALIFY row_number() OVER (PARTITION BY lower(x) ORDER BY doc_id) = 1"""
ORACLES["dedupe_first"] = "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang, lower(text) ORDER BY doc_id) = 1"
ORACLES["strip_synthetic"] = f"""SELECT doc_id, source FROM documents WHERE source <> 'src3'
QUALIFY row_number() OVER (PARTITION BY lang, lower({strip('text')}) ORDER BY doc_id) = 1"""
ORACLES["union_corpora"] = """SELECT origin, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
SELECT 'd' AS origin, text, NULL::VARCHAR AS role FROM documents UNION ALL SELECT 'b', text, NULL FROM benchmark
UNION ALL SELECT 'c', text, role FROM conversations) GROUP BY origin, role"""
ORACLES["normalized_names"] = """WITH b AS (SELECT p_partkey, ' O''Neil ' || p_name || ' ' || p_brand || '  & co. ' AS x FROM part)
SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9\\s]', '', 'g')), '\\s+', ' ', 'g') AS name_key,
trim(regexp_replace(x, '\\s+', ' ', 'g')) AS team,
substr(trim(regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 100) AS slug,
trim(regexp_replace(x, '\\s+', ' ', 'g')) AS plain FROM b"""
ORACLES["distinct_values"] = "SELECT DISTINCT p_brand FROM part WHERE p_brand <> ''"
ORACLES["class_distribution"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"


def split_sql(ratio: float, seed: int) -> str:
    return f"""s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('{seed}|' || doc_id::VARCHAR)) AS r,
count(*) OVER (PARTITION BY lang) AS n FROM documents),
sp AS (SELECT doc_id, lang, CASE WHEN r <= CASE WHEN n > 1 THEN least(greatest(round_even(n * {ratio}, 0)::BIGINT, 1), n - 1) ELSE 1 END
THEN 'train' ELSE 'test' END AS split FROM s)"""


ORACLES["stratified_split"] = f"WITH {split_sql(0.8, 42)} SELECT doc_id, lang, split FROM sp"
ORACLES["split_manifest"] = f"""WITH {split_sql(0.7, 7)} SELECT lang, count(*) FILTER (split='train') AS n_train,
count(*) FILTER (split='test') AS n_test FROM sp GROUP BY lang"""
ORACLES["split_manifest_report"] = f"""WITH {split_sql(0.7, 7)}, k AS (SELECT lang, count(*) FILTER (split='train') AS a, count(*) FILTER (split='test') AS b FROM sp GROUP BY lang)
SELECT sum(a + b)::BIGINT AS total_rows, sum(a)::BIGINT AS train_rows, sum(b)::BIGINT AS test_rows, 7 AS random_seed_used,
string_agg(lang || ':' || a, ',' ORDER BY lang) FILTER (a > 0) AS class_distribution_train, string_agg(lang || ':' || b, ',' ORDER BY lang) FILTER (b > 0) AS class_distribution_test FROM k"""
_v = REBALANCE_VARIANTS
ORACLES["rebalance"] = f"""WITH r AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang
ORDER BY md5('42|' || doc_id::VARCHAR) || doc_id::VARCHAR) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
p AS (SELECT *, unnest(CASE WHEN r < 150 THEN range(r, 150, n) ELSE [] END) AS place FROM r),
o AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1) * 150 AS off FROM (SELECT DISTINCT lang FROM documents))
SELECT off + place + 1 AS id, doc_id, p.lang, CASE WHEN place >= n THEN 'synthetic_balance' ELSE 'original' END AS source,
md5(CASE WHEN place >= n THEN {sql_list([b for b, _ in _v])}[(place % 4 + 1)::INT] || {strip('text')} || {sql_list([a for _, a in _v])}[(place % 4 + 1)::INT]
ELSE text END) AS h FROM p JOIN o ON p.lang = o.lang"""
_lab = {n: score("low", D[f"label_{n}"], v) for n, v in
        [("supportive", 3.0), ("constructive", 3.0), ("complaint", 2.0), ("attack", 2.0), ("debate", 2.0)]}
_bands = {f"{b}_{e}": case("expected_stance", {k: v[i][j] for k, v in LABEL_BANDS.items()}, "NULL")
          for i, b in enumerate(("score", "toxicity", "supportive_strength")) for j, e in enumerate(("lo", "hi"))}
ORACLES["heuristic_label"] = f"""WITH {TURNS}, b AS (SELECT doc_id, lower(text) AS low FROM turns),
s AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _lab.items())} FROM b),
l AS (SELECT doc_id, CASE WHEN attack >= 0.5 THEN 'DIRECT_ATTACK' WHEN supportive >= 0.45 AND complaint >= 0.25 THEN 'MIXED_STANCE'
WHEN supportive >= 0.45 THEN 'SUPPORTIVE_DEFENSE' WHEN complaint >= 0.5 THEN 'DISMISSIVE_COMPLAINT'
WHEN constructive >= 0.45 THEN 'CONSTRUCTIVE_CRITICISM' WHEN debate >= 0.45 THEN 'BALANCED_DEBATE' ELSE 'NEUTRAL_ANALYSIS' END AS expected_stance FROM s)
SELECT doc_id, expected_stance, {case('expected_stance', {'DIRECT_ATTACK': .85, 'MIXED_STANCE': .65, 'SUPPORTIVE_DEFENSE': .75, 'NEUTRAL_ANALYSIS': .6}, '0.7')}::DOUBLE AS label_confidence,
{', '.join(f'({e})::DOUBLE AS {n}' for n, e in _bands.items())} FROM l"""
ORACLES["heuristic_targets"] = f"""WITH {TURNS}, b AS (SELECT doc_id, turn, lower(text) AS low, {ASCII.format(x='lower(text)')} AS asc_low FROM turns),
t AS (SELECT doc_id, turn, ({anyof('low', D['target_reasoning'])}::INT + {anyof('low', D['target_suggestion'])}::INT + {anyof('low', D['target_comparison'])}::INT
+ regexp_matches(asc_low, '\\bif\\b|\\bthen\\b|\\bso\\b|\\bthus\\b')::INT >= 2)::INT AS constructive_target,
({anyof('low', D['target_abuse'])} OR regexp_matches(asc_low, '\\byou are\\b|\\bhe is\\b|\\bthey are\\b'))::INT AS toxic_target FROM b)
SELECT doc_id, constructive_target, toxic_target, greatest(0.0, least(100.0, ([78.0, 66.0, 58.0][(turn % 3 + 1)::INT] + 10.0*constructive_target - 22.0*toxic_target)))::DOUBLE AS expected_score FROM t"""
ORACLES["estimate_bands"] = f"""WITH {SUBS} SELECT id, round(greatest(0.0, value - 6), 2) AS score_lo, round(least(100.0, value + 6), 2) AS score_hi,
round(greatest(0.0, value/500 - 0.08), 4) AS toxicity_lo, round(least(1.0, value/500 + 0.08), 4) AS toxicity_hi,
round(greatest(0.0, value/400 - 0.15), 4) AS supportive_strength_lo, round(least(1.0, value/400 + 0.15), 4) AS supportive_strength_hi FROM subs"""

# --- paragraph signals -------------------------------------------------------------------------

ORACLES["abuse_report"] = f"""WITH f AS (SELECT {anyof('lower(text)', ABUSE)} AS p, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)),
n AS (SELECT count(*) AS n, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn,
count(*) FILTER (NOT p AND NOT t) AS tn FROM f)
SELECT *, round((tp+tn)*100.0::DOUBLE/n, 2) AS accuracy_percent, CASE WHEN fp+tn > 0 THEN round(fp*100.0::DOUBLE/(fp+tn), 2) ELSE 0.0 END AS fp_percent,
CASE WHEN fn+tp > 0 THEN round(fn*100.0::DOUBLE/(fn+tp), 2) ELSE 0.0 END AS fn_percent FROM n"""
_attacks = " + ".join(f"regexp_matches(al, '\\b{p}\\b')::INT" for p in ("you are", "he is", "they are", "that player is"))


ATTACKS = " + ".join(f"regexp_matches({ASCII.format(x='low')}, '\\b{p}\\b')::INT" for p in ("you are", "he is", "they are", "that player is"))


def abuse(words: Sequence[str]) -> str:
    return unit(f"0.7 * ({hits('low', words)} / {float(len(words))}) + 0.3 * least(1.0, ({ATTACKS}) / 2.0)")


ORACLES["toxicity"] = f"""WITH {LOWP}, a AS (SELECT doc_id, para_ix, {abuse(ABUSE)}::DOUBLE AS v FROM lp)
SELECT doc_id, para_ix, 0.0::DOUBLE AS model_toxicity, round(v, 6) AS abuse_signal, round(least(1.0, 0.75*v)::DOUBLE, 6) AS effective_toxicity, 0.0::DOUBLE AS negativity FROM a"""
_marks = sql_list([*LEXICON["abuse_words"], "You are", "he is", "They are", "that player is"])
_n_marks = len(LEXICON["abuse_words"]) + 4
ORACLES["toxicity_default"] = f"""WITH {LOWP}, mk AS (SELECT doc_id, para_ix, low || ' ' || lower({_marks}[((doc_id + para_ix) % {_n_marks} + 1)::INT])
|| ' ' || lower({_marks}[((doc_id * 7 + para_ix * 3) % {_n_marks} + 1)::INT]) AS low FROM lp), a AS (SELECT doc_id, para_ix, {abuse(LEXICON['abuse_words'])}::DOUBLE AS v FROM mk)
SELECT doc_id, para_ix, 0.0::DOUBLE AS model_toxicity, round(v, 6) AS abuse_signal, round(least(1.0, 0.75*v)::DOUBLE, 6) AS effective_toxicity, 0.0::DOUBLE AS negativity FROM a"""
_arc = f"({anyof('low', D['discourse_events'])} AND {anyof('low', D['discourse_interpretation'])} AND {anyof('low', D['discourse_impact'])})::INT"
DISC = (f"CASE WHEN len(ss) > 0 THEN {unit(f'0.3*{score("low", D["discourse_contrast"], 2.0)} + 0.2*{score("low", D["discourse_frames"], 2.0)} + 0.35*{_arc} + 0.15*{unit("(len(ss)-3)/4.0")}')} ELSE 0.0 END")
DEB = score("low", D["debate_balance"], 2.0)
ORACLES["discourse"] = f"WITH {LOWP} SELECT doc_id, para_ix, round({DISC}, 6)::DOUBLE AS discourse_score, round({DEB}, 6) AS debate_style_score FROM lp"
_expl = f"({anyof('low', D['reasoning'])} OR {anyof('low', D['explanation_connectors'])} OR regexp_matches({ASCII.format(x='low')}, '\\bif\\b.*\\bthen\\b'))"
_chain = f"({anyof('low', D['problem'])} AND {_expl} AND {anyof('low', D['implication'])})"
_short = f"({anyof('low', D['simple_problem'])} AND {anyof('low', D['simple_consequence'])})"
CONSTR = {
    "reasoning_marker_score": score("low", D["reasoning"], 4.0),
    "suggestion_score": score("low", D["constructive_suggestion"], 3.0),
    "explanation_depth_score": f"CASE WHEN len(ss) > 0 THEN greatest({unit(f'0.7*{_chain}::INT + 0.3*{unit("(len(ss)-2)/3.0")}')}, CASE WHEN {_chain} OR {_short} THEN 0.6 ELSE 0.0 END) ELSE 0.0 END",
    "strategic_score": score("low", D["strategic"], 3.0), "discourse_score": DISC, "debate_style_score": DEB,
}
CONSTR_CTE = f"""cp AS (SELECT doc_id, para_ix, text, low, ss, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in CONSTR.items())},
({anyof('low', D['respectful'])} AND NOT {anyof('low', D['constructiveness_abuse'])}) AS civil FROM lp),
cs AS (SELECT *, {unit('0.15 + 0.16*reasoning_marker_score + 0.16*suggestion_score + 0.14*explanation_depth_score + 0.14*discourse_score + 0.1*strategic_score + CASE WHEN debate_style_score >= 0.4 THEN 0.05*debate_style_score ELSE 0 END + CASE WHEN reasoning_marker_score >= 0.2 AND civil THEN 0.12 ELSE 0 END')} AS cscore FROM cp)"""
ORACLES["constructiveness"] = f"""WITH {LOWP}, {CONSTR_CTE} SELECT doc_id, para_ix, round(cscore, 6)::DOUBLE AS constructiveness_score,
0.0::DOUBLE AS constructive_similarity, 0.0::DOUBLE AS non_constructive_similarity, {', '.join(f'round({n}, 6) AS {n}' for n in CONSTR)},
round(least(1.0, 0.25*reasoning_marker_score + 0.2*explanation_depth_score + 0.2*discourse_score + 0.15*debate_style_score + 0.2*strategic_score), 6)::DOUBLE AS constructiveness_confidence FROM cs"""


def kwr(words: Sequence[str]) -> str:
    return f"(CASE WHEN len(t)=0 THEN 0.0 ELSE len(list_filter(t, lambda x: list_contains({sql_list(words)}, x))) / len(t)::DOUBLE END)"


ORACLES["paragraph_components"] = f"""WITH {LOWP}, {CONSTR_CTE},
p1 AS (SELECT *, {toks('text')} AS t, ({abuse(D['abuse_words'])})::DOUBLE AS ab FROM cs),
p2 AS (SELECT *, least(1.0, 0.75*ab) AS tox, {clear('len(t)', 'len(ss)', 'low')} AS clar,
{unit(f'0.48*{unit(f"14.0*{kwr(D['analytical_reasoning_terms'] + D['analytical_terms'])}")} + 0.24*{unit(f"2.2*({hits('low', D['analytical_phrases'])}/{float(len(D['analytical_phrases']))})")} + 0.28*strategic_score')} AS ana,
{unit(f"1.2*({hits('low', D['debate_terms'])}/{float(len(D['debate_terms']))})")} AS dbal,
{unit('0.5*cscore + 0.25*reasoning_marker_score + 0.15*explanation_depth_score + 0.1*discourse_score')} AS blend FROM p1),
p3 AS (SELECT *, {unit(f"0.78*(1-tox) + 0.12*{unit(f'20.0*{kwr(D['civility_terms'])}')} + 0.1*(1-ab)")} AS resp,
CASE WHEN explanation_depth_score >= 0.4 THEN greatest(blend, 0.55) ELSE blend END AS c0 FROM p2),
p4 AS (SELECT *, {unit(f"0.52*{unit(f'10.0*{kwr(D['fan_terms'])}')} + 0.15*c0")} AS fan FROM p3),
p5 AS (SELECT *, greatest(c0, CASE WHEN reasoning_marker_score >= 0.14 AND explanation_depth_score >= 0.2 AND resp >= 0.65 AND tox <= 0.12 THEN 0.65 ELSE 0 END,
CASE WHEN suggestion_score >= 0.5 AND resp >= 0.72 AND tox <= 0.12 THEN 0.58 ELSE 0 END,
CASE WHEN discourse_score >= 0.45 AND len(ss) >= 4 AND explanation_depth_score >= 0.3 AND tox <= 0.12 AND fan >= 0.3 THEN 0.6 ELSE 0 END) AS c1 FROM p4),
p6 AS (SELECT *, CASE WHEN debate_style_score >= 0.4 AND resp >= 0.68 AND tox <= 0.15 THEN {unit('c1 + 0.05*debate_style_score')} ELSE c1 END AS con FROM p5)
SELECT doc_id, round(avg(40.0*{unit('0.44*con + 0.24*(0.55*resp + 0.45*clar) + 0.2*ana')}), 3)::DOUBLE AS constructiveness,
round(avg(20.0*resp), 3)::DOUBLE AS respectfulness, round(avg(15.0*{unit('0.85*ana + 0.15*dbal')}), 3)::DOUBLE AS analytical_tone, round(avg(10.0*clar), 3)::DOUBLE AS clarity,
round(avg(15.0*fan), 3)::DOUBLE AS fan_sincerity, round(avg(tox), 3)::DOUBLE AS toxicity_mean, round(max(tox), 3)::DOUBLE AS toxicity_max, round(avg(ab), 3)::DOUBLE AS abuse_mean FROM p6 GROUP BY doc_id"""


def wcol(kind: str, w: str) -> str:
    return f"{kind}_" + w.lower().replace(" ", "_").replace("-", "_")


_rule = {w: f"least(1.0, (len(list_filter(t, lambda x: list_contains({sql_list(D[f'writer:{w}'])}, x)))) / greatest(2.0, 0.12*greatest(1, len(t)))::DOUBLE)"
         for w in WRITER_TYPES}
_sum = " + ".join(wcol("rule", w) for w in WRITER_TYPES)
WRITER_CTE = f"""wr AS (SELECT doc_id, {strip('text')} = '' AS blank, {', '.join(f'({e})::DOUBLE AS {wcol("rule", w)}' for w, e in _rule.items())}
FROM (SELECT doc_id, text, {toks('text')} AS t FROM documents)),
wp AS (SELECT *, {', '.join(f"CASE WHEN blank THEN {1.0 if w == WRITER_TYPES[-1] else 0.0} WHEN ({_sum}) > 0 THEN {wcol('rule', w)}/({_sum}) ELSE 0.2 END AS {wcol('prob', w)}" for w in WRITER_TYPES)} FROM wr),
wt AS (SELECT *, CASE greatest({', '.join(wcol('prob', w) for w in WRITER_TYPES)}) {' '.join(f'WHEN {wcol("prob", w)} THEN {q(w)}' for w in WRITER_TYPES)} END AS writer_type FROM wp)"""
ORACLES["writer_type"] = f"""WITH {WRITER_CTE} SELECT doc_id, writer_type, {', '.join(f'round(round(CASE WHEN blank THEN 0.0 ELSE {wcol("rule", w)} END, 4), 3) AS {wcol("rule", w)}' for w in WRITER_TYPES)},
{', '.join(f'round(round({wcol("prob", w)}, 4), 3)::DOUBLE AS {wcol("prob", w)}' for w in WRITER_TYPES)} FROM wt"""
ORACLES["writer_distribution"] = f"WITH {WRITER_CTE} SELECT writer_type, count(*) AS n FROM wt GROUP BY writer_type"

_P1 = "(masterclass|brilliant|amazing|fantastic|legendary|outstanding|elite).{0,50}(not performing|ignored|mistake|slow|dropped)"
_P2 = "(visionary|brilliant|amazing|masterclass).{0,80}(but|until|except|while).{0,80}(ignored|mistake|not performing|slow)"
_P3 = "(visionary|genius|masterclass).{0,30}really"
SARC = f"""s1 AS (SELECT *, {anyof('low', D['sarcasm_metaphors'])} AS meta, {anyof('low', D['sarcasm_comparisons'])} AS absurd, {anyof('low', D['sarcasm_praise'])} AS praise,
{anyof('low', D['sarcasm_mismatch'])} AS mism, {anyof('low', D['sarcasm_delayed'])} AS delayed, contains(low, 'apparently') AS appa,
regexp_matches(low, '{_P1}') AS fails, regexp_matches(low, '{_P2}') AS contra,
regexp_matches(low, '{_P3}') AS tail, {anyof('low', D['sarcasm_grief'])} AS grief FROM lp),
s2 AS (SELECT *, least(1.0, (meta::INT + absurd::INT + grief::INT)/2.0)::DOUBLE AS exaggeration_score,
least(1.0, (fails::INT + contra::INT + tail::INT + (praise AND contains(low,'?'))::INT + (praise AND appa)::INT + (praise AND mism)::INT)/2.0)::DOUBLE AS contradiction_score,
(praise AND (mism OR meta OR absurd OR appa))::INT::DOUBLE AS context_mismatch_score,
least(1.0, ((praise AND meta)::INT + (praise AND absurd)::INT + fails::INT)/2.0)::DOUBLE AS mocking_praise_score, delayed::INT::DOUBLE AS delayed_negative_score FROM s1),
s3 AS (SELECT *, {unit('0.2*exaggeration_score + 0.3*contradiction_score + 0.2*context_mismatch_score + 0.2*mocking_praise_score + 0.1*delayed_negative_score')} AS sarcasm_score FROM s2)"""
ORACLES["sarcasm"] = f"""WITH {LOWP}, {SARC} SELECT doc_id, para_ix, exaggeration_score, contradiction_score, context_mismatch_score,
mocking_praise_score, delayed_negative_score, round(sarcasm_score, 6) AS sarcasm_score FROM s3"""


def defence(src: str) -> str:
    contrast = score("low", D["contrast_structure"], 2.0)
    return f"""d1 AS (SELECT *, {score('low', D['fairness_defense'], 3.0)} AS fairness_defense_score, {score('low', D['reputation_defense'], 2.0)} AS reputation_defense_score,
greatest({score('low', D['criticism_reference'], 3.0)}, CASE WHEN {anyof('low', D['criticism_strong'])} THEN 0.4 ELSE 0.0 END)::DOUBLE AS criticism_reference_score,
{score('low', D['context_change'], 3.0)} AS context_change_score, {score('low', D['evaluation_redirection'], 2.5)} AS evaluation_redirection_score,
{score('low', D['credibility_restoration'], 2.0)} AS credibility_restoration_score,
(CASE WHEN {anyof('low', D['disagreement_context'])} AND {contrast} > 0 THEN greatest(0.6, {contrast}) ELSE 0.0 END)::DOUBLE AS contrast_structure_score FROM {src}),
d2 AS (SELECT *, {unit('0.4*criticism_reference_score + 0.3*context_change_score + 0.3*evaluation_redirection_score')} AS causal_defense_score,
{unit('0.6*credibility_restoration_score + 0.4*contrast_structure_score')} AS credibility_defense_score FROM d1),
d3 AS (SELECT *, {unit('0.3*fairness_defense_score + 0.2*reputation_defense_score + 0.3*causal_defense_score + 0.2*credibility_defense_score')} AS rule_strength FROM d2)"""


_DEF = ["fairness_defense_score", "reputation_defense_score", "criticism_reference_score", "context_change_score",
        "evaluation_redirection_score", "credibility_restoration_score", "contrast_structure_score",
        "causal_defense_score", "credibility_defense_score", "rule_strength"]
ORACLES["defence_scores"] = f"WITH {LOWP}, {defence('lp')} SELECT doc_id, para_ix, {', '.join(f'round({n}, 6) AS {n}' for n in _DEF)} FROM d3"


def quotes(src: str) -> str:
    rej = " OR ".join(f"regexp_matches(low, {q(p)})" for p in (
        "people say .+ but", "some say .+ but", "others think .+ but", "many argue .+ however", "critics say .+ but"))
    return f"""q1 AS (SELECT *, ({anyof('low', D['quote_context'])} AND {anyof('low', D['attack'])}) AS quoted_attack_detected,
({rej}) AS contrast_rejection_detected FROM {src}),
q2 AS (SELECT *, quoted_attack_detected AND ({anyof('low', D['rejection'])} OR regexp_matches(low, 'people say.*(but|however|instead|rather|actually).*(wrong|unfair|incorrect)')) AS attack_rejection_detected,
quoted_attack_detected AND ({anyof('low', D['endorsement'])} OR regexp_matches(low, 'people say .* and (they are|that''s) right')) AS attack_endorsement_detected FROM q1)"""


ORACLES["quote_flags"] = f"""WITH {LOWP}, {quotes('lp')} SELECT doc_id, para_ix, quoted_attack_detected, attack_endorsement_detected,
attack_rejection_detected, contrast_rejection_detected FROM q2"""

# --- stance ----------------------------------------------------------------------------------

_low = {"sup0": score("low", D["supportive"], 2.5), "con": score("low", D["constructive"], 2.5),
        "cmp": f"greatest({score('low', D['complaint'], 2.0)}, CASE WHEN {anyof('low', D['frustration'])} THEN 0.65 ELSE 0 END)",
        "att0": f"greatest({score('low', D['attack'], 2.0)}, CASE WHEN {anyof('low', D['selection_attack'])} THEN 0.65 ELSE 0 END)",
        "deb": score("low", D["debate_balance"], 2.0), "dis": score("low", D["contrast"] + D["discourse_extra"], 4.0),
        "dirw": score("low", D["directness"], 2.0), "neuw": score("low", D["neutrality"], 2.0),
        "depth": unit(f"0.7*{score('low', D['stance_reasoning'], 4.0)} + 0.3*least(1.0, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda z: {strip('z')} <> '')))/4.0)")}
_mixed = " AND ".join(f"contains(low, {q(m)})" for m in D["mixed_intent"])
_verbs = f"regexp_matches({ASCII.format(x='low')}, '\\b(is|are|has|have|keeps|clearly|should|must|handled|adapted|played|repeated|working)\\b')"
PR = ["supportive_defense", "direct_criticism", "sarcastic_attack", "neutral_commentary", "mixed_or_ambiguous"]


TONE = {**{m: m for m in ("sarcasm_score", "contradiction_score", "exaggeration_score", "context_mismatch_score")},
        "ridicule_score": unit("0.4*sarcasm_score + 0.3*exaggeration_score + 0.3*mocking_praise_score"), "directness_score": "directness",
        "certainty_score": score("low", D["certainty"], 2.0), "hostility_score": unit("0.65*att + 0.35*cmp"), "neutrality_score": "n_"}


def stance_ctes(src: str, keys: str, bench: bool = False) -> str:
    b = [f"0.65*bench[{i + 1}]" if bench else "0.08125" for i in range(8)]
    labels = [s.lower() for s in STANCES]
    mixsum = "(" + "+".join(f"m{i}" for i in range(8)) + ")"
    psum = "(" + "+".join(f"r{i}" for i in range(5)) + ")"
    best = "greatest(" + ",".join(f"b{i}" for i in range(8)) + ")"
    top = f"CASE WHEN {best} < 0.28 THEN 7 " + " ".join(f"WHEN b{i} = {best} THEN {i}" for i in range(8)) + " END"
    pbest = "greatest(" + ",".join(f"pp_{p}" for p in PR) + ")"
    ptop = "CASE " + " ".join(f"WHEN pp_{p} = {pbest} THEN {i}" for i, p in enumerate(PR)) + " END"
    return f"""lp AS (SELECT *, lower(text) AS low FROM {src}), {SARC}, {defence('s3')}, {quotes('d3')},
t1 AS (SELECT *, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _low.items())}, ({_mixed}) AS mixed_intent, len({toks('text')}) AS n_words, {strip('low')} = '' AS blank,
0.5*rule_strength AS strength, attack_rejection_detected OR (contrast_rejection_detected AND fairness_defense_score >= 0.4) AS rej, attack_endorsement_detected AS endo FROM q2),
t2 AS (SELECT *, least(1.0, CASE WHEN rej THEN least(1.0, sup0 + 0.25) ELSE sup0 END + 0.25*strength) AS sup,
CASE WHEN endo THEN least(1.0, CASE WHEN rej THEN att0*0.25 ELSE att0 END + 0.4) ELSE CASE WHEN rej THEN att0*0.25 ELSE att0 END END AS att FROM t1),
t3 AS (SELECT *, 0.55*sup + 0.15*dis AS w_sup, 0.55*con + 0.15*dis AS w_con, 0.45*greatest(0.0, 1 - (sup+con+cmp+att)/3.0) + 0.15*(1-deb) AS w_neu, 0.55*deb + 0.15*dis AS w_deb,
0.6*cmp + 0.1*(1-dis) AS w_cmp, 0.6*att + 0.1*cmp AS w_att, 0.45*sarcasm_score + 0.25*att + 0.15*cmp + 0.15*(1-sup) AS w_sar, 0.35*(sup+con+deb)/3.0 + 0.3*dis AS w_mix,
CASE WHEN sarcasm_score >= 0.4 THEN greatest(0.0, credibility_defense_score - 0.1) ELSE credibility_defense_score END AS cred FROM t2),
t4 AS (SELECT *, greatest(sup, rule_strength, fairness_defense_score, reputation_defense_score, causal_defense_score, cred) >= 0.72 AS explicit_sup FROM t3),
t5 AS (SELECT *, sarcasm_score >= 0.35 AND NOT explicit_sup AS gate FROM t4),
t6 AS (SELECT *, CASE WHEN sarcasm_score >= 0.4 THEN greatest(0.0, w_sup - 0.2) ELSE w_sup END AS x_sup, CASE WHEN sarcasm_score >= 0.4 THEN least(1.0, w_att + 0.15) ELSE w_att END AS x_att,
CASE WHEN causal_defense_score >= 0.35 AND context_change_score >= 0.3 AND evaluation_redirection_score >= 0.3 THEN TRUE ELSE FALSE END AS forced FROM t5),
t7 AS (SELECT *, CASE WHEN gate THEN greatest(0.0, x_sup - 0.25) ELSE x_sup END AS y_sup, CASE WHEN gate THEN greatest(x_att, 0.25 + 0.5*sarcasm_score) ELSE x_att END AS z_att,
CASE WHEN gate THEN greatest(w_sar, 0.55 + 0.35*sarcasm_score) ELSE w_sar END AS z_sar,
0.25*(fairness_defense_score >= 0.4 OR reputation_defense_score >= 0.4)::INT + 0.25*(causal_defense_score >= 0.35)::INT + 0.2*(cred >= 0.35)::INT
+ 0.15*(evaluation_redirection_score >= 0.35 AND cred >= 0.35)::INT + 0.2*forced::INT AS boost FROM t6),
t8 AS (SELECT *, CASE WHEN boost > 0 THEN least(1.0, y_sup + boost) ELSE y_sup END AS z_sup FROM t7),
t9 AS (SELECT *, 0.35*z_sup + {b[0]} AS b0, 0.35*w_con + {b[1]} AS b1, 0.35*w_neu + {b[2]} AS b2, 0.35*w_deb + {b[3]} AS b3, 0.35*w_cmp + {b[4]} AS b4, 0.35*z_att + {b[5]} AS b5,
0.35*z_sar + {b[6]} AS b6, 0.35*w_mix + {b[7]} AS b7, CASE WHEN gate THEN 1 WHEN endo THEN 2 WHEN att >= 0.85 THEN 3 WHEN rej AND causal_defense_score >= 0.3 THEN 4 ELSE 0 END AS rung FROM t8),
u1 AS (SELECT *, CASE rung WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 0 ELSE {top} END AS label0, CASE WHEN rung=4 THEN greatest(b0, 0.8) ELSE b0 END AS m0, b1 AS m1, b2 AS m2, b3 AS m3, b4 AS m4,
CASE rung WHEN 2 THEN greatest(b5, 0.9) WHEN 3 THEN greatest(b5, 0.85) ELSE b5 END AS m5, CASE WHEN rung=1 THEN greatest(b6, 0.78) ELSE b6 END AS m6, b7 AS m7 FROM t9),
u2 AS (SELECT *, {', '.join(f'round(m{i}/{mixsum}, 4) AS p_{s}' for i, s in enumerate(labels))},
NOT gate AND strength >= 0.3 AND att < 0.4 AND cmp < 0.4 AS prec,
{unit('0.5*z_sup + 0.2*strength')} AS s_, greatest(z_att, w_cmp, 0.85*w_con, 0.7*att + 0.3*cmp) AS k_, greatest(z_sar, sarcasm_score) AS x_,
{unit('0.7*att + 0.3*dirw')} AS directness, {unit('0.3*(1 - greatest(sup, att, cmp, sarcasm_score)) + 0.7*neuw')} AS n_ FROM u1),
u3 AS (SELECT *, CASE WHEN prec THEN 0 ELSE label0 END AS ix, CASE WHEN sarcasm_score >= 0.35 AND contradiction_score >= 0.35 AND context_mismatch_score >= 0.35 THEN greatest(0.0, s_ - 0.35) ELSE s_ END AS r0,
k_ AS r1, CASE WHEN gate THEN greatest(x_, 0.78) ELSE x_ END AS r2, n_ AS r3, greatest(0.0, 0.8 - abs(s_ - k_)) AS r4 FROM u2),
u4 AS (SELECT *, {', '.join(f'round(CASE WHEN {psum} > 0 THEN r{i}/{psum} ELSE 0.2 END, 4) AS pp_{p}' for i, p in enumerate(PR))} FROM u3),
u5 AS (SELECT *, CASE WHEN NOT gate AND s_ >= 0.3 AND k_ >= 0.2 AND mixed_intent THEN 11
WHEN NOT gate AND sarcasm_score < 0.35 AND s_ < 0.45 AND ix IN (5,4,1) THEN 10 WHEN gate THEN 1
WHEN s_ >= 0.28 AND k_ >= 0.28 AND abs(s_-k_) <= 0.15 THEN 2 WHEN k_ >= 0.34 AND k_ >= s_ - 0.02 AND x_ < 0.35 THEN 3
WHEN s_ >= 0.33 AND s_ >= k_ + 0.08 AND x_ < 0.35 THEN 4 WHEN s_ >= 0.42 AND k_ < 0.35 AND x_ < 0.35 THEN 5 WHEN k_ >= 0.4 AND x_ < 0.35 THEN 6
WHEN s_ >= 0.45 AND k_ >= 0.45 AND abs(s_-k_) <= 0.15 THEN 7 WHEN s_ >= 0.35 AND k_ >= 0.35 AND abs(s_-k_) <= 0.2 THEN 8
WHEN n_ >= 0.45 AND s_ < 0.35 AND k_ < 0.35 AND x_ < 0.35 THEN 9 ELSE 0 END AS why FROM u4),
st AS (SELECT {keys}, greatest(1, n_words) * greatest(0.05, depth) AS w, CASE WHEN blank THEN 2 ELSE ix END AS ix, CASE WHEN blank THEN 3 ELSE [{ptop}, 2, 4, 1, 0, 0, 1, 4, 4, 3, 1, 4][why + 1] END AS pix, why,
CASE WHEN blank THEN 3 WHEN gate THEN 2 WHEN sarcasm_score >= 0.35 THEN 1 ELSE 0 END AS gate_ix,
{', '.join(f"CASE WHEN blank THEN {1.0 if m == 'neutrality_score' else 0.0} ELSE round({e}, 4) END AS m_{m}" for m, e in TONE.items())},
{', '.join(f"CASE WHEN blank THEN {1.0 if s == 'neutral_analysis' else 0.0} ELSE p_{s} END AS p_{s}" for s in labels)},
{', '.join(f"CASE WHEN blank THEN {1.0 if p == 'neutral_commentary' else 0.0} ELSE pp_{p} END AS pp_{p}" for p in PR)},
CASE WHEN blank THEN [] ELSE list_filter([CASE WHEN directness >= 0.45 OR (NOT contains(low,'?') AND {_verbs}) THEN 'DIRECT' END,
CASE WHEN sarcasm_score >= 0.35 OR contradiction_score >= 0.5 THEN 'SARCASTIC' END, CASE WHEN exaggeration_score >= 0.5 THEN 'HYPERBOLIC' END,
CASE WHEN contains(low,'?') OR {anyof('low', D['tag_rhetorical'])} THEN 'RHETORICAL' END,
CASE WHEN contains(low,'"') OR contains(low,'''') OR {anyof('low', D['tag_quoted'])} THEN 'QUOTED' END, CASE WHEN {anyof('low', D['tag_reported'])} THEN 'REPORTED' END,
CASE WHEN sarcasm_score >= 0.35 AND directness < 0.45 THEN 'IMPLIED' END, CASE WHEN {anyof('low', D['tag_conversational'])} THEN 'CONVERSATIONAL' END], lambda z: z IS NOT NULL) END AS tags FROM u5)"""


_sl, _pl = sql_list(STANCES), sql_list([p.upper() for p in PR])
GATES = sql_list(["score_below_threshold", "blocked_by_stronger_explicit_supportive_context",
                  "sarcasm_threshold_met_and_no_stronger_supportive_context", "empty_text"])
WHYS = sql_list([
    "max_primary_probability", "sarcasm_gate_forced_sarcastic_attack", "close_support_and_criticism_balance",
    "criticism_signal_near_or_above_support", "supportive_signal_above_criticism_margin",
    "dominant_supportive_signal", "dominant_direct_criticism_signal", "balanced_support_and_criticism",
    "close_polarity_signals", "low_polarity_commentary", "legacy_critical_route_alignment",
    "contrastive_mixed_intent_pattern"])
ORACLES["paragraph_stance"] = f"""WITH {PARAS}, {stance_ctes('paras', 'doc_id, para_ix')}
SELECT doc_id, para_ix, {_sl}[ix + 1] AS stance_label, {_pl}[pix + 1] AS primary_stance_label, {WHYS}[why + 1] AS primary_reason,
{GATES}[gate_ix + 1] AS sarcasm_gate_reason, array_to_string(tags, ',') AS tags FROM st"""
ORACLES["tone_metrics"] = f"""WITH {PARAS}, {stance_ctes('paras', 'doc_id, para_ix')}
SELECT doc_id, para_ix, {', '.join(f'round(m_{m}, 3)::DOUBLE AS {m}' for m in TONE)} FROM st"""
_labels = [s.lower() for s in STANCES]
_rs = "(" + "+".join(f"a_{s}" for s in _labels) + ")"
_rp = "(" + "+".join(f"a_{p}" for p in ["p" + x for x in PR]) + ")"
_fb = "greatest(" + ",".join(f"f_{s}" for s in _labels) + ")"
_fp = "greatest(" + ",".join(f"g_{p}" for p in PR) + ")"
ORACLES["conversation_stance"] = f"""WITH {stance_ctes('conversations', 'conv_id, turn')},
tg AS (SELECT conv_id, list(tag ORDER BY k DESC, tag) AS tags FROM (SELECT conv_id, tag, count(*) AS k FROM (SELECT conv_id, unnest(tags) AS tag FROM st) GROUP BY conv_id, tag) GROUP BY conv_id),
ag AS (SELECT conv_id, count(*) AS n_paragraphs, max(ix) AS ix, max(pix) AS pix, any_value(tags) AS tags1, {', '.join(f'round(sum(w*p_{s})/sum(w), 4) AS a_{s}' for s in _labels)},
{', '.join(f'round(sum(w*pp_{p})/sum(w), 4) AS a_p{p}' for p in PR)} FROM st GROUP BY conv_id),
fn AS (SELECT *, {', '.join(f'CASE WHEN n_paragraphs=1 THEN a_{s} ELSE round(a_{s}/{_rs}, 4) END AS f_{s}' for s in _labels)},
{', '.join(f'CASE WHEN n_paragraphs=1 THEN a_p{p} ELSE round(a_p{p}/{_rp}, 4) END AS g_{p}' for p in PR)} FROM ag)
SELECT fn.conv_id, n_paragraphs, {_sl}[CASE WHEN n_paragraphs=1 THEN ix {' '.join(f'WHEN f_{s} = {_fb} THEN {i}' for i, s in enumerate(_labels))} END + 1] AS stance_label,
{_pl}[CASE WHEN n_paragraphs=1 THEN pix {' '.join(f'WHEN g_{p} = {_fp} THEN {i}' for i, p in enumerate(PR))} END + 1] AS primary_stance_label,
CASE WHEN n_paragraphs=1 THEN array_to_string(tags1, ',') ELSE coalesce(array_to_string(tg.tags, ','), '') END AS tags,
{', '.join(f'round(f_{s}, 3) AS prob_{s}' for s in _labels)} FROM fn LEFT JOIN tg USING (conv_id)"""
ORACLES["tag_counts"] = f"""WITH {PARAS}, {stance_ctes('paras', 'doc_id, para_ix')},
k AS (SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM st) GROUP BY doc_id, tag)
SELECT doc_id, string_agg(tag || ':' || n, ',' ORDER BY n DESC, tag) AS tags FROM k GROUP BY doc_id"""

# --- match facts -------------------------------------------------------------------------------

BALLS = f"""balls AS (SELECT l_orderkey::VARCHAR AS match_id, 'Mo S' || {letters('l_suppkey')} AS striker, 'Jo B' || {letters('l_partkey % 50')} AS bowler,
l_quantity::BIGINT AS br, (l_linenumber=5)::BIGINT AS wd, (l_linenumber=6)::BIGINT AS nb, (l_linenumber=7)::BIGINT AS pen, (l_linenumber NOT IN (5,6))::BIGINT AS legal,
CASE WHEN l_returnflag='R' THEN 'bowled' WHEN l_returnflag='A' AND l_linenumber > 3 THEN 'run out' WHEN l_returnflag='A' THEN 'retired hurt' ELSE '' END AS kind,
'T' || {letters('(l_orderkey + l_linenumber % 2) % 5')} AS team, l_linenumber AS ln FROM lineitem)"""
FACTS = f"""{BALLS}, info AS (SELECT o_orderkey::VARCHAR AS match_id, o_orderdate, (year(o_orderdate) + 28)::INT AS year, (year(o_orderdate)+28)::VARCHAR || strftime(o_orderdate, '-%m-%d') AS match_date,
(year(o_orderdate)+28)::VARCHAR AS season, o_orderpriority AS venue, 'T' || {letters('o_orderkey % 5')} AS team_a, 'T' || {letters('(o_orderkey + 1) % 5')} AS team_b FROM orders),
parts AS (SELECT match_id, striker AS player, team, ln, br AS runs, legal AS balls_faced, 0 AS rc, 0 AS bb, 0 AS wk, (kind IN ('bowled','run out'))::INT AS di FROM balls
UNION ALL SELECT match_id, bowler, NULL, NULL, 0, 0, br + wd + nb + pen, legal, (kind = 'bowled')::INT, 0 FROM balls),
pf AS (SELECT match_id, player, arg_max(team, ln) AS team, sum(runs)::DOUBLE AS runs, sum(balls_faced)::DOUBLE AS balls_faced, sum(di)::DOUBLE AS dismissals, sum(rc)::DOUBLE AS runs_conceded,
sum(bb)::DOUBLE AS balls_bowled, sum(wk)::DOUBLE AS wickets FROM parts GROUP BY match_id, player),
facts AS (SELECT pf.match_id, match_date, year, season, venue, player, coalesce(team, '') AS player_team,
CASE WHEN team IS NULL OR team_a IS NULL THEN '' WHEN team = team_a THEN team_b ELSE team_a END AS opposition, runs, balls_faced, dismissals, runs_conceded, balls_bowled, wickets,
pf.match_id || '.csv' AS source_file FROM pf LEFT JOIN info USING (match_id))"""
SUMS = "sum(runs) AS r, sum(balls_faced) AS bf, sum(dismissals) AS di, sum(runs_conceded) AS rc, sum(balls_bowled) AS bb, sum(wickets) AS wk"
STATS = """CASE WHEN di > 0 THEN round(r/di, 6) END AS batting_average, CASE WHEN bf > 0 THEN round(r*100.0/bf, 6) END AS strike_rate,
CASE WHEN bb > 0 THEN round(rc*6.0/bb, 6) END AS economy_rate, round(r, 6) AS runs_total, round(wk, 6) AS wickets_total"""
ORACLES["batting"] = f"WITH {BALLS} SELECT match_id, striker AS player, sum(br)::BIGINT AS runs, sum(legal)::BIGINT AS balls_faced FROM balls GROUP BY 1, 2"
ORACLES["bowling"] = f"""WITH {BALLS} SELECT match_id, bowler AS player, sum(br+wd+nb+pen)::BIGINT AS runs_conceded, sum(legal)::BIGINT AS balls_bowled,
sum((kind <> '' AND kind NOT IN ({','.join(map(q, NON_BOWLER_WICKETS))}))::INT)::BIGINT AS wickets FROM balls GROUP BY 1, 2"""
ORACLES["dismissals"] = f"WITH {BALLS} SELECT match_id, striker AS player, count(*) AS dismissals FROM balls WHERE kind IN ('bowled','run out') GROUP BY 1, 2"
ORACLES["match_info"] = f"WITH {FACTS} SELECT match_id, match_date, year, season, venue, team_a, team_b FROM info"
ORACLES["player_match"] = f"WITH {FACTS} SELECT * FROM facts"
ORACLES["player_stats"] = f"WITH {FACTS}, a AS (SELECT player, {SUMS} FROM facts GROUP BY player) SELECT player, {STATS} FROM a"
ORACLES["last_n_stat"] = f"""WITH {FACTS}, n AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY player ORDER BY match_date DESC NULLS LAST, match_id) <= 5),
a AS (SELECT player, {SUMS} FROM n GROUP BY player) SELECT player, {STATS} FROM a"""
ORACLES["this_season_stat"] = f"""WITH {FACTS}, n AS (SELECT * FROM facts QUALIFY season = max(season) OVER (PARTITION BY player)),
a AS (SELECT player, season, {SUMS} FROM n GROUP BY player, season) SELECT player, season, {STATS} FROM a"""

# --- claims: the texts are built from supplier rows, so the expected claims are known by construction ------

_c1 = "'In the last ' || (s_suppkey % 7 + 1) || ' matches Mo S' || " + letters("s_suppkey") + " || ' has runs of ' || (s_suppkey % 90 + 20)"
_c2 = "'M S' || " + letters("s_suppkey + 1") + " || ' has balls and a strike rate of 2550.5 this season against T' || " + letters("s_suppkey % 5") + " || '.'"
_c3 = "'The batting average is ' || (s_suppkey % 30 + 15) || ' from 2026 to 2021.'"
CLAIMS = f"""claims AS (
SELECT s_suppkey AS doc_id, 1 AS k, 'runs_total' AS stat_type, 'last_n_matches' AS window_type, (s_suppkey % 7 + 1)::INT AS window_size, NULL::VARCHAR AS season, NULL::INT AS year_lo, NULL::INT AS year_hi,
NULL::VARCHAR AS opposition, NULL::VARCHAR AS venue, (s_suppkey % 90 + 20)::DOUBLE AS claimed_value, md5({_c1}) AS h FROM supplier
UNION ALL SELECT s_suppkey, 2, 'strike_rate', NULL, NULL, 'this_season', NULL, NULL, 'T' || {letters('s_suppkey % 5')} || '.', NULL, 2550.5, md5({_c2}) FROM supplier
UNION ALL SELECT s_suppkey, 3, 'batting_average', NULL, NULL, NULL, 2021, 2026, NULL, NULL, (s_suppkey % 30 + 15)::DOUBLE, md5({_c3}) FROM supplier)"""
ORACLES["claims_extract"] = f"""WITH {CLAIMS} SELECT doc_id, stat_type, window_type, window_size::DOUBLE AS window_size, season, year_lo::DOUBLE AS year_lo, year_hi::DOUBLE AS year_hi, opposition, venue, claimed_value, h FROM claims"""
MENTIONS = f"""names AS (SELECT DISTINCT player FROM facts),
mentions AS (SELECT s_suppkey AS doc_id, 'Mo S' || {letters('s_suppkey')} AS player, 1 AS k FROM supplier UNION ALL SELECT s_suppkey, 'Mo S' || {letters('s_suppkey + 1')}, 2 FROM supplier),
men AS (SELECT m.* FROM mentions m JOIN names USING (player))"""
ORACLES["extract_mentions"] = f"WITH {FACTS}, {MENTIONS} SELECT doc_id, player FROM men"
ORACLES["fallback_mentions"] = f"""WITH names AS (SELECT 'Mo S' || {letters('s_suppkey')} AS player FROM supplier)
SELECT doc_id, player FROM (SELECT s_suppkey AS doc_id, 'Mo S' || {letters('s_suppkey')} AS player FROM supplier UNION ALL SELECT s_suppkey, 'Mo S' || {letters('s_suppkey + 1')} FROM supplier) JOIN names USING (player)"""
ORACLES["fuzzy_dimension"] = """WITH a AS (SELECT c_custkey, 'nation_' || (c_nationkey % 30) || CASE WHEN c_custkey % 2 = 0 THEN ' side' ELSE '' END AS v FROM customer),
f AS (SELECT v, coalesce(max(n_name) FILTER (lower(n_name) = v), min(n_name)) AS t FROM (SELECT DISTINCT v FROM a) JOIN nation ON contains(v, lower(n_name)) OR contains(lower(n_name), v) GROUP BY v)
SELECT c_custkey, coalesce(t, a.v) AS team FROM a LEFT JOIN f ON a.v = f.v"""
ORACLES["claim_verdict"] = """WITH li AS (SELECT l_suppkey, avg(l_quantity) AS v FROM lineitem GROUP BY l_suppkey),
j AS (SELECT s_suppkey AS id, (24 + s_suppkey % 5)::DOUBLE AS c, v, abs((24 + s_suppkey % 5) - v)/greatest(abs(v), 1e-9) AS d FROM supplier LEFT JOIN li ON s_suppkey = l_suppkey)
SELECT id, round(c, 6) AS claimed_value, round(v, 6) AS computed_value, round(d, 6) AS difference, coalesce(d <= 0.05, FALSE) AS stats_verified,
CASE WHEN d <= 0.05 THEN 1.0 WHEN d <= 0.10 THEN 0.6 ELSE 0.0 END::DOUBLE AS stat_accuracy_score, CASE WHEN d IS NULL THEN 'low' WHEN d <= 0.05 THEN 'high' WHEN d <= 0.10 THEN 'medium' ELSE 'high' END AS stat_confidence,
v IS NOT NULL AS stats_found FROM j"""
JUDGED = f"""{FACTS}, {CLAIMS}, {MENTIONS},
ab AS (SELECT c.* EXCLUDE (opposition), m.player, m.k AS mk, replace(c.opposition, '.', '') AS opposition FROM claims c JOIN men m ON c.doc_id = m.doc_id WHERE c.k = m.k
OR NOT EXISTS (SELECT 1 FROM men x WHERE x.doc_id = c.doc_id AND x.k = c.k)),
latest AS (SELECT player, max(season) AS ms FROM facts GROUP BY player),
hit AS (SELECT ab.doc_id, ab.k, ab.mk, ab.player, ab.window_size, f.* EXCLUDE (player), row_number() OVER (PARTITION BY ab.doc_id, ab.k, ab.mk ORDER BY f.match_date DESC NULLS LAST, f.match_id) AS rn
FROM ab JOIN facts f ON ab.player = f.player JOIN latest l ON l.player = f.player WHERE (ab.season IS NULL OR f.season = l.ms) AND (ab.year_lo IS NULL OR f.year BETWEEN ab.year_lo AND ab.year_hi)
AND (ab.opposition IS NULL OR f.opposition = ab.opposition)),
sm AS (SELECT doc_id, k, mk, {SUMS} FROM hit WHERE window_size IS NULL OR rn <= window_size GROUP BY doc_id, k, mk),
jd AS (SELECT ab.*, CASE stat_type WHEN 'runs_total' THEN r WHEN 'strike_rate' THEN CASE WHEN bf > 0 THEN r*100.0/bf END ELSE CASE WHEN di > 0 THEN r/di END END AS v FROM ab LEFT JOIN sm USING (doc_id, k, mk)),
j2 AS (SELECT *, abs(claimed_value - v)/greatest(abs(v), 1e-9) AS d FROM jd),
j3 AS (SELECT *, coalesce(d <= 0.05, FALSE) AS ok, CASE WHEN d <= 0.05 THEN 1.0 WHEN d <= 0.10 THEN 0.6 ELSE 0.0 END::DOUBLE AS acc,
CASE WHEN d IS NULL THEN 'low' WHEN d <= 0.05 THEN 'high' WHEN d <= 0.10 THEN 'medium' ELSE 'high' END AS conf FROM j2)"""
ORACLES["stat_mentions"] = f"""WITH {JUDGED} SELECT doc_id, player, stat_type, window_size::DOUBLE AS window_size, season, opposition, claimed_value, round(round(v, 2), 4) AS computed_value, v IS NOT NULL AS stats_found,
ok AS stats_verified, acc AS stat_accuracy_score, conf AS stat_confidence FROM j3"""
ORACLES["verify_documents"] = f"""WITH {JUDGED}, g AS (SELECT doc_id, avg(acc) FILTER (v IS NOT NULL) AS a, bool_and(ok) FILTER (v IS NOT NULL) AS allok, bool_or(conf = 'high') FILTER (v IS NOT NULL) AS hi, count(*) AS n FROM j3 GROUP BY doc_id)
SELECT s_suppkey AS doc_id, a IS NOT NULL AS stats_found, coalesce(allok, FALSE) AS stats_verified, coalesce(round(a, 4), 0.0) AS stat_accuracy_score, CASE WHEN a IS NULL THEN 'low' WHEN hi THEN 'high' ELSE 'medium' END AS stat_confidence,
coalesce(round((a - 0.5)*2.0, 2), 0.0) AS stat_score_adjustment, coalesce(n, 0) AS n_stat_mentions FROM supplier LEFT JOIN g ON doc_id = s_suppkey"""

ORACLES["score_with_claims"] = f"""SELECT doc_id, stats_found, stats_verified, stat_accuracy_score::DOUBLE AS stat_accuracy_score FROM ({ORACLES['verify_documents']})"""
ORACLES["verify_by_writer"] = f"""WITH {JUDGED}, g AS (SELECT doc_id, avg(acc) FILTER (v IS NOT NULL) AS a, bool_or(claimed_value IS NOT NULL) AS num FROM j3 GROUP BY doc_id)
SELECT s_suppkey AS doc_id, a IS NOT NULL AS stats_found, coalesce(round((a - 0.5)*2.0*CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN num THEN 1.5 ELSE 0.25 END WHEN 1 THEN 4.0 WHEN 2 THEN 0.75 WHEN 3 THEN 2.5 ELSE 1.0 END, 2), 0.0)::DOUBLE AS stat_score_adjustment
FROM supplier LEFT JOIN g ON doc_id = s_suppkey"""

# --- submissions, quotas, profiles ------------------------------------------------------------------

ORACLES["validate_submissions"] = f"""WITH {TURNS} SELECT doc_id, CASE WHEN length(text) < 10 THEN 'text_too_short' WHEN length(text) > 5000 THEN 'text_too_long' WHEN turn = 5 THEN 'unknown_model' END AS reject_reason FROM turns"""
QUICK = (f"greatest(20.0, least(95.0, 50.0 + 12.0*{anyof('lower(text)', D['quick_positive'])}::INT - 12.0*{anyof('lower(text)', D['quick_negative'])}::INT"
                          f" + 4.0*{anyof('lower(text)', D['quick_topic'])}::INT - 10.0*{anyof('lower(text)', D['quick_abuse'])}::INT))::DOUBLE")
ORACLES["quick_score"] = f"WITH {TURNS} SELECT doc_id, {QUICK} AS score, 0.72::DOUBLE AS confidence, least(100.0, {QUICK} + 3)::DOUBLE AS quality FROM turns"
ORACLES["stream_quick_scores"] = ORACLES["quick_score"]
ORACLES["route_scores"] = f"""WITH {TURNS}, a AS (SELECT doc_id AS id, turn, {QUICK} AS s, CASE WHEN turn % 3 = 0 THEN (length(text) % 100)::DOUBLE END AS rs FROM turns)
SELECT id, CASE WHEN turn = 1 THEN 'bqs' ELSE 'eqs' END AS model, CASE WHEN turn = 1 THEN 'EQS-local' WHEN rs IS NOT NULL THEN 'EQS-remote-v1' ELSE 'EQS-local-fallback' END AS model_version,
CASE WHEN turn <> 1 AND rs IS NOT NULL THEN greatest(20.0, least(95.0, rs)) ELSE s END::DOUBLE AS eqs_score, CASE WHEN turn <> 1 AND rs IS NOT NULL THEN 0.9 ELSE 0.72 END::DOUBLE AS confidence,
turn <> 1 AND rs IS NULL AS fallback FROM a"""
ORACLES["quota_status"] = f"""WITH {SUBS}, p AS (SELECT DISTINCT model, date_trunc('month', ts) AS m FROM subs), u AS (SELECT DISTINCT user_id FROM subs),
k AS (SELECT user_id, model, date_trunc('month', ts) AS m, count(*) FILTER (success) AS n FROM subs GROUP BY ALL), a AS (SELECT u.user_id, p.model, p.m, coalesce(n, 0) AS n FROM u CROSS JOIN p LEFT JOIN k ON k.user_id = u.user_id AND k.model = p.model AND k.m = p.m)
SELECT user_id, model, strftime(m, '%Y-%m-%d') AS period_start, strftime(m + INTERVAL 30 DAYS, '%Y-%m-%d') AS period_end, n AS request_count, 55 AS max_requests, round(n/55.0*100.0, 6)::DOUBLE AS usage_percentage,
55 - n AS requests_remaining, CASE WHEN n >= 55 THEN 'blocked' WHEN n/55.0*100 >= 80 THEN 'warning' ELSE 'active' END AS status FROM a"""
ORACLES["quota_decisions"] = f"""WITH {SUBS}, a AS (SELECT *, coalesce(sum((success AND model <> 'bqs')::INT) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM subs)
SELECT id, user_id, used_before, model = 'bqs' OR used_before < 20 AS allowed FROM a"""
ORACLES["stream_quota_decisions"] = ORACLES["quota_decisions"]
ORACLES["stream_quota_use"] = f"""WITH {SUBS} SELECT user_id, model, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period_start, count(*) FILTER (success) AS request_count FROM subs GROUP BY ALL"""
FOLD = f"""{SUBS}, nn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM subs),
hist AS (SELECT user_id, list(struct_pack(n := n, x := eqs_score) ORDER BY n) FILTER (eqs_score IS NOT NULL) AS h FROM nn GROUP BY user_id),
av AS (SELECT nn.*, CASE WHEN len(list_filter(h, lambda e: e.n <= nn.n)) > 0 THEN
list_reduce(list_transform(list_filter(h, lambda e: e.n <= nn.n), lambda e: struct_pack(n := e.n, x := e.x)), lambda a, e: struct_pack(n := e.n, x := (a.x*(e.n - 1) + e.x)/e.n)).x END AS avg_eqs_score FROM nn JOIN hist USING (user_id))"""
ORACLES["running_average"] = f"WITH {FOLD} SELECT id, n, round(avg_eqs_score, 6) AS avg_eqs_score FROM av"
ORACLES["running_reputation"] = f"""WITH {FOLD} SELECT id, n, max(floor(coalesce(avg_eqs_score, 0)*n/10.0 + 1e-9)) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS reputation_points FROM av"""
ORACLES["writer_profiles"] = f"""WITH {FOLD} SELECT user_id, count(*) AS total_submissions, round(arg_max(avg_eqs_score, n), 6) AS avg_eqs_score,
arg_max(stance_label, n) FILTER (stance_label IN ('analytical','balanced','emotional','dismissive','attack_based','unknown')) AS writing_style,
max(floor(coalesce(avg_eqs_score, 0)*n/10.0 + 1e-9))::BIGINT AS reputation_points FROM av GROUP BY user_id"""
ORACLES["profiles_by_day"] = ORACLES["writer_profiles"]
ORACLES["stream_profiles"] = ORACLES["writer_profiles"]
ORACLES["topic_affinity"] = f"""WITH {SUBS}, {COMM}, x AS (SELECT user_id, ts, subs.id, unnest([t1, t2, t3]) AS topic, unnest([1, 2, 3]) AS pos FROM subs JOIN comm ON comm.id = community_id),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, id, pos) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id, pos) AS k FROM f)
SELECT user_id, string_agg(topic, ',' ORDER BY k) AS topics FROM r WHERE k <= 5 GROUP BY user_id"""
ORACLES["scoring_history"] = f"WITH {SUBS} SELECT id, user_id, eqs_score FROM subs WHERE user_id = 7 ORDER BY ts DESC, id LIMIT 20 OFFSET 5"
ORACLES["history_summary"] = f"WITH {SUBS} SELECT user_id, count(*) AS total_submissions, round(avg(eqs_score), 6) AS avg_eqs_score, 0.72::DOUBLE AS avg_confidence FROM subs GROUP BY user_id"
ORACLES["score_bands"] = f"""WITH {SUBS} SELECT id, CASE WHEN value >= 80 THEN 'excellent' WHEN value >= 60 THEN 'good' WHEN value >= 40 THEN 'fair' ELSE 'poor' END AS band,
round(greatest(0.0, least(100.0, (value - 20)/75.0*100.0)), 6)::DOUBLE AS percent, round(CASE WHEN id % 9 = 0 THEN 50.0 ELSE greatest(20.0, least(95.0, value)) END, 6)::DOUBLE AS clamped,
round(CASE WHEN id % 9 = 0 THEN 0.0 ELSE value END, 6)::DOUBLE AS lenient, CASE WHEN id % 9 = 0 THEN 0 ELSE trunc(value)::BIGINT END AS whole FROM subs"""
ORACLES["explain_scores"] = f"""WITH {SUBS}, b AS (SELECT id, value AS v, event_type = 'click' AS f, id % 2 = 0 AS k FROM subs),
n AS (SELECT *, (v/200 >= 0.5)::INT + (f AND k)::INT + (v/300 >= 0.5)::INT + (v/100 >= 0.5)::INT + (v - 100 > 0)::INT AS s, (v/200 < 0.5)::INT + (f AND NOT k)::INT + (NOT f)::INT + (v/90 < 0.4)::INT + (v/400 >= 0.6)::INT AS c,
(v - 150 < 0)::INT + (v - 100 < 0)::INT AS p FROM b)
SELECT id, greatest(1, s)::INT AS n_strengths, greatest(1, c)::INT AS n_concerns, greatest(1, p)::INT AS n_penalties, CASE WHEN v/200 < 0.5 THEN 'Stance confidence is moderate/low, so interpretation may be less stable.'
WHEN f AND NOT k THEN 'Statistical claims were found but not fully verified.' WHEN NOT f THEN 'No verifiable numeric stats detected in the text.' WHEN v/90 < 0.4 THEN 'Coherence is relatively weak between ideas.'
WHEN v/400 >= 0.6 THEN 'High repetition lowers writing originality.' ELSE 'No major concerns were detected by the current deterministic rules.' END AS first_concern FROM n"""

# --- communities ---------------------------------------------------------------------------------------

ORACLES["list_communities"] = f"""WITH {COMM} SELECT id, name FROM comm WHERE (t1 = 'click' OR t2 = 'click' OR t3 = 'click') AND visibility = 'public' AND (name ILIKE '%nation_1%' OR 'Group ' || name ILIKE '%nation_1%')
ORDER BY created_at DESC, id LIMIT 5 OFFSET 1"""
# commands one after the other, over lists of the values that are taken
ORACLES["apply_creations"] = f"""WITH {SUBS}, {COMM}, cm AS (SELECT id AS cmd_id, ts, 'nation_' || (id % 300) AS slug, 'N' || (id % 300 * 7 % 290) AS name FROM subs),
l AS (SELECT list({{'s': [slug], 'n': [name], 'i': [cmd_id]}} ORDER BY ts, cmd_id) AS cs FROM cm), e AS (SELECT {{'s': list(slug), 'n': list(name), 'i': []::BIGINT[]}} AS st FROM comm),
r AS (SELECT list_reduce(list_concat([st], cs), lambda a, b: CASE WHEN list_has_any(a.s, b.s) OR list_has_any(a.n, b.n) THEN a
ELSE {{'s': list_concat(a.s, b.s), 'n': list_concat(a.n, b.n), 'i': list_concat(a.i, b.i)}} END) AS f FROM l, e)
SELECT cmd_id, slug, name FROM cm WHERE cmd_id IN (SELECT unnest(f.i) FROM r)"""
ORACLES["community_page"] = f"""WITH {COMM}, o AS (SELECT id, name, row_number() OVER (ORDER BY created_at DESC, id) AS k, count(*) OVER () AS total FROM comm WHERE visibility = 'public'),
nx AS (SELECT id AS next_id FROM o WHERE k = 8 AND total > 8)
SELECT id, name, total, (SELECT next_id FROM nx) AS next_id FROM o WHERE k BETWEEN 5 AND 8"""
WRITERS = """wr AS (SELECT user_id, list_sort(coalesce(list(DISTINCT event_type) FILTER (value > 150 + user_id % 3 * 50), [])) AS topics, count(*) AS subs, floor(max(value))::BIGINT AS rep,
CASE WHEN user_id % 3 = 0 THEN 'analytical' ELSE 'balanced' END AS style FROM events GROUP BY user_id),
ok AS (SELECT * FROM wr WHERE user_id % 11 <> 0 AND user_id % 13 <> 0)"""


def matches(topic: str | None, style: str | None) -> str:
    want = f"[{q(topic)}]" if topic else "w.topics"
    liked = f"(o.style = {q(style)})" if style else "FALSE"
    shared = f"CASE WHEN len({want}) = 0 THEN o.topics ELSE list_filter({want}, lambda x: list_contains(o.topics, x)) END"
    return f"""WITH {WRITERS}, m AS (SELECT w.user_id AS target_id, o.user_id, {shared} AS sh, {liked} AS lk, o.rep, o.subs FROM wr w JOIN ok o ON o.user_id <> w.user_id),
r AS (SELECT *, (2*len(sh) + lk::INT)::INT AS match_score FROM m WHERE len(sh) > 0 OR lk),
p AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY match_score DESC, rep DESC, subs DESC, user_id) AS place FROM r)
SELECT target_id, place::INT AS place, user_id, match_score, concat_ws('; ', CASE WHEN len(sh) > 0 THEN 'same topic: ' || array_to_string(sh[1:3], ', ') END, CASE WHEN lk THEN 'similar writing style' END) AS match_reason FROM p WHERE place <= 5"""


ORACLES["like_minded_writers"] = matches(None, "analytical")
ORACLES["like_minded_by_topic"] = matches("click", None)
ORACLES["discover_communities"] = f"""WITH {WRITERS}, {COMM}, pub AS (SELECT * FROM comm WHERE visibility = 'public'),
m AS (SELECT w.user_id, c.*, row_number() OVER (PARTITION BY w.user_id ORDER BY CASE WHEN len(w.topics) > 0 THEN member_count ELSE created_at END DESC, CASE WHEN len(w.topics) > 0 THEN c.id ELSE -c.id END) AS place
FROM wr w JOIN pub c ON len(w.topics) = 0 OR list_has_any(w.topics[1:3], [t1, t2, t3]))
SELECT user_id, place::INT AS place, id AS community_id, name, member_count FROM m WHERE place <= 5"""
MEMBERS = """mem AS (SELECT n_nationkey::BIGINT AS community_id, (n_nationkey % 20)::BIGINT AS user_id, 'owner' AS role FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 20, 'member' FROM nation)"""
ORACLES["community_members"] = f"""WITH {MEMBERS}, u AS (SELECT DISTINCT user_id FROM events) SELECT community_id, mem.user_id, 'user' || mem.user_id AS username, role FROM mem JOIN u ON u.user_id = mem.user_id"""
ORACLES["user_communities"] = f"WITH {MEMBERS}, {COMM} SELECT user_id, id, name FROM mem JOIN comm ON id = community_id"
REPLAY = f"""{COMM}, {MEMBERS}, cmd AS (SELECT event_id AS cmd_id, ts, event_id % 27 AS community_id, user_id % 20 AS user_id, CASE WHEN event_type = 'signup' THEN 'join' ELSE 'leave' END AS command FROM events WHERE event_type IN ('signup','error')),
s AS (SELECT cmd.*, visibility, coalesce(role = 'owner', FALSE) AS own, role IS NOT NULL AS was, lag(command) OVER w AS prev, coalesce(bool_or(command = 'leave') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS lft
FROM cmd LEFT JOIN comm ON comm.id = community_id LEFT JOIN mem USING (community_id, user_id) WINDOW w AS (PARTITION BY community_id, user_id ORDER BY ts, cmd_id)),
i AS (SELECT *, CASE WHEN own THEN TRUE WHEN visibility = 'public' THEN CASE WHEN prev IS NULL THEN was ELSE prev = 'join' END ELSE was AND NOT lft END AS inn FROM s),
rp AS (SELECT cmd_id, community_id, command, CASE WHEN command = 'leave' THEN CASE WHEN NOT inn THEN 'Not a member of this community' WHEN own THEN 'Owner cannot leave. Transfer ownership first.' ELSE 'Successfully left community' END
WHEN visibility IS NULL THEN 'Community not found' WHEN inn THEN 'Already a member of this community' WHEN visibility <> 'public' THEN 'This community is private. Request to join.' ELSE 'Successfully joined community' END AS reason FROM i)"""
ORACLES["membership_replay"] = f"WITH {REPLAY} SELECT cmd_id, starts_with(reason, 'Successfully') AS accepted, reason FROM rp"
ORACLES["member_counts"] = f"""WITH {REPLAY}, d AS (SELECT community_id, sum(CASE WHEN command = 'join' THEN 1 ELSE -1 END) AS d FROM rp WHERE starts_with(reason, 'Successfully') GROUP BY 1)
SELECT id, greatest(0, member_count + coalesce(d, 0))::BIGINT AS member_count FROM comm LEFT JOIN d ON id = community_id"""
ORACLES["first_creations"] = """WITH c AS (SELECT event_id AS cmd_id, ts, 'nation_' || (event_id % 400) AS slug FROM events)
SELECT cmd_id, slug FROM c WHERE slug NOT IN (SELECT lower(n_name) FROM nation) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ts, cmd_id) = 1"""
ORACLES["reject_existing"] = """SELECT c_custkey AS key FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""

# --- evaluation -------------------------------------------------------------------------------------------

PRED = f"""{SUBS}, pr AS (SELECT id, event_type AS expected, CASE WHEN id % 3 = 0 THEN 'click' ELSE event_type END AS predicted, least(120.0, value)::DOUBLE AS score, value/500 AS tox, value/400 AS sup FROM subs),
pb AS (SELECT *, CASE WHEN score < 20 THEN 20 - score WHEN score > 70 THEN score - 70 ELSE 0 END AS ob FROM pr),
pe AS (SELECT *, CASE WHEN predicted <> expected THEN 'stance_mismatch' WHEN ob <> 0 THEN 'score_band_miss' WHEN NOT tox BETWEEN 0 AND 0.2 THEN 'toxicity_band_miss' WHEN NOT sup BETWEEN 0.05 AND 1 THEN 'supportive_band_miss' ELSE 'ok' END AS e, abs(score - 45) AS dv FROM pb)"""
ORACLES["band_report"] = f"""WITH {PRED} SELECT expected, count(*) AS n, round(avg((predicted = expected)::INT)*100.0, 2) AS accuracy_percent, round(avg(ob), 2) AS average_score_deviation,
{', '.join(f"count(*) FILTER (e = '{k}') AS n_{k}" for k in ('stance_mismatch', 'score_band_miss', 'toxicity_band_miss', 'supportive_band_miss', 'ok'))} FROM pe GROUP BY expected"""
ORACLES["deviation_report"] = f"WITH {PRED} SELECT expected, count(*) AS n, round(avg(dv), 3) AS mean_deviation, round(max(dv), 3) AS max_deviation, count(*) FILTER (dv > 15) AS n_over_tolerance FROM pe GROUP BY expected"
ORACLES["worst_samples"] = f"WITH {PRED} SELECT id, round(dv, 6) AS deviation FROM pe ORDER BY dv DESC, id LIMIT 12"
ORACLES["best_samples"] = f"WITH {PRED} SELECT id, round(dv, 6) AS deviation FROM pe ORDER BY dv, id LIMIT 12"
ORACLES["score_histogram"] = """WITH h AS (SELECT (floor(greatest(0.0, least(99.999, value))/10)*10)::INT AS b FROM events)
SELECT g::INT AS bin_start, (g + 10)::INT AS bin_end, count(b) AS n FROM range(0, 100, 10) t(g) LEFT JOIN h ON b = g GROUP BY g"""
GRID = """g AS (SELECT unnest([0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])::DOUBLE AS threshold), cc AS (SELECT value/100 AS s, event_type = 'click' AS t FROM events),
k AS (SELECT threshold, count(*) FILTER (s >= threshold AND t) AS tp, count(*) FILTER (s >= threshold AND NOT t) AS fp, count(*) FILTER (s < threshold AND t) AS fn, count(*) FILTER (s < threshold AND NOT t) AS tn FROM g, cc GROUP BY threshold),
o AS (SELECT *, 0.6*coalesce(tp/nullif(tp+fn, 0)::DOUBLE, 0) + 0.25*coalesce(tp/nullif(tp+fp, 0)::DOUBLE, 0) + 0.15*coalesce(tn/nullif(tn+fp, 0)::DOUBLE, 0) AS ob FROM k)"""
ORACLES["threshold_grid"] = f"WITH {GRID} SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(ob, 6) AS objective FROM o"
ORACLES["tune_threshold"] = f"WITH {GRID} SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, round(ob, 6) AS objective FROM o ORDER BY ob DESC, threshold LIMIT 1"
ORACLES["threshold_summary"] = f"""WITH {PRED}, m AS (SELECT avg((predicted = expected)::INT)*100 >= 85 AS a, avg((tox < 0.9)::INT)*100 >= 95 AS b, avg(dv) <= 10 AS c, max(dv) <= 15 AS d FROM pe)
SELECT a AS constructiveness_accuracy_pass, b AS toxicity_accuracy_pass, c AS average_deviation_pass, d AS max_deviation_pass, a AND b AND c AND d AS overall_pass FROM m"""
ORACLES["compare_runs"] = f"WITH {PRED} SELECT count(*) AS n_compared, count(*) FILTER (dv > 15 AND abs(dv - 3) < dv) AS n_repaired FROM pe"
_parts = f"len(regexp_extract_all(text, {q(NOT_WS.replace(']', '.!?]') + '[^.!?]*')}))"


def featured(rows: str) -> str:
    """Rows with a text, and their ten rule features."""
    return f"""(WITH fs AS (SELECT *, lower(text) AS low FROM ({rows})), {defence('fs')}
SELECT *, [criticism_reference_score, context_change_score, evaluation_redirection_score, credibility_restoration_score, contrast_structure_score,
{score('low', D['suggestion'], 3.0)}, {score('low', D['complaint'], 2.0)}, {score('low', D['attack'], 2.0)},
{unit(f'0.7*{score("low", D["stance_reasoning"], 4.0)} + 0.3*least(1.0, greatest(1, {_parts})/4.0)')}, {score('low', D['contrast'] + D['discourse_extra'], 4.0)}] AS f FROM d3)"""


FEATURES = f"""e AS {featured("SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id")}"""


def cent(src: str) -> str:
    return f"""x AS (SELECT label, id, unnest(v) AS x, unnest(range(64)) AS dim FROM {src}),
mn AS (SELECT label, dim, avg(x) AS x, count(*) AS n FROM x GROUP BY label, dim), cn AS (SELECT label, dim, n, x/sqrt(sum(x*x) OVER (PARTITION BY label)) AS x FROM mn),
y AS (SELECT label, unnest(f) AS x, unnest(range(10)) AS dim FROM {src}), fm AS (SELECT label, dim, count(*) AS n, avg(x) AS x FROM y GROUP BY label, dim),
cl AS (SELECT a.label, c, fc FROM (SELECT label, list(x ORDER BY dim) AS c FROM cn GROUP BY label) a JOIN (SELECT label, list(x ORDER BY dim) AS fc FROM fm GROUP BY label) b ON a.label = b.label)"""


def near(a: str, b: str) -> str:
    return f"greatest(0.0, least(1.0, 1 - list_avg(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))))"


CENT = f"{FEATURES}, {cent('e')}"
SIMILAR = f"0.35*greatest(0.0, least(1.0, (list_dot_product(v, c) + 1)/2)) + 0.25*{near('f', 'fc')}"
ORACLES["label_centroids"] = f"""WITH {CENT} SELECT label, n, 'embedding' AS kind, dim::INT AS dim, round(x, 6) AS x FROM cn
UNION ALL SELECT label, n, 'features', dim::INT, round(x, 6) FROM fm"""
ORACLES["centroid_scores"] = f"WITH {CENT} SELECT id, cl.label, round({SIMILAR}, 5)::DOUBLE AS score FROM e CROSS JOIN cl"
_votes = """p AS (SELECT a.id, b.label, b.id AS sid, round_even(list_dot_product(a.v, b.v), 9) AS s FROM qs a CROSS JOIN bank b),
t AS (SELECT id, label, sum(greatest(0.0, s)^2) AS s FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, sid) <= 16) GROUP BY id, label)"""
BENCH = f"""{FEATURES}, bank AS (SELECT id, v, f, {sql_list(STANCES)}[label % 8 + 1] AS label FROM e WHERE id % 5 <> 0), {cent('bank')},
names AS (SELECT unnest({sql_list(STANCES)}) AS label, unnest(range(8)) AS place)"""
_probs = f"""sc AS (SELECT id, label, sum(s) AS raw FROM (SELECT * FROM t UNION ALL SELECT id, cl.label, {SIMILAR} FROM qs CROSS JOIN cl) GROUP BY id, label),
pr AS (SELECT id, label, round(raw/sum(raw) OVER (PARTITION BY id), 4) AS probability FROM sc)"""
ORACLES["benchmark_probabilities"] = f"""WITH {BENCH}, qs AS (SELECT id, v, f FROM e WHERE id % 5 = 0), {_votes}, {_probs}
SELECT doc_id AS id, names.label, round(CASE WHEN e.id IS NULL THEN 0.125 ELSE coalesce(probability, 0) END, 3)::DOUBLE AS probability
FROM documents CROSS JOIN names LEFT JOIN e ON e.id = doc_id LEFT JOIN pr ON pr.id = doc_id AND pr.label = names.label WHERE doc_id % 5 = 0"""
# each paragraph takes its document's vector, and features of its own
_own = featured("SELECT doc_id, para_ix, text, doc_id*1000000 + para_ix AS id, embedding::DOUBLE[] AS v FROM paras LEFT JOIN embeddings ON vec_id = doc_id")
ORACLES["benchmark_stance"] = f"""WITH {PARAS}, {BENCH}, qp AS MATERIALIZED {_own}, qs AS (SELECT id, v, f FROM qp WHERE v IS NOT NULL), {_votes}, {_probs},
bl AS (SELECT id, list(coalesce(probability, 0) ORDER BY place) AS bench FROM qs CROSS JOIN names LEFT JOIN pr USING (id, label) GROUP BY id),
bp AS MATERIALIZED (SELECT doc_id, para_ix, text, coalesce(bench, [0.125 FOR i IN range(8)]) AS bench FROM qp LEFT JOIN bl USING (id)), {stance_ctes('bp', 'doc_id, para_ix', True)}
SELECT doc_id, para_ix, {_sl}[ix + 1] AS stance_label, {', '.join(f'round(p_{x}, 2) AS {prob(s)}' for x, s in zip(_labels, STANCES, strict=True))} FROM st"""
ORACLES["knn_votes"] = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
p AS (SELECT a.id, b.label, b.id AS sid, round_even(list_dot_product(a.v, b.v), 9) AS s FROM e a CROSS JOIN e b),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, sid) <= 16)
SELECT id, label, round(sum(greatest(0.0, s)^2), 5) AS votes FROM t GROUP BY id, label"""
ORACLES["loo_scores"] = f"""WITH {FEATURES},
p AS (SELECT a.id, b.label, b.id AS sid, round_even(list_dot_product(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.id <> b.id),
t AS (SELECT id, label, sum(greatest(0.0, s)^2) AS s FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, sid) <= 16) GROUP BY id, label),
x AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS d FROM e), sm AS (SELECT label, list(s ORDER BY d) AS sv FROM (SELECT label, d, sum(x) AS s FROM x GROUP BY label, d) GROUP BY label),
y AS (SELECT label, unnest(f) AS x, unnest(range(10)) AS d FROM e), fm AS (SELECT label, list(s ORDER BY d) AS fv, max(n) AS n FROM (SELECT label, d, sum(x) AS s, count(*) AS n FROM y GROUP BY label, d) GROUP BY label),
r AS (SELECT e.id, sm.label, v, f, CASE WHEN sm.label = e.label THEN list_transform(list_zip(sv, v), lambda z: z[1] - z[2]) ELSE sv END AS rv,
CASE WHEN sm.label = e.label THEN list_transform(list_zip(fv, f), lambda z: (z[1] - z[2]) / (n - 1)) ELSE list_transform(fv, lambda z: z / n) END AS rf
FROM e CROSS JOIN sm JOIN fm ON fm.label = sm.label),
c AS (SELECT id, label, 0.35*greatest(0.0, least(1.0, (list_dot_product(rv, v)/sqrt(list_dot_product(rv, rv)) + 1)/2)) + 0.25*{near('f', 'rf')} AS s FROM r),
u AS (SELECT id, label, sum(s) AS raw FROM (SELECT * FROM t UNION ALL SELECT * FROM c) GROUP BY id, label)
SELECT id, label, round(round(raw/sum(raw) OVER (PARTITION BY id), 4), 3) AS probability FROM u"""
ORACLES["coherence_adjacent"] = """WITH e AS (SELECT (vec_id/25.0)::DOUBLE AS q, floor(vec_id/25)::BIGINT AS doc_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.doc_id, CASE WHEN b.v IS NOT NULL THEN greatest(0.0, least(1.0, (list_cosine_similarity(a.v, b.v) + 1)/2)) END AS s FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1 AND b.doc_id = a.doc_id)
SELECT doc_id, round(coalesce(avg(s), 0.5), 5) AS coherence FROM p GROUP BY doc_id"""

# --- calibration ---------------------------------------------------------------------------------------------

_lo = case("l", {k: v[0] for k, v in CALIBRATION_BANDS.items()}, "0.0")
_hi = case("l", {k: v[1] for k, v in CALIBRATION_BANDS.items()}, "100.0")
_rules = [
    ("l='SUPPORTIVE_DEFENSE' AND st >= 0.25 AND st < 0.4", "least(82.0, greatest(x, 72.0, 70 + 5*st))", "supportive_mid_strength_passthrough"),
    ("l='SUPPORTIVE_DEFENSE' AND cf >= 0.55", "clipped", "supportive_confident_band_map"),
    ("l='SUPPORTIVE_DEFENSE' AND cf >= 0.35", "x + 0.9*gap", "supportive_medium_conf_pull"),
    ("l='CONSTRUCTIVE_CRITICISM' AND cf >= 0.5", "clipped", "constructive_confident_band_map"),
    ("l='CONSTRUCTIVE_CRITICISM' AND cf >= 0.32", "x + 0.85*gap", "constructive_medium_conf_pull"),
    ("l='DISMISSIVE_COMPLAINT'", "least(x, hi)", "dismissive_cap"), ("l='DIRECT_ATTACK'", "least(x, hi)", "direct_attack_cap"),
    ("l IN ('NEUTRAL_ANALYSIS','BALANCED_DEBATE','MIXED_STANCE') AND cf >= 0.45", "clipped", "neutral_family_band_map"),
    ("l IN ('NEUTRAL_ANALYSIS','BALANCED_DEBATE','MIXED_STANCE') AND cf >= 0.25", "x + 0.85*gap", "neutral_family_medium_conf_pull"),
]
ORACLES["calibrated_scores"] = f"""WITH {SUBS}, a AS (SELECT id, {_sl}[(id % 8 + 1)::INT] AS l, value/300 AS cf, (id % 10)/20.0::DOUBLE AS st, least(95.0, value)::DOUBLE AS x FROM subs),
b AS (SELECT *, ({_lo})::DOUBLE AS lo, ({_hi})::DOUBLE AS hi FROM a), c AS (SELECT *, greatest(lo, least(hi, x)) AS clipped, CASE WHEN x < lo THEN lo - x WHEN x > hi THEN hi - x ELSE 0 END AS gap FROM b),
d AS (SELECT *, round(greatest(0.0, least(100.0, CASE {' '.join(f'WHEN {w} THEN {e}' for w, e, _ in _rules)} ELSE x END)), 2) AS y, CASE {' '.join(f"WHEN {w} THEN '{r}'" for w, _, r in _rules)} ELSE 'no_change' END AS r FROM c)
SELECT id, round(y, 6) AS calibrated_score, r AS calibration_reason, y <> x AS calibration_applied, round(abs(gap), 2) AS band_deviation_before, round(CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END, 2) AS band_deviation_after FROM d"""


# --- rule chain and fusion on derived rows --------------------------------------------------------------------

_pn = [f"p_{s.lower()}" for s in STANCES]
_wn = [wcol("w", w) for w in WRITER_TYPES]
_in = {**{n: f"((id * {k + 3}) % 11) / 40.0" for k, n in enumerate(_pn)}, **{n: f"(id % {k + 2}) / 10.0" for k, n in enumerate(_wn)},
       **{k: f"least({m}, value / {240.0 / m})" for k, m in COMPONENT_MAX.items()}}
ROWS = f"""{SUBS}, rw AS (SELECT id, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _in.items())}, {_sl}[(id % 8 + 1)::INT] AS label,
{sql_list(WRITER_TYPES)}[(id % 5 + 1)::INT] AS writer, id % 5 = 0 AS rej, id % 7 = 0 AS endo, (id % 10)/12.0::DOUBLE AS st, (id % 9)/12.0::DOUBLE AS causal, (id % 6)/6.0::DOUBLE AS resp,
(id % 13)/20.0::DOUBLE AS tm, (id % 17)/17.0::DOUBLE AS tx, (id % 3)/4.0::DOUBLE AS tr, (id % 19)/40.0::DOUBLE AS ab FROM subs)"""
_an = [f"p_{s.lower()}" for s in STANCE_ANCHORS]
_as = "(" + " + ".join(_an) + ")"
_max2 = f"list_sort([{', '.join(f'a_{n}' for n in _an)}], 'DESC')"
ANCH = f"""an AS (SELECT *, {', '.join(f'CASE WHEN {_as} > 0 THEN {n}/{_as} ELSE 0.0 END AS a_{n}' for n in _an)} FROM rw),
am AS (SELECT *, {_max2}[1] - {_max2}[2] AS gap, CASE greatest({', '.join(f'a_{n}' for n in _an)}) {' '.join(f'WHEN a_{n} THEN {v}' for n, v in zip(_an, STANCE_ANCHORS.values()))} END::DOUBLE AS dom,
{' + '.join(f'{v}*a_{n}' for n, v in zip(_an, STANCE_ANCHORS.values()))} AS soft FROM an),
ab AS (SELECT *, CASE WHEN gap >= 0.15 THEN 0.65*dom + 0.35*soft ELSE 0.45*dom + 0.55*soft END AS blend FROM am)"""


def prof(f: str) -> str:
    return case("writer", {w: p[f] for w, p in WRITER_PROFILES.items()}, "1.0")


_kind = "(label = 'SUPPORTIVE_DEFENSE' AND resp > 0.7)"
_host = "(label = 'DIRECT_ATTACK' AND NOT rej)"
_conf = "[" + ", ".join(_wn) + "][list_position(" + sql_list(WRITER_TYPES) + ", writer)]"
ORACLES["adaptive_scoring"] = f"""WITH {ROWS}, {ANCH}, w AS (SELECT *, greatest(20.0, least(95.0, CASE WHEN label IN ('DIRECT_ATTACK','DISMISSIVE_COMPLAINT') THEN dom ELSE blend END)) AS fin,
CASE WHEN {_kind} THEN least(40.0, constructiveness + 0.25) WHEN label = 'CONSTRUCTIVE_CRITICISM' THEN least(40.0, constructiveness + 0.3) WHEN label = 'BALANCED_DEBATE' THEN least(40.0, constructiveness + 2)
WHEN label = 'DISMISSIVE_COMPLAINT' THEN constructiveness*0.82 WHEN {_host} THEN constructiveness*0.7 ELSE constructiveness END AS c1,
CASE WHEN label = 'CONSTRUCTIVE_CRITICISM' THEN least(15.0, analytical_tone + 0.2) WHEN label = 'BALANCED_DEBATE' THEN least(15.0, analytical_tone + 1.5) ELSE analytical_tone END AS a1,
CASE WHEN {_host} THEN respectfulness*0.65 ELSE respectfulness END AS r1, CASE WHEN {_kind} THEN least(15.0, fan_sincerity + 0.35) ELSE fan_sincerity END AS f1 FROM ab),
x AS (SELECT *, round(greatest(c1, least(40.0, c1*(1 + 0.08*{_conf}))), 2) AS c2, round(least(20.0, r1*{prof('respectfulness')}), 2) AS r2, round(least(15.0, a1*{prof('analytical_tone')}), 2) AS a2,
round(least(10.0, clarity*{prof('clarity')}), 2) AS k2, round(least(15.0, f1*{prof('fan_sincerity')}), 2) AS f2, {unit('0.2*tm + 0.2*tx + 0.15*tr + 0.45*ab')} AS raw FROM w),
y AS (SELECT *, label = 'SUPPORTIVE_DEFENSE' AND st >= 0.4 AND resp >= 0.7 AND raw < 0.25 AND p_direct_attack <= 0.25 AND p_dismissive_complaint <= 0.35 AS fair,
label = 'SUPPORTIVE_DEFENSE' AND causal >= 0.35 AND NOT endo AS intent FROM x),
z AS (SELECT *, round(greatest(CASE WHEN intent THEN -1.0 WHEN rej OR fair THEN -5.0 ELSE -25.0 END, -25.0*{unit(f"pow(raw * CASE WHEN rej THEN 0.2 ELSE 1 END * CASE WHEN fair THEN 0.2 ELSE 1 END * CASE WHEN intent THEN 0.2 ELSE 1 END, 1.22) * {prof('toxicity_strength')} * greatest(0.65, least(1.35, 0.65 + 0.7*ab))")}), 2) AS pen FROM y)
SELECT id, round(c2, 4) AS constructiveness, round(r2, 4) AS respectfulness, round(a2, 4) AS analytical_tone, round(k2, 4) AS clarity, round(f2, 4) AS fan_sincerity, round(dom, 4) AS dominant_stance_component,
round(soft, 4) AS soft_stance_component, round(fin, 4) AS final_stance_component, round(pen, 4) AS toxicity_penalty, round(c2 + r2 + a2 + k2 + f2 + pen, 4) AS total FROM z"""
_arch = {k: wcol("w", w) for k, (w, _) in ARCHETYPES.items()}
_asum = "(" + " + ".join(_arch.values()) + ")"
_part = {"stance": "(stc - 20)/75", "stat_accuracy": "acc", "writing_quality": "(qual - 20)/75", "argument_logic": "(id % 7)/10.0", "information_density": "least(1.0, (id % 11)/10.0)",
         "toxicity": "1 - tox", "engagement_style": "least(1.0, fan_sincerity/15)", "structure": "(id % 4)/10.0", "coherence": "(id % 6)/10.0", "counter_argument": "(id % 5)/10.0"}
_fus = " + ".join(f"h_{k}*(" + " + ".join(f"{w}*({_part[p]})" for p, w in ws.items()) + ")" for k, (_, ws) in ARCHETYPES.items())


def rng(x: str) -> str:
    return f"(20 + 75*{unit(x)})"


_sent = "(pos + neu + neg)"
ORACLES["fuse_scores"] = f"""WITH {ROWS}, {ANCH}, b AS (SELECT *, {', '.join(f'CASE WHEN {_asum} > 0 THEN {c}/{_asum} ELSE 0.25 END AS h_{k}' for k, c in _arch.items())},
(id % 3)/3.0::DOUBLE AS pos, (id % 2)/4.0::DOUBLE AS neu, (id % 3)/5.0::DOUBLE AS neg, (id % 8)/8.0::DOUBLE AS sad, p_constructive_criticism + 0.7*p_balanced_debate AS cons,
least(1.0, (id % 4)/3.0)::DOUBLE AS acc, {rng('((id % 23) - 9 + 10)/25.0')} AS qual, least(1.0, (id % 26)/25.0)::DOUBLE AS tox,
{unit('0.5*(id % 10)/10.0 + 0.3*(id % 9)/10.0 - 0.2*(id % 8)/10.0')}::DOUBLE AS orig, CASE WHEN id % 10 = 1 THEN id % 4 ELSE 0 END AS sev FROM ab),
c AS (SELECT *, CASE WHEN {_sent} > 0 THEN pos/{_sent} ELSE 1 - sad END AS s1, CASE WHEN {_sent} > 0 THEN neu/{_sent} ELSE 0 END AS s2, CASE WHEN {_sent} > 0 THEN neg/{_sent} ELSE sad END AS s3,
{unit(f"({case('label', STANCE_STRENGTH_BASE, '0.55')}) + 0.14*st + 0.08*cons - 0.2*p_direct_attack - 0.12*p_dismissive_complaint")} AS strength FROM b),
e AS (SELECT *, 78*s1 + 62*s2 + 40*s3 AS senti, list_sort([s1, s2, s3], 'DESC')[1] - list_sort([s1, s2, s3], 'DESC')[2] AS sgap,
greatest(20.0, least(95.0, 0.8*blend + 0.2*(20 + 75*strength) + 20*st + 10*cons - 16*p_direct_attack - 12*p_dismissive_complaint)) AS stc FROM c),
f AS (SELECT *, {_fus} AS fus, 0.45*stc + 0.25*senti + 0.15*qual + 0.1*{rng('acc')} + 0.05*{rng('orig')} AS core0, least(gap, sgap) < 0.1 AS unsure FROM e),
g AS (SELECT *, CASE WHEN unsure THEN 0.9*core0 + 0.05*(soft + senti) ELSE core0 END AS core FROM f),
h AS (SELECT *, (0.8*core + 0.2*{rng('fus')}) * CASE WHEN unsure THEN 0.98 ELSE 1 END + CASE WHEN id % 3 <> 0 THEN 0 WHEN id % 6 = 0 THEN 4 WHEN (id % 4)/3.0 >= 0.5 THEN 2 ELSE -6 END AS raw0 FROM g),
i AS (SELECT *, CASE WHEN tox > 0.75 THEN least(raw0, 30) WHEN tox > 0.6 THEN least(raw0, 40) ELSE raw0 END AS raw1,
CASE WHEN label = 'DIRECT_ATTACK' OR sev >= 1 THEN [40.0, 30.0, 25.0, 20.0][(sev + 1)::INT] WHEN label = 'DISMISSIVE_COMPLAINT' OR id % 12 = 2 THEN CASE WHEN id % 2 = 0 THEN 50.0 ELSE 40.0 END END AS ceil FROM h)
SELECT id, round(round(greatest(20.0, least(95.0, CASE WHEN ceil IS NOT NULL THEN least(raw1, ceil) ELSE greatest({case('label', {k: v[0] for k, v in FUSION_BANDS.items()}, '20.0')}, least({case('label', {k: v[1] for k, v in FUSION_BANDS.items()}, '95.0')}, raw1)) END)), 2), 3) AS final_score,
CASE WHEN tox > 0.75 THEN 'cap_30' WHEN tox > 0.6 THEN 'cap_40' ELSE 'none' END AS toxicity_adjustment, round(ceil::DOUBLE, 3) AS ceiling,
CASE greatest({', '.join(f'h_{k}' for k in _arch)}) {' '.join(f"WHEN h_{k} THEN '{k}'" for k in _arch)} END AS archetype_detected, round(round(core, 4), 3) AS core_component, round(round(orig, 4), 3) AS originality_component FROM i"""


CH = f"""{ROWS}, ch AS (SELECT *, -(id % 26)::DOUBLE AS pen, (id % 4)/4.0 AS fair_s, (id % 7)/14.0 AS pat, (id % 11)/22.0 AS reas, (id % 9)/30.0 AS sugg, (id % 13)/24.0 AS depth, (id % 5)/12.0 AS strat,
(id % 8)/16.0 AS disc, 20.0 + id % 90 AS words, id % 9 AS sens, id % 6 AS rr, id % 4 AS rs, id % 3 = 1 AS rc, id % 4 <> 1 AS cc, id % 5 AS cr, id % 3 AS cs2,
constructiveness AS con, respectfulness AS res, analytical_tone AS ana, clarity AS cla, fan_sincerity AS fan, constructiveness + respectfulness + analytical_tone + clarity + fan_sincerity - (id % 26) AS tot FROM rw)"""
_fw = FLOOR_QUALITY_WEIGHTS
_short = {"constructiveness": "con", "respectfulness": "res", "analytical_tone": "ana", "clarity": "cla", "fan_sincerity": "fan"}


def _quality(w: str) -> str:
    return " + ".join(f"{x}*({_short[k]}/{COMPONENT_MAX[k]})" for k, x in _fw[w].items())


def _lifted(k: str) -> str:
    share = case("writer", {w: t.get(k, 0.0) for w, t in UPLIFT_WEIGHTS.items()}, "0.0")
    return f"CASE WHEN lift IS NOT NULL AND ({share}) > 0 THEN round(least({COMPONENT_MAX[k]}, {_short[k]} + lift*({share})), 2) ELSE {_short[k]} END AS l_{_short[k]}"


_order = list(_short.items())
_room = {n: f"greatest(0.0, {COMPONENT_MAX[k]} - l_{n})" for k, n in _order}
_used, _adds = "0.0", {}
for _k, _n in _order:
    _adds[_n] = f"least({_room[_n]}, greatest(0.0, rest - ({_used})))"
    _used += f" + {_room[_n]}"
ORACLES["floor_uplift"] = f"""WITH {CH}, a AS (SELECT *, CASE writer WHEN 'Analyst' THEN {_quality('Analyst')} WHEN 'Storyteller' THEN {_quality('Storyteller')} WHEN 'Debater' THEN {_quality('Debater')} ELSE {_quality('other')} END AS qs,
label = 'SUPPORTIVE_DEFENSE' AND rej AND st >= 0.45 AND fair_s >= 0.5 AND resp >= 0.75 AND ab < 0.2 AND tm < 0.2 AND p_direct_attack <= 0.2 AND p_dismissive_complaint <= 0.3 AS gate FROM ch),
b AS (SELECT *, greatest({case('writer', WRITER_FLOORS, '60.0')}, CASE WHEN gate THEN 72.0 ELSE 0 END) AS flr, pat >= 0.35 OR (writer = 'Analyst' AND ana >= 7) OR (writer = 'Debater' AND ana >= 6.5 AND res >= 13) OR (writer = 'Storyteller' AND cla >= 7 AND fan >= 7)
OR (writer = 'Passionate Fan' AND fan >= 8 AND res >= 14) OR gate OR (writer IN ('Analyst','Debater') AND ab < 0.08 AND pat >= 0.2 AND qs >= 0.34) OR (writer = 'Storyteller' AND ab < 0.08 AND pat >= 0.2 AND qs >= 0.36 AND cla >= 6) AS trig FROM a),
c AS (SELECT *, CASE WHEN (ab < 0.12 OR gate) AND trig AND tot < flr THEN flr - tot END AS lift FROM b), e AS (SELECT *, {', '.join(_lifted(k) for k in _short)} FROM c),
f AS (SELECT *, CASE WHEN lift IS NULL THEN 0 ELSE greatest(0.0, flr - ({' + '.join(f'l_{n}' for n in _short.values())} + pen)) END AS rest FROM e),
g AS (SELECT *, {', '.join(f'CASE WHEN {e} > 0 THEN round(l_{n} + {e}, 2) ELSE l_{n} END AS z_{n}' for n, e in _adds.items())} FROM f)
SELECT id, {', '.join(f'round(z_{n}, 3) AS {k}' for k, n in _order)}, round(CASE WHEN lift IS NULL THEN tot ELSE {' + '.join(f'z_{n}' for n in _short.values())} + pen END, 3) AS total FROM g"""
ORACLES["rescue_layer"] = f"""WITH {CH}, a AS (SELECT *, tm < 0.18 AND ab < 0.08 AS calm, writer <> 'Passionate Fan' AS elig FROM ch),
b AS (SELECT *, writer = 'Analyst' AND calm AND resp >= 0.65 AND strat >= 0.2 AS g1, calm AND tm < 0.05 AND resp > 0.7 AND (reas >= 0.4 OR depth >= 0.4) AS g2,
calm AND resp >= 0.65 AND (reas >= 0.08 OR rr >= 1 OR disc >= 0.35 OR ana >= 6.5) AND (sugg >= 0.12 OR depth >= 0.2 OR disc >= 0.4 OR rs >= 2) AND words >= 70 AND sens >= 4 AS g3,
rc AND sugg < 0.12 AND rs <= 1 AND reas < 0.3 AND rr <= 2 AND disc < 0.25 AS moan FROM a),
c AS (SELECT *, elig AND (g1 OR g2 OR g3) AND NOT moan AS act FROM b),
e AS (SELECT *, act AND label = 'SUPPORTIVE_DEFENSE' AND st >= 0.4 AND depth >= 0.3 AND resp >= 0.7 AS fr, act AND (reas >= 0.2 OR rr >= 4) AND depth >= 0.25 AND pat >= 0.15 AND resp >= 0.72 AND tm < 0.12 AS bo FROM c),
f AS (SELECT *, CASE WHEN act AND g2 THEN round(least(40.0, con + 0.25), 2) ELSE con END AS c1, CASE WHEN act AND g2 THEN round(least(15.0, ana + 0.35), 2) ELSE ana END AS a1 FROM e),
g AS (SELECT *, CASE WHEN fr THEN round(least(40.0, c1 + 0.2), 2) ELSE c1 END AS c2, CASE WHEN fr THEN round(least(15.0, a1 + 0.15), 2) ELSE a1 END AS a2 FROM f),
h AS (SELECT *, CASE WHEN fr OR (act AND g2) THEN c2 + res + a2 + cla + fan + pen ELSE tot END AS t2, CASE WHEN bo THEN round(least(40.0, c2 + 2), 2) ELSE c2 END AS c3 FROM g),
i AS (SELECT *, t2 + CASE WHEN bo THEN 2 ELSE 0 END + CASE WHEN act AND c3 < 24 THEN 24 - c3 ELSE 0 END AS t3, CASE WHEN act THEN greatest(24.0, c3) ELSE c3 END AS c4, CASE WHEN g1 THEN 80.0 WHEN writer IN ('Analyst','Debater') THEN 73.0 ELSE 68.0 END AS fl FROM h)
SELECT id, round(c4, 3) AS constructiveness, round(res, 3) AS respectfulness, round(a2, 3) AS analytical_tone, round(cla, 3) AS clarity, round(fan, 3) AS fan_sincerity, round(CASE WHEN act THEN greatest(fl, t3) ELSE t3 END, 3) AS total,
CASE WHEN NOT elig THEN 'writer_not_eligible' WHEN NOT (g1 OR g2 OR g3) THEN 'signal_gate_failed' WHEN moan THEN 'complaint_like_blocked' WHEN fr THEN 'fairness_defense_detected' WHEN g2 THEN 'simple_reasoning_detected' ELSE 'constructive_rescue' END AS rescue_reason,
act AS rescue_activated, act AND t3 < fl AS rescued_outlier, bo AS analytical_boost_applied FROM i"""
ORACLES["complaint_and_abuse_caps"] = f"""WITH {CH}, a AS (SELECT *, writer = 'Analyst' AND depth >= 0.4 AND resp >= 0.7 AS deep FROM ch),
b AS (SELECT *, CASE WHEN deep THEN greatest(24.0, con) ELSE con END AS c1 FROM a), c AS (SELECT *, CASE WHEN deep THEN c1 + res + ana + cla + fan + pen ELSE tot END AS t1 FROM b),
e AS (SELECT *, CASE WHEN ab < 0.12 AND cc AND reas < 0.1 AND cr <= 1 AND sugg < 0.1 AND (depth < 0.18 OR cs2 = 0) AND disc < 0.2 AND c1 < 18 AND fan < 6 THEN least(58.0, t1) ELSE t1 END AS t2 FROM c),
f AS (SELECT *, CASE WHEN ab < 0.12 AND cc AND sugg < 0.1 AND ana < 4.5 AND fan < 6 AND cr <= 2 THEN least(60.0, t2) ELSE t2 END AS t3, cc AND reas < 0.1 AND sugg < 0.1 AND depth < 0.2 AND disc < 0.2 AND ab < 0.12 AS mt FROM e),
g AS (SELECT *, CASE WHEN mt THEN round(c1*0.78, 2) ELSE c1 END AS c2, ab >= 0.2 AND NOT rej AS bad FROM f),
h AS (SELECT *, CASE WHEN bad THEN least(pen, CASE WHEN ab >= 0.35 THEN -25.0 ELSE -20.0 END) ELSE pen END AS p2, CASE WHEN mt THEN c2 + res + ana + cla + fan + pen ELSE t3 END AS t4 FROM g)
SELECT id, round(c2, 3) AS constructiveness, round(p2, 3)::DOUBLE AS toxicity_penalty, round(CASE WHEN bad THEN least(35.0, c2 + res + ana + cla + fan + p2) ELSE t4 END, 3) AS total FROM h"""
ORACLES["sarcasm_penalty"] = f"""WITH {CH}, a AS (SELECT *, CASE WHEN id % 7 <> 3 THEN greatest(20.0, least(95.0, tot + id % 7 - 3)) ELSE tot END AS t1, (id % 11)/10.0 AS sa, (id % 7)/7.0 AS ri, id % 3 = 0 AS mock FROM ch),
b AS (SELECT *, CASE WHEN (mock OR label IN ('SARCASTIC_CRITICISM','DIRECT_ATTACK','DISMISSIVE_COMPLAINT')) AND label <> 'SUPPORTIVE_DEFENSE' THEN
greatest(0.0, least(42.0, (12*sa + 9*ri + 7*((id % 5)/5.0) + 7*(id % 2) + 4*((id % 3)/3.0) - 4*((id % 12)/12.0) + CASE WHEN sa >= 0.5 AND ri >= 0.5 THEN 8 ELSE 0 END + CASE WHEN id % 4 = 0 AND mock THEN 6 ELSE 0 END) * (0.8 + 0.4*((id % 16)/16.0)))) ELSE 0 END AS p FROM a),
c AS (SELECT *, round(greatest(20.0, least(95.0, CASE WHEN p > 0 THEN greatest(0.0, t1 - p) ELSE t1 END)), 2) AS sc FROM b)
SELECT id, round(round(-p, 2), 2)::DOUBLE AS sarcasm_credibility_penalty, round(CASE WHEN label = 'SUPPORTIVE_DEFENSE' AND st >= 0.25 AND st < 0.4 THEN round(least(82.0, sc + 5*st), 2) ELSE sc END, 2) AS rule_score FROM c"""
ORACLES["fold_adjustments"] = f"""WITH {CH}, a AS (SELECT *, greatest(20.0, least(95.0, tot)) AS r, (id % 9 - 4)::DOUBLE AS adj, CASE WHEN label IN ('DIRECT_ATTACK','DISMISSIVE_COMPLAINT') THEN least(3.0, id % 22 - 7) ELSE id % 22 - 7 END::DOUBLE AS q FROM ch),
b AS (SELECT *, CASE WHEN id % 3 = 0 THEN round(greatest(20.0, least(95.0, r + adj)), 2) ELSE r END AS s FROM a)
SELECT id, round(round(greatest(20.0, least(95.0, s + q)), 2), 2) AS adjusted_score, round(round(q, 2), 2) AS writing_quality_component FROM b"""


# --- rounding -------------------------------------------------------------------------------------------------

def half_up(sql: str) -> str:
    """Every round(x, n) becomes round((x) + 1e-9, n): ties must not depend on the last floating-point bit."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "'":
                k = sql.index("'", k + 1)
            elif ch in "([":
                depth += 1
            elif ch in ")]":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = half_up(sql[j + len(key):comma])
        out.append(sql[i:j] + f"round(({inner}) + 1e-9,{sql[comma + 1:k]}")
        i = k


ORACLES.update({n: half_up(sql) for n, sql in ORACLES.items()})

# --- predicted flags and the repair pass ---------------------------------------------------------------------

CAL = """cal AS (SELECT event_id AS id, ['Constructive Storyteller', 'Constructive Debater', 'Constructive Passionate Fan', 'Non-constructive complaint', 'Toxic attack', 'Neutral'][event_id % 6 + 1] AS category,
event_id % 97 / 1.0 AS fs, -(event_id % 23) / 2.0 AS tp, event_id % 19 / 90.0 AS ab, event_id % 29 / 140.0 AS tm, event_id % 31 / 60.0 AS md, event_id % 37 / 70.0 AS dp, event_id % 16 / 15.0 AS si, event_id % 43 / 80.0 AS ms,
0.35*(event_id % 11 / 10.0) + 0.25*(event_id % 13 / 12.0) + 0.2*(event_id % 41 / 40.0) + 0.1*(event_id % 7 / 6.0) + 0.06*(event_id % 5 / 4.0) + 0.03*(event_id % 3 / 2.0) + 0.01*(event_id % 17 / 16.0) AS bl FROM events),
pf AS (SELECT *, bl >= 0.42 OR (fs >= 65 AND tp > -6) AS pc, tp <= -8 OR ab >= 0.12 AS pt FROM cal),
rp AS (SELECT *, CASE WHEN category IN ('Constructive Storyteller', 'Constructive Debater') AND fs < 70 AND tm < 0.12 AND md >= 0.18 AND dp >= 0.25 AND si >= 0.28 THEN 'story_rescue'
WHEN category = 'Constructive Passionate Fan' AND fs < 68 AND tm < 0.12 AND ms >= 0.25 AND si >= 0.2 THEN 'fan_floor'
WHEN category = 'Non-constructive complaint' AND (fs > 60 OR pc) THEN 'complaint' END AS repair FROM pf)"""
ORACLES["predicted_flags"] = f"WITH {CAL} SELECT id, pc AS predicted_constructive, pt AS predicted_toxic, NULL::VARCHAR AS repair, round(fs, 4)::DOUBLE AS final_score FROM pf"
ORACLES["repaired_scores"] = f"""WITH {CAL} SELECT id, CASE WHEN repair IN ('story_rescue', 'fan_floor') THEN TRUE WHEN repair = 'complaint' THEN FALSE ELSE pc END AS predicted_constructive,
pt AS predicted_toxic, repair, round(CASE repair WHEN 'story_rescue' THEN greatest(fs, 74) WHEN 'fan_floor' THEN greatest(fs, 68) WHEN 'complaint' THEN least(fs, 56) ELSE fs END, 4)::DOUBLE AS final_score FROM rp"""
ORACLES["repair_counts"] = f"WITH {CAL} SELECT count(*) FILTER (repair = 'story_rescue') AS storyteller_rescues, count(*) FILTER (repair = 'complaint') AS complaint_suppressions FROM rp"

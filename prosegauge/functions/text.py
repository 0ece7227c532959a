"""Text column expressions.

All of them are built-in Spark expressions, so they stay in the JVM and reach
whole texts: no UDF, no truncation. Substring markers use ``contains`` and word
keywords use tokens, because the two give different hits ("but" is inside
"contribute").
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from prosegauge.functions.numeric import any_of, ratio, unit

# Unicode white space, as a character set for trimming and as a regex class.
SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = "".join(map(chr, SPACE_CODES))
_SPACE_CLASS = (r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{_SPACE_CLASS}]"
NOT_WS = f"[^{_SPACE_CLASS}]"
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"
PARAGRAPH_BREAK = rf"\n{WS}*\n+"
WORD = r"[a-zA-Z']+"
URL = r"(?i)https?://" + NOT_WS + r"+|www\." + NOT_WS + "+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_ref(c: Column) -> Column:
    """``strip`` for a column reference or lambda variable: most values have nothing to trim at either end."""
    edge = F.lit(SPACES).contains(F.substring(c, 1, 1)) | F.lit(SPACES).contains(F.substring(c, -1, 1))
    return F.when(edge, F.btrim(c, F.lit(SPACES))).otherwise(c)


def _is_blank(c: Column) -> Column:
    return ~c.rlike(NOT_WS)


# --- normalisation and predicates -----------------------------------------------

def normalize_text(c: Column) -> Column:
    """Links become a space, white space collapses, ends are trimmed."""
    no_links = F.regexp_replace(c, r"https?://" + NOT_WS + "+", " ")
    return strip(F.regexp_replace(no_links, WS + "+", " "))


def normalize_name(c: Column) -> Column:
    kept = strip(F.regexp_replace(F.lower(c), f"[^a-z0-9{_SPACE_CLASS}]", ""))
    return F.regexp_replace(kept, WS + "+", " ")


def normalize_team(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))


def normalize_column_name(name: str) -> str:
    """Snake-case form of a header (driver side, header names only)."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.strip().lower())
    return "_".join(kept.split())


def slugify(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9_-]+", "-")
    return F.substring(F.btrim(F.regexp_replace(dashed, "-+", "-"), F.lit("-")), 1, 100)


def is_url_only(c: Column) -> Column:
    return ~_is_blank(c) & _is_blank(F.regexp_replace(c, URL, ""))


def is_hashtag_only(c: Column) -> Column:
    """Every white-space token is a hashtag; the empty text is not."""
    return strip(c).rlike(rf"(?U)^#\w+(?:{WS}+#\w+)*$")


def is_hashtag_run(c: Column) -> Column:
    """Full-match form: hashtags may touch each other ("#a#b"); the empty text counts."""
    return _is_blank(c) | strip(c).rlike(rf"(?U)^(?:#\w+{WS}*)+$")


def is_symbol_only(c: Column) -> Column:
    """Nothing but symbols remains after links, mentions and hashtags are removed."""
    bare = F.regexp_replace(F.regexp_replace(c, URL, ""), r"(?U)[@#]\w+", "")
    return ~bare.rlike(r"[\p{L}\p{N}]")


def is_emoji_only(c: Column) -> Column:
    """Only emoji code points and white space."""
    return F.regexp_replace(c, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}" + _SPACE_CLASS + "]", "") == ""


def is_repost(c: Column, require_no_colon: bool = False) -> Column:
    lowered = F.lower(strip(c))
    bare = lowered.startswith("rt @")
    return bare & ~lowered.contains(":") if require_no_colon else bare


def word_list(words: Sequence[str]) -> Column:
    """A list as one constant array (folded at planning time), so plans stay small for any list length."""
    return F.split(F.lit("\u0001".join(words)), "\u0001")


def contains_any(lowered: Column, markers: Sequence[str]) -> Column:
    return F.exists(word_list(markers), lambda m: lowered.contains(m)) if markers else F.lit(False)


def regex_any(c: Column, patterns: Sequence[str]) -> Column:
    return any_of([c.rlike(p) for p in patterns])


def regex_any_with(c: Column, patterns: Sequence[str], needed: Sequence[str]) -> Column:
    """``regex_any`` of patterns whose every match holds one of the ``needed`` substrings: other texts are not searched."""
    return contains_any(c, needed) & regex_any(c, patterns)


# --- splitting --------------------------------------------------------------------

def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip_ref), lambda s: s != "")


def paragraphs(c: Column, sep: str = PARAGRAPH_BREAK) -> Column:
    return _pieces(strip(F.replace(c, F.lit("\r\n"), F.lit("\n"))), sep)


def sentences(c: Column) -> Column:
    return _pieces(strip(c), SENTENCE_BREAK)


def clauses(c: Column) -> Column:
    return _pieces(c, r"(?iU)\b(?:while|however|but)\b|;")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    """Space-joined n-grams, built by pairing the token array with its own shifts."""
    size = F.size(toks)
    grams = toks
    for k in range(1, n):
        length = F.greatest(F.lit(0), size - k)
        grams = F.zip_with(F.slice(grams, F.lit(1), length), F.slice(toks, F.lit(k + 1), length),
                           lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def space_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NOT_WS + "+"))


def sentence_count(c: Column) -> Column:
    return F.size(sentences(c))


# --- marker scores ---------------------------------------------------------------

def hits(lowered: Column, markers: Sequence[str]) -> Column:
    """How many markers occur as a substring (each counted once per listing)."""
    return F.size(F.filter(word_list(markers), lambda m: lowered.contains(m))) if markers else F.lit(0)


def marker_score(lowered: Column, markers: Sequence[str], norm: float) -> Column:
    return F.least(F.lit(1.0), hits(lowered, markers) / F.lit(norm))


def phrase_ratio(lowered: Column, phrases: Sequence[str]) -> Column:
    return hits(lowered, phrases) / F.lit(float(len(phrases)))


def keyword_hits(toks: Column, keywords: Sequence[str]) -> Column:
    return F.size(F.filter(toks, lambda t: F.array_contains(word_list(keywords), t)))


def keyword_ratio(toks: Column, keywords: Sequence[str]) -> Column:
    return ratio(keyword_hits(toks, keywords), F.size(toks))


# --- quality signals -----------------------------------------------------------------

def lexical_diversity(toks: Column) -> Column:
    ttr = ratio(F.size(F.array_distinct(toks)), F.size(toks))
    return unit(ttr * (1.0 - F.least(F.lit(0.35), (1.0 - ttr) * 0.65)))


def repetition(toks: Column) -> Column:
    """Twice the weighted share of repeated 1-, 2- and 3-grams; short texts score 0."""
    n = F.size(toks)

    def repeated(grams: Column, count: Column) -> Column:
        return (count - F.size(F.array_distinct(grams))) / F.greatest(F.lit(1), count)

    def shares(pairs: Column) -> Column:
        # pairs are made once, and triples from them
        length = F.greatest(F.lit(0), n - 2)
        triples = F.zip_with(F.slice(pairs, F.lit(1), length), F.slice(toks, F.lit(3), length),
                             lambda a, b: F.concat(a, F.lit(" "), b))
        return 0.35 * repeated(toks, n) + 0.4 * repeated(pairs, n - 1) + 0.25 * repeated(triples, n - 2)

    share = F.get(F.transform(F.array(ngrams(toks, 2)), shares), F.lit(0))
    return F.when(n < 6, 0.0).otherwise(unit(share * 2.0))


def sentence_variety(sents: Column, sent_toks: Column, clause_words: Sequence[str]) -> Column:
    """Spread of sentence lengths and share of distinct sentence shapes; ``sent_toks``: tokens per sentence."""
    n = F.size(sents)
    # lengths are whole numbers, so both sums are exact
    lengths = F.aggregate(
        sent_toks, F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q")),
        lambda a, t: F.struct((a["s"] + F.size(t)).alias("s"), (a["q"] + F.size(t) * F.size(t)).alias("q")),
        lambda a: F.when(a["s"] > 0, F.sqrt(F.greatest(
            F.lit(0.0), (n * a["q"] - a["s"] * a["s"]).cast("double"))) / a["s"]).otherwise(0.0))

    def shape(s: Column, t: Column) -> Column:
        return F.struct(
            F.get(t, F.lit(0)).alias("starter"),
            F.arrays_overlap(t, word_list(clause_words)).alias("clause"),
            s.rlike(r"\p{Nd}").alias("numeric"),
            (F.size(t) > 20).alias("long"),
        )

    shapes = F.filter(F.zip_with(sents, sent_toks, shape), lambda p: p["starter"].isNotNull())
    # one pass over the shapes gives both counts
    counts = F.transform(F.array(shapes), lambda a: F.size(F.array_distinct(a)) / F.greatest(F.lit(1), F.size(a)))
    return (F.when(n == 0, 0.0).when(n == 1, 0.35)
            .otherwise(unit(0.55 * unit(lengths * 1.8) + 0.45 * F.get(counts, F.lit(0)))))


def evidence_score(c: Column, lowered: Column, keywords: Sequence[str]) -> Column:
    has = lowered.contains

    def counted(pattern: str, needed: Column) -> Column:
        # few texts have what a match needs; only these are searched at every word boundary
        return F.when(~needed, 0).otherwise(F.regexp_count(lowered, F.lit(pattern)))

    numbers = counted(r"(?U)\b\d+(?:\.\d+)?%?\b", lowered.rlike(r"\p{Nd}"))
    years = counted(r"(?U)\b(?:19|20)\d{2}\b", has("19") | has("20"))
    comparisons = counted(r"(?U)\b(better than|worse than|compared to|compared with)\b",
                          has("better than") | has("worse than") | has("compared to") | has("compared with"))
    windows = counted(
        r"(?U)\b(last\s+\d+\s+(?:matches?|innings?)|this\s+season|between\s+20\d{2}\s+and\s+20\d{2})\b",
        has("last") & (has("match") | has("inning")) | has("this") & has("season") | has("between") & has("20"))
    names = F.size(F.filter(
        F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"), F.lit(0)),
        lambda m: m.rlike(WS)))
    found = (numbers + years + hits(lowered, keywords) + comparisons + windows
             + F.least(names, F.lit(3)))
    return F.least(F.lit(1.0), found / 8.0)


def completeness(sents: Column, lowered: Column, intro: Sequence[str], argument: Sequence[str],
                 conclusion: Sequence[str]) -> Column:
    first = F.lower(F.get(sents, F.lit(0)))
    last = F.lower(F.get(sents, F.size(sents) - 1))
    six_words = first.rlike(f"^{WS}*+(?:{NOT_WS}++{WS}++){{5}}{NOT_WS}")
    found = ((contains_any(first, intro) | six_words).cast("int")
             + contains_any(lowered, argument).cast("int")
             + contains_any(last, conclusion).cast("int"))
    return F.when(F.size(sents) > 0, found / 3.0).otherwise(0.0)


def content_ratio(toks: Column, stopwords: Sequence[str], suffixes: Sequence[str]) -> Column:
    def is_content(t: Column) -> Column:
        ends = t.rlike("(?:" + "|".join(suffixes) + ")$")
        return ~F.array_contains(word_list(stopwords), t) & ((F.length(t) >= 5) | ends)

    return ratio(F.size(F.filter(toks, is_content)), F.size(toks))


def syllable_count(lowered: Column) -> Column:
    return F.regexp_count(lowered, F.lit("[aeiouy]+"))


def clarity(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Readability share: Flesch ease from sentence, word and vowel-group counts; no sentence scores 0."""
    words = F.greatest(F.lit(1), n_words)
    per_sentence = words / F.greatest(F.lit(1), n_sentences)
    flesch = 206.835 - 1.015 * per_sentence - 84.6 * (n_syllables / words)
    score = 0.78 * unit((flesch - 15.0) / 75.0) + 0.22 * (1.0 - unit((per_sentence - 30.0) / 22.0))
    return F.when(n_sentences > 0, unit(score)).otherwise(0.0)

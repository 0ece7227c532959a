"""Operator 5: personal data by weak-supervision aggregation, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Shape:
    """A pattern of a kind: ``hint`` occurs in every text that it matches, ``base`` says that its matches are base spans
    once they pass their check. Possessive repeats match what greedy ones do here and stay linear."""

    name: str
    kind: str
    pattern: str
    hint: str
    base: bool = False


SHAPES = (
    # a match starts where a run of local characters starts or where the match before it ended
    Shape("email", "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", True),
    Shape("ip", "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", True),
    Shape("card", "card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", True),
    Shape("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    Shape("spelled_email", "email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++"
          r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]++)++", r"(?i)[(\[{]at[)\]}]"),
    Shape("local_phone", "phone", r"(?<![0-9+.-])(?<![0-9+]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
          r"[0-9]{3}[.-][0-9]{4}"),
)

#: Gazetteers and context words: fixed values.
DOMAINS = ("com|org|net|edu|gov|mil|int|info|biz|io|ai|dev|app|de|fr|es|it|uk|us|ca|au|ch|at|nl|be|eu|se|no|dk|fi|pl|pt|ie|"
           "jp|cn|kr|in|br|mx|ru|example|test|invalid")
CALLING = ("1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|"
           "91|92|93|94|95|98|2[1-9][0-9]|3[5-8][0-9]|42[0-9]|5[0-9]{2}|6[7-9][0-9]|8[0578][0-9]|9[679][0-9]")
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35|30[0-5]|3[689]|62"
WORDS_FOR = {
    "email": r"(?i)\b(e-?mail|mail|mailto|contact|write|reach|address|from|to|cc)\b",
    "ip": r"(?i)\b(ip|host|server|client|from|address|login|addr|peer|connection)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|paid|pan|cc)\b",
    "phone": r"(?i)\b(phone|call|tel|telephone|mobile|cell|fax|sms|whatsapp|dial|number|contact)\b",
}
WORDS_AGAINST = r"(?i)(\b(version|ver|release|build|order|invoice|isbn|issn|doi|section|part|sku|serial|ticket|case)\b|[#v])\W*$"
CONTEXT = 40
#: Code points of the pieces that a text is rebuilt from.
PIECE = 1000
#: Labelers in the order of a vote code's digits; 0 abstains, 1 is for, 2 is against.
LABELERS = ("regex", "gazetteer", "context", "edges", "variety")


def running_sums(numbers: Column, join: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Sums of all entries before each place, one more than entries; or what another ``join`` with the unit 0 gives. In
    blocks of about the root of their number, as an array that grows by one entry is copied."""
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    n = F.size(numbers)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))),
                        lambda b: F.slice(numbers, b * width + 1, width))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), join))
    starts = F.aggregate(sums, zero, grow)
    inside = F.transform(parts, lambda p, i: F.slice(F.aggregate(p, F.array(F.get(starts, i)), grow), 1, F.size(p)))
    return F.concat(F.flatten(inside), F.array(F.element_at(starts, -1)))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(shape: Shape, found: Column) -> Column:
    """The check of a base match."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if shape.kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if shape.kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if shape.kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _worth(shape: Shape, found: Column) -> Column:
    """Matches that are candidates at all: the rest is no more than digits."""
    if shape.kind == "card":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(13, 19)
    return F.length(found) >= 7


def _votes(shape: Shape, found: Column, before: Column, after: Column, passed: Column) -> Column:
    """The labelers' votes as digits of base 3."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    vote = lambda test: F.when(test, 1).otherwise(2)
    regex = vote(passed) if shape.base else F.lit(0)
    known = {
        "email": lambda: vote(F.lower(found).rlike(rf"[.\x20)\]}}]({DOMAINS})$")),
        "ip": lambda: F.when(found.rlike(r"^(0|127|22[4-9]|2[3-5][0-9])\."), 2).otherwise(1),
        "card": lambda: vote(digits.rlike(f"^({ISSUERS})")),
        "phone": lambda: vote(digits.rlike(f"^({CALLING})")) if shape.base else F.lit(0),
    }[shape.kind]()
    context = F.when(before.rlike(WORDS_AGAINST), 2).when(before.rlike(WORDS_FOR[shape.kind]), 1).otherwise(0)
    edges = F.when(before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]"), 2).otherwise(1)
    plain = digits if shape.kind != "email" else F.regexp_replace(F.lower(found), "[^a-z]", "")
    variety = vote(F.size(F.array_distinct(F.split(plain, ""))) >= (3 if shape.kind != "email" else 4))
    code = F.lit(0)
    for v in (regex, known, context, edges, variety):
        code = code * 3 + v
    return code


def _judge(shape: Shape, gaps: str) -> Callable[[Column, Column], Column]:
    """The vote on the i-th match, from the text before and after it."""

    def judge(found: Column, i: Column) -> Column:
        before, after = F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.get(gaps, i + 1), F.lit(1))
        passed = _passes(shape, found)
        return F.struct((passed if shape.base else F.lit(False)).alias("base"), _worth(shape, found).alias("worth"),
                        _votes(shape, found, before, after, passed).alias("code"))

    return judge


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with, for each shape, the text between matches and the matches with their votes (hidden columns)."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    cut = {}
    for s in SHAPES:
        has = text.rlike(s.hint)
        cut[f"_gaps_{s.name}"] = F.when(has, F.split(text, s.pattern, -1)).otherwise(F.array(text))
        cut[f"_found_{s.name}"] = F.when(has, F.regexp_extract_all(text, F.lit(s.pattern), F.lit(0))).otherwise(none)
    docs = docs.withColumns(cut)
    voted = {}
    for s in SHAPES:
        voted[f"_votes_{s.name}"] = F.transform(F.col(f"_found_{s.name}"), _judge(s, f"_gaps_{s.name}"))
    return docs.withColumns(voted)


# ---- the model: reliabilities by expectation-maximisation, then a classifier of spans

def _digits(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


#: What a labeler's votes (none, for, against) are held for before any are counted, given the truth.
_YES, _NO, _NO_WEAK = (0.2, 0.7, 0.1), (0.2, 0.1, 0.7), (0.2, 0.4, 0.4)


def reliabilities(counts: dict[int, int], rounds: int = 40) -> dict[int, float]:
    """Chance that a vote code marks personal data: labelers are independent given the truth, each with its own rates
    of votes for, against and none. Starts from the share of votes for; a fifth as many supposed votes as candidates
    keep a labeler that is nearly always for (edges, variety) from settling the truth alone."""
    belief = {}
    for code in counts:
        votes = _digits(code)
        belief[code] = 0.2 if votes[0] == 2 else (votes.count(1) + 0.5) / (votes.count(1) + votes.count(2) + 1)
    total = sum(counts.values())
    supposed = 2 + total / 5
    for _ in range(rounds):
        mass = sum(n * belief[c] for c, n in counts.items())
        prior = (mass + supposed / 2) / (total + supposed)
        rate = {}
        for j, name in enumerate(LABELERS):
            guess = _NO_WEAK if name in ("edges", "variety") else _NO
            for v in range(3):
                yes = sum(n * belief[c] for c, n in counts.items() if _digits(c)[j] == v)
                no = sum(n * (1 - belief[c]) for c, n in counts.items() if _digits(c)[j] == v)
                rate[j, v] = (yes + supposed * _YES[v]) / (mass + supposed), (no + supposed * guess[v]) / (total - mass + supposed)
        for code in counts:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(_digits(code)):
                odds += math.log(rate[j, v][0] / rate[j, v][1])
            belief[code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def span_classifier(counts: dict[int, int], belief: dict[int, float], steps: int = 400) -> dict[int, float]:
    """Logistic regression on each labeler's votes for and against, trained on the beliefs."""
    codes = list(counts)
    rows = [[1.0] + [float(d == v) for d in _digits(c) for v in (1, 2)] for c in codes]
    # a start that agrees with the labelers settles what the sample says nothing of
    weights = [0.0] + [0.5, -0.5] * len(LABELERS)
    prior = list(weights)
    total = sum(counts.values()) or 1
    score = lambda row: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * x for w, x in zip(weights, row, strict=True))))))
    for _ in range(steps):
        slope = [0.01 * (w - p) for w, p in zip(weights, prior, strict=True)]
        for code, row in zip(codes, rows, strict=True):
            off = (score(row) - belief[code]) * counts[code] / total
            for j, x in enumerate(row):
                if x:
                    slope[j] += off * x
        weights = [w - 1.0 * s for w, s in zip(weights, slope, strict=True)]
    return {c: score(r) for c, r in zip(codes, rows, strict=True)}


@dataclass(frozen=True)
class Model:
    """Vote codes of each kind that the span classifier takes for personal data."""

    accepted: dict[str, tuple[int, ...]]


def _is(k: int) -> Callable[[Column], Column]:
    return lambda kind: kind == k


def _coded(shape: Shape) -> Callable[[Column], Column]:
    return lambda vote: F.struct(F.lit(shape.kind).alias("kind"), vote["code"].alias("code"))


def fit(docs: DataFrame, least: float = 0.9) -> Model:
    """Count the vote codes of all candidates of all texts (at most 243 for each kind reach the driver) and train."""
    found = with_candidates(docs.select("text"))
    every = F.concat(*[
        F.transform(F.filter(f"_votes_{s.name}", lambda v: v["worth"]), _coded(s)) for s in SHAPES])
    rows = found.select(F.explode(every).alias("c")).groupBy("c.kind", "c.code").count().collect()
    accepted = {}
    for kind in KINDS:
        counts = {r["code"]: r["count"] for r in sorted(rows) if r["kind"] == kind}
        scores = span_classifier(counts, reliabilities(counts)) if counts else {}
        # what fails its own check needs a context that speaks for it
        accepted[kind] = tuple(c for c, p in sorted(scores.items()) if p >= least and (_digits(c)[0] != 2 or _digits(c)[2] == 1))
    return Model(accepted)


def _taken(shape: Shape, vote: Column, model: Model) -> Column:
    codes = model.accepted.get(shape.kind, ())
    more = vote["worth"] & vote["code"].isin(*codes) if codes else F.lit(False)
    return vote["base"] | more if shape.base else more


def _span(shape: Shape, model: Model) -> Callable[[Column, Column], Column]:
    def span(vote: Column, i: Column) -> Column:
        start = F.get(f"_from_{shape.name}", i) + F.length(F.get(f"_gaps_{shape.name}", i))
        return F.struct(F.lit(KINDS.index(shape.kind)).alias("kind"), start.alias("start"),
                        F.get(f"_from_{shape.name}", i + 1).alias("stop"), vote["base"].alias("base"),
                        _taken(shape, vote, model).alias("taken"))

    return span


def _spans(docs: DataFrame, model: Model) -> tuple[DataFrame, Column]:
    """``docs`` with hidden columns, and the array of the spans that are taken, base and accepted."""
    found = with_candidates(docs)
    lengths = {}
    for s in SHAPES:
        lengths[f"_from_{s.name}"] = running_sums(F.zip_with(
            F.slice(f"_gaps_{s.name}", 1, F.size(f"_found_{s.name}")), f"_found_{s.name}",
            lambda g, m: F.length(g).cast("long") + F.length(m)))
    found = found.withColumns(lengths)
    spans = {}
    for s in SHAPES:
        spans[f"_spans_{s.name}"] = F.transform(f"_votes_{s.name}", _span(s, model))
    every = F.filter(F.concat(*[f"_spans_{s.name}" for s in SHAPES]), lambda x: x["taken"])
    return found.withColumns(spans), every


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """Personal data in every whole ``text`` (null: empty), one row for each input row, in one narrow stage.

    Base spans are the matches of the base shapes that pass their checks; the model adds candidates that it accepts.
    Columns: doc_id (null stays null), n_email, n_ip, n_card, n_phone (base), base_sha256 (of kind:start:end in code
    points, by kind, then start, comma-joined), spans (all of them likewise, empty if none). Repeated rows give repeated
    rows; columns of ``docs`` other than doc_id and text are not read.
    """
    found, every = _spans(docs.select("doc_id", "text"), model)
    text_of = lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["stop"])
    base = F.filter("_every", lambda x: x["base"])
    kept = found.select("doc_id", F.array_sort(F.transform(every, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["base"].alias("base")))).alias("_every"))
    return kept.select(
        "doc_id",
        *[F.size(F.filter(F.transform(base, lambda x: x["kind"]), _is(k))).cast("long").alias(f"n_{kind}")
          for k, kind in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform(base, text_of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.col("_every"), text_of), ",").alias("spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span of ``find_personal_data`` in ``text`` replaced by its kind in angle brackets; null stays null.

    Spans that overlap are replaced as one, from the first start to the last end, by the kind of the first, longest one.
    The text is rebuilt once, from what is between. One narrow stage.
    """
    names, schema = docs.columns, docs.schema
    found, every = _spans(docs, model)
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(
        x["start"].alias("start"), (-x["stop"]).alias("back"), x["kind"].alias("kind"))))
    text = found.select(*names, ordered.alias("_every"))
    text = text.withColumn("_reach", running_sums(F.transform("_every", lambda x: -x["back"]), lambda a, x: F.greatest(a, x)))
    # what is between spans is cut from pieces, as a cut counts code points from the start of its string
    text = text.withColumn("_pieces", F.when(F.size("_every") > 0, F.regexp_extract_all(
        "text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def between(start: Column, stop: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        some = F.slice("_pieces", first + 1, F.floor(stop / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))

    def part(span: Column, i: Column) -> Column:
        before = F.get("_reach", i)
        tag = F.concat(F.lit("<"), F.get(F.array(*map(F.lit, KINDS)), span["kind"]), F.lit(">"))
        return F.when(span["start"] >= before, F.concat(between(before, span["start"]), tag)).otherwise("")

    rest = between(F.element_at("_reach", -1), F.length("text").cast("long"))
    whole = F.concat(F.array_join(F.transform("_every", part), ""), rest)
    clean = F.when(F.size("_every") > 0, whole).otherwise(F.col("text"))
    return text.select(*[clean.alias("text") if c == "text" else F.col(c) for c in names]).to(schema)

"""A labelled bank as a model: neighbours, centroids and rule features give each text benchmark probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import numeric as nu
from prosegauge.lexicons import LEXICON, STANCES
from prosegauge.operators import evaluate as ev, stance
from prosegauge.session import checkpointed, stored

c = F.col
#: Neighbours whose votes count.
NEIGHBOURS = 16


@dataclass
class Bank:
    """Labelled samples (id, label, embedding) and the centroids of their labels, embeddings and rule features."""

    samples: DataFrame
    centroids: DataFrame
    labels: Sequence[str]
    lex: stance.Lex


def with_features(df: DataFrame, lex: stance.Lex = LEXICON, text: str = "text", name: str = "features") -> DataFrame:
    """``df`` with the ten rule features of its text; a NULL text has those of an empty one."""
    # a column of its own: inside the features each marker would lower the text anew
    whole = F.coalesce(c(text), F.lit(""))
    low = df.withColumn("_lowered", F.lower(whole))
    return low.withColumn(name, stance.feature_vector(c("_lowered"), whole, lex)).drop("_lowered")


def fit(samples: DataFrame, lex: stance.Lex = LEXICON, labels: Sequence[str] = STANCES) -> Bank:
    """The bank of ``samples`` (id, label, text, embedding); those without a vector or a label of ``labels`` take no part.

    One aggregate sums embeddings and features per label; the samples themselves stay where they are.
    """
    known = samples.filter(c("embedding").isNotNull() & c("label").isin(*labels))
    centroids = checkpointed(ev.label_centroids(with_features(known, lex), features="features"))
    return Bank(known.select("id", "label", "embedding"), centroids, labels, lex)


def _with_chances(rows: DataFrame, bank: Bank, k: int) -> DataFrame:
    """``rows`` (text, embedding) and ``_chance``, the probability of each of the bank's labels, in their order.

    Rows of the same vector have the same neighbours: these are looked for once a vector, and their votes join as one
    array. Centroids are compared in place, so a row stays one row. Rows without a vector are spread over the join.
    """
    labels = list(bank.labels)

    def in_order(by_label: str) -> Column:
        return F.array(*[F.coalesce(F.try_element_at(c(by_label), F.lit(x)), F.lit(0.0)) for x in labels])

    vectors = stored(rows.filter(c("embedding").isNotNull()).select("embedding").distinct().withColumn(
        "id", F.monotonically_increasing_id()))
    votes = ev.knn_label_votes(vectors, bank.samples, k).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "votes"))).alias("_all"))
    voted = vectors.join(votes, "id", "left").select(c("embedding").alias("_vec"), F.xxhash64("embedding").alias("_at"),
                                                     in_order("_all").alias("_votes"))
    # no constant in place of the hash: it would leave the join's keys, and all rows without a vector would meet in one task
    spread = rows.withColumn("_spread", F.when(c("embedding").isNull(), F.monotonically_increasing_id()).otherwise(
        F.xxhash64("embedding")))
    met = spread.join(voted, (c("_spread") == c("_at")) & (c("embedding") == c("_vec")), "left").drop("_spread", "_at", "_vec")
    # rows without a vector have no votes and need no features; what is used several times is a column, so that it is made once
    own = with_features(met.withColumn("_own", F.when(c("embedding").isNotNull(), c("text"))), bank.lex, "_own")
    scored = ev.with_centroid_scores(own, bank.centroids, "_centred", features="features").drop("_own", "features")
    raw = F.zip_with("_votes", in_order("_scores"), lambda a, b: F.greatest(a + b, F.lit(0.0)))
    even = F.array(*[F.lit(1.0 / len(labels))] * len(labels))
    made = scored.withColumn("_scores", F.map_from_entries("_centred")).withColumn("_raw", raw).withColumn(
        "_mass", F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x))
    return made.withColumn("_chance", F.when(c("_mass") > 0, F.transform(
        "_raw", lambda x: nu.rounded(x / c("_mass"), 4))).otherwise(even)).drop("_scores", "_raw", "_mass", "_votes", "_centred")


def probabilities(queries: DataFrame, bank: Bank, k: int = NEIGHBOURS) -> DataFrame:
    """``id``, ``label`` and ``probability`` for every label of the bank and every row of ``queries`` (id, text, embedding).

    Squared similarities of the ``k`` nearest samples, plus 0.35 of the closeness to the label's embedding centroid and
    0.25 of that to its feature centroid, divided by their sum and rounded to four digits. Without a vector, or with an
    empty bank, all labels are equally likely. Ids are unique.
    """
    found = _with_chances(queries.select("id", "text", "embedding"), bank, k)
    # unrolled where it is made, as in ``evaluate.centroid_scores``
    return found.select("id", F.inline(F.array(*[
        F.struct(F.lit(x).alias("label"), F.get("_chance", F.lit(i)).alias("probability")) for i, x in enumerate(bank.labels)])))


def with_benchmark(paras: DataFrame, bank: Bank, k: int = NEIGHBOURS) -> DataFrame:
    """``paras`` (with text and embedding) and the columns ``bench_<label>`` that ``stance.paragraph_stance`` reads."""
    found = _with_chances(paras, bank, k)
    return found.select(*paras.columns, *[F.get("_chance", F.lit(i)).alias(f"bench_{x.lower()}") for i, x in enumerate(bank.labels)])

"""Model hooks: user-supplied scorers and encoders, and adapters of their output.

No model ships with the package. Scores normally arrive as a table that is
joined on; a callable can be run instead, batch by batch, inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

MODEL_COLUMNS = ["toxic", "anger", "sadness", "fear", "joy", "love", "negative", "neutral", "positive"]


def with_model_scores(df: DataFrame, make_model: Callable[[], Callable[[list[str]], pd.DataFrame]],
                      cols: Sequence[str] = MODEL_COLUMNS, text: str = "text") -> DataFrame:
    """Add ``cols`` scored by a model that ``make_model`` builds once per task."""
    out = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in cols]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            scores = model(batch[text].fillna("").tolist()).reset_index(drop=True)
            yield pd.concat([batch.reset_index(drop=True), scores[list(cols)].astype(float)], axis=1)

    return df.mapInPandas(run, out)


def with_embeddings(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
                    out: str = "embedding", text: str = "text") -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            vectors = [list(map(float, v)) for v in encode(batch[text].fillna("").tolist())]
            yield batch.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def join_scores(paras: DataFrame, scores: DataFrame | None, keys: Sequence[str] = ("doc_id", "para_ix"),
                cols: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Pre-computed scores by key; a paragraph without scores gets zeros."""
    if scores is None:
        return paras.withColumns({c: F.lit(0.0) for c in cols if c not in paras.columns})
    have = [c for c in cols if c in scores.columns]
    joined = paras.join(scores.select(*keys, *have), list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in cols})


def _label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def score_columns(output: Column) -> dict[str, Column]:
    """Named columns from a classifier's ARRAY<STRUCT<label, score>>.

    Emotions match by exact label, sentiment by prefix fragment; toxicity is
    ``toxic`` or one minus ``non_toxic``.
    """
    items = F.transform(output, lambda e: F.struct(_label_key(e["label"]).alias("label"), e["score"].alias("score")))

    def last(match: Callable[[Column], Column]) -> Column:
        found = F.filter(items, lambda e: match(e["label"]))
        return F.when(F.size(found) > 0, F.get(found, F.size(found) - 1)["score"])

    def exact(name: str) -> Column:
        return last(lambda lab: lab == name)

    neg = last(lambda lab: lab.contains("neg"))
    neu = last(lambda lab: lab.contains("neu") & ~lab.contains("neg"))
    pos = last(lambda lab: lab.contains("pos") & ~lab.contains("neg") & ~lab.contains("neu"))
    cols = {n: exact(n) for n in ("anger", "sadness", "fear", "joy", "love")}
    cols |= {"negative": neg, "neutral": neu, "positive": pos,
             "toxic": F.coalesce(exact("toxic"), 1.0 - exact("non_toxic"))}
    return {n: F.coalesce(c, F.lit(0.0)) for n, c in cols.items()}


def sentiment_name(label: Column) -> Column:
    """0/1/2 or free-form labels to negative, neutral, positive."""
    lab = F.lower(label.cast("string"))
    return (F.when(lab == "2", "positive").when(lab == "1", "neutral").when(lab == "0", "negative")
            .when(lab.contains("pos"), "positive").when(lab.contains("neu"), "neutral").otherwise("negative"))


def tiebreak(df: DataFrame, hook: str, label: str = "writer_type", gap: str = "writer_gap",
             allowed: Mapping[str, object] | Sequence[str] = ()) -> DataFrame:
    """Take the hook column's answer where the two best types are within .08."""
    answer = F.col(hook)
    valid = answer.isin(*allowed) if allowed else answer.isNotNull()
    return df.withColumn(label, F.when((F.col(gap) < 0.08) & valid, answer).otherwise(F.col(label)))

"""Quality classifier: Bradley-Terry pairwise ranking on text features.

A pair of documents, one labelled better than the other, is won by the
better one with probability sigmoid(s(better) - s(worse)), s = w . x. The
weights minimise the logistic loss over feature differences of sampled pairs
(Newton steps with a ridge). Documents are then cut at a quantile of the
scores of all labelled documents: the share of lesser ones among them. The
reported score is sigmoid(s - cut + logit(threshold)), so it meets the
threshold at the cut.

The fit alone uses at most ``per_class`` labelled documents of each class,
those with the smallest hash of their id (a bounded sample, the same at every
run); the quantile is an exact order statistic over every labelled document,
features and scores cover all documents and whole texts.

Defined results: null text reads as empty; empty texts are scored like any
other; labels that are null or whose document is missing teach nothing; with
one class only, every score is 1 or 0 by that class, with none 0.5; repeated
rows are scored one by one; columns of the output's names are replaced.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from offerlab.functions.stats import order_statistics
from offerlab.llm.common import in_filter, need, text_or_empty, written

FEATURES = ("symbols", "pipes", "bangs", "capitals", "twins", "repeats", "repeats_in_lines", "variety",
            "word_length", "digits", "marks", "words", "short")
SYMBOLS = "#*$%&<>~^=_{}[]@\\"
#: Slots of the filter on labelled ids, as a power of two.
FILTER_BITS = 25
NOT_WORDS = re.compile(r"[^\w\s]|_")


def features(text: str) -> list[float]:
    """Shares and logarithms, each about 0 to 1; a text's length counts only through 'words' and 'short'."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lower = text.lower()
    letters = len(re.findall(r"[^\W\d_]", lower)) or 1
    capitals = sum(map(operator.ne, text, lower)) if len(text) == len(lower) else sum(map(str.isupper, text))
    lines = dict.fromkeys(x.strip() for x in text.split("\n"))
    once = words if len(lines) == text.count("\n") + 1 else [w for x in lines for w in x.split()]
    return [
        min(1.0, sum(map(text.count, SYMBOLS)) / n),
        min(1.0, 3 * text.count("|") / n),
        min(1.0, text.count("!") / n),
        capitals / letters,
        min(1.0, 3 * sum(map(operator.eq, words, words[1:])) / n),
        repeated(words) / n,
        repeated(once) / max(1, len(once)),
        min(1.0, len(set(once)) / max(1.0, len(once)) ** 0.9),
        min(1.0, sum(map(len, words)) / n / 20),
        sum(map(str.isdigit, words)) / n,
        min(1.0, len(NOT_WORDS.findall(text)) / (2 * n)),
        min(1.0, math.log(n) / 12),
        1 / n,
    ]


def repeated(words: list[str], window: int = 5) -> int:
    """Words in windows that come up before in the text."""
    seen, n = set(), 0
    for w in zip(*(words[i:] for i in range(window))):
        if w in seen:
            n += 1
        else:
            seen.add(w)
    return n


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in texts], dtype=object)

    return df.withColumn(out, run(text_or_empty(text)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, ridge: float = 1.0, pairs: int = 100_000, steps: int = 30, seed: int = 5):
    """Weights of w . (good - bad) by Newton steps on the logistic loss over sampled pairs."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_features(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """(_id, _y, _x): labels that have a document, with its features; ``docs`` has (_id, text), ``known`` (_id, _y).

    Features are taken where the documents lie, so that a few numbers of each document are shuffled, and no text.
    A filter of fixed size on the ids spares most documents without a label; the join is exact.
    """
    docs = docs.where("_id is not null")
    kind = docs.schema["_id"].dataType
    if kind == known.schema["_id"].dataType and isinstance(kind, (T.IntegralType, T.StringType)):  # else equal ids may have different hashes
        may_be_known = in_filter(known.select(F.xxhash64("_id").alias("h")), FILTER_BITS)
        docs = docs.where(may_be_known(F.xxhash64("_id")))
    rows = with_features(docs, text, "_x").select("_id", "_x")
    return rows.join(known, "_id").groupBy("_id", "_y").agg(F.min("_x").alias("_x"))


def score_quality(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality",
                  threshold: float = 0.3, per_class: int = 5_000) -> DataFrame:
    """Adds score (0 to 1) and predicted to ``docs``; ``labels`` (doc, label 0/1) is all that may be learned from."""
    need(docs, doc, text)
    need(labels, doc, label)
    docs = docs.drop("score", "predicted")
    known = labels.select(F.col(doc).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    taught = written(labelled_features(docs.select(F.col(doc).alias("_id"), text), known, text), "labelled")
    lesser = taught.where("_y = 0").count()
    rows = pd.concat([taught.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class).toPandas() for y in (0, 1)])
    rows = rows.sort_values("_id")  # at most 2 x per_class rows; sorted, so that the fit does not depend on arrival
    x = np.array(rows["_x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    y = rows["_y"].to_numpy()
    score = F.col("__score")
    if (y == 1).any() and (y == 0).any():
        w = fit_pairs(x[y == 1], x[y == 0])
        cut = quantile_cut(taught.select(sum(F.col("_x")[i] * float(v) for i, v in enumerate(w)).alias("s")), lesser)
        w, shift = w.tolist(), math.log(threshold / (1 - threshold)) - cut

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            raw = np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES)) @ np.array(w) + shift
            return pd.Series(1 / (1 + np.exp(-np.clip(raw, -500, 500))))

        scored = docs.withColumn("__score", run(text_or_empty(text)))
    else:
        scored = docs.withColumn("__score", F.lit(1.0 if (y == 1).any() else 0.0 if (y == 0).any() else 0.5))
    return scored.withColumn("score", score).withColumn("predicted", (score >= threshold).cast("int")).drop("__score")


def quantile_cut(scores: DataFrame, below: int) -> float:
    """The score ``s`` that ``below`` rows lie below; halfway between the scores on both sides."""
    found = order_statistics(scores, {"s": [below - 1, below]})
    return (found["s", below - 1] + found["s", below]) / 2

"""Quality rules with robust multivariate outliers (minimum covariance determinant).

Each text gives counts; a text fails the base rules with fewer than
``min_words`` words or with more than ``most_repeats`` of its words inside
repeated five-word windows. The others become a vector of transformed
statistics. Per language and source, a minimum-covariance-determinant
estimate is found by concentration steps: keep the share ``support`` of the
rows nearest by Mahalanobis distance, take their mean and covariance, repeat.
The steps run from three starts at once (medians and median deviations; mean
and covariance; spatial signs about the medians), and the end with the least
determinant is taken. A row farther than the cutoff is rejected.

All estimates are grouped sums and mergeable quantile sketches over every
row, so a source that holds a third of the corpus combines before the
shuffle. A group of n rows is pooled with its language's estimate, which
counts as ``prior_rows`` more rows, and the language's with the corpus'
likewise; the corpus' covariance is widened by 1 + prior_rows / n. So small
groups lean on larger ones without a switch. Noise floors keep a statistic
that hardly varies from rejecting harmless texts.

Defined results: null text has no words and fails; null language or source
is a group of its own; repeated rows count one by one; an empty table gives
an empty one; columns of the output's names are replaced.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from offerlab.llm.common import need, text_or_empty, written

SYMBOLS = "#*$%&|<>"
#: Transformed statistics and their noise floors (standard deviations that are taken as harmless)
STATS = {"length": 0.15, "symbols": 0.4, "lines": 0.6, "repeats": 0.8, "words": 0.4}
DIM = len(STATS)
#: Parts that a level is split into in joins.
SALTS = 32


def base_counts(text: str, window: int = 5) -> tuple[int, int, int, int, int]:
    """(words, word_chars, symbols, duplicate lines, words in repeated windows)"""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: cut at ASCII white space only
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if n > window:
        number: dict = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        windows = list(zip(*(ids[i:] for i in range(window))))
        first, again = {}, set()
        for w in windows:
            if first.setdefault(w, w) is not w:
                again.add(w)
        end = 0
        if again:
            for i, w in enumerate(windows):
                if w in again:
                    repeats += i + window - max(i, end)
                    end = i + window
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([base_counts(x) for x in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return (df.withColumn("__counts", run(text_or_empty(text))).withColumns({c: F.col(f"__counts.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}).drop("__counts"))


def chi2_share(x: float, k: float) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-15:
        i += 1
        term *= z / i
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z > 0 else 0.0


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, k) < p else (low, mid)
    return (low + high) / 2


def _distance() -> F.Column:
    """Squared Mahalanobis distance of x to the joined estimate (mean, inverse)."""
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(DIM)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.col("inverse")[i * DIM + j] for i, j in combinations_with_replacement(range(DIM), 2)]
    return sum(terms[1:], terms[0])


PAIRS = list(combinations_with_replacement(range(DIM), 2))
ESTIMATE = "level string, start int, mean array<double>, cov array<double>, inverse array<double>, logdet double"


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and second moments of x by level and start."""
    return rows.groupBy("level", "start").agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(DIM)]).alias("mean"),
        F.array(*[F.avg(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS]).alias("second"))


def _inverted(moments: DataFrame, factor: float, floors: np.ndarray) -> DataFrame:
    """Means, covariances, their inverses and determinants from grouped moments, one small row per group and start."""
    def run(batches):
        for m in batches:
            covs, inverses, dets = [], [], []
            for row in m.to_dict("records"):
                mean = np.array(row["mean"])
                second = np.zeros((DIM, DIM))
                for (i, j), v in zip(PAIRS, row["second"]):
                    second[i, j] = second[j, i] = v
                # the noise floor keeps the estimate regular; rounding may leave a tiny negative part
                cov = factor * (second - np.outer(mean, mean)) + np.diag(floors ** 2)
                covs.append(cov.ravel().tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame({"level": m["level"], "start": m["start"], "mean": m["mean"], "cov": covs, "inverse": inverses, "logdet": dets})

    return moments.mapInPandas(run, ESTIMATE)


def pooled(chain: list[tuple[int, np.ndarray, np.ndarray]], prior_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the last of (rows, mean, covariance), each pooled with the one before it as ``prior_rows`` rows."""
    n, mean, cov = chain[0]
    cov = cov * (1 + prior_rows / n)
    for n, m, c in chain[1:]:
        a = n / (n + prior_rows)
        apart = m - mean
        mean, cov = a * m + (1 - a) * mean, a * c + (1 - a) * cov + a * (1 - a) * np.outer(apart, apart)
    return mean, cov


def salted(table: DataFrame) -> DataFrame:
    """A small table with each row once per salt; the other side's rows carry a salt of their own."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def estimates(rows: DataFrame, support: float, steps: int) -> DataFrame:
    """(level, mean, cov) from rows (level, salt, x) by concentration steps; x holds the transformed statistics.

    Joins are by (level, salt), so a level with many rows is spread before its sums combine.
    """
    floors = np.array(list(STATS.values()))
    factor = support / chi2_share(chi2_quantile(support, DIM), DIM + 2)
    accuracy = 2000
    middle = rows.groupBy("level").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, accuracy) for i in range(DIM)]).alias("mean"))
    middle = written(middle, "medians")
    away = [F.col("x")[i] - F.col("mean")[i] for i in range(DIM)]
    spread = rows.join(salted(middle), ["level", "salt"]).groupBy("level").agg(F.array(*[
        F.percentile_approx(F.abs(d), 0.5, accuracy) for d in away]).alias("mad"))
    width = lambda i: F.pow(1.4826 * F.col("mad")[i], 2) + float(floors[i]) ** 2
    centre = written(middle.join(spread, "level").select("level", "mean", F.array(*[width(i) for i in range(DIM)]).alias("width")), "centres")
    # the starts, as first and second moments that give their means and covariances
    second = lambda c: F.array(*[c(i, j) + F.col("mean")[i] * F.col("mean")[j] for i, j in PAIRS]).alias("second")
    from_medians = centre.select("level", F.lit(0).alias("start"), "mean", second(lambda i, j: F.col("width")[i] if i == j else F.lit(0.0)))
    from_all = _moments(rows.withColumn("start", F.lit(1)))
    reach = sum(d * d / F.col("width")[i] for i, d in enumerate(away))
    signs = rows.join(salted(centre), ["level", "salt"]).withColumn("reach", F.when(reach > 0, reach))
    from_signs = signs.groupBy("level", "mean").agg(F.array(*[
        F.coalesce(F.avg(DIM * away[i] * away[j] / F.col("reach")), F.lit(0.0)) for i, j in PAIRS]).alias("signs"))
    at = {p: k for k, p in enumerate(PAIRS)}
    from_signs = from_signs.select("level", F.lit(2).alias("start"), "mean", second(lambda i, j: F.col("signs")[at[i, j]]))
    now = written(_inverted(from_medians.unionByName(from_all).unionByName(from_signs), 1.0, floors), "estimate")
    for _ in range(steps):
        measured = rows.join(salted(now), ["level", "salt"]).select("level", "start", _distance().alias("d2"))
        limit = written(measured.groupBy("level", "start").agg(F.percentile_approx("d2", support, accuracy).alias("limit")), "limits")
        near = rows.join(salted(now.join(limit, ["level", "start"])), ["level", "salt"]).where(_distance() <= F.col("limit"))
        now = written(_inverted(_moments(near), factor, floors), "estimate")
    return now.groupBy("level").agg(F.min_by(F.struct("mean", "cov"), F.struct("logdet", "start")).alias("_e")).select("level", "_e.mean", "_e.cov")


def apply_rules(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source"), min_words: int = 10,
                most_repeats: float = 0.2, support: float = 0.75, confidence: float = 0.99999, steps: int = 5, prior_rows: int = 100,
                keep: list[str] | None = None) -> DataFrame:
    """Adds the counts, base_failed and kept; ``keep`` names the columns to carry (all but the text by default)."""
    need(docs, text, *groups)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    carried = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in made]
    packed = docs.select(F.struct(*[F.col(c) for c in carried]).alias("_row"), F.col(text).alias("_text"),
                         *[F.col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(groups)])
    named = [F.coalesce(F.concat(F.lit("="), F.col(f"_g{i}")), F.lit("-")) for i in range(2)]
    levels = [F.concat(named[0], F.lit("\n"), named[1]), named[0], F.lit("*")]
    counted = with_counts(packed, "_text").drop("_text").withColumn("base_failed", (
        (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * most_repeats)) * F.col("n_words"))))
    n = F.col("n_words")
    x = F.array(F.log(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / F.col("word_chars")),
                F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n), F.log(n))
    counted = written(counted.withColumn("x", F.when(~F.col("base_failed"), x)).withColumn("_levels", F.array(*levels))
                      .withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).drop("_g0", "_g1"), "counts")
    rows = counted.where("x is not null").select(F.explode("_levels").alias("level"), "salt", "x")
    rows = written(rows, "vectors")
    final = estimates(rows, support, steps)
    cutoff = chi2_quantile(confidence, DIM)
    # one small row per (group, language, corpus)
    sized = final.join(rows.groupBy("level").count(), "level").select("level", F.struct("count", "mean", "cov").alias("_e"))
    wanted = counted.where("x is not null").select("_levels").distinct().select("_levels", F.posexplode("_levels").alias("_at", "level"))
    chains = wanted.join(sized, "level").groupBy("_levels").agg(F.sort_array(F.collect_list(F.struct("_at", "_e")), asc=False).alias("_chain"))

    def choose(batches):
        for m in batches:
            ends = [pooled([(r["_e"]["count"], np.array(r["_e"]["mean"]), np.array(r["_e"]["cov"]).reshape(DIM, DIM)) for r in chain], prior_rows)
                    for chain in m["_chain"]]
            yield pd.DataFrame({"_levels": m["_levels"], "mean": [e[0].tolist() for e in ends],
                                "inverse": [np.linalg.inv(e[1]).ravel().tolist() for e in ends]})

    best = written(chains.mapInPandas(choose, "_levels array<string>, mean array<double>, inverse array<double>"), "chosen")
    judged = counted.join(salted(best), ["_levels", "salt"], "left")
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(_distance() <= cutoff, F.lit(True)))
    return judged.select("_row.*", *made[:6], verdict.alias("kept"))

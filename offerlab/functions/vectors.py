"""Expression helpers over short fixed-width vectors.

A k-vector (k actions, k policies, d context features) is carried as a
Python list of k SQL expression strings; the helpers compose those strings
and the caller turns each finished entry into a Column with ``F.expr``.
The result is plain scalar arithmetic that Catalyst folds and whole-stage
codegen compiles (no higher-order-function interpretation, no Python UDF),
and building it costs one JVM call per output column instead of one per
expression node.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F

EPS = 1e-8

Vec = Sequence[str]


def lit(v: float) -> str:
    """Double literal that parses back to the same binary value."""
    return f"CAST({repr(float(v))} AS DOUBLE)"


def col(name: str) -> str:
    return f"`{name}`"


def cols(prefix: str, k: int) -> list[str]:
    return [f"`{prefix}{i}`" for i in range(k)]


def lit_vec(values) -> list[str]:
    return [lit(v) for v in values]


def from_array(array_col: str, k: int) -> list[str]:
    return [f"CAST(`{array_col}`[{i}] AS DOUBLE)" for i in range(k)]


def E(s: str) -> Column:
    return F.expr(s)


def to_array(v: Vec) -> Column:
    return F.expr("array(" + ", ".join(v) + ")")


def vsum(v: Vec) -> str:
    out = v[0]
    for x in v[1:]:
        out = f"({out} + {x})"
    return out


def vmean(v: Vec) -> str:
    return f"({vsum(v)} / {lit(len(v))})"


def dot(a: Vec, b: Vec) -> str:
    return vsum([f"({x} * {y})" for x, y in zip(a, b)])


def vmax(v: Vec) -> str:
    return f"greatest({', '.join(v)})" if len(v) > 1 else v[0]


def vmin(v: Vec) -> str:
    return f"least({', '.join(v)})" if len(v) > 1 else v[0]


def clip(c: str, lo: float | None = None, hi: float | None = None) -> str:
    if lo is not None:
        c = f"greatest({c}, {lit(lo)})"
    if hi is not None:
        c = f"least({c}, {lit(hi)})"
    return c


def argmax(v: Vec) -> str:
    """Index of the first maximum (numpy argmax tie rule)."""
    m = vmax(v)
    whens = " ".join(f"WHEN {x} >= {m} THEN {i}" for i, x in enumerate(v[:-1]))
    return f"(CASE {whens} ELSE {len(v) - 1} END)" if len(v) > 1 else "0"


def pick(v: Vec, idx: str) -> str:
    """v[idx] for a per-row integer index (NULL when out of range)."""
    whens = " ".join(f"WHEN {idx} = {i} THEN {x}" for i, x in enumerate(v))
    return f"(CASE {whens} END)"


def softmax(v: Vec) -> list[str]:
    """Row softmax shifted by the row max; the denominator floored at EPS."""
    m = vmax(v)
    ex = [f"exp({x} - {m})" for x in v]
    den = f"greatest({vsum(ex)}, {lit(EPS)})"
    return [f"({e} / {den})" for e in ex]


def pop_std(v: Vec) -> str:
    mu = vmean(v)
    return f"sqrt({vmean([f'(({x} - {mu}) * ({x} - {mu}))' for x in v])})"


def row_standardize(v: Vec) -> list[str]:
    """(x - mean) / max(population std, EPS) across one row."""
    mu = vmean(v)
    sd = f"greatest({pop_std(v)}, {lit(EPS)})"
    return [f"(({x} - {mu}) / {sd})" for x in v]


def minmax(v: Vec) -> list[str]:
    """Row min-max to [0,1]; a range below EPS gives all zeros."""
    lo, hi = vmin(v), vmax(v)
    rng = f"({hi} - {lo})"
    return [f"(CASE WHEN {rng} < {lit(EPS)} THEN {lit(0.0)} ELSE (({x} - {lo}) / {rng}) END)" for x in v]


def to_distribution(v: Vec) -> list[str]:
    """Negatives to 0, normalise to sum 1; a total <= EPS gives uniform."""
    pos = [f"greatest({x}, {lit(0.0)})" for x in v]
    tot = vsum(pos)
    return [f"(CASE WHEN {tot} <= {lit(EPS)} THEN {lit(1.0 / len(v))} ELSE ({p} / {tot}) END)" for p in pos]


def floor_propensity(v: Vec, min_p: float) -> list[str]:
    """p*(1-k*m)+m then renormalise, when 0 < m < 1/k; else unchanged."""
    k = len(v)
    if not (0.0 < min_p < 1.0 / k):
        return list(v)
    q = [f"(({x} * {lit(1.0 - k * min_p)}) + {lit(min_p)})" for x in v]
    den = f"greatest({vsum(q)}, {lit(EPS)})"
    return [f"({x} / {den})" for x in q]


def quad_form(x: Vec, m) -> str:
    """x^T M x for a literal matrix M (zero entries skipped)."""
    terms = [f"(({x[i]} * {x[j]}) * {lit(m[i][j])})"
             for i in range(len(x)) for j in range(len(x)) if m[i][j] != 0.0]
    return vsum(terms) if terms else lit(0.0)


def top_indices(v: Vec, n: int) -> str:
    """Indices of the n largest entries, score descending, ties by higher
    index first (the order a reversed ascending stable sort gives)."""
    pairs = ", ".join(f"named_struct('s', {x}, 'i', {i})" for i, x in enumerate(v))
    return f"transform(slice(reverse(array_sort(array({pairs}))), 1, {n}), p -> p.i)"


def with_vec(df, prefix: str, v: Vec):
    """Attach a vector as columns prefix0..prefix{k-1} in one projection."""
    return df.withColumns({f"{prefix}{i}": F.expr(x) for i, x in enumerate(v)})

"""Alignment of two word lists, and the small network that corrects word times."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

_DROP = str.maketrans("", "", string.punctuation)


def edit_distance(a: str, b: str) -> int:
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def aligned(source: list[str], other: list[str], radius_part: float = 0.1, radius: int = 32) -> list[str]:
    """For each source word the other words that time warping puts to it, joined by blanks;
    each other word is used once. Pairs further apart than the radius cost 9999. Only the
    band is filled, so long lists take memory in proportion."""
    n = len(source)
    r = int(max(n * radius_part, radius))
    other = other[: n + r] if len(other) > n else other
    m = len(other)
    if not n or not m:
        return [""] * n
    a, b = ([w.translate(_DROP).strip().lower() for w in ws] for ws in (source, other))
    known: dict = {}

    def cost(i: int, j: int) -> float:
        if not max(i - r, 0) <= j < min(i + r, m):
            return 9999.0
        key = (a[i], b[j])
        if key not in known:
            known[key] = edit_distance(*key)
        return known[key]

    # Row by row over the columns a path can sensibly use: the band, widened to reach the end.
    lo = [max(0, min(i - r, m - 1)) for i in range(n)]
    hi = [m if i == n - 1 else min(m, i + r + 1) for i in range(n)]
    total, back = [], []
    for i in range(n):
        t, p = np.full(hi[i] - lo[i], np.inf), np.zeros(hi[i] - lo[i], np.int8)
        for j in range(lo[i], hi[i]):
            best, how = (0.0, 0) if i == 0 and j == 0 else (np.inf, 0)
            if i and lo[i - 1] <= j - 1 < hi[i - 1] and total[-1][j - 1 - lo[i - 1]] < best:
                best, how = total[-1][j - 1 - lo[i - 1]], 1
            if i and lo[i - 1] <= j < hi[i - 1] and total[-1][j - lo[i - 1]] < best:
                best, how = total[-1][j - lo[i - 1]], 2
            if j > lo[i] and t[j - 1 - lo[i]] < best:
                best, how = t[j - 1 - lo[i]], 3
            t[j - lo[i]], p[j - lo[i]] = best + cost(i, j), how
        total.append(t)
        back.append(p)
    path, i, j = [], n - 1, m - 1
    while True:
        path.append((i, j))
        if i == 0 and j == 0:
            break
        how = back[i][j - lo[i]]
        i, j = (i - 1, j - 1) if how == 1 else (i - 1, j) if how == 2 else (i, j - 1)
    out, seen = [[] for _ in source], -1
    for i, j in reversed(path):
        if j > seen:
            out[i].append(other[j])
        seen = j
    return [" ".join(x) for x in out]


@F.pandas_udf(ArrayType(StringType()))
def aligned_words(source: pd.Series, other: pd.Series) -> pd.Series:
    """aligned() row by row; a null list counts as an empty one."""
    return pd.Series([aligned(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(source, other)])


def offset_network(weights: dict[str, np.ndarray]):
    """A function of a column of 18 features (array) that gives the two time offsets:
    standardised, two layers of 32 with relu, tanh, times exp(temp), plus bias. Weights:
    mean, std (18), w0 (32x18), b0, w1 (32x32), b1, w2 (2x32), b2, temp, bias (2)."""
    w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @F.pandas_udf(ArrayType(FloatType()))
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        f = (np.stack(x.to_numpy()).astype(np.float32) - w["mean"]) / w["std"]
        h = np.maximum(f @ w["w0"].T + w["b0"], 0)
        h = np.maximum(h @ w["w1"].T + w["b1"], 0)
        return pd.Series(list(np.tanh(h @ w["w2"].T + w["b2"]) * np.exp(w["temp"]) + w["bias"]))

    def apply(features: Column) -> Column:
        return run(features)

    return apply

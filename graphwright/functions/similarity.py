"""Similarity of texts, vectors, places and periods as native expressions; null where it cannot be computed."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphwright import config


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity over code points: 1 for equal texts, 0 if one is empty; greedy matching within max(len) // 2 - 1.

    Folds over the characters of ``a`` and keeps the used positions of ``b``;
    stays in the plan, no Python.
    """
    ca, cb = F.split(a, ""), F.split(b, "")
    la, lb = F.length(a), F.length(b)
    window = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, ch: Column) -> Column:
        lo, hi = F.greatest(acc["i"] - window, F.lit(0)), F.least(acc["i"] + window, lb - 1)
        options = F.when(lo <= hi, F.filter(F.sequence(lo, hi), lambda j: (F.get(cb, j) == ch) & ~F.array_contains(acc["used"], j))).otherwise(F.array().cast("array<int>"))
        j = F.get(options, F.lit(0))
        return F.struct((acc["i"] + 1).alias("i"), F.when(j.isNotNull(), F.array_append(acc["used"], j)).otherwise(acc["used"]).alias("used"), F.when(j.isNotNull(), F.array_append(acc["got"], ch)).otherwise(acc["got"]).alias("got"))

    m = F.aggregate(ca, start, step)
    matched = F.transform(F.array_sort(m["used"]), lambda j: F.get(cb, j))
    n = F.size(m["got"])
    swaps = F.floor(F.size(F.filter(F.zip_with(m["got"], matched, lambda x, y: x != y), lambda z: z)) / 2)
    score = F.when(n == 0, F.lit(0.0)).otherwise((n / la + n / lb + (n - swaps) / n) / 3.0)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(score)


def jaro_winkler(a: Column, b: Column, prefix_weight: float = 0.1) -> Column:
    """Jaro similarity raised for up to four common first characters, at any similarity."""
    j = jaro(a, b)
    same = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
    long = lambda k: (F.length(a) >= k) & (F.length(b) >= k)
    p = F.when(long(4) & same(4), 4).when(long(3) & same(3), 3).when(long(2) & same(2), 2).when(long(1) & same(1), 1).otherwise(0)
    return j + p * F.lit(prefix_weight) * (1 - j)


def best_name_similarity(a: Column, b: Column) -> Column:
    """Greatest Jaro-Winkler over all pairs of names; null if a side has none."""
    all_ = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: jaro_winkler(x, y))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_max(all_))


def jaro_of(a: str, b: str) -> float:
    """``jaro`` of two texts in plain Python."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window, free, mine = max(max(len(a), len(b)) // 2 - 1, 0), list(b), []
    taken = [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and free[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    n = len(mine)
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, other, strict=True)) // 2
    return (n / len(a) + n / len(b) + (n - swaps) / n) / 3


#: Pairs of names whose similarity a process remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
_SEEN: dict[tuple[str, str], float] = {}


def _winkler_of(a: str, b: str) -> float:
    key = (a, b)
    if key not in _SEEN:
        if len(_SEEN) >= REMEMBERED:
            _SEEN.clear()
        j, k = jaro_of(a, b), 0
        while k < min(4, len(a), len(b)) and a[k] == b[k]:
            k += 1
        _SEEN[key] = j + k * 0.1 * (1 - j)
    return _SEEN[key]


def _best_of(x: Sequence[str] | None, y: Sequence[str] | None) -> float | None:
    return max((_winkler_of(p, q) for p in x for q in y), default=None) if x is not None and y is not None else None


def best_name_similarity_batched(a: Column, b: Column) -> Column:
    """``best_name_similarity`` in Arrow batches: each pair of names is compared once per process."""

    @F.pandas_udf("double")
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_best_of(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return best(a, b)


def name_similarities_batched(a: Column, others: Column) -> Column:
    """``best_name_similarity`` of the names ``a`` with each element of ``others``, an array of arrays of names."""

    @F.pandas_udf("array<double>")
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([[_best_of(x, y) for y in ys] for x, ys in zip(left, right, strict=True)])

    return best(a, others)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; null for unequal lengths, empty vectors and zero norms.  Norms that are at hand can be given."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0), _dot(a, b) / both)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    root = F.sqrt(h)
    return F.lit(2 * config.EARTH_KM) * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root))


def temporal_compatible(from1: Column, to1: Column, from2: Column, to2: Column) -> Column:
    """False only if the periods are provably apart (open ends are unbounded); null if a side has neither bound."""
    apart = F.coalesce(to1 < from2, F.lit(False)) | F.coalesce(to2 < from1, F.lit(False))
    return F.when((from1.isNotNull() | to1.isNotNull()) & (from2.isNotNull() | to2.isNotNull()), ~apart)


def shared_count(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def both_least(a: Column, b: Column) -> Column:
    """The smaller of two values, null if either is (``least`` alone skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))

"""Similarities of two fields: native where Spark can say it, Arrow kernels for the two string measures it lacks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth for each of up to four equal first letters, if it exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    matched: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, swaps = len(matched), sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


#: Longest text that is compared in a matrix with others; longer ones are compared one by one.
MATRIX_WIDTH = 48


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs of non-empty texts at once: a step for each place in the first, over all pairs."""
    out = np.empty(len(a))
    short = np.array([len(x) <= MATRIX_WIDTH and len(y) <= MATRIX_WIDTH for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~short).tolist():
        out[i] = jaro_winkler(a[i], b[i])
    rows = np.flatnonzero(short)
    if not len(rows):
        return out
    texts = [np.array([side[i] for i in rows.tolist()], dtype=np.str_) for side in (a, b)]
    x, y = (t.view(np.uint32).reshape(len(rows), -1) for t in texts)  # code points, zeros behind the end
    nx, ny = (np.char.str_len(t) for t in texts)
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)[:, None]
    places = np.arange(y.shape[1])[None, :]
    free, hit = places < ny[:, None], np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        here = (y == x[:, i : i + 1]) & free & (np.abs(places - i) <= reach) & (i < nx)[:, None]
        found = here.any(1)
        at = np.flatnonzero(found)
        free[at, here[at].argmax(1)] = False
        hit[at, i] = True
    used = ~free & (places < ny[:, None])
    m = hit.sum(1)

    def matched(codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
        r, c = np.nonzero(flags)
        packed = np.zeros((len(codes), max(1, int(m.max()))), np.uint32)
        packed[r, (np.cumsum(flags, 1) - 1)[r, c]] = codes[r, c]
        return packed

    swaps = (matched(x, hit) != matched(y, used)).sum(1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / some) / 3, 0.0)
    wide = min(4, x.shape[1], y.shape[1])
    same = np.cumprod((x[:, :wide] == y[:, :wide]) & (x[:, :wide] > 0), 1).sum(1)
    out[rows] = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    whole = len(a) + len(b)
    return 2.0 * common_subsequence(a, b) / whole if whole else 1.0


@lru_cache(100_000)
def token_similarity(a: str, b: str) -> float:
    """The better of comparing sorted tokens and comparing token sets, in 0..1.

    Sets: if all tokens of one side occur in the other (and there are any), 1. Otherwise the best of the two remainders
    after the common tokens, and of the common tokens against either side.
    """
    ta, tb = sorted(a.split()), sorted(b.split())
    ordered = _ratio(" ".join(ta), " ".join(tb))
    sa, sb = set(ta), set(tb)
    both, only_a, only_b = sorted(sa & sb), sorted(sa - sb), sorted(sb - sa)
    if both and (not only_a or not only_b):
        return 1.0
    base, ra, rb = " ".join(both), " ".join(only_a), " ".join(only_b)
    full_a, full_b = f"{base} {ra}".strip(), f"{base} {rb}".strip()
    best = max(ordered, _ratio(full_a, full_b))
    if base:
        best = max(best, _ratio(base, full_a), _ratio(base, full_b))
    return best


_TEXT = T.StructType([T.StructField("no", T.DoubleType()), T.StructField("vendor", T.DoubleType())])


@F.pandas_udf(_TEXT)
def text_similarities(no_a: pd.Series, no_b: pd.Series, vendor_a: pd.Series, vendor_b: pd.Series) -> pd.DataFrame:
    """Both string measures of pairs: Jaro-Winkler of numbers, token similarity of vendors; 0 where one of two is empty."""

    def column(a: list[str], b: list[str], measure) -> np.ndarray:
        # neither empty nor equal, in one order, each pair once
        pairs = [(x, y) if x < y else (y, x) for x, y in zip(a, b)]
        asked = list(dict.fromkeys(p for p in pairs if p[0] and p[0] != p[1]))
        known = dict(zip(asked, measure([x for x, _ in asked], [y for _, y in asked])))
        return np.array([known.get(p, 1.0 if p[0] and p[0] == p[1] else 0.0) for p in pairs], float)

    tokens = lambda xs, ys: map(token_similarity, xs, ys)
    return pd.DataFrame({"no": column(no_a.tolist(), no_b.tolist(), jaro_winkler_pairs), "vendor": column(vendor_a.tolist(), vendor_b.tolist(), tokens)})


def amount_similarity(a: Column, b: Column) -> Column:
    """1 if equal, else by how much the smaller absolute amount falls short of the larger; 0 if either is null."""
    high, low = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    short = 1.0 - (high - low).cast("double") / high.cast("double")
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), short))


def date_similarity(a: Column, b: Column, decay_days: float = 45.0) -> Column:
    """Falls linearly from 1 on the same day to 0 after ``decay_days``; 0 if either is null."""
    gap = F.abs(F.date_diff(a, b)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - gap / decay_days), F.lit(0.0))


def period_match(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)

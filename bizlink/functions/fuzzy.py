"""Name similarity. Edit bounds are native; only what they leave open goes to Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one row."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity from 0 to 100."""
    n = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / n if n else 100.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a: str, b: str) -> float:
    """Best similarity of the shorter text to a window of the longer of its length, windows
    cut off at either end included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, m = len(a), len(b)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, best = (1 << n) - 1, 0.0
    for s in range(1 - n, m):
        low, high = max(0, s), min(m, s + n)
        size = n + high - low
        # A window that ends (or, cut off at the right, begins) with a letter not in ``a`` is no
        # better than its neighbour without it.
        if 200.0 * (high - low) / size <= best or b[high - 1 if s + n <= m else s] not in masks:
            continue
        row = full
        for ch in b[low:high]:
            hit = row & masks.get(ch, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        best = max(best, 100.0 * 2 * (n - row.bit_count()) / size)
    return best


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(both, one), ratio(both, two)]
    return max(scores)


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def ratio_udf():
    return _pairwise(ratio)


def sorted_ratio_udf():
    return _pairwise(sorted_ratio)


def partial_udf():
    return _pairwise(partial)


def best_ratio_udf():
    """Largest of sorted, partial and set ratio: the gate for place names."""
    return _pairwise(lambda a, b: max(sorted_ratio(a, b), partial(a, b), token_set(a, b)))

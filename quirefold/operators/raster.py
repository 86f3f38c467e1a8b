"""Array work on small grey pages: threshold, components, coverage, gutters, skew. Pages are rows with a
binary of height * width bytes; every function handles one page and runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def otsu(gray: np.ndarray) -> int:
    """The threshold that parts the histogram with the greatest variance between its sides."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    total, mean = hist.sum(), (hist * np.arange(256)).sum()
    below, sum_below = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sum_below / below - (mean - sum_below) / above) ** 2
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 127


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the true stretches of a row of flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def components(ink: np.ndarray) -> np.ndarray:
    """Labels of 8-connected ink, from 1, in order of their first pixel; 0 is paper. Union of row runs."""
    labels = np.zeros(ink.shape, dtype=np.int32)
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    before: list[tuple[int, int, int]] = []
    for y in range(ink.shape[0]):
        now = []
        for a, b in runs(ink[y]):
            mine = 0
            for c, d, k in before:
                if c <= b and d >= a:
                    k = find(k)
                    if mine and k != mine:
                        parent[max(k, mine)] = min(k, mine)
                        mine = min(k, mine)
                    else:
                        mine = k
            if not mine:
                mine = len(parent)
                parent.append(mine)
            labels[y, a:b] = mine
            now.append((a, b, mine))
        before = now
    roots = np.array([find(k) for k in range(len(parent))])
    flat = roots[labels]
    _, first = np.unique(flat[flat > 0], return_index=True) if (flat > 0).any() else (None, np.array([], dtype=int))
    order = {int(flat[flat > 0][i]): n + 1 for n, i in enumerate(sorted(first.tolist()))}
    return np.vectorize(lambda k: order.get(int(k), 0), otypes=[np.int32])(flat) if order else flat


def boxes(labels: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x0, y0, x1, y1 and pixels of each component."""
    out = []
    for k in range(1, int(labels.max()) + 1 if labels.size else 1):
        ys, xs = np.nonzero(labels == k)
        out.append((int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1, len(xs)))
    return out


def covered_share(ink: np.ndarray, words: list[tuple[int, int, int, int]]) -> float:
    """Share of the ink that lies in word boxes."""
    n = int(ink.sum())
    if not n:
        return 0.0
    mask = np.zeros_like(ink, dtype=bool)
    for x0, y0, x1, y1 in words:
        mask[max(0, y0) : y1, max(0, x0) : x1] = True
    return float((ink & mask).sum() / n)


def uncovered(ink: np.ndarray, words: list[tuple[int, int, int, int]], least: int = 2) -> list[tuple[int, int, int, int, int]]:
    """Components of ink outside word boxes."""
    rest = ink.copy()
    for x0, y0, x1, y1 in words:
        rest[max(0, y0) : y1, max(0, x0) : x1] = False
    return [b for b in boxes(components(rest)) if b[4] >= least]


def gutters(ink: np.ndarray, least: int = 8, most: int = 3) -> list[tuple[int, int]]:
    """The widest empty column stretches between inked columns."""
    inked = np.flatnonzero(ink.any(axis=0))
    if not len(inked):
        return []
    inner = [(a + int(inked[0]), b + int(inked[0])) for a, b in runs(~ink.any(axis=0)[inked[0] : inked[-1] + 1])]
    return sorted(sorted((g for g in inner if g[1] - g[0] >= least), key=lambda g: (g[0] - g[1], g[0]))[:most])


def skew(ink: np.ndarray, limit: float = 8.0, step: float = 0.5, gain: float = 1.16) -> float:
    """Degrees of a turn whose profile of upper edges is sharper than the upright one by `gain`; 0 without one."""
    above = np.zeros_like(ink)
    above[1:] = ink[:-1]
    ys, xs = np.nonzero(ink & ~above)
    if len(ys) < 10:
        return 0.0

    def sharp(angle: float) -> float:
        rows = np.rint(ys - (xs - ink.shape[1] / 2) * np.tan(np.radians(angle))).astype(int)
        h = np.bincount(rows - rows.min())
        return float((np.diff(np.concatenate([[0.0], h, [0.0]])) ** 2).sum())

    base = sharp(0.0) or 1.0
    angles = np.arange(-limit, limit + step / 2, step)
    best = max(angles, key=lambda a: (sharp(a), -abs(a)))
    return float(best) if sharp(best) > gain * base else 0.0


def page_measures(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height, gray (binary) to threshold, ink share, components, gutters and skew."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, p, w, h, raw in pdf[["doc_id", "page", "width", "height", "gray"]].itertuples(index=False):
                gray = np.frombuffer(raw, dtype=np.uint8).reshape(h, w)
                t = otsu(gray)
                ink = gray <= t if gray.min() < gray.max() else np.zeros_like(gray, dtype=bool)
                rows.append((d, p, t, float(ink.mean()), int(components(ink).max()), len(gutters(ink)), skew(ink)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "threshold", "ink", "components", "gutters", "skew"])

    return pages.mapInPandas(measure, "doc_id bigint, page int, threshold int, ink double, components int, gutters int, skew double")

"""Problem 6: percentiles of very large numeric columns per group, with a stated error bound.

Dyadic Count-sketches. A value is encoded to an integer that keeps its order (sign, exponent and the
first `MANTISSA` bits of a double), so its relative error is bounded. For every binary resolution of the
codes one signed sketch counts the nodes of that resolution; levels with few nodes keep exact counters.
Sketches of days or partitions merge by adding cells, and weights may be negative (deletions). A rank is
found by going down the levels, left or right by the count of the left node.

Error: take the HEAVY largest nodes of a sketched level apart. A node meets one of them in a row with a
probability of HEAVY / WIDTH at most, and the median of DEPTH rows is spoilt only if most rows do, which is under
1e-6 (10 * (HEAVY / WIDTH)^3). Otherwise a row is off by the other nodes alone, with a variance of F2' / WIDTH, where F2' is the
sum of their squared counts, read from the cells of the sketch without its HEAVY largest. A rank is the
sum of one estimate per level, made with independent hashes, so it is off by more than
4 * sqrt(sum of F2' / WIDTH over the sketched levels) with a probability under 1 %; this is reported as
rank_bound (share of the group, the same for all percentiles). Only cells that hold something are kept, so
WIDTH costs a small group nothing. A value is off by at most 2^-(MANTISSA + 1) of itself.

Defined results: nulls and NaN are left out; a group without values has no row; equal values are one
code; infinities are values beyond all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA, DEPTH, WIDTH, HEAVY = 8, 5, 65536, 256
BITS = 12 + MANTISSA
EXACT_NODES = WIDTH * 2  # levels with at most so many nodes are counted exactly
_SHIFT = 52 - MANTISSA
_SEEDS = [[(0x9E3779B97F4A7C15 * (2 * (level * 2 * DEPTH + k) + 3)) & (2**64 - 1) for k in range(2 * DEPTH)] for level in range(BITS)]


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes of BITS bits."""
    raw = np.asarray(values, dtype=np.float64) + 0.0
    u = raw.view(np.int64)
    top = (u >> _SHIFT) & ((1 << (BITS - 1)) - 1)
    half = 1 << (BITS - 1)
    return np.where(u < 0, half - 1 - top, half + top).astype(np.int64)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of each code's interval; zero for the code of zero."""
    half = 1 << (BITS - 1)
    codes = np.asarray(codes, dtype=np.int64)
    top = np.where(codes >= half, codes - half, half - 1 - codes)
    middle = np.where(top == 0, 0, (top << _SHIFT) | (1 << (_SHIFT - 1)))
    size = middle.astype(np.int64).view(np.float64)
    return np.where(codes >= half, size, -size)


def _hash(nodes: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _exact(level: int) -> bool:
    return (1 << (BITS - level)) <= EXACT_NODES


def cells_of(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers and values that the weighted codes add to a sketch."""
    cells, values = [], []
    for level in range(BITS):
        nodes = codes >> level
        base = level * DEPTH * EXACT_NODES
        if _exact(level):
            cells.append(base + nodes)
            values.append(weights)
            continue
        for d in range(DEPTH):
            bucket = (_hash(nodes, _SEEDS[level][2 * d]) % np.uint64(WIDTH)).astype(np.int64)
            sign = ((_hash(nodes, _SEEDS[level][2 * d + 1]) & np.uint64(1)).astype(np.int64)) * 2 - 1
            cells.append(base + d * EXACT_NODES + bucket)
            values.append(sign * weights)
    return np.concatenate(cells), np.concatenate(values)


class Sketch:
    """The cells of one group, for reading ranks."""

    def __init__(self, cells: np.ndarray, values: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.values = np.asarray(cells)[order], np.asarray(values)[order]
        self.n = int(self._range((BITS - 1) * DEPTH * EXACT_NODES, 2).sum())

    def _range(self, start: int, size: int) -> np.ndarray:
        a, b = np.searchsorted(self.cells, [start, start + size])
        return self.values[a:b]

    def _cell(self, cell: int) -> int:
        i = np.searchsorted(self.cells, cell)
        return int(self.values[i]) if i < len(self.cells) and self.cells[i] == cell else 0

    def count(self, level: int, node: int) -> float:
        base = level * DEPTH * EXACT_NODES
        if _exact(level):
            return self._cell(base + node)
        one = np.array([node])
        return float(
            np.median(
                [
                    (int(_hash(one, _SEEDS[level][2 * d + 1])[0] & np.uint64(1)) * 2 - 1) * self._cell(base + d * EXACT_NODES + int(_hash(one, _SEEDS[level][2 * d])[0] % np.uint64(WIDTH)))
                    for d in range(DEPTH)
                ]
            )
        )

    def code_at(self, rank: float) -> int:
        """The code of the value that `rank` values of the group lie below."""
        node, left_over, below = 0, float(self.n), rank
        for level in range(BITS - 1, -1, -1):
            left = min(max(self.count(level, node * 2), 0.0), left_over)
            if below < left:
                node, left_over = node * 2, left
            else:
                node, below, left_over = node * 2 + 1, below - left, left_over - left
        return node

    def rank_bound(self) -> float:
        """Share of the group that a rank may be off by."""
        total = 0.0
        for level in range(BITS):
            if not _exact(level):
                rows = [self._range(level * DEPTH * EXACT_NODES + d * EXACT_NODES, WIDTH).astype(float) ** 2 for d in range(DEPTH)]
                total += np.median([np.partition(r, len(r) - HEAVY)[: len(r) - HEAVY].sum() if len(r) > HEAVY else 0.0 for r in rows]) / WIDTH
        return min(1.0, (4.0 * np.sqrt(total) + 1) / max(1, self.n))


def sketches(df: DataFrame, groups: list[str], value: Column, weight: Column | None = None) -> DataFrame:
    """groups, cell, value: one sketch per group. Values are reduced to codes in each batch, codes to
    counts before the only shuffle of codes, and each count updates its cells once."""
    rows = df.select(*groups, value.cast("double").alias("__v"), (F.lit(1).cast("long") if weight is None else weight.cast("long")).alias("__w"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*groups).schema.fields)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(code=encode(pdf["__v"].to_numpy()))
            yield pdf.groupby([*groups, "code"], dropna=False, sort=False, observed=True)["__w"].sum().reset_index(name="w")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.groupby(groups, dropna=False, sort=False):
                c, v = cells_of(g["code"].to_numpy(), g["w"].to_numpy())
                part = pd.DataFrame({"cell": c, "value": v}).groupby("cell", sort=False)["value"].sum().reset_index()
                for name, x in zip(groups, key):
                    part[name] = None if pd.isna(x) else x
                yield part[[*groups, "cell", "value"]]

    counted = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v")).mapInPandas(codes, f"{schema}, code bigint, w bigint")
    counted = counted.groupBy(*groups, "code").agg(F.sum("w").alias("w")).where("w <> 0")
    return merged(counted.mapInPandas(cells, f"{schema}, cell bigint, value bigint"), groups)


def merged(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of parts, days or batches added up for (coarser) groups."""
    return cells.groupBy(*groups, "cell").agg(F.sum("value").alias("value")).where("value <> 0")


def percentiles(cells: DataFrame, groups: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Per group and share: n, the estimate and its bounds. A group has at most BITS * DEPTH * EXACT_NODES cells."""
    fields = cells.select(*groups).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Sketch(pdf["cell"].to_numpy(), pdf["value"].to_numpy())
        out = pd.DataFrame(
            {"share": shares, "n": s.n, "estimate": decode(np.array([s.code_at(p * max(0, s.n - 1)) for p in shares])), "rank_bound": s.rank_bound(), "value_bound": 2.0 ** -(MANTISSA + 1)}
        )
        for f in fields:
            out[f.name] = pdf[f.name].iloc[0]
        return out[[f.name for f in fields] + ["share", "n", "estimate", "rank_bound", "value_bound"]]

    return cells.groupBy(*groups).applyInPandas(read, f"{schema}, share double, n bigint, estimate double, rank_bound double, value_bound double")

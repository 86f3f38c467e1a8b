"""Problem 8: texts of varying length in containers of fixed capacity with little unused space.

Minimum bin slack: a window of items is a multiset of lengths. The largest remaining item opens a
container; a bitset of reachable sums over the remaining lengths (one big integer, a shift per binary
part of a count) gives the filling closest to capacity, the stored bitsets give back its counts, and
the same filling is used again as long as the counts allow. Items go to windows by hash, of a fixed
expected size, so that windows are alike and independent at every scale; what lies in containers with
slack above a limit goes through a second round of windows.

Defined results: a text above the capacity is split into pieces of exactly the capacity and a rest, any
other is never split; a text without tokens lies in the first container of its window; null texts have
no row; repeated documents are items of their own; equal fillings are taken in the order of lengths.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import spread, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind part a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 4096


def tokenizer(vocabulary: bytes):
    """The encoding of a vocabulary file's bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of the whole text. The vocabulary file is read where the job starts and sent along (under 1 MB),
    so executors need no copy of it."""
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) for t in pdf["text"].tolist()]})

    return spread(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id").mapInPandas(count, "doc_id bigint, n_tokens bigint")


def _steps(counts: dict[int, int], room: int) -> Iterator[tuple[int, int]]:
    """Lengths that fit, longest first, with binary parts of their counts."""
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        c, k = min(counts[n], room // n), 1
        while c:
            take = min(k, c)
            yield n, take
            c -= take
            k *= 2


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The counts of the filling whose sum is closest to `room` from below."""
    mask = (1 << (room + 1)) - 1
    bits, before, steps = 1, [], []
    for n, take in _steps(counts, room):
        before.append(bits)
        steps.append((n, take))
        bits |= (bits << (n * take)) & mask
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    used: dict[int, int] = {}
    for (n, take), b in zip(reversed(steps), reversed(before)):
        if not b >> at & 1:
            at -= n * take
            used[n] = used.get(n, 0) + take
    return used


def fill_window(lengths: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Containers of a window: the lengths each holds and its slack, every item in exactly one."""
    counts: dict[int, int] = defaultdict(int)
    for n in lengths:
        if n:
            counts[n] += 1
    out = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        used = closest(counts, capacity - first)
        used[first] = used.get(first, 0) + 1
        counts[first] += 1
        again = min(counts[n] // c for n, c in used.items())
        content = [n for n, c in sorted(used.items(), reverse=True) for _ in range(c)]
        out += [(content, capacity - sum(content))] * again
        for n, c in used.items():
            counts[n] -= c * again
            if not counts[n]:
                del counts[n]
    return out


def _pack(items: DataFrame, n_windows: dict[int, int], round_no: int) -> DataFrame:
    """One round: containers of every (size, window)."""
    windows = F.create_map(*[F.lit(x) for k, v in n_windows.items() for x in (k, v)])
    placed = items.withColumn("window", F.pmod(F.xxhash64("row_no", "piece_no", F.lit(round_no)), F.element_at(windows, F.col("size_id"))).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row_no", "piece_no"], ascending=[False, True, True]).reset_index(drop=True)
        capacity = int(pdf["capacity_tokens"].iloc[0])
        lengths = pdf["n_tokens"].tolist()
        rows: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(lengths):
            rows[n].append(i)
        for n in rows:
            rows[n].reverse()
        box, slack = [0] * len(lengths), [capacity] * len(lengths)
        for k, (content, free) in enumerate(fill_window(lengths, capacity)):
            for n in content:
                i = rows[n].pop()
                box[i], slack[i] = k, free
        first = next((s for b, s, n in zip(box, slack, lengths) if b == 0 and n), capacity)
        pdf["box_no"] = box
        pdf["slack"] = [first if n == 0 else s for n, s in zip(lengths, slack)]
        pdf["round_no"] = round_no
        return pdf

    return placed.groupBy("size_id", "window").applyInPandas(
        pack,
        "size_id int, capacity_tokens int, doc_id bigint, row_no bigint, piece_no int, start_token bigint, n_tokens bigint, window int, box_no int, slack int, round_no int",
    )


def containers(tokens: DataFrame, sizes: DataFrame, window: int = WINDOW, limit: float = 0.01) -> DataFrame:
    """size_id, capacity_tokens, container_id, doc_id, piece_no, start_token, n_tokens of every item.
    `sizes` is a small fixed table (checked). Containers with more slack than `limit` of the capacity
    are emptied and filled again together."""
    rows = sizes.select("size_id", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container sizes")
    caps = {r[0]: r[1] for r in rows}
    if not caps:
        caps = {0: 1}
        tokens = tokens.limit(0)
    tokens = staged(tokens.select("doc_id", "n_tokens").withColumn("row_no", F.monotonically_increasing_id()), "token-counts")  # repeated rows stay apart
    size = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("size_id"), F.lit(v).cast("int").alias("capacity_tokens")) for k, v in sorted(caps.items())]))
    each = tokens.select("doc_id", "row_no", "n_tokens", size.alias("s")).select("doc_id", "row_no", "n_tokens", "s.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")) - 1).cast("int")
    items = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).select(
        "size_id",
        "capacity_tokens",
        "doc_id",
        "row_no",
        "piece_no",
        (F.col("piece_no").cast("long") * F.col("capacity_tokens")).alias("start_token"),
        F.least(F.col("capacity_tokens").cast("long"), F.col("n_tokens") - F.col("piece_no").cast("long") * F.col("capacity_tokens")).alias("n_tokens"),
    )
    whole = items.where("n_tokens = capacity_tokens").withColumns(
        {"window": F.lit(0), "box_no": F.lit(0), "slack": F.lit(0), "round_no": F.lit(0)}
    )
    part = items.where("n_tokens < capacity_tokens")
    n = {r[0]: r[1] for r in part.groupBy("size_id").count().collect()}
    first = staged(_pack(part, {k: max(1, math.ceil(n.get(k, 0) / window)) for k in caps}, 1), "packed")
    loose = (F.col("slack") > F.col("capacity_tokens") * limit)
    rest = first.where(loose).select(*items.columns)
    m = {r[0]: r[1] for r in first.where(loose).groupBy("size_id").count().collect()}
    second = _pack(rest, {k: max(1, math.ceil(m.get(k, 0) / window)) for k in caps}, 2)
    keep = ["size_id", "capacity_tokens", "doc_id", "piece_no", "start_token", "n_tokens"]
    named = F.concat_ws("-", "size_id", "round_no", "window", "box_no").alias("container_id")
    full = F.concat_ws("-", "size_id", F.lit("full"), "row_no", "piece_no").alias("container_id")
    return (
        whole.select(*keep, full)
        .unionByName(first.where(~loose).select(*keep, named))
        .unionByName(second.select(*keep, named))
    )

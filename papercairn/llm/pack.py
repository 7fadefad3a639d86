"""Problem 7: filling containers of fixed capacity, by bin completion."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate, combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papercairn.tables import spread

_CUTS = (re.compile(rb"\n[ \t\r]*\n"), re.compile(rb"[.!?](?=\s)|\xe3\x80\x82|\xe0\xa5\xa4"), re.compile(rb"\s"))


def pieces(text: str, capacity: int) -> list[int]:
    """Sizes (UTF-8 bytes and one end token) of the pieces of a text that is larger than a container: each as long as it
    may be, but cut after a paragraph, a sentence or a word if one ends in its last half; never inside a character."""
    raw, at, out = text.encode("utf-8", "replace"), 0, []
    while len(raw) - at + 1 > capacity:
        most = at + capacity - 1
        end = 0
        for pattern in _CUTS:
            for m in pattern.finditer(raw, at + (most - at) // 2, most):
                end = m.end()
            if end:
                break
        if not end:
            end = most
            while end > at + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append(end - at + 1)
        at = end
    out.append(len(raw) - at + 1)
    return out


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; sizes descend. Positions in each bin."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        k = bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            free, b = room.pop(k)
            bins[b].append(i)
            insort(room, (free - s, b))
    return bins


def _dominated(free: list[int], chosen: tuple[int, ...], left: int) -> bool:
    """Whether a filling can be bettered in one step: an item left out fits beside it, or takes the place of one or two of
    its items that are no larger together. (Then the items put out fit wherever it would have stood.)"""
    taken = set(chosen)

    def out_of(low: int, high: int) -> bool:
        """Whether an item of a size above low and up to high is left out."""
        return any(i not in taken for i in range(bisect_right(free, low), bisect_right(free, high)))

    sizes = [free[i] for i in chosen]
    if out_of(0, left) or any(out_of(s, s + left) for s in set(sizes)):
        return True
    return any(out_of(a + b - 1, a + b + left) for a, b in combinations(sizes, 2)) if len(sizes) < 12 else False


def completions(free: list[int], room: int, waste: int, keep: int = 4, steps: int = 300) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` with any number of the ascending sizes `free`, wasting at most `waste`, fullest
    first, at most `keep`. They are met in the order of how often a smaller item than the largest that fits is taken
    (limited discrepancy), so the first is the greedy one; a branch ends where all smaller items together would waste too
    much. The search ends at a perfect filling or after `steps` items taken."""
    total = [0, *accumulate(free)]
    found: dict[tuple[int, ...], int] = {}
    met: set[tuple[int, ...]] = set()
    budget = steps

    def fill(top: int, left: int, chosen: tuple[int, ...], slips: int) -> bool:
        """Goes on with items below `top`; True ends the search."""
        nonlocal budget
        i = bisect_right(free, left, 0, top) - 1
        if i < 0:
            sizes = tuple(free[j] for j in chosen)
            if left <= waste and sizes not in met:
                met.add(sizes)
                if not _dominated(free, chosen, left):
                    found[chosen] = left
            return left == 0
        slipped = 0
        while i >= 0 and slipped <= slips and total[i + 1] >= left - waste:
            budget -= 1
            if budget < 0:
                return True
            if fill(i, left - free[i], (*chosen, i), slips - slipped):
                return True
            i = bisect_left(free, free[i], 0, i) - 1  # the next smaller size
            slipped += 1
        return False

    for slips in range(64):
        before = budget
        if fill(len(free), room, (), slips) or before - budget >= budget:
            break
    return sorted(found, key=lambda c: (found[c], len(c)))[:keep]


def bin_completion(sizes: list[int], capacity: int, nodes: int = 400) -> list[list[int]]:
    """Bins of positions of `sizes`, each at most `capacity`. Depth-first branch and bound: around the largest item left,
    undominated fillings (see completions) are tried, fullest first; a branch ends where its waste passes what a solution
    of one bin fewer than the incumbent may waste. The incumbent begins as best-fit decreasing; the search ends at the lower bound
    ceil(sum / capacity) or after `nodes` branchings beyond one descent (then the incumbent stands)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    down = [sizes[i] for i in order]
    best = best_fit(down, capacity)
    total, least = sum(down), -(-sum(down) // capacity)
    budget = nodes + len(down)
    while len(best) > least and budget > 0:
        allowed = (len(best) - 1) * capacity - total  # waste of a solution of one bin fewer
        free: list[tuple[int, int]] = sorted((s, -i) for i, s in enumerate(down))
        stack: list[tuple[list[list[int]], list[int], int]] = []
        bins: list[list[int]] = []
        waste, solved = 0, False
        pending: list[list[tuple[int, ...]]] = []
        taken: list[tuple[list[tuple[int, int]], int]] = []
        while budget > 0:
            if not free:
                solved = True
                break
            largest = free[-1]
            values = [s for s, _ in free[:-1]]
            choices = completions(values, capacity - largest[0], allowed - waste)
            pending.append(choices[::-1])
            moved = False
            while pending:
                if pending[-1]:
                    c = pending[-1].pop()
                    items = [free[k] for k in c] + [free[-1]]
                    for k in sorted(c, reverse=True):
                        del free[k]
                    free.pop()
                    lost = capacity - sum(s for s, _ in items)
                    waste += lost
                    taken.append((items, lost))
                    bins.append([-i for _, i in items])
                    budget -= 1
                    moved = True
                    break
                pending.pop()
                if taken:
                    items, lost = taken.pop()
                    bins.pop()
                    waste -= lost
                    for x in items:
                        insort(free, x)
                    budget -= 1
            if not moved:
                break
        if not solved:
            break
        best = bins
    return [[order[i] for i in b] for b in best]


def pack(docs: DataFrame, capacity: int, per_shard: int = 2000, nodes: int = 400) -> DataFrame:
    """doc_id, piece, pieces, size, container (string, shard and number), fill of each piece of each document.

    Size is that of the byte tokenizer: UTF-8 bytes and one end token for each piece. Only texts larger than a container
    are split. Documents are dealt over shards of about `per_shard` pieces by a hash of doc_id, and each shard is packed
    by bin_completion; a shard leaves at most one container badly filled. Only ids and sizes are shuffled. A doc_id
    delivered twice counts once; a null text counts as empty (size 1); a null doc_id as one document."""
    if capacity < 6:
        raise ValueError("a container must hold the longest character and the end token")
    one = docs.select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    small = one.filter(F.col("size") <= capacity).select("doc_id", F.array(F.col("size").cast("int")).alias("sizes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [pieces(t, capacity) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "sizes"])

    large = one.filter(F.col("size") > capacity).select("doc_id", "text").mapInArrow(cut, "doc_id bigint, sizes array<int>")
    sized = small.unionByName(large).groupBy("doc_id").agg(F.first("sizes").alias("sizes"))
    n = docs.agg(F.count(F.lit(1))).first()[0]
    shards = max(1, round(n / per_shard))
    items = sized.select("doc_id", F.size("sizes").alias("pieces"), F.posexplode("sizes").alias("piece", "size")).withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "doc_id", "piece"), F.lit(shards)).cast("int"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["size"].tolist()
        name, fills = [""] * len(sizes), [0] * len(sizes)
        for k, b in enumerate(bin_completion(sizes, capacity, nodes)):
            f = sum(sizes[i] for i in b)
            for i in b:
                name[i], fills[i] = f"{key[0]}-{k}", f
        return pdf.assign(container=name, fill=fills)[["doc_id", "piece", "pieces", "size", "container", "fill"]]

    return spread(items, "shard").groupBy("shard").applyInPandas(fill, "doc_id bigint, piece int, pieces int, size int, container string, fill int")

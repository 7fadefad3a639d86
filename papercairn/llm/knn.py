"""Problem 5: the most similar vectors of every vector, by learned partitions of a neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.tables import kept, spread


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of x (of length 1), by cosine."""
    x = x.astype(np.float32)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 256):
        sim = x[s : s + 256] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out[s : s + 256] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def partition(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size that cut few edges of the graph: halving by the median of a smoothed direction, again and
    again, with exchanges between the halves where these save edges."""
    label = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:
        new = np.empty_like(label)
        for p in range(n):
            own = np.flatnonzero(label == p)
            inside = np.full(len(x), -1)
            inside[own] = np.arange(len(own))
            g = inside[graph[own]]
            ok = g >= 0
            here = x[own] - x[own].mean(axis=0)
            v = here @ np.linalg.svd(here.T @ here)[0][:, 0]
            for _ in range(8):
                v = 0.5 * v + 0.5 * np.where(ok, v[g], 0).sum(axis=1) / np.maximum(1, ok.sum(axis=1))
                v -= v.mean()
            side = np.zeros(len(own), bool)
            side[np.argsort(v, kind="stable")[len(own) // 2 :]] = True
            for _ in range(4):
                other = (np.where(ok, side[g] != side[:, None], False).sum(axis=1) * 2 - ok.sum(axis=1)).astype(float)
                a, b = (np.flatnonzero((side == s) & (other > 0)) for s in (False, True))
                m = min(len(a), len(b)) // 2
                if not m:
                    break
                side[a[np.argsort(-other[a], kind="stable")[:m]]] = True
                side[b[np.argsort(-other[b], kind="stable")[:m]]] = False
            new[own] = 2 * p + side
        label, n = new, n * 2
    return label


@dataclass
class Router:
    """A network of one hidden layer that gives each vector's probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2


def train(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 12, seed: int = 5) -> Router:
    """A router that learns, for each vector, in what parts its neighbours are (its own counts for 0.3): queries are sent
    where their neighbours are, which needn't be where they would be put themselves."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    shapes = ((x.shape[1], hidden), (hidden,), (hidden, parts), (parts,))
    w = [(rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for s in shapes]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    beside = label[graph]
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.002 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        for s in range(0, len(x), 256):
            b = order[s : s + 256]
            z = x[b] @ w[0] + w[1]
            h = np.maximum(0, z)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            rows = np.arange(len(b))
            np.subtract.at(p, (rows[:, None], beside[b]), np.float32(0.7 / graph.shape[1]))
            p[rows, label[b]] -= np.float32(0.3)
            p /= len(b)
            back = (p @ w[2].T) * (z > 0)
            step += 1
            for i, g in enumerate((x[b].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Router(*w)


def valid(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key and vector of the rows whose vector has the dimension, no null or NaN, and is not all zero."""
    v = F.col(vector)
    return df.select(F.col(key).alias("id"), v.alias("vector")).filter((F.size(v) == dim) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e)) & F.exists(v, lambda e: e != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, visits: int = 24, homes: int = 2, per_part: int = 32, most_parts: int = 4096, most_sample: int = 65_536, block: int = 8192) -> DataFrame:
    """id, neighbour_id, similarity, rank: of each row of `queries` (id, vector) the k rows of `vectors` (id, vector) with
    other ids and the highest cosine similarity; ties by id. Both as valid() gives them.

    There are about as many parts as the root of the number of vectors (a power of two, `most_parts` at most). A
    neighbour graph of a sample of `per_part` vectors a part, `most_sample` at most (at least 16 a part), is cut into
    balanced parts; a small network learns them. Every vector is indexed, in its `homes` likeliest parts. A query
    searches its `visits` likeliest parts, at any size, and is compared with all their vectors exactly; so with n vectors
    it meets visits * homes / root(n) of them. Parts are cut into blocks of about `block` vectors and eight times as many
    queries, so no task holds a hot part. An id delivered twice counts once; no vectors or no queries give no rows."""
    n = vectors.count()
    parts = min(most_parts, most_sample // 16, 1 << max(0, round(math.log2(max(1, n)) / 2)))
    sample = min(most_sample, parts * per_part)
    keep = min(1.0, 2 * sample / n) if n else 1.0
    hashed = vectors.withColumn("h", F.xxhash64(F.lit(3), "id"))
    fit = hashed.filter(F.col("h") < int((keep - 0.5) * 2**64)) if keep < 1 else hashed
    fit = fit.dropDuplicates(["id"]).orderBy("h", "id").limit(sample).select("vector").toArrow()
    out = "id string, neighbour_id string, similarity double"
    parts = min(parts, 1 << max(0, (fit.num_rows // 16).bit_length() - 1))
    router = None
    if parts > 1:
        x = _matrix(fit.column("vector"), dim)
        graph = neighbours(x, 10)
        router = train(x, graph, partition(x, graph, parts), parts)
    visits, homes = min(parts, visits), min(parts, homes)

    def route(top: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                if router is None:
                    likely = np.zeros((b.num_rows, 1), np.int32)
                else:
                    s = router.scores(_matrix(b.column("vector"), dim).astype(np.float32))
                    likely = np.argpartition(-s, top - 1, axis=1)[:, :top].astype(np.int32) if top < parts else np.tile(np.arange(parts, dtype=np.int32), (len(s), 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(likely) + 1, dtype=np.int32) * likely.shape[1]), pa.array(likely.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), lists], ["id", "vector", "parts"])

        return work

    kind = "id string, vector array<float>, parts array<int>"

    def routed(df: DataFrame, top: int) -> DataFrame:
        df = df.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        return kept(df.mapInArrow(route(top), kind).select("id", "vector", F.explode("parts").alias("part")))

    v, q = routed(vectors, homes), routed(queries, visits)
    # At most most_parts rows each
    v_blocks = {r["part"]: -(-r["n"] // block) for r in v.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    q_blocks = {r["part"]: -(-r["n"] // (8 * block)) for r in q.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def number(blocks: dict[int, int]) -> F.Column:
        return F.element_at(F.lit([blocks.get(p, 1) for p in range(parts)]), F.col("part") + 1)

    def every(blocks: dict[int, int]) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), (number(blocks) - 1).cast("long")))

    # Only parts that some query visits
    v = v.filter(F.col("part").isin(list(q_blocks))) if 2 * len(q_blocks) < parts else v
    v = v.withColumn("vb", F.pmod(F.xxhash64("id"), number(v_blocks))).withColumn("qb", every(q_blocks))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), number(q_blocks))).withColumn("vb", every(v_blocks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.string()), "neighbour_id": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        names, first = np.unique(np.array(left.column("id").to_pylist(), object).astype(str), return_index=True)
        base = _matrix(left.column("vector"), dim)[first]
        asked, at = np.unique(np.array(right.column("id").to_pylist(), object).astype(str), return_index=True)
        x = _matrix(right.column("vector"), dim)[at]
        ids, found, score = [], [], []
        place = np.searchsorted(names, asked)
        for s in range(0, len(x), 256):
            sim = np.round(x[s : s + 256] @ base.T, 12)
            for i, row in enumerate(sim):
                p = place[s + i]
                if p < len(names) and names[p] == asked[s + i]:
                    row[p] = -np.inf
                if k < len(row):
                    bar = np.partition(row, len(row) - k)[len(row) - k]
                    near = np.flatnonzero(row >= bar)
                    near = near[np.lexsort((near, -row[near]))][:k]
                else:
                    near = np.arange(len(row))
                near = near[row[near] > -np.inf]
                ids.append(np.full(len(near), asked[s + i], object))
                found.append(names[near])
                score.append(row[near])
        return pa.table({"id": pa.array(np.concatenate(ids), pa.string()), "neighbour_id": pa.array(np.concatenate(found).astype(object), pa.string()), "similarity": pa.array(np.concatenate(score), pa.float64())})

    pairs = v.groupBy("part", "vb", "qb").cogroup(q.groupBy("part", "vb", "qb")).applyInArrow(lambda left, right: search(left.select(["id", "vector"]), right.select(["id", "vector"])), out)
    # A neighbour may be met in each of its homes; one shuffle serves both steps
    once = spread(pairs, "id").groupBy("id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, block: int = 4096) -> DataFrame:
    """id, recall: the share of the k nearest by comparison with all vectors that `found` has for each query. For
    measuring; the work grows with queries times vectors. Queries go to the tasks in blocks of `block`, a list of the
    ids asked being all that the driver holds; each task keeps the k best of its vectors for each query of a block."""
    asked = queries.select("id").distinct().orderBy("id").toArrow().column(0).to_pylist()
    every = None
    for s in range(0, len(asked), block):
        part = queries.filter(F.col("id").isin(asked[s : s + block])).dropDuplicates(["id"]).select("id", "vector").toArrow()
        names, x = np.array(part.column("id").cast(pa.string()).to_pylist(), object), _matrix(part.column("vector"), dim)

        def work(batches: Iterator[pa.RecordBatch], names=names, x=x) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids = np.array(b.column("id").cast(pa.string()).to_pylist(), object)
                sim = np.round(x @ _matrix(b.column("vector"), dim).T, 12)
                sim[names[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-sim, axis=1, kind="stable")[:, : k + 1]
                at = np.repeat(np.arange(len(names)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.string()), pa.array(ids[top.ravel()], pa.string()), pa.array(sim[at, top.ravel()])], ["id", "neighbour_id", "similarity"])

        got = vectors.select("id", "vector").dropDuplicates(["id"]).mapInArrow(work, "id string, neighbour_id string, similarity double").filter(F.col("similarity") > float("-inf"))
        every = got if every is None else every.unionByName(got)
    if every is None:
        return queries.select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("recall")).limit(0)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id"))
    truth = every.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "neighbour_id")
    hit = truth.join(found.select("id", "neighbour_id", F.lit(1.0).alias("hit")), ["id", "neighbour_id"], "left")
    return hit.groupBy("id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))

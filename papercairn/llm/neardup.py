"""Problem 6: near-duplicate texts, by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papercairn.tables import kept

_WORD = re.compile(r"[^\W_]+")
#: Minwise hash functions; each level of a tree branches on functions of its own sixteenth.
FUNCTIONS, PER_LEVEL, DEPTH = 64, 16, 4
_A = (np.random.default_rng(20240229).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return " ".join(_WORD.findall(text)).lower().split(" ")


class _Hashes(dict):
    """64-bit hashes of words, kept for the words met before; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return x


def shingle_hashes(texts: list[list[str]], size: int, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text (of `size` words at least), and where each text's begin."""
    counts = np.array([len(t) for t in texts])
    h = np.fromiter((known[w] for t in texts for w in t), np.uint64, counts.sum())
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = _mix(x + h[k : k + n] + np.uint64(k))
    ends = np.cumsum(counts)
    keep = np.ones(n, bool)
    for k in range(1, size):
        at = ends - k
        keep[at[at < n]] = False
    return x[keep], np.concatenate([[0], np.cumsum(counts - size + 1)[:-1]])


def slices(batch: pa.RecordBatch, column: str, rows: int = 2000, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of up to `rows` rows and about `most` bytes of text, one row at least."""
    sizes = np.diff(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).cumsum(), prepend=0)
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and (size + n > most or i - lo >= rows):
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _branch(path: np.ndarray, sig: np.ndarray, level: int, ways: int, first: int | None = None) -> list[np.ndarray]:
    """The children of each record's node: `ways` functions of this level, chosen by the path or those from `first` on, and
    their minima."""
    rows = np.arange(len(path))
    first = (_mix(path + np.uint64(level)) % np.uint64(PER_LEVEL)).astype(np.int64) if first is None else np.full(len(path), first)
    out = []
    for j in range(ways):
        f = level * PER_LEVEL + (first + j) % PER_LEVEL
        out.append(_mix(_mix(path ^ np.uint64(f + 1)) ^ sig[rows, f]))
    return out


def near_duplicates(texts: DataFrame, threshold: float, shingle: int = 5, least_words: int = 20, trees: int = 5, ways: int = 2, node: int = 64, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the rows of `texts` (tbl, id, text), compared within a tbl. members: tbl, cls, id, one row per
    id of at least `least_words` words; rows with the same words in the same order share a cls. links: cls_a < cls_b and
    the similarity (intersection over union of the sets of runs of `shingle` words) of every two classes found to reach
    the threshold.

    Each tree starts from all records and branches, at each node, on `ways` minwise hash functions chosen by the path (at
    the root on functions of its own, so that trees don't miss the same pairs): a record follows its own minima. Nodes of up to `node` records are compared exhaustively, by 128-bit sketches of 64
    minima first, then exactly; larger ones branch on, down to DEPTH levels. What is still larger there holds records
    that agree on every chosen minimum, so nearly all of them are links; it is compared in blocks of `block`, two at a
    time: n records make 2 n * n / block rows to shuffle, and none of their links is lost. Counts, not groups, are
    gathered, so no task holds a hot node. A pair of similarity 0.6 shares a node of two levels in one tree with
    probability 0.75, in five trees 0.999; at 0.7 0.9999. Null texts and texts with fewer words have no rows; an id with
    two texts counts with both. Null ids are a key."""
    if not 0 < threshold <= 1 or shingle < 1 or trees < 1 or ways < 1:
        raise ValueError("the threshold lies in (0, 1]; shingle, trees and ways are 1 at least")
    least = max(least_words, shingle)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for b in slices(whole, "text"):
                salt, ids, kept_words, cls = [], [], [], []
                for tbl, key, text in zip(b.column("tbl").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist()):
                    w = words(text)
                    if len(w) >= least:
                        ids.append((tbl, key))
                        kept_words.append(w)
                        cls.append(int.from_bytes(hashlib.blake2b(f"{tbl}\n{' '.join(w)}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                        salt.append(known[f"\n{tbl}"])
                if not ids:
                    continue
                x, starts = shingle_hashes(kept_words, shingle, known)
                sig = np.empty((len(ids), FUNCTIONS), np.uint64)
                for k in range(FUNCTIONS):
                    sig[:, k] = np.minimum.reduceat(x * _A[k], starts)
                sig >>= np.uint64(32)
                two = (_mix(sig) & np.uint64(3)).reshape(len(ids), 2, 32)
                sketch = (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
                keys = []
                for t in range(trees):
                    root = _mix(np.array(salt, np.uint64) + np.uint64(t * 7919 + 1))
                    for first in _branch(root, sig, 0, ways, t * ways):
                        keys += _branch(first, sig, 1, ways)
                keys_flat = np.stack(keys, axis=1).view(np.int64)
                deep = np.ascontiguousarray(sig[:, 2 * PER_LEVEL :]).astype(np.uint32).view(np.int32)

                def lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))

                yield pa.RecordBatch.from_arrays(
                    [pa.array([i[0] for i in ids], pa.string()), pa.array([i[1] for i in ids], pa.string()), pa.array(cls, pa.int64()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), lists(keys_flat, pa.int64()), lists(deep, pa.int32())],
                    ["tbl", "id", "cls", "s1", "s2", "keys", "deep"],
                )

    source = texts.select("tbl", "id", "text").filter(F.col("text").isNotNull())
    f = kept(source.mapInArrow(features, "tbl string, id string, cls bigint, s1 bigint, s2 bigint, keys array<bigint>, deep array<int>"))
    members = f.select("tbl", "cls", "id").distinct()
    entries = f.select(F.explode("keys").alias("key"), "cls", "s1", "s2").distinct()
    # Sketches agree in J + (1 - J) / 4 of 64 places on average; 3.3 standard deviations below that of the threshold
    p = threshold + (1 - threshold) / 4
    agree = int(64 * (p - 3.3 * (p * (1 - p) / 64) ** 0.5))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs within the runs of one key of rows sorted by it."""
        rest = None
        low = np.uint64(0x5555555555555555)

        def pairs(key, cls, s1, s2):
            out_a, out_b = [], []
            d = 1
            i = np.arange(len(key) - 1)
            while len(i):
                i = i[i + d < len(key)]
                i = i[key[i] == key[i + d]]
                j = i + d
                x, y = s1[i] ^ s1[j], s2[i] ^ s2[j]
                differ = np.bitwise_count((x | (x >> np.uint64(1))) & low).astype(int) + np.bitwise_count((y | (y >> np.uint64(1))) & low)
                hit = (64 - differ >= agree) & (cls[i] != cls[j])
                out_a.append(np.minimum(cls[i[hit]], cls[j[hit]]))
                out_b.append(np.maximum(cls[i[hit]], cls[j[hit]]))
                d += 1
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["cls_a", "cls_b"])

        for batch in batches:
            cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("key", "cls", "s1", "s2")]
            cols[2:] = [c.view(np.uint64) for c in cols[2:]]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0] != cols[0][-1], False)) if cols[0][0] == cols[0][-1] else int(np.flatnonzero(cols[0] != cols[0][-1])[-1] + 1)
            rest = [c[cut:] for c in cols]
            if cut:
                yield pairs(*(c[:cut] for c in cols))
        if rest is not None:
            yield pairs(*rest)

    def deeper(level: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                path = b.column("key").to_numpy().view(np.uint64)
                deep = b.column("deep")
                sig = np.zeros((b.num_rows, FUNCTIONS), np.uint64)
                sig[:, 2 * PER_LEVEL :] = deep.flatten().to_numpy().view(np.uint32).reshape(b.num_rows, -1)
                for child in _branch(path, sig, level, ways):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("cls"), b.column("s1"), b.column("s2")], ["key", "cls", "s1", "s2"])

        return work

    entry_type = "key bigint, cls bigint, s1 bigint, s2 bigint"
    found = None
    for level in range(2, DEPTH + 1):
        counts = kept(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        together = entries.join(counts, "key")
        part = together.filter(F.col("n") <= node)
        big = not counts.filter(F.col("n") > node).isEmpty()
        if big and level == DEPTH:
            blocks = F.ceil(F.col("n") / block).cast("int")
            own = F.pmod(F.xxhash64("cls"), blocks)
            other = F.explode(F.sequence(F.lit(0), blocks - 1))
            large = together.filter(F.col("n") > node).withColumn("own", own).select("*", other.alias("other")).select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "cls", "s1", "s2")
            part = part.select("key", "cls", "s1", "s2").unionByName(large)
        pairs = part.select("key", "cls", "s1", "s2").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "cls_a bigint, cls_b bigint")
        found = pairs if found is None else found.unionByName(pairs)
        if not big or level == DEPTH:
            break
        signatures = f.select("cls", "deep").dropDuplicates(["cls"])
        entries = kept(together.filter(F.col("n") > node).select("key", "cls", "s1", "s2").join(signatures, "cls").mapInArrow(deeper(level), entry_type))
    found = kept(found.distinct())

    first = f.groupBy("cls").agg(F.min(F.struct("tbl", "id")).alias("r")).select("cls", "r.tbl", "r.id")
    used = found.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct().join(first, "cls")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            own, cls = [], []
            for tbl, c, text in zip(b.column("tbl").to_pylist(), b.column("cls").to_pylist(), b.column("text").to_pylist()):
                w = words(text)
                if len(w) >= least and int.from_bytes(hashlib.blake2b(f"{tbl}\n{' '.join(w)}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) == c:
                    own.append(np.unique(shingle_hashes([w], shingle, known)[0]).view(np.int64))
                    cls.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["cls", "grams"])

    grams = source.join(used, [source["tbl"].eqNullSafe(used["tbl"]), source["id"].eqNullSafe(used["id"])]).select(source["tbl"], "cls", "text").mapInArrow(sets, "cls bigint, grams array<bigint>").dropDuplicates(["cls"])
    both = found.join(grams.select(F.col("cls").alias("cls_a"), F.col("grams").alias("a")), "cls_a").join(grams.select(F.col("cls").alias("cls_b"), F.col("grams").alias("b")), "cls_b")
    common = F.size(F.array_intersect("a", "b"))
    links = both.select("cls_a", "cls_b", F.size("a").alias("na"), F.size("b").alias("nb"), common.alias("nc")).select("cls_a", "cls_b", (F.col("nc") / (F.col("na") + F.col("nb") - F.col("nc"))).alias("similarity")).filter(F.col("similarity") >= threshold)
    return kept(links), members


def pairs_of_rows(links: DataFrame, members: DataFrame) -> DataFrame:
    """tbl, id_a < id_b of every two rows whose classes are linked or the same."""
    one, two = members.select("tbl", F.col("cls").alias("cls_a"), F.col("id").alias("x")), members.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = links.select("cls_a", "cls_b").join(one, "cls_a").join(two, "cls_b").select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    a, b = members.alias("a"), members.alias("b")
    same = a.join(b, (F.col("a.cls") == F.col("b.cls")) & (F.col("a.id") < F.col("b.id"))).select("a.tbl", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    return across.filter("id_a < id_b").unionByName(same).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """tbl, id, cls, links: the class of every row and the number of other classes linked to it."""
    n = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    return members.join(n, "cls", "left").select("tbl", "id", "cls", F.coalesce("links", F.lit(0)).alias("links"))

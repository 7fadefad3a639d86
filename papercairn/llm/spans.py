"""Problem 9: long exact spans shared between documents, by compact windows of minimum hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.tables import blank, kept

MULT, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Characters hashed at a time; a position within them takes so many bits.
SEGMENT, POSITION_BITS = 1 << 19, np.uint64(20)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over x[i : i + width] for every i with a whole window (van Herk and Gil-Werman: two passes by blocks)."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, width)
    left = f.accumulate(blocks, axis=1).ravel()
    right = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return f(right[:m], left[width - 1 : width - 1 + m])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    b = int(MULT) | 1
    up = np.full(n, b, np.uint64)
    down = np.full(n, pow(b, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def windows(codes: np.ndarray, owner: np.ndarray, gram: int, width: int, powers: tuple[np.ndarray, np.ndarray], every: bool = False) -> tuple[np.ndarray, ...]:
    """(position, key, grams to the left, grams to the right) of the compact windows of at least `width` grams.

    A gram is a run of `gram` characters of one text; `owner` tells texts apart. A compact window groups all runs of grams
    that have one minimum hash, at one position: it reaches to the next smaller hash on either side, as a node of the
    Cartesian tree of hashes does. Only those positions can head a window of `width` grams that are the leftmost minimum
    of a run of `width`, so only these are looked at. Reaches are cut at `width`. Of a run of windows with one key, as
    in periodic text, only the first two and the last stay unless `every` is set: that two texts share a span shows at
    one of them in both, though not every place of it."""
    n = len(codes) - gram - width + 2
    none = (np.empty(0, np.int64),) * 4
    if n < 1:
        return none
    x = _mixed((codes.astype(np.uint64) + np.uint64(1)) * MULT)
    up, down = powers
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    h = _mixed((total[gram:] - total[:-gram]) * down[: len(x) - gram + 1])
    low = np.uint64((1 << int(POSITION_BITS)) - 1)
    at = np.arange(len(h), dtype=np.uint64)
    v = (h & ~low) | at
    v[owner[: len(h)] != owner[gram - 1 :]] = ~np.uint64(0)
    whole = owner[:n] == owner[gram + width - 2 :]
    least = _sliding(v, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    c = np.unique(least[whole] & low).astype(np.int64)
    if not len(c):
        return none
    key = h[c]
    same = (key[1:] == key[:-1]) & (owner[c[1:]] == owner[c[:-1]])
    drop = np.zeros(len(c), bool)
    if not every:
        drop[2:-1] = same[1:-1] & same[:-2] & same[2:]
    c, key = c[~drop], key[~drop]
    reach = []
    tables = [v]
    while (1 << len(tables)) <= width:
        t, s = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-s], t[s:]) if len(t) > s else t[:0])
    mine = v[c]
    fence = owner[c]
    for sign in (-1, 1):
        got = np.zeros(len(c), np.int64)
        for level in range(len(tables) - 1, -1, -1):
            t, s = tables[level], 1 << level
            if not len(t):
                continue
            begin = c - got - s if sign < 0 else c + got + 1
            last = begin + s - 1
            ok = (begin >= 0) & (last < len(h))
            b = np.clip(begin, 0, len(t) - 1)
            ok &= (t[b] > mine) & (owner[np.clip(begin, 0, len(owner) - 1)] == fence) & (owner[np.clip(last + gram - 1, 0, len(owner) - 1)] == fence)
            got += np.where(ok, s, 0)
        reach.append(got)
    return c, key, reach[0], reach[1]


def _windows_of(gram: int, width: int, every: bool = False):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(SEGMENT + 1)
        for b in batches:
            group: list[tuple[int, int, np.ndarray]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                codes = np.concatenate([g[2] for g in group])
                lengths = np.array([len(g[2]) for g in group])
                owner = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
                c, key, left, right = windows(codes, owner, gram, width, powers, every)
                own = owner[c]
                start = np.concatenate([[0], np.cumsum(lengths)])[own] if len(c) else np.empty(0, np.int64)
                offset = np.array([g[1] for g in group])[own] if len(c) else np.empty(0, np.int64)
                cls = np.array([g[0] for g in group], np.int64)[own] if len(c) else np.empty(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), pa.int64()), pa.array(cls, pa.int64()), pa.array((c - start + offset).astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], ["key", "cls", "pos", "lft", "rgt"])

            for cls, text in zip(b.column("cls").to_pylist(), b.column("text").to_pylist()):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                for s in range(0, max(1, len(codes) - gram - width + 2), SEGMENT - gram - width + 2):
                    part = codes[s : s + SEGMENT]
                    if size + len(part) > SEGMENT:
                        yield flush()
                        group, size = [], 0
                    group.append((cls, s, part))
                    size += len(part)
            if group:
                yield flush()

    return work


def _common(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """(to the left, to the right) characters that a before i and b before j, and a from i and b from j, have in common."""

    def run(n: int, same) -> int:
        low, step = 0, 64
        while low < n and same(low, min(n, low + step)):
            low, step = min(n, low + step), step * 2
        high = min(n, low + step)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(low, mid) else (low, mid - 1)
        return low

    right = run(min(len(a) - i, len(b) - j), lambda x, y: a[i + x : i + y] == b[j + x : j + y])
    left = run(min(i, j), lambda x, y: a[i - y : i - x] == b[j - y : j - x])
    return left, right


def classed(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, cls (a hash of the text: copies share it), text; of the documents whose text is long enough to count."""
    text = F.col("text")
    return docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("cls"), text).filter((F.char_length(text) >= least) & ~blank(text))


def shared(docs: DataFrame, least: int = 200, gram: int = 120) -> tuple[DataFrame, DataFrame]:
    """(spans, members): spans has cls_a, cls_b, start_a, start_b, length of the longest runs of at least `least` characters
    that two different texts have in common; members has cls and doc_id of all documents long enough to count.

    Every run of `least` characters holds least - gram + 1 grams, whose minimum hash heads a compact window that holds them
    all, in either text; so no two texts that share a run are missed, with one hash. Windows are joined on that hash and on
    what both intervals have in common; the texts then decide. Where a text repeats itself with a short period, a shared
    run is listed at the beginnings and ends of the periodic stretches only, not at each of its places (coverage() counts
    all of them). Copies of a text are one class. Blank, null and shorter texts have
    no rows."""
    if not 0 < gram <= least:
        raise ValueError("gram must lie between 1 and least")
    width = least - gram + 1
    d = classed(docs, least)
    members = d.select("cls", "doc_id").distinct()
    w = kept(d.select("cls", "text").mapInArrow(_windows_of(gram, width), "key bigint, cls bigint, pos int, lft smallint, rgt smallint"))
    w = w.groupBy("key", "cls", "pos").agg(F.first("lft").alias("lft"), F.first("rgt").alias("rgt"))
    a, b = w.alias("a"), w.alias("b")
    pairs = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.least("a.lft", "b.lft") + F.least("a.rgt", "b.rgt") + 1 >= width))
        .groupBy(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"), (F.col("a.pos") - F.col("b.pos")).alias("shift"))
        .agg(F.collect_set("a.pos").alias("at"))
    )
    pairs = kept(pairs)
    used = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    texts = d.select("cls", "text").join(used, "cls", "left_semi").dropDuplicates(["cls"])
    both = pairs.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a").join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ca, cb, shift, at, ta, tb in zip(*(batch.column(k).to_pylist() for k in ("cls_a", "cls_b", "shift", "at", "text_a", "text_b"))):
                past = -1
                for i in sorted(at):
                    if i < past:
                        continue
                    left, right = _common(ta, tb, i, i - shift)
                    past = i + right
                    if left + right >= least:
                        out.append((ca, cb, i - left, i - shift - left, left + right))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["cls_a", "cls_b", "start_a", "start_b", "length"])

    spans = both.select("cls_a", "cls_b", "shift", "at", "text_a", "text_b").mapInArrow(verify, "cls_a bigint, cls_b bigint, start_a int, start_b int, length int")
    return kept(spans), members


def pairs_of_documents(spans: DataFrame, members: DataFrame) -> DataFrame:
    """doc_a < doc_b for every two documents that share a span, copies included."""
    m1, m2 = members.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("x")), members.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("y"))
    across = spans.select("cls_a", "cls_b").distinct().join(m1, "cls_a").join(m2, "cls_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    a, b = members.alias("a"), members.alias("b")
    copies = a.join(b, (F.col("a.cls") == F.col("b.cls")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))
    return across.filter("doc_a < doc_b").unionByName(copies)


def coverage(docs: DataFrame, least: int = 200, gram: int = 120) -> DataFrame:
    """doc_id, cls, n_chars, shared_chars, n_spans, share: how much of each document stands in another one; one row per
    document, 0 where nothing does. Overlapping spans count once; a copy stands wholly elsewhere.

    No pairs of texts are formed, so a stretch that any number of texts share costs as much as it has characters in all of
    them: compact windows whose minimum occurs in more than one class name the runs of `least` characters that may be
    shared; these are hashed, and a hash of more than one class marks the place in all of them."""
    if not 0 < gram <= least:
        raise ValueError("gram must lie between 1 and least")
    width = least - gram + 1
    d = classed(docs, least)
    members = kept(d.select("cls", "doc_id").distinct())
    w = kept(d.select("cls", "text").dropDuplicates(["cls"]).mapInArrow(_windows_of(gram, width, True), "key bigint, cls bigint, pos int, lft smallint, rgt smallint"))

    def in_two(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("cls").alias("one"), F.max("cls").alias("other")).filter("one < other").select(*keys)

    # Starts of the runs whose minimum is at pos: one range for each window
    ranges = w.join(in_two(w, "key"), "key").select("cls", F.struct((F.col("pos") - F.col("lft")).alias("low"), (F.col("pos") + F.col("rgt") - width + 1).alias("high")).alias("r")).filter("r.low <= r.high")
    ranges = ranges.groupBy("cls").agg(F.collect_list("r").alias("ranges"))  # at most one for each character of a text

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, text, found in zip(*(b.column(k).to_pylist() for k in ("cls", "text", "ranges"))):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(codes) < least:
                    continue
                up, down = _powers(len(codes) + 1)
                total = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(_mixed((codes.astype(np.uint64) + np.uint64(1)) * MULT) * up[: len(codes)], out=total[1:])
                edge = np.zeros(len(codes) + 2, np.int32)
                np.add.at(edge, [max(0, r["low"]) for r in found], 1)
                np.add.at(edge, [min(len(codes), r["high"] + 1) for r in found], -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(codes) - least + 1])
                part = (total[at + least] - total[at]) * down[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cls, np.int64)), pa.array(at.astype(np.int32)), pa.array(_mixed(part).view(np.int64)), pa.array(_mixed(part ^ MIX1).view(np.int64) >> 40)], ["cls", "start", "h1", "h2"])

    texts = d.select("cls", "text").dropDuplicates(["cls"]).join(ranges, "cls")
    at = kept(texts.mapInArrow(runs, "cls bigint, start int, h1 bigint, h2 bigint"))
    marked = at.join(in_two(at, "h1", "h2"), ["h1", "h2"], "left_semi").select("cls", "start")
    before = F.col("start") - F.lag("start").over(W.partitionBy("cls").orderBy("start"))
    merged = marked.withColumn("step", before).groupBy("cls").agg(F.sum(F.least(F.lit(least), F.coalesce("step", F.lit(least)))).alias("chars"), F.sum(F.when(F.col("step").isNull() | (F.col("step") > least), 1).otherwise(0)).alias("spans"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    sizes = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars")).dropDuplicates(["doc_id"])
    out = sizes.join(members, "doc_id", "left").join(merged, "cls", "left").join(copies, "cls", "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    chars = F.when(copied, F.col("n_chars")).otherwise(F.coalesce("chars", F.lit(0)))
    return out.select("doc_id", "cls", "n_chars", chars.cast("long").alias("shared_chars"), F.when(copied, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"), F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))

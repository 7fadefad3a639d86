"""Counts of words over a whole corpus, kept for words frequent enough."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(corpus: DataFrame, n: int, sample: int, longest: int, seed: int) -> list[str]:
    """`sample` different texts (of the first column, which has `n` rows) of at most `longest` characters: those of the
    smallest hashes, so the same ones each time, in order. A text repeated however often is one."""
    text = F.col(corpus.columns[0])
    rows = corpus.select(text.alias("t")).filter(F.char_length("t") <= longest).withColumn("h", F.xxhash64(F.lit(seed), "t"))
    share = min(1.0, 4 * sample / n) if n else 1.0
    below = rows.filter(F.col("h") < int((share - 0.5) * 2**64)) if share < 1 else rows
    got = below.dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    if len(got) < sample and share < 1:  # many repeats: look at all
        got = rows.dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    return sorted(r["t"] for r in got)


def counts(texts: DataFrame, tokens: Callable[[str], dict[str, Counter] | Counter], share: float = 1e-6, least: int = 3, kinds: int = 1, apart: bool = False) -> dict[str, tuple[int, ...]]:
    """For every word that makes up the share `share` of all words or more, and occurs `least` times or more, its counts
    of each of `kinds` kinds over all texts (the first column of `texts`). tokens(text) lists the words of each kind;
    the first kind is all occurrences. With `apart`, what white space parts is counted first and tokens() then applied to
    each different piece once. At most 1 / share words can be so frequent, at any size: that bounds the result,
    which the caller may broadcast. Words are counted within tasks first, so a frequent word is no hot key."""
    column = texts.columns[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Counter() for _ in range(kinds)]
        raw: Counter = Counter()

        def out() -> pa.RecordBatch:
            for piece, n in raw.items():
                for c, found in zip(own, tokens(piece)):
                    for word in found:
                        c[word] += n
            raw.clear()
            words = list(own[0].keys() | set().union(*own[1:])) if kinds > 1 else list(own[0])
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in own)], ["word", *(f"n{i}" for i in range(kinds))])
            for c in own:
                c.clear()
            return batch

        for b in batches:
            for text in b.column(0).to_pylist():
                if text and apart:
                    raw.update(text.split())
                elif text:
                    for c, found in zip(own, tokens(text)):
                        c.update(found)
            if len(own[0]) + len(raw) > 300_000:
                yield out()
        yield out()

    names = [f"n{i}" for i in range(kinds)]
    by = texts.select(column).mapInArrow(work, "word string, " + ", ".join(f"{n} bigint" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names))
    from papercairn.tables import kept

    by = kept(by.filter(F.col("n0") >= least))
    total = by.agg(F.sum("n0")).first()[0] or 0
    rows = by.filter(F.col("n0") >= max(least, share * total)).toArrow()
    return dict(zip(rows.column("word").to_pylist(), zip(*(rows.column(n).to_pylist() for n in names))))

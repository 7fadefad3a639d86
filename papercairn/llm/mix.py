"""Problem 8: mixing sources to target shares, by the cube method of balanced sampling."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papercairn.tables import kept

#: Rates of plans and sources are kept in the driver and broadcast up to this number of them; beyond it they are joined.
SMALL = 20_000
EPS = 1e-9


def flight(probs: list[float], sizes: list[int], rng: random.Random, land: bool) -> list[float]:
    """Moves inclusion probabilities to 0 or 1 so that their sum and the sum of probability times size stay as they are.

    Three units at a time move along the null space of the two constraints, one way or the other with the odds that keep
    each unit's expectation, until one of them is settled. At most two units stay open; with `land` these are settled
    too, by the rounding whose total size is nearest."""
    p = list(probs)
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS][::-1]
    for i, x in enumerate(p):
        if not EPS < x < 1 - EPS:
            p[i] = float(round(x))
    live: list[int] = []
    while True:
        while len(live) < 3 and todo:
            live.append(todo.pop())
        if len(live) < 3:
            break
        i, j, k = live
        u = (float(sizes[j] - sizes[k]), float(sizes[k] - sizes[i]), float(sizes[i] - sizes[j]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, d in zip((p[i], p[j], p[k]), u):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, x / -d), min(down, (1 - x) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for q, d in zip(live, u):
            p[q] += step * d
            if p[q] < EPS:
                p[q] = 0.0
            elif p[q] > 1 - EPS:
                p[q] = 1.0
        live = [q for q in live if 0.0 < p[q] < 1.0]
    if land and live:
        goal = sum(p[q] * sizes[q] for q in live)
        combos = [[m >> b & 1 for b in range(len(live))] for m in range(1 << len(live))]
        chosen = min(combos, key=lambda c: abs(goal - sum(x * sizes[q] for x, q in zip(c, live))))
        for x, q in zip(chosen, live):
            p[q] = float(x)
    return p


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source (trimmed, lower case), size in tokens of the byte tokenizer; one row per doc_id. A null text counts as empty."""
    return (
        docs.select("doc_id", F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
        .groupBy("doc_id")
        .agg(F.first("source").alias("source"), F.first("size").alias("size"))
    )


def rates(units: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row per plan and source of `targets`: plan_id, source, target_share, max_repeats, docs, available (tokens of
    the source), total (tokens aimed at: `size`, or those of all documents), target (tokens), rate (copies of each
    document). With a smaller `size` sources that can't reach their share of all documents may reach it."""
    by = units.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("available"))
    total = size if size is not None else units.agg(F.sum("size")).first()[0] or 0
    t = targets.select("plan_id", F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"), "target_share", "max_repeats").dropDuplicates(["plan_id", "source"])
    return (
        t.join(by, "source", "left")
        .withColumns({"total": F.lit(total).cast("long"), "docs": F.coalesce("docs", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
        .withColumn("target", F.col("target_share") * F.col("total"))
        .withColumn("rate", F.when(F.col("available") > 0, F.least(F.col("target") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))
    )


def mixture(units: DataFrame, plan: DataFrame, per_block: int = 4096, seed: int = 1) -> DataFrame:
    """plan_id, source, doc_id, size, copies (0 or more) of every document of every source of every plan.

    A document's copies are the whole part of its source's rate plus one by balanced sampling with the fractional part as
    inclusion probability. The flight runs in blocks of about `per_block` documents by a hash; what each block leaves
    open (two units at most) goes to the next round of blocks, until one block per plan and source lands the rest. So
    the tokens of a source differ from its rate by at most a document or two at any size."""
    p = plan.select("plan_id", "source", "docs", "rate")
    known = p.limit(SMALL + 1).collect()
    if len(known) <= SMALL:
        p = F.broadcast(p.sparkSession.createDataFrame(known, p.schema))
    blocks = max([1, *(-(-r["docs"] // per_block) for r in known)]) if len(known) <= SMALL else max(1, -(-p.agg(F.max("docs")).first()[0] // per_block))
    units = units.join(p, "source").select("plan_id", "source", "doc_id", "size", "docs", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("prob"))
    columns = ["plan_id", "source", "doc_id", "size", "docs", "whole", "prob"]

    def run(part: DataFrame, k: int, land: bool) -> DataFrame:
        def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            rng = random.Random(f"{seed}|{k}|{key}")
            return pdf.assign(prob=flight(pdf["prob"].tolist(), pdf["size"].tolist(), rng, land))[columns]

        n = F.greatest(F.lit(1), F.ceil(F.col("docs") / per_block / (per_block // 4) ** k)).cast("long")
        block = F.lit(0) if land else F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n)
        return part.withColumn("block", block).groupBy("plan_id", "source", "block").applyInPandas(work, part.select(*columns).schema)

    k, done, left = 0, [], units
    while blocks > 1:
        part = kept(run(left, k, False))
        done.append(part.filter((F.col("prob") == 0) | (F.col("prob") == 1)))
        left = part.filter((F.col("prob") > 0) & (F.col("prob") < 1))
        k, blocks = k + 1, -(-blocks // (per_block // 4))
    out = run(left, k, True)
    for part in done:
        out = out.unionByName(part)
    return out.select("plan_id", "source", "doc_id", "size", (F.col("whole") + F.col("prob").cast("int")).alias("copies"))


def report(docs: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row per row of `targets`: the target, the tokens and documents the mixture takes, the share of the mixture that
    the source makes up (share) and of the total aimed at (reached), and whether the source can't reach its share: the
    sampling then takes all its documents max_repeats times and still falls short. Documents with a null source count
    only in the total."""
    units = kept(sized(docs))
    plan = rates(units, targets, size)
    drawn = mixture(units, plan)
    got = drawn.groupBy("plan_id", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.min("copies").alias("least_copies"), F.max("copies").alias("most_copies"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "copies", "most_copies")}
    all_taken = F.coalesce(F.col("least_copies") >= F.col("max_repeats"), F.lit(True))  # a source without documents, too
    rows = plan.join(got, ["plan_id", "source"], "left").withColumns(zero).withColumn("unreachable", all_taken & (F.col("tokens") < F.col("target")))
    whole = rows.groupBy("plan_id").agg(F.sum("tokens").alias("mixed"))
    return rows.join(whole, "plan_id").select(
        "plan_id", "source", "target_share", "max_repeats", "available", "total", "tokens", "copies", "most_copies",
        F.when(F.col("mixed") > 0, F.col("tokens") / F.col("mixed")).alias("share"), F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).alias("reached"), "unreachable",
    )

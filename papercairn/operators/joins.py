"""Joins that plain keys don't express: as of, by place in a text, one to one by score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import text as X
from papercairn.functions.python import title_key, title_score
from papercairn.operators.windows import carried


def as_of(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, take: list[str]) -> DataFrame:
    """Each row of `left` with the columns `take` of the last row of `right` of its key at or before it; nulls if there is
    none. Both relations are one in order, and no pairs are made; rows of a frequent key are spread (see windows). Where
    several rows of `right` stand at one place, that of the greatest `take` counts."""
    packed = F.struct(*[F.col(c).alias(c) for c in take])
    r = right.groupBy(key, F.col(right_order).alias("_at")).agg(F.max(packed).alias("_take")).select(key, "_at", F.lit(0).alias("_side"), "_take", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    row = left.select(key, F.col(left_order).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_take"].dataType).alias("_take"), F.struct(*left.columns).alias("_row"))
    both = r.unionByName(row).withColumn("_id", F.xxhash64("_row"))
    both = carried(both, key, ["_at", "_side", "_id"], F.col("_take"), "_last")
    return both.filter("_side = 1").select("_row.*", *[F.col(f"_last.{c}").alias(c if c not in left.columns else f"{c}_before") for c in take])


def letters(text: Column) -> Column:
    """Letters and digits only, in lower case: the key under which texts are looked up in others."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def located(needles: DataFrame, haystacks: DataFrame, key: str, lengths: tuple[int, ...] = (70, 110, 160, 240, 400)) -> DataFrame:
    """needle, place, length of each row of `needles` (key, needle, text) in the text of its key (key, text), by letters: the
    first of the lengths at which its beginning stands there once only; no row where none does."""
    n = needles.select(key, "needle", letters(F.col("text")).alias("n"))
    h = haystacks.select(key, letters(F.col("text")).alias("h"))
    both = n.join(h, key)
    tries = []
    for size in lengths:
        first = F.expr(f"instr(h, substring(n, 1, {size}))")
        again = F.expr(f"locate(substring(n, 1, {size}), h, instr(h, substring(n, 1, {size})) + 1)")
        tries.append(F.when((F.length("n") > 0) & (first > 0) & (again == 0), F.struct((first - 1).alias("place"), F.lit(size).alias("length"))))
    return both.select(key, "needle", F.coalesce(*tries).alias("x")).filter("x IS NOT NULL").select(key, "needle", "x.place", "x.length")


def owners(texts: DataFrame, segments: DataFrame, key: str, probes: int = 3, size: int = 40) -> DataFrame:
    """needle and owner (own, other, unknown) of each text (key, needle, text): where its probes of 40 letters stand among the
    segments (key, segment, own, text). other: two probes or more in foreign segments, none in its own, half of them found.
    Probes are joined with the runs of 40 letters of the segments by their hashes, so no text is compared with all others."""
    t = texts.select(key, "needle", letters(F.col("text")).alias("n"))
    step = F.greatest(F.lit(1), F.floor((F.length("n") - size) / max(1, probes - 1))).cast("int")
    at = F.filter(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: (i * step + 1).cast("int")), lambda s: s + size - 1 <= F.length("n"))
    p = t.withColumn("at", F.explode(at)).select(key, "needle", F.expr(f"xxhash64(substring(n, at, {size}))").alias("probe")).distinct()
    s = segments.select(key, "own", letters(F.col("text")).alias("s")).filter(F.length("s") >= size)
    s = s.select(key, "own", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - size + 1), lambda i: F.xxhash64(F.substring(F.col("s"), i, F.lit(size))))).alias("probe"))
    hit = p.join(s, [key, "probe"]).groupBy(key, "needle", "probe").agg(F.max("own").alias("own"))
    by = p.groupBy(key, "needle").agg(F.count(F.lit(1)).alias("n")).join(hit.groupBy(key, "needle").agg(F.sum(F.col("own").cast("int")).alias("mine"), F.count(F.lit(1)).alias("found")), [key, "needle"], "left")
    mine, found = F.coalesce("mine", F.lit(0)), F.coalesce("found", F.lit(0))
    owner = F.when(mine > 0, "own").when((found >= 2) & (F.col("n") >= 3) & (found >= 0.5 * F.col("n")), "other").otherwise("unknown")
    return t.select(key, "needle").join(by.select(key, "needle", owner.alias("owner")), [key, "needle"], "left").select(key, "needle", F.coalesce("owner", F.lit("unknown")).alias("owner"))


def _reference_score(p: dict, q: dict, banned: set) -> float:
    title = title_score(p["title"], p["raw"], q["title"])
    doi = p["doi"] and p["doi"] not in banned and p["doi"] == q["doi"]
    year = p["year"] is None or q["year"] is None or pd.isna(p["year"]) or pd.isna(q["year"]) or abs(p["year"] - q["year"]) <= 1
    if doi and not (p["title"] and q["title"] and title < 55):
        return 200 + title
    if title >= 88 and year:
        return 100 + title
    names = [w for w in (q["author"], str(int(q["year"])) if q["year"] is not None and not pd.isna(q["year"]) else None, q["journal"]) if w]
    raw = (p["raw"] or "").lower()
    return 80.0 if len(names) == 3 and all(n.lower() in raw for n in names) else 0.0


def paired(printed: DataFrame, items: DataFrame) -> DataFrame:
    """(paper_id, pos, item, score): printed references (paper_id, pos, title, year, doi, raw) matched one to one with listed
    ones (paper_id, pos, title, year, doi, author, journal), best scores first, ties by position: a DOI of both, unless the
    titles contradict; a title of 88 of 100 with the year within one; surname, year and journal within the printed text.
    DOIs printed three times or more in a paper identify none. A task holds one paper's two lists, but only pairs that may
    match are scored: by DOI and equal titles first, then those of what is left whose letters and years are near enough."""
    left = printed.select("paper_id", "pos", "title", "year", X.canonical_doi(F.col("doi")).alias("doi"), "raw")
    # Names of their own, as both lists may come of one relation, whose columns would be taken for the same
    right = items.select(F.col("paper_id").alias("_paper"), *[F.col(c).alias(f"_{c}") for c in ("pos", "title", "year", "author", "journal")], X.canonical_doi(F.col("doi")).alias("_doi"))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = [r for r in a.where(a.notna(), None).to_dict("records")]
        cols = [{k[1:]: v for k, v in r.items()} for r in b.where(b.notna(), None).to_dict("records")]
        n = a["doi"].value_counts()
        found = one_to_one(rows, cols, set(n[n >= 3].index)) if rows and cols else []
        return pd.DataFrame([(rows[0]["paper_id"], *x) for x in found], columns=["paper_id", "pos", "item", "score"])

    return left.groupBy("paper_id").cogroup(right.groupBy("_paper")).applyInPandas(work, "paper_id string, pos int, item int, score double")


def one_to_one(rows: list[dict], cols: list[dict], banned: set) -> list[tuple[int, int, float]]:
    """(pos, pos of the listed one, score): the pairs that scoring all and taking the best first gives. Scores of 200 and more
    are those of a DOI or of equal titles, those from 188 those of like titles, 80 is that of the printed text; each kind is
    looked for among what the higher ones left."""
    for r in (*rows, *cols):
        r["year"] = None if r["year"] is None or pd.isna(r["year"]) else int(r["year"])
    keys = [" ".join(sorted(k.split())) if len(k := title_key(r["title"])) >= 12 else "" for r in rows]
    plain = [k if len(k := title_key(q["title"])) >= 12 else "" for q in cols]
    listed = [" ".join(sorted(k.split())) for k in plain]
    used_p, used_q, out = set(), set(), []

    def take(pairs) -> None:
        for s, i, j in sorted(pairs):
            if i not in used_p and j not in used_q:
                used_p.add(i)
                used_q.add(j)
                out.append((i, j, -s))

    def scored(pairs, low: float, high: float):
        for x, y in pairs:
            p, q = rows[x], cols[y]
            if p["pos"] not in used_p and q["pos"] not in used_q and low <= (s := _reference_score(p, q, banned)) < high:
                yield -s, p["pos"], q["pos"]

    by_doi: dict[str, list[int]] = {}
    for y, q in enumerate(cols):
        if q["doi"]:
            by_doi.setdefault(q["doi"], []).append(y)
    same = [(x, y) for x, p in enumerate(rows) if p["doi"] and p["doi"] not in banned for y in by_doi.get(p["doi"], ())]
    by_identity = sorted(set(scored(same, 200.0, 1e9)))
    take(s for s in by_identity if s[0] < -200)
    at_200: dict[int, list[int]] = {}
    for s, i, j in by_identity:
        if s == -200:
            at_200.setdefault(i, []).append(j)
    # Equal titles: lists of positions by title and year, each left from its front
    fronts: dict[str, dict] = {}
    for y in sorted(range(len(cols)), key=lambda y: cols[y]["pos"], reverse=True):
        if listed[y]:
            fronts.setdefault(listed[y], {}).setdefault(cols[y]["year"], []).append(cols[y]["pos"])
    places: dict[int, list[int]] = {}
    for x, p in enumerate(rows):
        places.setdefault(p["pos"], []).append(x)
    for i in sorted(places):
        if i in used_p:
            continue
        able = [j for j in at_200.get(i, ()) if j not in used_q]
        for x in places[i]:
            years = fronts.get(keys[x], {}) if keys[x] else {}
            y = rows[x]["year"]
            for stack in years.values() if y is None else [years[z] for z in (y - 1, y, y + 1, None) if z in years]:
                while stack and stack[-1] in used_q:
                    stack.pop()
                able += stack[-1:]
        if able:
            used_p.add(i)
            used_q.add(min(able))
            out.append((i, min(able), 200.0))
    left, right = ([x for x, r in enumerate(t) if r["pos"] not in used] for t, used in ((rows, used_p), (cols, used_q)))
    take(set(scored(_like_titles(rows, cols, keys, plain, listed, left, right), 188.0, 200.0)))
    left, right = ([x for x, r in enumerate(t) if r["pos"] not in used] for t, used in ((rows, used_p), (cols, used_q)))
    take(set(scored(_named(rows, cols, left, right), 80.0, 188.0)))
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has each character of a title_key."""
    out = np.zeros((len(texts), 128), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128)
    return np.ascontiguousarray(out[:, [32, *range(48, 58), *range(97, 123)]])


def _like_titles(rows: list[dict], cols: list[dict], keys: list[str], plain: list[str], listed: list[str], left: list[int], right: list[int]):
    """Pairs of the rows and columns left whose title may score 88 with a year within one: those of too few letters in
    common, or for a printed text of too few of the title's words (see title_score), aren't among them."""
    by_year: dict = {}
    for y in right:
        if listed[y]:
            by_year.setdefault(cols[y]["year"], []).append(y)
    groups = {z: (np.array(ys), _letters([listed[y] for y in ys])) for z, ys in by_year.items()}
    words: dict[str, list[int]] = {}
    n_words = np.zeros(len(cols))
    texts = [x for x in left if not keys[x] and len(title_key(rows[x]["raw"])) >= 20]
    if texts:
        for y in right:
            for w in {w for w in plain[y].split() if len(w) >= 4}:
                words.setdefault(w, []).append(y)
                n_words[y] += 1
    own = dict(zip(titled := [x for x in left if keys[x]], _letters([keys[x] for x in titled])))
    for x in (*titled, *texts):
        y = rows[x]["year"]
        near = [g for z, g in groups.items() if y is None or z is None or abs(y - z) <= 1]
        if keys[x]:
            for ys, letters in near:
                common = np.minimum(letters, own[x]).sum(axis=1)
                yield from ((x, int(j)) for j in ys[common >= 0.44 * (letters.sum(axis=1) + len(keys[x])) - 1e-6])
        elif near:
            text = title_key(rows[x]["raw"])
            hits = np.zeros(len(cols))
            for w, ys in words.items():
                if w in text:
                    hits[ys] += 1
            for ys, _ in near:
                yield from ((x, int(j)) for j in ys[hits[ys] >= 0.6 * n_words[ys] - 1e-6])


def _named(rows: list[dict], cols: list[dict], left: list[int], right: list[int]):
    """Pairs of the rows and columns left where year, journal and author of the one stand in the printed text of the other."""
    tree: dict = {}
    for y in right:
        q = cols[y]
        if q["author"] and q["year"] is not None and q["journal"]:
            tree.setdefault(str(q["year"]), {}).setdefault(q["journal"].lower(), {}).setdefault(q["author"].lower(), []).append(y)
    for x in left:
        raw = (rows[x]["raw"] or "").lower()
        if raw:
            yield from ((x, y) for year, journals in tree.items() if year in raw for journal, authors in journals.items() if journal in raw for author, ys in authors.items() if author in raw for y in ys)


def merged_references(printed: DataFrame, items: DataFrame) -> DataFrame:
    """Printed references with what their listed ones add (source parsed+listed), those without one (parsed), and listed ones
    that none was printed of (listed), in this order."""
    pairs = paired(printed, items).select("paper_id", "pos", "item")
    q = items.select("paper_id", F.col("pos").alias("item"), F.col("title").alias("t"), F.col("year").alias("y"), F.col("doi").alias("d"))
    # One join in full, so that lists are matched once
    both = printed.join(pairs, ["paper_id", "pos"], "left").withColumn("_own", F.lit(True)).join(q, ["paper_id", "item"], "full")
    source = F.when(F.col("_own").isNull(), "listed").when(F.col("item").isNull(), "parsed").otherwise("parsed+listed")
    return both.select("paper_id", "pos", F.coalesce("title", "t").alias("title"), F.coalesce("year", "y").alias("year"), F.coalesce("d", "doi").alias("doi"), source.alias("source"))


def filled_numbers(keys: DataFrame) -> DataFrame:
    """(paper_id, pos, number): numbers of references in order, those not known filled in where the places between two known
    ones are as many as the numbers between them, and counted on at the ends."""
    before = W.partitionBy("paper_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("paper_id").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("number").isNotNull(), F.struct("pos", "number"))
    k = keys.withColumn("a", F.last(known, ignorenulls=True).over(before)).withColumn("b", F.first(known, ignorenulls=True).over(after))
    up, down = F.col("a.number") + F.col("pos") - F.col("a.pos"), F.col("b.number") - (F.col("b.pos") - F.col("pos"))
    fits = F.col("b.pos") - F.col("a.pos") == F.col("b.number") - F.col("a.number")
    value = F.when(F.col("number").isNotNull(), F.col("number")).when(F.col("a").isNull(), F.when(down > 0, down)).when(F.col("b").isNull(), up).when(fits, up)
    return k.select("paper_id", "pos", value.cast("int").alias("number"))

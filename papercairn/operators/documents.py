"""Papers as ordered paragraphs: sections, duplicates, placement of floats, citations, chunks, and the readable view."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papercairn.functions import text as X
from papercairn.operators.windows import carried, numbered

ORDER = ("sec_ord", "par_ord")


def distinct_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """One row per par_uid; a paragraph delivered twice has the same content."""
    return paragraphs.dropDuplicates(["par_uid"])


def sections(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, sec_ord, path, given, own): one row per section; own is what its headings say."""
    s = paragraphs.groupBy("paper_id", "sec_ord").agg(F.min("path").alias("path"), F.min("section_type").alias("given"))
    return s.withColumn("own", X.classify_path(F.col("path")))


def carried_sections(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, sec_ord, own, section_type): a section whose headings say nothing takes the type of the last one before it
    that is intro, methods, results or discussion, in papers that have two such types, methods or results among them."""
    known = F.when(F.col("own").isin("intro", "methods", "results", "discussion"), F.col("own"))
    s = carried(sections(paragraphs).select("paper_id", "sec_ord", "own"), "paper_id", ["sec_ord"], known, "last")
    types = s.groupBy("paper_id").agg(F.collect_set(known).alias("types")).select(F.col("paper_id").alias("_key"), ((F.size("types") >= 2) & F.arrays_overlap("types", F.array(F.lit("methods"), F.lit("results")))).alias("gate"))
    s = s.join(types, F.col("paper_id").eqNullSafe(F.col("_key")))
    return s.select("paper_id", "sec_ord", "own", F.when((F.col("own") == "other") & F.col("gate"), F.coalesce("last", F.lit("other"))).otherwise(F.col("own")).alias("section_type"))


def repeated_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, par_uid, first_uid): paragraphs whose text, in any case, stood before in the same paper."""
    p = distinct_paragraphs(paragraphs).filter(F.coalesce("text", F.lit("")).rlike(r"\S")).select("paper_id", "par_uid", *ORDER, F.xxhash64(F.lower(X.flat(F.col("text")))).alias("h"), F.lower(X.flat(F.col("text"))).alias("t"))
    first = p.groupBy("paper_id", "h", "t").agg(F.min_by("par_uid", F.struct(*ORDER, "par_uid")).alias("first_uid"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return p.join(first, ["paper_id", "h", "t"]).filter(F.col("par_uid") != F.col("first_uid")).select("paper_id", "par_uid", "first_uid")


def boilerplate(paragraphs: DataFrame, share: float = 0.05) -> DataFrame:
    """(text, papers): paragraphs whose text, digits masked, stands in that share of all papers or more: running matter."""
    p = paragraphs.select("paper_id", F.regexp_replace(X.flat(F.col("text")), r"\d+", "#").alias("text")).filter((F.char_length("text") > 0) & (F.char_length("text") <= 200)).distinct()
    n = paragraphs.select("paper_id").distinct().count()
    return p.groupBy("text").agg(F.count("paper_id").alias("papers")).filter((F.col("papers") >= 2) & (F.col("papers") >= share * n))


def abstract_echoes(papers: DataFrame, paragraphs: DataFrame, least: float = 0.8, n: int = 6) -> DataFrame:
    """(paper_id, par_uid, coverage): paragraphs whose runs of six words the paper's abstract has to that share. Runs are
    hashed before they meet, so neither text travels with the other."""
    a = papers.filter("abstract IS NOT NULL AND paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("abstract")).select("paper_id", _hashed(F.col("abstract"), n).alias("whole"))
    p = distinct_paragraphs(paragraphs).filter("text IS NOT NULL").select("paper_id", "par_uid", _hashed(F.col("text"), n).alias("part"))
    return p.join(a, "paper_id").select("paper_id", "par_uid", X.coverage(F.col("part"), F.col("whole")).alias("coverage")).filter(F.col("coverage") >= least)


def _hashed(text: Column, n: int) -> Column:
    """Distinct runs of n words as 64-bit hashes."""

    def runs(t: Column) -> Column:
        size = F.size(t)
        return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(F.slice(t, i, n))))).otherwise(F.array().cast("array<bigint>"))

    return X.let(X.words(text), runs)


def missing_prose(source: DataFrame, canonical: DataFrame, key: str, least: float = 0.5, words: int = 25, n: int = 6) -> DataFrame:
    """Texts of `source` (key, text) of `words` words or more that `canonical` (key, text) covers to less than `least` by runs
    of six words. Hashes of runs are joined and counted for the hash of their text; texts come back at the end."""
    long = source.filter("text IS NOT NULL").filter(F.size(X.words(F.col("text"))) >= words)
    s = long.select(key, F.xxhash64("text", F.char_length("text")).alias("of"), F.explode(_hashed(F.col("text"), n)).alias("g"))
    c = canonical.filter("text IS NOT NULL").select(key, F.explode(_hashed(F.col("text"), n)).alias("g")).distinct().withColumn("hit", F.lit(1))
    by = s.distinct().join(c, [key, "g"], "left").groupBy(key, "of").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage")).filter(F.col("coverage") < least)
    texts = long.select(key, F.xxhash64("text", F.char_length("text")).alias("of"), "text").dropDuplicates([key, "of"])
    by = by.withColumnsRenamed({key: "_key", "of": "_of"})
    return texts.join(by, (F.col("of") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))).select(key, "text", "coverage")


def citations(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, par_uid, number): the numbers a paragraph cites, from the markers in its text."""
    return distinct_paragraphs(paragraphs).filter("text IS NOT NULL").select("paper_id", "par_uid", F.explode(X.markers(F.col("text"))).alias("number"))


def citation_gaps(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, cited, highest, missing): distinct numbers cited in a paper, the highest, and how many below it never are."""
    return citations(paragraphs).groupBy("paper_id").agg(F.countDistinct("number").alias("cited"), F.max("number").alias("highest")).withColumn("missing", F.col("highest") - F.col("cited"))


def relinked(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, par_uid, linked, unknown): of each paragraph's listed references, how many are printed in its text, and how
    many numbers printed there are not listed."""
    p = distinct_paragraphs(paragraphs).filter("text IS NOT NULL")
    listed = F.array_distinct(F.filter(F.transform(F.coalesce("cited_refs", F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int")), lambda x: x.isNotNull()))
    printed = X.markers(F.col("text"))
    return p.select("paper_id", "par_uid", F.size(F.array_intersect(listed, printed)).alias("linked"), F.size(F.array_except(printed, listed)).alias("unknown")).filter("linked + unknown > 0")


def float_homes(paragraphs: DataFrame, floats: DataFrame, key: str, refs: str) -> DataFrame:
    """(paper_id, key, id, par_uid, sec_ord, par_ord): the first paragraph that refers to each table or figure by its id;
    nulls for those that none refers to."""
    first = distinct_paragraphs(paragraphs).select("paper_id", "par_uid", *ORDER, F.explode(refs).alias("id")).groupBy("paper_id", "id").agg(F.min(F.struct(*ORDER, "par_uid")).alias("home"))
    return floats.select("paper_id", key, "id").distinct().join(first, ["paper_id", "id"], "left").select("paper_id", key, "id", "home.par_uid", "home.sec_ord", "home.par_ord")


_STOP = re.compile(r"(?<=[.!?。])[\"'”’)\]]*\s+")


def _sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _STOP.finditer(text):
        if m.end() < len(text) and not re.search(r"\b(?:al|vs|cf|e\.g|i\.e|Dr|Fig|Figs|No|approx|ref|Suppl|p|[A-Z])\.$", text[at : m.start() + 1].rstrip()):
            out.append(text[at : m.end()])
            at = m.end()
    return [*out, text[at:]]


def pack(pieces: list[tuple[str, str]], target: int, most: int, least: int) -> list[list[tuple[str, str]]]:
    """Pieces (id, text) in order, filled into groups: a group is closed when the next piece would take it over `target`,
    if it has `least` already or would pass `most`. Groups below `least` then join the next, else the one before, where
    that stays within `most`. Sizes are a quarter of the characters, with an empty line between pieces."""

    def size(group) -> int:
        return max(1, (sum(len(t) for _, t in group) + 2 * (len(group) - 1)) // 4) if group else 0

    groups: list[list[tuple[str, str]]] = []
    for piece in pieces:
        last = groups[-1] if groups else None
        over = last is not None and size([*last, piece])
        if last is None or over > target and (size(last) >= least or over > most):
            groups.append([piece])
        else:
            last.append(piece)
    i = 0
    while i < len(groups):
        if size(groups[i]) < least and i + 1 < len(groups) and size(groups[i] + groups[i + 1]) <= most:
            groups[i : i + 2] = [groups[i] + groups[i + 1]]
        elif size(groups[i]) < least and i and size(groups[i - 1] + groups[i]) <= most:
            groups[i - 1 : i + 1] = [groups[i - 1] + groups[i]]
            i -= 1
        else:
            i += 1
    return groups


def split_long(text: str, target: int, most: int, overlap: int = 2) -> list[str]:
    """Sentences gathered up to `target` tokens, each part beginning with the last `overlap` sentences of the one before where
    these fit; a sentence over `most` is cut between words, a word over it at its characters."""
    units: list[str] = []
    for s in _sentences(text):
        while len(s) > 4 * most:
            cut = s.rfind(" ", 1, 4 * most) + 1 or 4 * most
            units.append(s[:cut])
            s = s[cut:]
        if s:
            units.append(s)
    out: list[list[str]] = []
    for u in units:
        if out and (sum(map(len, out[-1])) + len(u)) // 4 <= target:
            out[-1].append(u)
            continue
        back = out[-1][-overlap:] if out and overlap else []
        while back and (sum(map(len, back)) + len(u)) // 4 > target:
            back = back[1:]
        out.append([*back, u])
    return ["".join(x).strip() for x in out]


def chunk_papers(paragraphs: DataFrame, papers: DataFrame, target: int = 550, most: int = 700, least: int = 80) -> DataFrame:
    """(paper_id, seq, section_type, header, text, n_tokens, para_ids): each paper's paragraphs packed into chunks that never
    cross a section; back matter is left out. A section is the unit of work: what one task gathers is one section of one
    paper, whatever the paper's size; numbers in a paper are given afterwards, over ranges."""
    titles = papers.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("meta.title").alias("title"))
    p = distinct_paragraphs(paragraphs).filter((F.coalesce("text", F.lit("")).rlike(r"\S")) & (F.coalesce("section_type", F.lit("other")) != "back"))
    p = p.join(titles, "paper_id", "left").select("paper_id", *ORDER, "id", "par_uid", "section_type", X.context_header(F.coalesce("title", F.col("paper_id")), F.col("path")).alias("header"), X.collapse(F.col("text")).alias("text"))

    kind = pa.schema([("paper_id", pa.string()), ("sec_ord", pa.int32()), ("k", pa.int32()), ("section_type", pa.string()), ("header", pa.string()), ("text", pa.string()), ("n_tokens", pa.int32()), ("para_ids", pa.list_(pa.string()))])

    def section(rows: list[tuple]) -> list[tuple]:
        paper, sec, _, section_type, header, _ = rows[0]
        room = max(16, most - len(header) // 4 - 1)
        pieces = [(r[2] or "", part) for r in rows for part in (split_long(r[5], min(target, room), room) if len(r[5]) // 4 > room else [r[5]])]
        out = []
        for k, g in enumerate(pack(pieces, min(target, room), room, least)):
            text = "\n\n".join(t for _, t in g)
            out.append((paper, sec, k, section_type, header, text, max(1, (len(header) + 2 + len(text)) // 4), list(dict.fromkeys(i for i, _ in g))))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sections one after the other: rows come sorted by them."""
        rows: list[tuple] = []

        def given(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * len(kind), kind)], schema=kind)

        for b in batches:
            done: list[tuple] = []
            for r in zip(*(b.column(c).to_pylist() for c in ("paper_id", "sec_ord", "id", "section_type", "header", "text"))):
                if rows and rows[0][:2] != r[:2]:
                    done += section(rows)
                    rows = []
                rows.append(r)
            yield given(done)
        if rows:
            yield given(section(rows))

    ordered = p.repartition("paper_id", "sec_ord").sortWithinPartitions("paper_id", "sec_ord", "par_ord", "par_uid")
    packed = ordered.mapInArrow(work, "paper_id string, sec_ord int, k int, section_type string, header string, text string, n_tokens int, para_ids array<string>")
    return numbered(packed, "paper_id", ["sec_ord", "k"], "seq").drop("sec_ord", "k")


def markdown_view(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, sec_ord, par_ord, markdown): each paragraph with the headings that change before it, at their levels. A view
    is the lines of a paper in order; no paper is gathered into one row."""
    p = distinct_paragraphs(paragraphs).filter(F.coalesce("text", F.lit("")).rlike(r"\S"))
    path = F.filter(F.coalesce("path", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    p = carried(p.select("paper_id", *ORDER, "par_uid", "text", path.alias("parts")), "paper_id", [*ORDER, "par_uid"], F.col("parts"), "before")
    p = p.withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
    index = F.sequence(F.lit(1), F.size("parts"))
    news = F.filter(index, lambda i: ~F.slice("parts", 1, i).eqNullSafe(F.slice("before", 1, i)))
    heads = F.when(F.size("parts") > 0, F.array_join(F.transform(news, lambda i: F.concat(F.repeat(F.lit("#"), (i + 1).cast("int")), F.lit(" "), F.element_at("parts", i), F.lit("\n\n"))), "")).otherwise("")
    return p.select("paper_id", *ORDER, "par_uid", F.concat(heads, X.flat(F.col("text"))).alias("markdown"))


def units(paragraphs: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, key, text): what is translated of a paper: its abstract, its distinct headings and its paragraphs."""
    a = papers.filter("abstract IS NOT NULL AND paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("text")).select("paper_id", F.lit("abstract").alias("key"), "text")
    p = distinct_paragraphs(paragraphs).filter(F.coalesce("text", F.lit("")).rlike(r"\S"))
    h = p.select("paper_id", F.explode("path").alias("text")).filter(F.coalesce("text", F.lit("")).rlike(r"\S")).groupBy("paper_id", F.lower("text").alias("k")).agg(F.min("text").alias("text")).select("paper_id", F.concat(F.lit("h:"), "k").alias("key"), "text")
    return a.unionByName(h).unionByName(p.select("paper_id", F.concat(F.lit("p:"), "par_uid").alias("key"), "text"))


def overlaid(unit: DataFrame, cache: DataFrame) -> DataFrame:
    """(paper_id, key, text, translated): units with their translation from the cache (paper_id, key, text) where that keeps
    the citation numbers of the original, each as often; the original elsewhere."""
    c = cache.select("paper_id", "key", F.col("text").alias("other"))
    numbers = lambda t: F.array_sort(F.regexp_extract_all(t, F.lit(r"\[(\d+)\]"), 1))
    good = F.col("other").isNotNull() & (numbers(F.col("other")) == numbers(F.col("text")))
    return unit.join(c, ["paper_id", "key"], "left").select("paper_id", "key", F.when(good, F.col("other")).otherwise(F.col("text")).alias("text"), good.alias("translated"))


def untranslated(unit: DataFrame, cache: DataFrame) -> DataFrame:
    """Units (paper_id, key, text) that the cache (paper_id, key) doesn't have: what an incremental run has to do."""
    return unit.join(cache.select("paper_id", "key").distinct(), ["paper_id", "key"], "left_anti")


def repaired_symbols(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, par_uid, text): paragraphs in which codes of a symbol font stand for signs, with the signs. A letter between
    digits is a point anywhere; equals and plus are put only in papers that show somewhere that their fractions are no
    fractions (P ¼ .05), so that About ¼ stays."""
    p = distinct_paragraphs(paragraphs).filter("text IS NOT NULL").select("paper_id", "par_uid", "text")
    sign = r"(\p{L}|\)) ¼ (?=[\d.−-])"
    shown = p.filter(F.col("text").rlike(sign)).select("paper_id").distinct().withColumn("shown", F.lit(True))
    point = F.regexp_replace("text", r"(?<=\d)Á(?=\d)", "·")
    gated = F.regexp_replace(F.regexp_replace(point, sign, "$1 = "), r"(?<=[\p{L}\p{N}]) þ ", " + ")
    out = p.join(shown, "paper_id", "left").select("paper_id", "par_uid", F.col("text").alias("before"), F.when(F.col("shown"), gated).otherwise(point).alias("text"))
    return out.filter("text <> before").drop("before")


def split_table(caption: str, markdown: str, most: int) -> list[str]:
    """A table as texts of up to `most` tokens: its rows in order, each part with the caption and the header repeated unless
    these fill half of it; a row that is too long is cut at its characters."""
    rows = [r for r in markdown.split("\n") if r.strip()]
    n = 2 if len(rows) > 1 and set(rows[1].strip()) <= set("|-: ") else min(1, len(rows))
    head = "\n".join(filter(None, [caption and f"{caption}\n", *rows[:n]]))
    whole = "\n".join([head, *rows[n:]]) if rows[n:] else head
    if len(whole) // 4 <= most:
        return [whole] if whole.strip() else []
    if len(head) // 4 > most // 2:
        head, rest = "", [r for line in ([caption] if caption else []) + rows for r in (line[i : i + 4 * most] for i in range(0, len(line), 4 * most))]
    else:
        room = 4 * most - len(head) - 1
        rest = [line[i : i + room] for line in rows[n:] for i in range(0, len(line), room)]
    out: list[list[str]] = []
    for r in rest:
        if not out or (len(head) + 1 + sum(len(x) + 1 for x in out[-1]) + len(r)) // 4 > most:
            out.append([])
        out[-1].append(r)
    return ["\n".join(filter(None, [head, *part])) for part in out]


def float_chunks(tables: DataFrame, figures: DataFrame, papers: DataFrame, most: int = 700) -> DataFrame:
    """(paper_id, kind, uid, part, text, n_tokens): chunks of what stands outside the sections: abstracts, tables by rows, and
    figures by their captions. Empty ones give none."""
    a = papers.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("text")).select("paper_id", F.lit("abstract").alias("kind"), F.col("paper_id").alias("uid"), "text", F.lit("").alias("markdown"))
    t = tables.select("paper_id", F.lit("table").alias("kind"), F.col("table_uid").alias("uid"), F.col("caption").alias("text"), "markdown").dropDuplicates(["uid"])
    f = figures.select("paper_id", F.lit("figure").alias("kind"), F.col("figure_uid").alias("uid"), F.col("caption").alias("text"), F.lit("").alias("markdown")).dropDuplicates(["uid"])

    def work(batches):
        for b in batches:
            rows = []
            for p, kind, uid, text, markdown in b.itertuples(index=False):
                text, markdown = text or "", markdown or ""
                parts = split_table(text.strip(), markdown, most) if kind == "table" else split_long(text.strip(), most, most, 2) if text.strip() else []
                rows += [(p, kind, uid, k, x, max(1, len(x) // 4)) for k, x in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["paper_id", "kind", "uid", "part", "text", "n_tokens"])

    return a.unionByName(t).unionByName(f).mapInPandas(work, "paper_id string, kind string, uid string, part int, text string, n_tokens int")

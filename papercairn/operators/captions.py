"""Captions, abstracts, terms and references as lines: what belongs to a paper's text and what only stands in it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import text as X
from papercairn.functions import values as V
from papercairn.functions.python import common_words

# Fixed values
ABSTRACT_TAILS = (
    r"(?s)\s*(?:K ?E ?Y ?\s?W ?O ?R ?D ?S?\b|Key ?[Ww]ords?\s*:).*$",
    r"\s*\([A-Z][A-Za-z .]{4,40}\s+\d{4};\d+[:;].*$",
    r"\s*\(\s*$",
    r"(?is)\s*(?:the online version of this article|electronic supplementary|supplementary information).*$",
)
CAPTION_LEAK = r"(?s)^(.*?[.!?]['\"”)\]]?)\s+((?:Figure|Fig\.|Table|TABLE|FIGURE)\s*\d{1,3}[.:]\s.{15,400})$"
SIGNATURES = {
    "replaced": r"\x{FFFD}",
    "control": r"[\x{0080}-\x{009F}]",
    "utf8_as_latin": r"[ÃÂ][\x{0080}-\x{00BF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]",
    "utf8_as_mac": r"√[©®±§¥†°¢£•¶ß]|‚Ä",
    "utf8_as_dos": r"[┬├╬][^\s\w]",
    "quarter": r"(\p{L}|\)) ¼ [\d.−-]",
    "middle_dot": r"\dÁ\d",
    "ligature": r"[ﬀﬁﬂﬃﬄ]",
    "cid": r"\(cid:\d+\)",
    "private": r"[\x{E000}-\x{F8FF}]",
}


def floats(tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(paper_id, uid, kind, number, caption): captions of tables and figures with their kind and number, each once."""
    t = tables.select("paper_id", F.col("table_uid").alias("uid"), F.lit("table").alias("kind"), "caption")
    f = figures.select("paper_id", F.col("figure_uid").alias("uid"), F.lit("figure").alias("kind"), "caption")
    return t.unionByName(f).distinct().withColumn("number", X.table_number(F.col("caption")))


def caption_map(captions: DataFrame) -> DataFrame:
    """(paper_id, kind, number, caption, claims): the longest caption of each number (the last by order among equals), and by
    how many different captions it is claimed."""
    c = captions.filter("number IS NOT NULL")
    return c.groupBy("paper_id", "kind", "number").agg(F.max(F.struct(F.char_length("caption").alias("n"), "caption")).alias("best"), F.countDistinct("caption").alias("claims")).select("paper_id", "kind", "number", F.col("best.caption").alias("caption"), "claims")


def ambiguous_numbers(captions: DataFrame, least: float = 0.7) -> DataFrame:
    """(paper_id, kind, number): numbers claimed by a caption unlike the longest one of the number (edit ratio below 0.7)."""
    best = caption_map(captions).filter("claims > 1").withColumnRenamed("caption", "best")
    both = captions.join(best, ["paper_id", "kind", "number"])
    ratio = 1 - F.levenshtein("caption", "best") / F.greatest(F.char_length("caption"), F.char_length("best"))
    return both.filter(ratio < least).select("paper_id", "kind", "number").distinct()


def leaked_captions(paragraphs: DataFrame, captions: DataFrame, words: int = 6) -> DataFrame:
    """(paper_id, uid, par_uid): paragraphs that hold the first words of a caption of their paper. Joined on these words as one
    run among the runs of each paragraph, not paragraph by caption."""
    lead = F.xxhash64(F.array_join(F.slice(X.words(F.col("caption")), 1, words), " "))
    c = captions.filter(F.size(X.words(F.col("caption"))) >= words).select("paper_id", "uid", lead.alias("g"))
    p = paragraphs.filter("text IS NOT NULL").select("paper_id", "par_uid", F.explode(F.transform(X.shingles(X.words(F.col("text")), words), lambda g: F.xxhash64(g))).alias("g"))
    return p.join(c, ["paper_id", "g"]).select("paper_id", "uid", "par_uid").distinct()


def without_caption(text: Column) -> Column:
    """struct(text, caption): a caption that trails behind the last sentence taken off; null where there is none."""
    return F.struct(F.when(text.rlike(CAPTION_LEAK), F.regexp_extract(text, CAPTION_LEAK, 1)).otherwise(text).alias("text"), F.nullif(F.regexp_extract(text, CAPTION_LEAK, 2), F.lit("")).alias("caption"))


def without_journal(text: Column, journal: Column) -> Column:
    """The text without the journal's name (of twelve characters or more, in any case) wherever it stands in the midst of a
    sentence: behind a word that calls for no name and no end mark, before a small letter."""
    calls = "|".join(V.BEFORE_JOURNAL)
    name = F.regexp_replace(F.regexp_replace(F.trim(journal), r"([\\\[\](){}.*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    pattern = F.concat(F.lit(rf"(?<=[^\s.!?:;])(?<!\b(?i:{calls})[^A-Za-z]{{0,12}})\s+(?i:"), name, F.lit(r")\s+(?=[a-z])"))
    return F.when(F.char_length(F.trim(journal)) >= 12, F.regexp_replace(text, pattern, F.lit(" "))).otherwise(text)


def abstract_tail(abstract: Column) -> Column:
    """The abstract without what print sets behind it, if that begins after its 120th character: a line of keywords (in
    capitals, or with a colon), the journal's citation of itself, an opening bracket left over, a note on supplements."""
    out = F.trim(abstract)
    for tail in ABSTRACT_TAILS:
        body = F.regexp_replace(out, tail, "")
        out = F.when((F.char_length(body) > 120) & (F.char_length(body) < F.char_length(out)), F.rtrim(body)).otherwise(out)
    return out


def abstract_verdict(abstract: Column, witness: Column) -> Column:
    """struct(precision, recall, ok) of an abstract against another source's: ok from a recall of 0.85 and a precision of 0.80
    of its words as multisets; null where either is missing."""
    size = lambda t: F.size(X.words(F.coalesce(t, F.lit(""))))
    common = common_words(abstract, witness)
    known = (size(abstract) > 0) & (size(witness) > 0)
    precision, recall = F.when(known, common / size(abstract)), F.when(known, common / size(witness))
    return F.struct(precision.alias("precision"), recall.alias("recall"), ((recall >= 0.85) & (precision >= 0.80)).alias("ok"))


def chosen_abstract(extracted: Column, api: Column) -> Column:
    """struct(abstract, source): the extracted one where it is confirmed or nothing is there to confirm it; the other source's
    where it isn't; neither where both are missing."""
    ok = abstract_verdict(extracted, api)["ok"]
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(ok, F.struct(extracted.alias("abstract"), F.lit("extracted").alias("source"))).when(some(api), F.struct(api.alias("abstract"), F.lit("api").alias("source"))).when(some(extracted), F.struct(extracted.alias("abstract"), F.lit("extracted_unver").alias("source"))).otherwise(F.struct(F.lit(None).cast("string").alias("abstract"), F.lit("none").alias("source")))


def terms_in(text: Column, glossary: list[str], limit: int = 24) -> Column:
    """Terms of the glossary that the text holds, longest first, none that is part of another one found."""
    every = F.array(*[F.lit(t.lower()) for t in sorted(set(glossary), key=lambda t: (-len(t), t))])
    found = X.let(F.lower(text), lambda low: F.filter(every, lambda t: low.contains(t)))
    return X.let(found, lambda some: F.slice(F.filter(some, lambda t: ~F.exists(some, lambda u: (u != t) & u.contains(t))), 1, limit))


def author_line(authors: Column, limit: int = 6) -> Column:
    """The first six authors, and et al. where there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, limit), ", "), F.when(F.size(authors) > limit, F.lit(", et al")).otherwise(F.lit("")))


def reference_line(meta: Column) -> Column:
    """Authors. Title. Journal. Year. doi: what is known of a paper, as one line."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    return F.concat_ws(". ", some(author_line(meta["authors"])), some(meta["title"]), some(meta["journal"]), meta["year"].cast("string"), F.concat(F.lit("doi:"), some(meta["doi"])))


def human_name(meta: Column, longest: int = 110) -> Column:
    """Year, journal's abbreviation and title, as the name of a file."""
    name = F.concat_ws(" ", meta["year"].cast("string"), X.journal_abbreviation(meta["journal"]), F.regexp_replace(F.coalesce(meta["title"], F.lit("")), r"[\\/:*?\"<>|]", " "))
    return F.trim(F.substring(X.flat(name), 1, longest))


def encoding_profile(texts: DataFrame, key: str) -> DataFrame:
    """How many texts (key, text) of each key show each signature of damage."""
    return texts.filter("text IS NOT NULL").groupBy(key).agg(*[F.sum(F.col("text").rlike(p).cast("int")).alias(name) for name, p in SIGNATURES.items()])


def marker_numbers(paragraphs: DataFrame) -> DataFrame:
    """(paper_id, key, number): the printed number of each citation key, as most of its paragraphs have it (the smaller of
    equals); numbers that two keys of a paper claim are left out."""
    pairs = paragraphs.select("paper_id", "par_uid", F.explode(F.arrays_zip("cited_keys", "cited_refs")).alias("x")).distinct()
    votes = pairs.select("paper_id", F.col("x.cited_keys").alias("key"), F.col("x.cited_refs").try_cast("int").alias("number")).filter("key IS NOT NULL AND number BETWEEN 1 AND 999")
    best = votes.groupBy("paper_id", "key", "number").agg(F.count(F.lit(1)).alias("n")).groupBy("paper_id", "key").agg(F.max_by("number", F.struct("n", -F.col("number"))).alias("number"))
    once = best.groupBy("paper_id", "number").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).filter("n = 1")
    return once.select("paper_id", "key", "number")


def merged_metadata(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """One row per key of several sources' rows: each column from the first source, by priority, that knows it."""
    others = [c for c in rows.columns if c not in (key, priority)]
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in others])


def numbered_paths(headings: DataFrame) -> DataFrame:
    """(doc_id, ord, path) of headings (doc_id, ord, number, title) in order: the headings above each by the depth of its
    number (3.1 is below 3), four levels at most; one without a number is below the last of the first level."""
    depth = F.when(F.coalesce("number", F.lit("")).rlike(r"^\d+(\.\d+)*\.?$"), F.least(F.lit(4), F.size(F.split(F.regexp_replace("number", r"\.$", ""), r"\.")))).otherwise(2)
    h = headings.withColumn("depth", depth)
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    for d in range(1, 5):
        h = h.withColumn(f"h{d}", F.last(F.when(F.col("depth") <= d, F.struct("ord", "depth", "title")), ignorenulls=True).over(w))
    levels = F.array(*[F.when((F.col("depth") >= d) & (F.col(f"h{d}.depth") == d), F.col(f"h{d}.title")) for d in range(1, 5)])
    return h.select("doc_id", "ord", F.filter(levels, lambda x: x.isNotNull()).alias("path"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """(paper_id, number, parts, rows): tables whose rows go on under captions of the same number that say so, as one; parts
    are the uids in order."""
    t = tables.select("paper_id", "table_uid", "caption", "markdown").distinct().withColumn("number", X.table_number(F.col("caption"))).filter("number IS NOT NULL")
    again = F.coalesce(F.col("caption"), F.lit("")).rlike(r"(?i)\bcont(inued|\.|d\.?)")
    g = t.withColumn("again", again).groupBy("paper_id", "number").agg(F.array_sort(F.collect_list("table_uid")).alias("parts"), F.max(F.col("again").cast("int")).alias("again"), F.sum(F.greatest(F.lit(0), F.size(F.filter(F.split(F.coalesce("markdown", F.lit("")), "\n"), lambda r: F.trim(r) != "")) - 2)).alias("rows"))
    return g.filter("again = 1").select("paper_id", "number", "parts", "rows")


def reranked(hits: DataFrame, scorer: Column, head: int = 50) -> DataFrame:
    """hits (qid, rank, ...) with the first 50 of each query put in order of a score, the rest behind them as they were."""
    w = W.partitionBy("qid").orderBy(F.when(F.col("rank") <= head, 0).otherwise(1), F.when(F.col("rank") <= head, -scorer), "rank")
    return hits.withColumn("_r", F.row_number().over(w)).drop("rank").withColumnRenamed("_r", "rank")


def shown(hits: DataFrame, width: int = 80) -> DataFrame:
    """hits as lines for reading: rank, paper, header, and the first characters of the text."""
    return hits.select("qid", "rank", F.format_string("%2d. [%s] %s: %s", "rank", F.coalesce("paper_id", F.lit("?")), F.coalesce("context_header", F.lit("")), F.substring(X.flat(F.coalesce("text", F.lit(""))), 1, width)).alias("line"))


def filters_from(options: dict) -> dict:
    """Options as typed (section, kind, paper, year, journal, type) as the filters of retrieval.passes; unknown sections, kinds
    or years are errors."""
    out: dict = {}
    split = lambda v: [x.strip() for y in (v if isinstance(v, list) else [v]) for x in y.split(",") if x.strip()]
    closed = {"section": ("section_types", {*X.SECTIONS, "other"}), "kind": ("kinds", {"abstract", "text", "table", "figure"}), "paper": ("paper_ids", None), "type": ("pub_types", None)}
    for name, value in options.items():
        if value in (None, "", []):
            continue
        if name == "year":
            low, _, high = str(value).replace(" ", "").partition("-")
            if not all(x == "" or x.isdigit() and len(x) == 4 for x in (low, high)) or not low and not high:
                raise ValueError(f"no span of years: {value}")
            out["years"] = (int(low) if low else None, int(high) if high else None if "-" in str(value) else int(low))
        elif name == "journal":
            out["journal"] = value
        elif name in closed:
            key, known = closed[name]
            out[key] = split(value)
            if known and (bad := {x.lower() for x in out[key]} - known):
                raise ValueError(f"unknown {name}: {', '.join(sorted(bad))}")
        else:
            raise ValueError(f"unknown option: {name}")
    return out


def load_queries(path) -> list[dict]:
    """The queries of a golden set, a file of JSON with `queries`: id, query, and perhaps anchor (what a paper's title must
    hold to be an answer), lang, hard (few words in common with its answers), section_types (a filter to be kept to).
    Queries without an id or text, or with an id given before, are errors."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["queries"]
    out, seen = [], set()
    for r in rows:
        if not r.get("id") or not (r.get("query") or "").strip() or r["id"] in seen:
            raise ValueError(f"a query of the golden set has no id or text of its own: {r}")
        seen.add(r["id"])
        out.append({"id": r["id"], "query": r["query"], "anchor": r.get("anchor"), "lang": r.get("lang") or "en", "hard": bool(r.get("hard")), "section_types": list(r.get("section_types") or [])})
    return out

"""The collection as relations: manifest, metadata, resumption, duplicates, and quality of each paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import text as X
from papercairn.functions.python import common_words, identity_score
from papercairn.tables import kept

#: What each flag takes off a paper's score, and which flags fail it whatever the score.
PENALTIES = {
    "scanned_no_text_layer": 0.5, "no_sections": 0.4, "abstract_is_body_first_paragraph": 0.3, "abstract_title_zero_overlap": 0.3, "abstract_truncated_or_foreign": 0.25, "abstract_polluted": 0.15,
    "abstract_unverified": 0.0, "doi_unresolved": 0.5, "identity_mismatch": 0.5, "no_references_extracted": 0.15, "ref_count_off": 0.1, "char_corruption": 0.2, "fallback_needs_grobid": 0.0,
}
FATAL = ("no_sections", "doi_unresolved", "identity_mismatch")
#: Signs of damage and of what doesn't belong into the body.
BROKEN = r"[\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]"
LIGATURES, CID = "[ﬀﬁﬂﬃﬄﬆ]", r"\(cid:\d+\)"
FRONT_MATTER = r"(?i)^\s*(received:|accepted:|correspondence\b|©|copyright|downloaded from|e-?mail|how to cite|this article|funding information|conflict of interest|doi:\s*10\.)"
GLUED_CITATION = r"\b[a-z]{4,}\.\d{1,3}[,\-–]\d{1,3}\b"
REFERENCE = r"^[A-Z][a-zA-Z\-]+ [A-Z]{1,3}(,| et al).{0,120}\.\s.{5,}\.\s.{0,60}\d{4}"
PASS_SCORE = 0.6


def latest(df: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    """The last delivery of each key: the row of the latest time, ties by the columns given. By aggregation, so rows of a
    frequent key are reduced before they are shuffled."""
    row = F.struct(*[c for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.struct(time, *ties)).alias("r")).select("r.*")


def duplicate_groups(manifest: DataFrame) -> DataFrame:
    """file, dup_group and is_primary of each file: files of one DOI, else of one content, else alone; the first by name is
    the primary. A file listed twice counts once."""
    group = F.coalesce(F.concat(F.lit("doi:"), F.lower(F.nullif(F.trim("doi"), F.lit("")))), F.concat(F.lit("sha1:"), F.nullif(F.trim("sha1"), F.lit(""))), F.concat(F.lit("path:"), F.col("file")))
    rows = manifest.select("file", group.alias("dup_group")).distinct()
    first = rows.groupBy("dup_group").agg(F.min("file").alias("first"))
    return rows.join(first, "dup_group").select("file", "dup_group", (F.col("file") == F.col("first")).alias("is_primary"))


def unidentified(manifest: DataFrame) -> DataFrame:
    """Files without a DOI, and without one among the candidates printed in them."""
    none = lambda c: c.isNull() | (F.trim(c) == "")
    return manifest.filter(none(F.col("doi")) & (F.coalesce(F.size("doi_candidates"), F.lit(0)) <= 0)).select("file", "sha1", "title_guess").distinct()


def to_process(manifest: DataFrame, papers: DataFrame) -> DataFrame:
    """Files to work on: readable primaries with a DOI whose paper isn't there yet. An anti join, so nothing is collected."""
    wanted = manifest.filter(F.col("is_primary") & F.col("error").isNull() & F.col("doi").isNotNull()).select("file", F.lower(F.trim("doi")).alias("paper_id")).distinct()
    return wanted.join(papers.select(F.lower(F.trim("paper_id")).alias("paper_id")).distinct(), "paper_id", "left_anti")


def resume(previous: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both ledgers as one: the new row of a key replaces the previous one; keys only in the previous one stay."""
    return previous.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def changed(previous: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of `now` that are new or whose digest differs from the previous one: what an idempotent run has to redo."""
    before = previous.select(key, F.col(digest).alias("_before"))
    return now.join(before, key, "left").filter(~F.col("_before").eqNullSafe(F.col(digest)) | F.col("_before").isNull()).drop("_before")


def enriched(papers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Papers with what the manifest knows of their primary files; papers without a file keep nulls."""
    files = manifest.filter("is_primary").groupBy("paper_id").agg(F.min("file").alias("file"), F.max("pages").alias("pages"), F.max("total_chars").alias("total_chars"), F.max("is_scanned_candidate").alias("is_scanned_candidate"))
    return papers.join(files, "paper_id", "left")


def doi_claims(manifest: DataFrame, least: int = 3) -> DataFrame:
    """DOIs that many files print: doi, files, banned. A DOI printed in `least` files or more identifies none of them."""
    printed = manifest.select("file", F.explode(F.array_distinct(F.transform("doi_candidates", X.canonical_doi))).alias("doi")).distinct()
    return printed.groupBy("doi").agg(F.count(F.lit(1)).alias("files")).withColumn("banned", F.col("files") >= least)


def resolved_dois(manifest: DataFrame, papers: DataFrame, least: int = 90) -> DataFrame:
    """file, doi, score for files without a DOI: of the DOIs printed in them, the paper whose title is likest the guessed one,
    at `least` of 100 by edit distance. The join is on the printed DOI, so titles are compared only there."""
    files = manifest.filter(F.col("doi").isNull() & F.col("title_guess").isNotNull()).select("file", X.ascii_key(F.col("title_guess")).alias("guess"), F.explode(F.array_distinct(F.transform("doi_candidates", X.canonical_doi))).alias("doi")).distinct()
    titles = papers.select(X.canonical_doi(F.col("paper_id")).alias("doi"), X.ascii_key(F.col("meta.title")).alias("title")).distinct()
    both = files.join(titles, "doi")
    longest = F.greatest(F.char_length("guess"), F.char_length("title"))
    score = F.when(longest > 0, F.round(100 * (1 - F.levenshtein("guess", "title") / longest), 1))
    best = both.withColumn("score", score).filter(F.col("score") >= least)
    return best.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy(F.desc("score"), "doi"))).filter("n = 1").select("file", "doi", "score")


def lexical_agreement(left: Column, right: Column) -> Column:
    """struct(common, precision, recall) of the words of two texts as multisets: what they have in common, as a share of each;
    null for a text without words."""
    common = common_words(left, right)
    share = lambda t: F.when(F.size(X.words(F.coalesce(t, F.lit("")))) > 0, common / F.size(X.words(F.coalesce(t, F.lit("")))))
    return F.struct(common.cast("int").alias("common"), share(left).alias("precision"), share(right).alias("recall"))


def signals(papers: DataFrame, paragraphs: DataFrame, tables: DataFrame, manifest: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row per paper with its counts: sections, paragraphs, characters, damage, duplicates, headings that are none, front
    matter, citations and references in the body, references, tables and empty ones, and what its file and other sources
    say. metadata: paper_id, api_abstract, reference_count (as registered), known (some source knows the paper), resolves
    (its DOI does), file_name; without it nothing is known of these. Every relation is counted by itself, on its own key,
    before the joins."""
    p = paragraphs.select("paper_id", "sec_ord", "par_ord", "text", "path").distinct()
    t = F.coalesce(F.col("text"), F.lit(""))
    head = F.element_at("path", -1)
    odd = head.isNotNull() & (head.rlike(r"^[\d\s.|)]+$") | (F.char_length(head) == 1) | (F.char_length(head) > 150))
    times = lambda pattern: F.sum(F.size(F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)))
    having = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by = p.groupBy("paper_id").agg(
        F.countDistinct("sec_ord").alias("n_sections"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.sum(F.char_length(t)).alias("letters"),
        times(BROKEN).alias("broken"),
        times(LIGATURES).alias("ligatures"),
        times(CID).alias("cid"),
        times(GLUED_CITATION).alias("glued"),
        having(F.trim(t).rlike(REFERENCE)).alias("listed"),
        F.count("text").alias("n_texts"),
        F.countDistinct("text").alias("n_different"),
        having(X.is_truncated(t)).alias("truncated"),
        having(t.rlike(FRONT_MATTER)).alias("frontmatter"),
        F.countDistinct(F.when(odd, F.col("sec_ord"))).alias("bad_headings"),
        F.min_by("text", F.when(F.trim(t) != "", F.struct("sec_ord", "par_ord", "text"))).alias("first_text"),
    )
    refs = paragraphs.select("paper_id", F.explode("cited_keys").alias("ref")).filter("ref IS NOT NULL").distinct().groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_references"))
    tb = tables.select("paper_id", "table_uid", "markdown").distinct().groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_tables"), having(F.trim(F.coalesce("markdown", F.lit(""))) == "").alias("empty_tables"))
    m = manifest.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.max("pages").alias("pages"), F.max("total_chars").alias("total_chars"), F.max("is_scanned_candidate").alias("scanned"))
    base = papers.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min(F.col("source")).alias("source"), F.min("abstract").alias("abstract"), F.min("abstract_source").alias("abstract_source"), F.min("meta.title").alias("title"), F.min(F.array_join("meta.pub_types", " ")).alias("pub_types"))
    if metadata is None:
        metadata = papers.sparkSession.createDataFrame([], "paper_id string, api_abstract string, reference_count int, known boolean, resolves boolean, file_name string")
    out = base.join(by, "paper_id", "left").join(refs, "paper_id", "left").join(tb, "paper_id", "left").join(m, "paper_id", "left").join(metadata, "paper_id", "left")
    counts = ["n_sections", "n_paragraphs", "letters", "broken", "ligatures", "cid", "glued", "listed", "n_texts", "n_different", "truncated", "frontmatter", "bad_headings", "n_references", "n_tables", "empty_tables", "pages", "total_chars"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    return out.withColumn("n_chars", F.col("letters") + F.greatest(F.lit(0), F.col("n_paragraphs") - 1)).withColumn("duplicates", F.col("n_texts") - F.col("n_different")).drop("letters")


def _marked(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda f: f.isNotNull())


def quality(s: DataFrame) -> DataFrame:
    """paper_id, source, flags, quality_score, passed from the signals of each paper. An abstract is judged by what another
    source has of it (words it lacks: cut or foreign; words of its own: polluted), by the body's first paragraph and by the
    title; one that nothing speaks for or against is unverified, which costs nothing. The score is 1 less the penalties of
    the flags; that of an extracted abstract is at most 0.6 and 0.4 of its recall; papers read from layout alone stay at
    0.65 at most. Not passed: below 0.6, or any fatal flag."""
    abstract, api = F.trim(F.coalesce("abstract", F.lit(""))), F.trim(F.coalesce("api_abstract", F.lit("")))
    there = abstract != ""
    with_api, with_body = lexical_agreement(abstract, api), lexical_agreement(abstract, F.coalesce("first_text", F.lit("")))
    title = F.filter(X.words(F.coalesce("title", F.lit(""))), lambda w: F.char_length(w) > 3)
    s = s.withColumns({"_api": with_api, "_body": with_body, "_same": identity_score(F.col("title"), F.col("file_name"))})
    compared = there & (api != "")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    echo = there & (F.least(share("_body.precision"), share("_body.recall")) >= 0.90)
    foreign = there & (F.size(title) > 0) & (F.size(F.array_intersect(X.words(abstract), title)) == 0)
    cut, polluted = compared & (share("_api.recall") < 0.85), compared & (share("_api.precision") < 0.80)
    registered = F.coalesce(F.col("reference_count"), F.lit(0))
    rules = {
        "scanned_no_text_layer": F.col("scanned"),
        "no_sections": (F.col("n_sections") == 0) | (F.col("n_paragraphs") == 0),
        "abstract_is_body_first_paragraph": echo,
        "abstract_title_zero_overlap": foreign,
        "abstract_truncated_or_foreign": cut,
        "abstract_polluted": polluted,
        "abstract_unverified": there & (api == "") & ~echo & ~foreign,
        "doi_unresolved": ~F.coalesce("known", F.lit(False)) | ~F.coalesce("resolves", F.lit(True)),
        "identity_mismatch": F.coalesce(F.col("_same") < 70, F.lit(False)),
        "no_references_extracted": (registered > 0) & (F.col("n_references") == 0),
        "ref_count_off": (registered > 0) & (F.col("n_references") > 0) & (F.abs(F.col("n_references") - registered) / F.greatest(registered, F.lit(1)) > 0.5),
        "char_corruption": F.col("broken") / F.greatest("n_chars", F.lit(1)) > 0.005,
        "fallback_needs_grobid": F.col("source") == "pdf_fallback",
    }
    off = sum((F.when(c, F.lit(PENALTIES[k])).otherwise(0.0) for k, c in rules.items()), F.lit(0.0))
    matched = (F.col("abstract_source") == "extracted") & compared
    raw = F.when(matched, F.least(1 - off, 0.6 + 0.4 * F.round(share("_api.recall"), 3))).otherwise(1 - off)
    raw = F.when(F.col("source") == "pdf_fallback", F.least(raw, F.lit(0.7)) - 0.05).otherwise(raw)
    score = F.greatest(F.lit(0.0), F.round(raw, 3))
    return s.select("paper_id", "source", _marked(rules).alias("flags"), score.alias("quality_score")).withColumn("passed", (F.col("quality_score") >= PASS_SCORE) & ~F.arrays_overlap("flags", F.array(*map(F.lit, FATAL))))


def audit(s: DataFrame) -> DataFrame:
    """paper_id and the flags of an audit of its text, from the signals. Letters and the like (by publication type, or -L- or
    -C- in the file's name) need have neither sections nor much body nor all references."""
    letter = F.coalesce(F.col("pub_types"), F.lit("")).rlike("(?i)letter|comment|editorial|reply|correspondence") | F.coalesce(F.col("file_name").rlike("-[LC]-"), F.lit(False))
    registered = F.coalesce(F.col("reference_count"), F.lit(0))
    rules = {
        "under_extracted": (F.col("total_chars") > 4000) & (F.round(F.col("n_chars") / F.col("total_chars"), 2) < 0.12),
        "no_sections": ~letter & (F.col("pages") >= 3) & (F.col("n_sections") <= 1),
        "too_little_body": ~letter & (F.col("pages") >= 4) & (F.col("n_chars") < 1500),
        "unresolved_ligatures": F.col("ligatures") > 8,
        "broken_chars": F.col("broken") > 3,
        "cid_artifacts": F.col("cid") > 0,
        "frontmatter_leak": F.col("frontmatter") >= 2,
        "cite_contamination": F.col("glued") >= 4,
        "references_in_body": F.col("listed") >= 3,
        "suspicious_headings": F.col("bad_headings") >= 2,
        "duplicate_paragraphs": F.col("duplicates") >= 3,
        "no_title": F.coalesce(F.col("title"), F.lit("")) == "",
        "references_missing": ~letter & (registered >= 8) & (F.col("n_references") < registered * 0.5),
    }
    return s.select("paper_id", _marked(rules).alias("flags"))


def flag_counts(audited: DataFrame) -> DataFrame:
    """flag and papers: how many papers have each flag; 'clean' are those without any."""
    return audited.select(F.explode(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("clean")))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("papers"))


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share and value: the values at positions round(share * (n - 1)) of the sorted column, halves to even. Values are counted,
    parted by ranges and written; each part's total gives where it begins, so that only parts are sorted and only as many
    totals as parts come to the driver."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = kept(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    totals = sorted(parts.groupBy("part").agg(F.min("value").alias("least"), F.sum("n").alias("n")).collect(), key=lambda r: r["least"])
    n = sum(r["n"] for r in totals)
    places = [(float(q), int(round(q * (n - 1)))) for q in shares] if n else []
    before, wanted = 0, []
    for r in totals:
        wanted += [(r["part"], q, p - before) for q, p in places if before <= p < before + r["n"]]
        before += r["n"]
    some = parts.join(F.broadcast(df.sparkSession.createDataFrame(wanted, "part int, share double, place bigint")), "part")  # a row a share
    running = some.withColumn("upto", F.sum("n").over(W.partitionBy("part", "share").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    return running.filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))).select("share", "value")

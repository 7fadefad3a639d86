"""Signs by which lines and paragraphs of print are told apart: JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papercairn.functions import text as X

# Fixed values
DEGREES = ("MD", "PhD", "MSc", "MPH", "MBBS", "BSc", "DO", "RN", "DrPH")
IMRAD = ("abstract", "intro", "methods", "results", "discussion")
ABSTRACT_HEAD = r"(?m)^[ \t]*(?:A ?B ?S ?T ?R ?A ?C ?T|Abstract|SUMMARY|Summary)[ \t]*[|:.]?[ \t]*$|^[ \t]*Abstract[ \t]*[|:][ \t]*(?=\S)"
ABSTRACT_STOP = r"(?m)^[ \t]*(?:K ?E ?Y ?\s?W ?O ?R ?D ?S?|Key[ \t]?words?)\b|^[ \t]*(?:\d[.\s|]*)?(?:INTRODUCTION|Introduction|BACKGROUND\s*$)|^[ \t]*(?:©|Copyright\b|This is an open access)|^[ \t]*(?:What'?s already known|What is already known)"
FOREIGN_SHARE = 0.15


def degrees(text: Column) -> Column:
    """How many academic degrees a text names."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\b({'|'.join(DEGREES)})\b"), 1))


def is_byline(text: Column) -> Column:
    """Whether a paragraph is a line of authors: three degrees or more."""
    return degrees(text) >= 3


def is_capitals(title: Column) -> Column:
    """Whether a title is set in capitals: three letters or more, none of them small."""
    letters = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}]", "")
    return (F.char_length(letters) >= 3) & ~letters.rlike(r"\p{Ll}")


def is_imrad(kinds: Column) -> Column:
    """Whether the types of a paper's headings make it one of the usual build: two of them, methods or results among them."""
    known = F.array_distinct(F.filter(kinds, lambda k: k.isin(*IMRAD)))
    return (F.size(known) >= 2) & F.arrays_overlap(known, F.array(F.lit("methods"), F.lit("results")))


def looks_author(text: Column) -> Column:
    """Whether a line names authors or where they work: an address or institution; or two words or more, four fifths with a
    capital and none of the common small ones, with a comma, a degree, or a mark behind a figure."""
    t = F.trim(F.coalesce(text, F.lit("")))
    place = t.contains("@") | t.rlike(r"(?i)\b(e-?mail|correspondence|department|university|hospital|college of medicine)\b")
    words = F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z'’\-]*)"), 1)
    small = F.exists(words, lambda w: F.lower(w).isin("the", "of", "and", "in", "for", "with", "to", "on", "by", "from", "was", "were", "is", "are", "an", "a"))
    capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    signs = t.contains(",") | t.rlike(r"\b(MD|PhD|MSc|MBBS|MPH|iD)\b") | t.rlike(r"\d\s*[,*]")
    return place | ((F.size(words) >= 2) & ~small & (capitals >= 0.8 * F.size(words)) & signs)


def is_author_list(text: Column) -> Column:
    """Whether a line (under 160 characters) lists authors: names parted by bars, or three or more by commas, or two of two
    words each, all beginning with a capital."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(t, r"\s*[|,]\s*"), F.trim), lambda p: p != "")
    names = F.forall(parts, lambda p: p.rlike(r"^[A-Z][\w.'’\-]*( [A-Z][\w.'’\-]*){0,4}$"))
    two = F.forall(parts, lambda p: F.size(F.split(p, r"\s+")) >= 2)
    return (F.char_length(t) < 160) & (F.size(parts) >= 2) & names & (t.contains("|") | (F.size(parts) >= 3) | two)


def looks_prose(text: Column) -> Column:
    """Whether a line is running text rather than cells: 60 characters, ten words, figures an eighth at most."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.char_length(t) >= 60) & (F.size(F.split(t, r"\s+")) >= 10) & (F.char_length(F.regexp_replace(t, r"\D", "")) <= 0.12 * F.char_length(t))


def reference_item(text: Column) -> Column:
    """Whether a line begins a numbered reference."""
    return F.coalesce(text, F.lit("")).rlike(r"^\s*\[?\d{1,3}[.\])]\s+[A-Z]")


def reference_sign(text: Column) -> Column:
    """Whether a line has what references have: year; volume: pages, et al, a DOI, a number before a capital, or a name with
    initials."""
    t = F.coalesce(text, F.lit(""))
    signs = [r"\b(19|20)\d\d;\s?\d+", r"\bet al\b", r"\b10\.\d{4,9}/", r"^\s*\[?\d{1,3}[.\])]\s+[A-Z]", r"\b[A-Z][a-z]+ [A-Z]{1,3}[,.]"]
    return reduce(lambda a, b: a | b, [t.rlike(s) for s in signs])


def doi_line(text: Column) -> Column:
    """The DOI of a line that holds nothing else; else null."""
    d = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)^\s*(?:https?://(?:dx\.)?doi\.org/|doi:?\s*)?(10\.\d{4,9}/\S+)\s*$", 1)
    return F.nullif(F.regexp_replace(d, "[.,;]+$", ""), F.lit(""))


def printed_abstract(text: Column, limit: int = 6000) -> Column:
    """What follows the heading of the abstract in a text of pages, up to the keywords, the introduction or a copyright note
    (80 characters at least); empty where there is no such heading."""
    behind = F.get(F.split(text, ABSTRACT_HEAD, 2), F.lit(1))
    body = F.substring(F.coalesce(behind, F.lit("")), 1, limit)
    first = F.get(F.split(body, ABSTRACT_STOP, 2), F.lit(0))
    part = F.when((F.char_length(first) > 80) & (F.char_length(first) < F.char_length(body)), first).otherwise(body)
    return X.collapse(F.regexp_replace(part, r"^\s+|\s+$", ""))


def foreign_scope(text: Column) -> Column:
    """Whether more than 15 % of a text are Hangul: such a paper's body is left out."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return (n > 0) & (F.char_length(F.regexp_replace(text, r"[^\x{AC00}-\x{D7A3}]", "")) > FOREIGN_SHARE * n)


def caption_prepared(caption: Column) -> Column:
    """A caption on one line, a label set apart by blanks (F I G U R E) joined, letters of panels before it taken off."""
    s = X.flat(F.regexp_replace(F.coalesce(caption, F.lit("")), "\n", " "))
    spaced = r"^((?:T ?A ?B ?L ?E|F ?I ?G ?U ?R ?E|F ?I ?G))(?=[ .]*\d)"
    label = F.regexp_extract(s, spaced, 1)
    s = F.when(label != "", F.concat(F.replace(label, F.lit(" "), F.lit("")), F.substring(s, F.char_length(label) + 1, F.char_length(s)))).otherwise(s)
    return F.regexp_replace(s, r"^(?:\(?[A-Ha-h]\)?[ .,]+){1,8}(?=(?i:fig|table))", "")


def heading_terms(mesh: Column, keywords: Column) -> Column:
    """Subject headings, then keywords that are none of them, each once in any case; blanks left out."""
    some = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.trim), lambda x: x.isNotNull() & (x != ""))

    def first(a: Column, x: Column) -> Column:
        return F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.concat(some(mesh), some(keywords)), F.array().cast("array<string>"), first)

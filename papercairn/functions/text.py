"""Column expressions over text: all of them run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papercairn.functions import values as V

SECTIONS: dict[str, list[str]] = {}
for _phrase, _kind in V.rows(V.SECTION_ROWS):
    SECTIONS.setdefault(_kind, []).append(_phrase)
LAST_WORDS = dict(V.rows(V.LAST_WORD_ROWS))
# Fixed values
STOPWORDS = "a an and are as at be been by for from had has have in into is it its of on or that the their there these this those to was were which with we our".split()
NUMBER_PREFIX = r"(?i)^\s*(\d+(\.\d+)*|[ivxlcdm]+|[a-z])[.)]\s+"
DOI = r"10\.\d{4,9}/[^\s\"<>]+"
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV")
JUNK_SENTENCE_SHARE = (0.30, 0.55)
#: Letters of Latin script with a mark, and those without it, by Unicode decomposition.
ACCENTS = tuple(map("".join, zip(*[(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()])))
WORD = r"[\p{L}\p{N}]+"
TERM = r"[\p{L}\p{N}]+(?:[-/][\p{L}\p{N}]+)*"


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once a row: in a lambda an expression is worked out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of blanks and tabs as one blank; none at the ends. Line ends stay."""
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def flat(text: Column) -> Column:
    """All white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least; null text gives null."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


def slug(text: Column) -> Column:
    """A file name: what is no letter, digit, point, hyphen or underscore becomes an underscore; empty or null is unknown."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^-_.\p{L}\p{N}]", "_")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def clean_doi(text: Column) -> Column:
    """The first DOI in the text, in lower case, without closing punctuation; null if there is none."""
    hit = F.lower(F.regexp_replace(F.regexp_extract(text, "(" + DOI + ")", 1), r"[).,;:\]]+$", ""))
    return F.when(F.length(hit) > 0, hit)


def canonical_doi(text: Column) -> Column:
    """A DOI with its prefix of protocol or resolver cut off and doubled slashes joined, in lower case."""
    s = F.lower(F.trim(text))
    s = F.regexp_replace(s, r"^(https?://)?(dx\.)?(doi\.org/)?(doi:\s*)?", "")
    return F.regexp_replace(s, "/+", "/")


def paper_key_kind(paper_id: Column) -> Column:
    """Which of the kinds of identity a key is: doi, pmid, sha1, file, or other; null for null."""
    return F.when(paper_id.rlike(r"^10\.\d{4,9}/"), "doi").when(paper_id.startswith("pmid:"), "pmid").when(paper_id.startswith("sha1:"), "sha1").when(paper_id.startswith("file:"), "file").when(paper_id.isNotNull(), "other")


def paper_identity(doi: Column, pmid: Column, sha1: Column, file: Column) -> Column:
    """The first known of DOI, PMID, content hash (16 digits) and file name without its ending."""
    some = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    return F.coalesce(F.lower(some(doi)), F.concat(F.lit("pmid:"), some(pmid)), F.concat(F.lit("sha1:"), F.substring(some(sha1), 1, 16)), F.concat(F.lit("file:"), F.regexp_replace(some(file), r"(^.*/)|(\.[^.]*$)", "")))


def normalize_title(title: Column) -> Column:
    """A heading without its number and the punctuation around it."""
    return F.regexp_replace(F.regexp_replace(flat(title), NUMBER_PREFIX, ""), r"^[ :.\-—–\t]+|[ :.\-—–\t]+$", "")


def is_not_heading(title: Column) -> Column:
    """Whether it stands where a heading would but is none: numbers of citations, a letter, the label of a table or figure,
    the word keywords, or the label of a part of an abstract, which a colon tells from a heading."""
    t = flat(title)
    low = F.lower(t)
    numbers = t.rlike(r"^\d{1,3}( ?[,–-] ?\d{1,3})*$")
    letter = t.rlike("^[A-Za-z]$")
    label = low.rlike(r"^(table|figure|fig) ?\.? ?[\divx]+\b")
    part = low.endswith(":") & F.rtrim(F.substring(low, F.lit(1), F.char_length(low) - 1)).isin(*V.ABSTRACT_LABELS)
    return numbers | letter | label | low.isin("keyword", "keywords") | part


def is_junk_title(title: Column) -> Column:
    """Whether a running header or footer took the place of a heading."""
    return _junk(F.lower(normalize_title(title)))


def _junk(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [low.startswith(j) for j in V.JUNK_BEGINNINGS])


def _any_of(phrases: list[str]) -> str:
    return "|".join(p.replace(".", r"\.") for p in sorted(phrases, key=lambda p: (-len(p), p)))


def classify_section(title: Column) -> Column:
    """abstract, intro, methods, results, discussion, back or other: by the whole title, else by how it begins, else by its
    last word. Back matter comes first among whole titles and last among beginnings."""
    t = F.lower(normalize_title(F.coalesce(title, F.lit(""))))
    main = [k for k in SECTIONS if k != "back"]
    rules = [(_junk(t) | (t == ""), "other"), (t.isin(SECTIONS["back"]), "back")]
    rules += [(t.isin(SECTIONS[k]), k) for k in main]
    rules += [(t.rlike(f"^({_any_of(SECTIONS[k])})"), k) for k in main]
    rules += [(t.rlike(f"^({_any_of(SECTIONS['back'])})"), "back")]
    last = F.regexp_extract(t, r"([\p{L}\p{N}_-]+)$", 1)
    rules += [(last.isin([w for w, k in LAST_WORDS.items() if k == kind]), kind) for kind in dict.fromkeys(LAST_WORDS.values())]
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise("other")


def classify_path(path: Column) -> Column:
    """The class of the outermost heading; where that is other, of the innermost that has one. Null, blank and junk parts
    don't count."""
    parts = F.filter(path, lambda p: p.isNotNull() & (F.trim(p) != "") & ~is_junk_title(p))
    kinds = F.filter(F.transform(parts, classify_section), lambda k: k != "other")
    first = classify_section(F.get(parts, F.lit(0)))
    return F.when(path.isNull() | (F.size(parts) == 0), "other").when(first != "other", first).otherwise(F.coalesce(F.get(kinds, F.size(kinds) - 1), F.lit("other")))


def tidy_punctuation(text: Column) -> Column:
    """No blank before , ; and closing brackets or after opening ones, none between a number and %, none in [1], [2]; a
    number's leading point and ratios keep theirs."""
    s = F.regexp_replace(text, r"\s+([,;)\]])", "$1")
    s = F.regexp_replace(s, r"([(\[])\s+", "$1")
    s = F.regexp_replace(s, r"(\d)\s+%", "$1%")
    s = F.regexp_replace(s, r"\](,\s*|\s+)\[", "][")
    return F.regexp_replace(s, r"\(\s*\)", "")


def dehyphenate(text: Column) -> Column:
    """do- mains as domains, unless the first part or the second is one that compounds are made with (self- reported,
    cell- free), or the second is longer than seven letters."""
    heads, tails = "|".join(V.HYPHEN_HEADS), "|".join(V.HYPHEN_TAILS)
    return F.regexp_replace(text, rf"\b(?!(?:{heads})-)([a-z]{{2,}})-\s+(?!(?:{tails})\b)([a-z]{{2,{V.HYPHEN_TAIL}}})\b", "$1$2")


def citation_numbers(marker: Column) -> Column:
    """The numbers a printed marker stands for: 3,5 and 12-14 give 3, 5, 12, 13, 14. Ranges of more than 40 or backwards
    are left out; a marker with anything else in it, as of author and year, gives none."""
    plain = F.when(marker.rlike(r"^[\d,–\-\s\[\]()]*$"), F.regexp_replace(marker, r"[\[\]()\s]", "")).otherwise(F.lit(""))
    parts = F.filter(F.split(plain, ","), lambda p: p.rlike(r"^\d{1,4}([-–]\d{1,4})?$"))

    def numbers(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        b = F.coalesce(F.nullif(F.regexp_extract(p, r"[-–](\d+)$", 1), F.lit("")).cast("int"), a)
        return F.when((b >= a) & (b - a <= 40), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, numbers))


def markers(text: Column) -> Column:
    """Numbers of all [n], [n,m] and [n-m] in the text, distinct, in order."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(\[\d{1,4}(?:\s*[,–-]\s*\d{1,4})*\])"), 1), citation_numbers)))


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def terms(text: Column) -> Column:
    """Index terms of a text in NFKC (see functions.python.norm_text): words and compounds with hyphens or slashes, and the
    parts of these; no single characters, no stopwords (the parts of a compound that is one still count)."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)
    parts = lambda t: F.regexp_extract_all(F.array_join(F.filter(t, lambda x: x.rlike("[-/]")), " "), F.lit(f"({WORD})"), 1)
    return F.filter(let(tokens, lambda t: F.concat(t, parts(t))), lambda t: (F.char_length(t) > 1) & ~t.isin(STOPWORDS))


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, each joined with blanks; none if there are fewer."""

    def runs(t: Column) -> Column:
        size = F.size(t)
        every = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(size >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def coverage(part: Column, whole: Column) -> Column:
    """The share of the distinct elements of `part` that `whole` has; 0 if there are none."""
    return let(F.array_distinct(part), lambda p: F.when(F.size(p) > 0, F.size(F.array_intersect(p, whole)) / F.size(p)).otherwise(F.lit(0.0)))


def ascii_key(text: Column) -> Column:
    """A key for comparing: accents of Latin letters off, lower case, letters and digits only, single blanks."""
    s = F.translate(F.lower(text), *ACCENTS)
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def surname(name: Column) -> Column:
    """The key of a family name: before a comma if there is one, else the last word."""
    return F.when(name.contains(","), ascii_key(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(ascii_key(name), " "), -1))


def table_number(caption: Column) -> Column:
    """The number of a caption that begins Table, Tab., Figure or Fig., in Arabic or Roman digits (to XV); else null."""
    n = F.regexp_extract(caption, r"(?i)^\s*(?:table|tab|figure|fig)\.?\s*(\d{1,3}|[ivx]{1,4})\b", 1)
    roman = F.create_map(*[x for i, r in enumerate(ROMAN) for x in (F.lit(r), F.lit(i + 1))])
    return F.coalesce(F.expr("NULL").cast("int"), F.when(n.rlike(r"^\d+$"), n.cast("int")).when(n != "", F.try_element_at(roman, F.upper(n))))


def caption_parts(caption: Column) -> Column:
    """struct(kind, label, number, supplementary, description) of a caption; kind is null if it has no label."""
    pattern = r"(?i)^\s*(suppl(?:ementary|\.)?\s+)?(table|tab|figure|fig)\.?\s*(S?)(\d{1,3}|[ivx]{1,4})\b[.:)]?\s*"
    word = F.lower(F.regexp_extract(caption, pattern, 2))
    kind = F.when(word.startswith("t"), "table").when(word.startswith("f"), "figure")
    number = table_number(F.regexp_replace(caption, r"(?i)^\s*suppl(ementary|\.)?\s+", ""))
    supp = (F.regexp_extract(caption, pattern, 1) != "") | (F.upper(F.regexp_extract(caption, pattern, 3)) == "S")
    label = F.concat(F.initcap(kind), F.lit(" "), F.coalesce(number.cast("string"), F.regexp_extract(caption, pattern, 4)))
    return F.struct(kind.alias("kind"), label.alias("label"), number.alias("number"), F.when(kind.isNotNull(), supp).alias("supplementary"), F.trim(F.regexp_replace(caption, pattern, "")).alias("description"))


def year_range(spec: Column) -> Column:
    """struct(low, high) of 2018-2025, 2018-, -2015 or 2020; both null for anything else."""
    s = F.regexp_replace(spec, r"\s", "")
    low, high = F.regexp_extract(s, r"^(\d{4})?-(\d{4})?$", 1), F.regexp_extract(s, r"^(\d{4})?-(\d{4})?$", 2)
    one = F.regexp_extract(s, r"^(\d{4})$", 1)
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    return F.struct(F.coalesce(number(one), number(low)).alias("low"), F.coalesce(number(one), number(high)).alias("high"))


def journal_abbreviation(journal: Column) -> Column:
    """What follows " : ", else the name itself up to 24 characters, else its initials, eight at most."""
    tail = F.regexp_extract(journal, r" : (.+)$", 1)
    initials = F.substring(F.array_join(F.transform(F.filter(F.split(journal, r"[^\p{L}]+"), lambda w: F.length(w) > 0), lambda w: F.upper(F.substring(w, 1, 1))), ""), 1, 8)
    return F.when(tail != "", tail).when(F.char_length(journal) <= 24, journal).otherwise(initials)


def context_header(title: Column, path: Column) -> Column:
    """[title] > path > ... of a chunk; empty parts are left out."""
    parts = F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.array_join(F.concat(F.array(F.concat(F.lit("["), F.coalesce(title, F.lit("")), F.lit("]"))), parts), " > ")


def is_truncated(text: Column) -> Column:
    """Whether a paragraph begins in the midst of a sentence: with a small letter that begins no statistic or unit."""
    t = F.ltrim(text)
    return t.rlike(r"^\p{Ll}") & ~t.rlike(r"^(p|n|r|t|pH|mRNA|x|e|α|β|γ|κ|µ|mg|kg|ml)([^\p{L}\p{N}]|$)")


def is_junk_sentence(text: Column) -> Column:
    """Twenty characters or more of which over 30 % are digits and under 55 % letters."""
    n = F.char_length(text)
    digits = F.char_length(F.regexp_replace(text, r"[^\p{N}]", ""))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (n >= 20) & (digits / n > JUNK_SENTENCE_SHARE[0]) & (letters / n < JUNK_SENTENCE_SHARE[1])


def broken_characters(text: Column) -> Column:
    """How many replacement characters, control characters and (cid:n) codes the text has."""
    marks = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\x{FFFD}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{009F}]", ""))
    return marks + F.size(F.regexp_extract_all(text, F.lit(r"(\(cid:\d+\))"), 1))


def doi_candidates(text: Column, limit: int = 24) -> Column:
    """DOIs printed in a text: those on one line, then those cut by a line's end put together with the next line's first word
    and with each of its parts up to a point, longest first; distinct, `limit` at most."""
    whole = F.regexp_extract_all(text, F.lit("(" + DOI + ")"), 1)
    cut = F.regexp_extract_all(text, F.lit(r"(10\.\d{4,9}/[^\s\"<>]*\s*\n\s*[^\s\"<>]+)"), 1)
    tidy = lambda x: F.lower(F.regexp_replace(x, r"[).,;:\]]+$", ""))

    def stitched(x: Column) -> Column:
        head, tail = F.regexp_extract(x, r"^(\S+)", 1), F.regexp_extract(x, r"(\S+)$", 1)
        parts = F.split(tail, r"\.")
        return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.concat(head, F.array_join(F.slice(parts, F.lit(1), i), ".")))

    every = F.concat(F.transform(whole, tidy), F.transform(F.flatten(F.transform(cut, stitched)), tidy))
    return F.slice(F.array_distinct(F.filter(every, lambda d: F.length(d) > 8)), 1, limit)


def content_words(text: Column) -> Column:
    """Distinct words of four characters or more."""
    return F.array_distinct(F.filter(words(F.coalesce(text, F.lit(""))), lambda w: F.char_length(w) >= 4))


def dropcap(text: Column) -> Column:
    """A capital set apart at the beginning put to its word: V itiligo; not where the capital is a word (A, I) or what follows
    is one (T he is left as it was printed)."""
    return F.regexp_replace(text, r"^([B-HJ-Z]) (\p{Ll}{4,})", "$1$2")


def joined_fragments(a: Column, b: Column) -> Column:
    """Two parts of a cell: a hyphen at the end of the first is taken off before a small letter and kept otherwise."""
    cut = a.rlike(r"\p{L}-$")
    return F.when(cut & b.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), b)).when(cut, F.concat(a, b)).otherwise(F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def is_plausible_title(title: Column) -> Column:
    """Twenty characters or more, three words, letters for 60 % of them, and no running header."""
    t = flat(title)
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.char_length(t) >= 20) & (F.size(words(t)) >= 3) & (letters / F.char_length(t) >= 0.6) & ~is_junk_title(t)


def asset_label(caption: Column, id: Column, word: str) -> Column:
    """Table 2 of a caption that says so, else the id, else the word."""
    return F.coalesce(caption_parts(caption)["label"], F.nullif(F.trim(id), F.lit("")), F.lit(word))


def clean_reply(text: Column) -> Column:
    """A generated text without blocks of reasoning, fences and a first line that only announces it."""
    s = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?m)^```\w*\s*$", "")
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    return bare(F.regexp_replace(bare(s), r"(?i)^(here is|here's|translation|sure)[^\n]*:\s*\n", ""))

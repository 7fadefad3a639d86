"""Pages as lines, strokes, pieces and images: what is heading, paragraph, reference or ornament, by place and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import signs as S

# Fixed values
RULE_SHORTEST, RULE_THICKEST, STRAIGHT = 20.0, 3.0, 0.8
GAP_MOST = 96.0
PAGE_AREA = 595.0 * 842.0


def rules(strokes: DataFrame) -> DataFrame:
    """(doc, page, way, at, low, high): horizontal (h) and vertical (v) rules among strokes (doc, page, kind line or box, x0,
    y0, x1, y1): lines at most 0.8 off straight, boxes at most 3 thick, both 20 long or more."""
    x0, x1, y0, y1 = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    wide, high = x1 - x0, y1 - y0
    thin = F.when(F.col("kind") == "line", F.lit(STRAIGHT)).otherwise(F.lit(RULE_THICKEST))
    way = F.when((high <= thin) & (wide >= RULE_SHORTEST), "h").when((wide <= thin) & (high >= RULE_SHORTEST), "v")
    return strokes.select("doc", "page", way.alias("way"), F.when(way == "h", (y0 + y1) / 2).otherwise((x0 + x1) / 2).alias("at"), F.when(way == "h", x0).otherwise(y0).alias("low"), F.when(way == "h", x1).otherwise(y1).alias("high")).filter("way IS NOT NULL")


def turned(box: Column, mode: Column) -> Column:
    """struct(x0, y0, x1, y1) of a box on a page turned by mode: 0 as it is, 1 for text running up, 2 for text running down."""
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    one, two = (-y1, x0, -y0, x1), (y0, -x1, y1, -x0)
    return F.struct(*[F.when(mode == 1, b).when(mode == 2, c).otherwise(a).alias(n) for n, a, b, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), one, two)])


def alone(lines: DataFrame) -> DataFrame:
    """lines (doc, page, col, ord, x0, y0, x1, y1) with a column alone: whether no other line of its column stands beside it,
    as cells of a table do. Lines meet only those of their own and the next band of their page's column, by their heights'
    half; a page bounds both."""
    h = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    a = lines.select("doc", "page", "col", "ord", "x0", "y0", "x1", (F.col("y1") - h * 0.5).alias("until"))
    # A band is as high as any line may be
    band = lambda y: F.floor(y / 100.0)
    left = a.withColumn("band", F.explode(F.sequence(band(F.col("y0")), F.greatest(band(F.col("y0")), band(F.col("until"))))))
    right = a.withColumn("band", band(F.col("y0"))).withColumnsRenamed({"ord": "o2", "x0": "a0", "x1": "a1", "y0": "b0", "until": "u2"})
    beside = (F.col("ord") != F.col("o2")) & ((F.col("b0") > F.col("y0")) | ((F.col("b0") == F.col("y0")) & (F.col("o2") > F.col("ord")))) & (F.col("b0") < F.col("until")) & ((F.col("a0") > F.col("x1") + 1) | (F.col("a1") < F.col("x0") - 1))
    pairs = left.join(right, ["doc", "page", "col", "band"]).filter(beside)
    hit = pairs.select("doc", F.explode(F.array("ord", "o2")).alias("ord")).distinct().withColumn("hit", F.lit(True))
    return lines.join(hit, ["doc", "ord"], "left").withColumn("alone", F.col("hit").isNull()).drop("hit")


def paragraph_starts(lines: DataFrame, body: float) -> DataFrame:
    """lines (doc, page, col, ord, x0, y0, y1, text) with columns starts and paragraph (its number on the page): a paragraph
    starts with a column, below a gap of over 0.7 of the body's size, or with an indent of over 0.8 of it behind a line that
    ends a sentence; parts of one line start none. Windows are of one page."""
    w = W.partitionBy("doc", "page").orderBy("ord")
    before = {c: F.lag(c).over(w) for c in ("col", "x0", "y1", "text")}
    d = lines.withColumns({f"_{c}": v for c, v in before.items()})
    gap = F.col("y0") - F.col("_y1")
    indent = (F.col("x0") - F.col("_x0") > body * 0.8) & F.rtrim("_text").rlike(r"[.:?]$")
    starts = F.col("_col").isNull() | (F.col("col") != F.col("_col")) | ((F.col("y0") >= F.col("_y1") - 1.0) & ((gap > body * 0.7) | indent))
    return d.withColumn("starts", F.coalesce(starts, F.lit(True))).withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop(*[f"_{c}" for c in before])


def joined_paragraphs(lines: DataFrame, least: int = 40) -> DataFrame:
    """(doc, page, paragraph, text) of lines of paragraph_starts: joined with blanks, words cut at a line's end put together,
    paragraphs under 40 characters left out."""
    t = lines.withColumn("t", F.trim("text")).filter("t <> ''").groupBy("doc", "page", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("text"))
    whole = F.regexp_replace(F.regexp_replace("text", r"(?<![ -])-\n(?=\p{Ll})", ""), "\n", " ")
    return t.withColumn("text", whole).filter(F.char_length("text") >= least)


def _ahead(lines: DataFrame, flag: Column, name: str, window: int) -> DataFrame:
    """(doc, ord, name): how many of the lines from each on, `window` of them, have the flag. A line with it is sent to those
    it counts for, so no paper is gathered in a window."""
    sent = lines.filter(flag).select("doc", F.explode(F.sequence(F.col("ord") - window + 1, F.col("ord"))).alias("ord"))
    return sent.groupBy("doc", "ord").agg(F.count(F.lit(1)).alias(name))


def reference_zone(lines: DataFrame) -> DataFrame:
    """(doc, first, last): the lines (doc, ord from 0, text) that are the list of references. It begins behind 35 % of the
    lines: at a heading that says so, with four lines or more of the next twelve showing signs of references, else at a
    numbered item with four items and six signs in 25 lines; it ends before a line after which fewer than two of 20 show
    signs, or with the paper. Papers of fewer than 20 lines have none."""
    sign, item = S.reference_sign(F.col("text")), S.reference_item(F.col("text"))
    n = lines.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")
    d = lines.join(n, "doc")
    for name, flag, window in (("s13", sign, 13), ("s25", sign, 25), ("i25", item, 25), ("s20", sign, 20)):
        d = d.join(_ahead(lines, flag, name, window), ["doc", "ord"], "left")
    d = d.fillna(0, ["s13", "s25", "i25", "s20"])
    heading = F.trim("text").rlike(r"^(\d+[\s.|)]*)?(References|REFERENCES|Bibliography|BIBLIOGRAPHY|Literature [Cc]ited)\s*:?$")
    own = sign.cast("int")
    late = F.col("ord") >= F.floor(F.col("n") * 0.35)
    by_head = F.min(F.when(late & heading & (F.col("s13") - own >= 4), F.col("ord")))
    by_item = F.min(F.when(late & item & (F.col("i25") >= 4) & (F.col("s25") >= 6), F.col("ord")))
    start = d.groupBy("doc").agg(F.coalesce(by_head, by_item).alias("first")).filter("first IS NOT NULL")
    after = d.join(start, "doc").groupBy("doc", "first", "n").agg(F.min(F.when((F.col("ord") > F.col("first")) & (F.col("n") - F.col("ord") >= 25) & (F.col("s20") < 2), F.col("ord"))).alias("end"))
    return after.select("doc", "first", F.coalesce(F.col("end") - 1, F.col("n") - 1).cast("int").alias("last"))


def front_matter(lines: DataFrame, most_lines: int = 12, most_chars: int = 700) -> DataFrame:
    """(doc, ord): lines (doc, block, ord, text) that are front matter: in blocks of up to 12 lines and 700 characters, all
    from the first line on that names authors or an institution; elsewhere that line alone."""
    own = S.is_author_list(F.col("text")) | (F.col("text").contains(",") & (S.degrees(F.col("text")) >= 2)) | F.col("text").rlike(r"(?i)^\s*(received|accepted|correspond|funding|conflicts? of interest|©|copyright)\b")
    d = lines.withColumn("own", own)
    blocks = d.groupBy("doc", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min(F.when(F.col("own"), F.col("ord"))).alias("first"))
    both = d.join(blocks, ["doc", "block"])
    small = (F.col("n") <= most_lines) & (F.col("chars") <= most_chars)
    return both.filter(F.col("own") | (small & (F.col("ord") >= F.col("first")))).select("doc", "ord")


def ornaments(images: DataFrame) -> DataFrame:
    """(doc, image): images (doc, page, image, x0, y0, x1, y1) that are logos or watermarks: on two pages or more at one place
    (6 points off at most) and under a quarter of a page, or on half the pages and under 6 000 square points."""
    pages = images.groupBy("doc").agg(F.max("pages").alias("pages")) if "pages" in images.columns else images.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    spread = lambda c: F.max(F.round(c)) - F.min(F.round(c))
    by = images.groupBy("doc", "image").agg(F.countDistinct("page").alias("on"), spread("x0").alias("dx"), spread("y0").alias("dy"), F.max((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")).join(pages, "doc")
    still = (F.col("dx") <= 6) & (F.col("dy") <= 6) & (F.col("area") < 0.25 * PAGE_AREA)
    many = (F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.5))) & (F.col("area") < 6000)
    return by.filter((F.col("on") >= 2) & (still | many)).select("doc", "image")


def grown(pieces: DataFrame, from_below: bool = True) -> DataFrame:
    """pieces (region, piece, y0, y1) that belong together, from the one nearest the caption (below them, or above) as long as
    no gap is over 96 points. A region's pieces are those of one figure."""
    w = W.partitionBy("region").orderBy(*([F.desc("y1"), "piece"] if from_below else [F.asc("y1"), "piece"])).rowsBetween(W.unboundedPreceding, -1)
    gap = F.min("y0").over(w) - F.col("y1") if from_below else F.col("y0") - F.max("y1").over(w)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = pieces.withColumn("far", F.coalesce(gap > GAP_MOST, F.lit(False)).cast("int"))
    return d.withColumn("cut", F.sum("far").over(upto)).filter("cut = 0").select(*pieces.columns)


def next_stop(captions: DataFrame, stops: DataFrame) -> DataFrame:
    """(doc, page, uid, stop): where the region under a caption (doc, page, uid, x0, x1, y1) ends: the nearest of the stops
    (doc, page, x0, x1, y0; other captions, headings) below it that overlaps it sideways; null if there is none. Both sides
    are of one page."""
    s = stops.select("doc", "page", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("y0").alias("top"))
    c = captions.select("doc", "page", "uid", "x0", "x1", "y1")
    hit = c.join(s, ["doc", "page"]).filter((F.col("top") >= F.col("y1")) & (F.col("a0") < F.col("x1")) & (F.col("a1") > F.col("x0")))
    return c.select("doc", "page", "uid").distinct().join(hit.groupBy("doc", "page", "uid").agg(F.min("top").alias("stop")), ["doc", "page", "uid"], "left")


def barriers(figures: DataFrame, blocks: DataFrame, share: float = 0.45) -> DataFrame:
    """(doc, page, uid, above, below): the nearest blocks (doc, page, x0, x1, y0, y1) over and under each caption (doc, page,
    uid, x0, x1, y0, y1) that overlap its width by 45 % or more; null where there is none."""
    b = blocks.select("doc", "page", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    over = F.greatest(F.lit(0.0), F.least("x1", "a1") - F.greatest("x0", "a0")) >= share * (F.col("x1") - F.col("x0"))
    both = figures.join(b, ["doc", "page"]).filter(over)
    near = both.groupBy("doc", "page", "uid").agg(F.max(F.when(F.col("b1") <= F.col("y0"), F.col("b1"))).alias("above"), F.min(F.when(F.col("b0") >= F.col("y1"), F.col("b0"))).alias("below"))
    return figures.select("doc", "page", "uid").distinct().join(near, ["doc", "page", "uid"], "left")


def figure_names(figures: DataFrame) -> DataFrame:
    """figures (paper_id, id, number, supplementary) with folder and name: a folder a paper, fig and the number, else the id;
    a name taken before gets a number of its own."""
    from papercairn.functions.text import slug

    folder = F.concat(F.substring(slug("paper_id"), 1, 80), F.lit("_figs"))
    stem = F.when(F.col("number").isNotNull(), F.concat(F.lit("fig"), F.when(F.coalesce("supplementary", F.lit(False)), "S").otherwise(""), F.col("number").cast("string"))).otherwise(F.substring(slug(F.coalesce("id", F.lit("fig"))), 1, 60))
    d = figures.withColumns({"folder": folder, "_stem": stem})
    n = F.row_number().over(W.partitionBy("folder", "_stem").orderBy("id"))
    return d.withColumn("name", F.when(n == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("_"), n.cast("string")))).drop("_stem")


def glyphs(spans: DataFrame, maps: DataFrame) -> DataFrame:
    """spans (font, text, ...) with each character as its font's glyph map (font, code, printed; one to one) prints it. Fonts
    are compared without the subset's prefix, in small letters. The maps are those of fonts: a few hundred rows each."""
    name = lambda c: F.lower(F.regexp_replace(F.trim(c), r"^[A-Z]{6}\+", ""))
    m = maps.groupBy(name(F.col("font")).alias("_font")).agg(F.map_from_entries(F.collect_set(F.struct("code", "printed"))).alias("_map"))
    d = spans.withColumn("_font", name(F.col("font"))).join(m, "_font", "left")
    shown = F.array_join(F.transform(F.split("text", ""), lambda c: F.coalesce(F.try_element_at("_map", c), c)), "")
    return d.withColumn("text", F.when(F.col("_map").isNotNull(), shown).otherwise(F.col("text"))).drop("_font", "_map")


def rehyphenated(words: DataFrame, printed: DataFrame) -> DataFrame:
    """(word, restored): words of six letters or more that printed lines (text) never show solid, but hyphenated inside a line;
    the first place of those shown is taken. Evidence is counted once and joined."""
    pair = r"([A-Za-z]{2,}-[A-Za-z]{2,})"
    w = words.select(F.lower("word").alias("word")).filter(F.col("word").rlike("^[a-z]{6,}$")).distinct()
    shown = printed.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(pair), 1)).alias("p")).select(F.lower("p").alias("p")).distinct()
    solid = printed.select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("text", pair, " ")), F.lit("([a-z]{6,})"), 1)).alias("word")).distinct()
    made = shown.select(F.replace("p", F.lit("-"), F.lit("")).alias("word"), "p")
    return w.join(made, "word").join(solid, "word", "left_anti").groupBy("word").agg(F.min_by("p", F.instr("p", "-")).alias("restored"))


def floats_audit(items: DataFrame, captions: DataFrame) -> DataFrame:
    """(paper_id, kind, number, state): tables and figures (paper_id, kind, number, caption) against the captions printed: ok,
    missing (printed, not there), extra (there, not printed), duplicate (there twice), empty (there without its caption)."""
    a = items.filter("number IS NOT NULL").groupBy("paper_id", "kind", "number").agg(F.count(F.lit(1)).alias("n"), F.max(F.trim(F.coalesce("caption", F.lit("")))).alias("held"))
    b = captions.filter("number IS NOT NULL").select("paper_id", "kind", "number", F.lit(1).alias("printed")).distinct()
    both = a.join(b, ["paper_id", "kind", "number"], "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("printed").isNull(), "extra").when(F.col("held") == "", "empty").otherwise("ok")
    return both.select("paper_id", "kind", "number", state.alias("state"))


def repaired_floats(items: DataFrame, captions: DataFrame) -> DataFrame:
    """(paper_id, kind, number, caption, action) of tables and figures (paper_id, kind, number, caption) with the captions
    printed (the same): empty ones are filled, ones that end in the midst of the printed one replaced, missing ones added;
    numbers that several captions claim are left alone."""
    once = captions.filter("number IS NOT NULL").groupBy("paper_id", "kind", "number").agg(F.countDistinct("caption").alias("claims"), F.max("caption").alias("printed")).filter("claims = 1")
    i = items.filter("number IS NOT NULL").groupBy("paper_id", "kind", "number").agg(F.max("caption").alias("held"))
    both = i.withColumn("there", F.lit(True)).join(once, ["paper_id", "kind", "number"], "full")
    held, shown = F.trim(F.coalesce("held", F.lit(""))), F.trim(F.coalesce("printed", F.lit("")))
    action = F.when(F.col("there").isNull(), "added").when((held == "") & (shown != ""), "filled").when((shown != "") & (held != shown) & shown.startswith(held), "replaced").otherwise("kept")
    return both.select("paper_id", "kind", "number", F.when(action == "kept", F.col("held")).otherwise(F.col("printed")).alias("caption"), action.alias("action"))


def discovered(candidates: DataFrame, items: DataFrame, foreign: DataFrame) -> DataFrame:
    """candidates (paper_id, number, caption) for new tables, without those whose number is there (items), that only go on
    with another table, or that a neighbouring paper owns (foreign: paper_id, caption)."""
    c = candidates.filter("number IS NOT NULL").filter(~F.coalesce(F.col("caption"), F.lit("")).rlike(r"(?i)\bcont(inued|\.|d\.?)"))
    return c.join(items.select("paper_id", "number").distinct(), ["paper_id", "number"], "left_anti").join(foreign.select("paper_id", "caption").distinct(), ["paper_id", "caption"], "left_anti").distinct()


def line_text(spans: DataFrame, body: float) -> DataFrame:
    """(doc, ord, text, cited) of lines of spans (doc, ord, k, text, size, raised): what is raised or under 0.72 of the body's
    size and holds figures only is a citation and comes out of the text. A line's spans are few."""
    small = (F.coalesce("raised", F.lit(False)) | (F.col("size") < 0.72 * body)) & F.trim("text").rlike(r"^[\d,\s–-]+$")
    put = lambda keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("k", "text", small.alias("s")))), lambda x: x["s"] == F.lit(not keep)), lambda x: x["text"]), "" if keep else ",")
    return spans.groupBy("doc", "ord").agg(F.trim(put(True)).alias("text"), put(False).alias("cited"))


def without_notes(rows: DataFrame) -> DataFrame:
    """(table, row, note) for the rows (table, row, cells) of each table: note is set on those at its end that hold one cell
    with a note's mark, an address or an abbreviation explained, and on none before a row that doesn't."""
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    one = F.trim(F.get(filled, F.lit(0)))
    sign = (F.size(filled) == 1) & (one.rlike(r"(?i)^(https?://|doi:|www\.)\S+$") | one.rlike(r"^[*†‡§¶]|^[a-z]\)?\s[A-Z]") | one.rlike(r"\b[A-Z]{2,6}\s?[,=:]\s"))
    d = rows.withColumn("sign", sign)
    last = d.groupBy("table").agg(F.coalesce(F.max(F.when(~F.coalesce("sign", F.lit(False)), F.col("row"))), F.lit(-1)).alias("last"))
    return d.join(last, "table").select("table", "row", F.when(F.col("row") > F.col("last"), one).alias("note"))

"""Tables in Markdown and boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATOR = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"


def lines(markdown: Column) -> Column:
    return F.filter(F.split(F.coalesce(markdown, F.lit("")), r"\r\n|\n"), lambda r: F.trim(r) != "")


def cells(row: Column) -> Column:
    """The cells of a row, white space off; a bar behind a backslash belongs to its cell."""
    inner = F.regexp_replace(F.trim(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def check(tables: DataFrame) -> DataFrame:
    """(table_uid, n_rows, n_cols, data_rows, problems) of each table's Markdown: no_separator, separator_misplaced (not the
    second line), no_data_rows, single_column, ragged_columns, collapsed, truncated (the last line doesn't end its row),
    unreadable (a third of the cells' characters are damaged). Tables without Markdown have no rows and the problem empty."""
    t = tables.select("table_uid", "markdown").distinct().withColumn("rows", lines(F.col("markdown")))
    widths = F.transform(F.filter("rows", lambda r: ~F.trim(r).rlike(SEPARATOR)), lambda r: F.size(cells(r)))
    t = t.withColumn("widths", widths).withColumn("at", F.array_position(F.transform("rows", lambda r: F.trim(r).rlike(SEPARATOR)), True))
    data = F.greatest(F.lit(0), F.size("widths") - 1)
    wide = F.coalesce(F.array_max("widths"), F.lit(0))
    some = F.size("rows") > 0
    problems = F.array(
        F.when(~some, "empty"),
        F.when(some & (F.col("at") == 0), "no_separator"),
        F.when(some & (F.col("at") != 0) & (F.col("at") != 2), "separator_misplaced"),
        F.when(some & (data == 0), "no_data_rows"),
        F.when(some & (wide == 1), "single_column"),
        F.when(some & (F.array_max("widths") != F.array_min("widths")), "ragged_columns"),
        F.when(some & (wide >= 12) & (data <= 1), "collapsed"),
        F.when(some & F.trim(F.element_at("rows", 1)).startswith("|") & ~F.trim(F.element_at("rows", -1)).endswith("|"), "truncated"),
        F.when(some & (3 * F.char_length(F.regexp_replace("markdown", r"[^\x{FFFD}\x{E000}-\x{F8FF}\x{0080}-\x{009F}]", "")) > F.char_length(F.regexp_replace("markdown", r"[\s|:-]", ""))), "unreadable"),
    )
    return t.select("table_uid", F.size("widths").alias("n_rows"), wide.alias("n_cols"), data.alias("data_rows"), F.filter(problems, lambda p: p.isNotNull()).alias("problems"))


def grid(tables: DataFrame) -> DataFrame:
    """(table_uid, row, col, value, is_header): every cell of every table."""
    t = tables.select("table_uid", F.filter(lines(F.col("markdown")), lambda r: ~F.trim(r).rlike(SEPARATOR)).alias("rows")).distinct()
    r = t.select("table_uid", F.posexplode("rows").alias("row", "line"))
    return r.select("table_uid", "row", F.posexplode(cells(F.col("line"))).alias("col", "value")).withColumn("is_header", F.col("row") == 0)


def to_markdown(cell: DataFrame) -> DataFrame:
    """(table_uid, markdown) of a grid, the inverse of grid(): rows padded to the widest, | in cells escaped."""
    width = cell.groupBy("table_uid").agg((F.max("col") + 1).alias("width"))
    v = F.replace(F.col("value"), F.lit("|"), F.lit("\\|"))
    row = cell.groupBy("table_uid", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", v.alias("value")))).alias("by")).join(width, "table_uid")
    text = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width").cast("int")), " | "), F.lit(" |"))
    line = row.select("table_uid", "row", F.when(F.col("row") == 0, F.concat(text, rule)).otherwise(text).alias("line"))
    return line.groupBy("table_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def not_tables(tables: DataFrame) -> DataFrame:
    """(table_uid, reason): what is no table: its caption begins with no number of a table, and it has fewer than two columns,
    or a third of its rows look like references."""
    t = tables.select("table_uid", "caption", "markdown").distinct().withColumn("rows", F.filter(lines(F.col("markdown")), lambda r: ~F.trim(r).rlike(SEPARATOR)))
    named = F.coalesce(F.col("caption"), F.lit("")).rlike(r"(?i)^\s*tab(le|\.)?\s*\S")
    wide = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(cells(r)))), F.lit(0))
    refs = F.size(F.filter("rows", lambda r: r.rlike(r"(?i)(et al|doi:|\b(19|20)\d\d;\s*\d+)")))
    reason = F.when(wide < 2, "columns").when((F.size("rows") > 0) & (refs / F.size("rows") >= 0.34), "references")
    return t.filter(~named).select("table_uid", reason.alias("reason")).filter("reason IS NOT NULL")


def empty_tables(tables: DataFrame) -> DataFrame:
    """table_uid of tables without data rows and with a caption of fewer than 15 characters."""
    n = F.size(F.filter(lines(F.col("markdown")), lambda r: ~F.trim(r).rlike(SEPARATOR)))
    return tables.filter((n <= 1) & (F.char_length(F.trim(F.coalesce("caption", F.lit("")))) < 15)).select("table_uid").distinct()


def numbers(markdown: Column) -> Column:
    """All numbers of a table, sorted, each as often as it stands there."""
    return F.array_sort(F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1))


def loses_numbers(old: Column, new: Column) -> Column:
    """Whether some number stands less often in the new Markdown than in the old."""
    a, b = numbers(old), numbers(new)
    return F.exists(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) > F.size(F.filter(b, lambda y: y == x)))


def boxes(tables: DataFrame) -> DataFrame:
    """(paper_id, table_uid, page, x0, y0, x1, y1): where tables stand, corners in order."""
    b = tables.filter("pdf_span IS NOT NULL").select("paper_id", "table_uid", "pdf_span.*").distinct()
    return b.select("paper_id", "table_uid", "page", F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))


def row_bands(b: DataFrame, key: tuple[str, ...] = ("paper_id", "page"), slack: float = 0.0) -> DataFrame:
    """Boxes with the band of rows they stand in: boxes of a page in order of y0 are of one band while the next begins before
    all before it end (and `slack` more)."""
    w = W.partitionBy(*key).orderBy("y0", "y1", "table_uid")
    end = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    return b.withColumn("band", F.sum(F.when(end.isNull() | (F.col("y0") > end + slack), 1).otherwise(0)).over(w))


def merged_bands(b: DataFrame, key: tuple[str, ...] = ("paper_id", "page")) -> DataFrame:
    """(paper_id, page, band, y0, y1, boxes): the bands merged into one span each."""
    return row_bands(b, key).groupBy(*key, "band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("boxes"))


def gaps(b: DataFrame, most: float = 60.0) -> DataFrame:
    """Bands that follow the one before on their page at more than `most` points."""
    m = merged_bands(b)
    before = F.lag("y1").over(W.partitionBy("paper_id", "page").orderBy("band"))
    return m.withColumn("gap", F.col("y0") - before).filter(F.col("gap") > most).select("paper_id", "page", "band", "gap")


def overlap(a: str, b: str) -> Column:
    """The area two boxes (aliases a and b) share, as a share of the smaller."""
    c = lambda t, n: F.col(f"{t}.{n}")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo)))
    area = lambda t: (c(t, "x1") - c(t, "x0")) * (c(t, "y1") - c(t, "y0"))
    least = F.least(area(a), area(b))
    return F.when(least > 0, side("x0", "x1") * side("y0", "y1") / least).otherwise(F.lit(0.0))


def overlapping(b: DataFrame) -> DataFrame:
    """(paper_id, page, first, second, share): boxes of a page that overlap. Joined within bands, where alone they can."""
    r = row_bands(b)
    x, y = r.alias("a"), r.alias("b")
    on = (F.col("a.paper_id") == F.col("b.paper_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.table_uid") < F.col("b.table_uid"))
    return x.join(y, on).select("a.paper_id", "a.page", F.col("a.table_uid").alias("first"), F.col("b.table_uid").alias("second"), overlap("a", "b").alias("share")).filter("share > 0")

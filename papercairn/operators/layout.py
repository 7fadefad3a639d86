"""Lines of pages (doc_id, page, ord, text, x0, y0, x1, y1, size, page_w, page_h) put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def body_size(lines: DataFrame, least: int = 45) -> DataFrame:
    """(doc_id, size): the size of type most characters have, counted over lines of `least` characters, over all where there
    are none."""
    n = F.char_length("text")
    by = lines.groupBy("doc_id", "size").agg(F.sum(F.when(n >= least, n).otherwise(0)).alias("long"), F.sum(n).alias("all"))
    return by.groupBy("doc_id").agg(F.max_by("size", F.struct("long", "all", -F.col("size"))).alias("size"))


def columns(lines: DataFrame, bins: float = 3.0) -> DataFrame:
    """lines with col: 0 or 1 on pages of two columns (full-width lines stay in 0), 0 elsewhere. A page has two where, of the
    bins of line beginnings right of its middle third, the fullest holds a fifth of its lines and as many end left of it."""
    page = ["doc_id", "page"]
    start = (F.floor(F.col("x0") / bins) * bins).alias("start")
    peak = lines.filter(F.col("x0") > F.col("page_w") * 0.35).groupBy(*page, start).agg(F.count(F.lit(1)).alias("n")).groupBy(*page).agg(F.max_by("start", F.struct("n", -F.col("start"))).alias("split"))
    both = lines.join(peak, page, "left")
    right = F.col("x0") >= F.col("split")
    left = F.col("x1") <= F.col("split") + 2 * bins
    w = W.partitionBy(*page)
    both = both.withColumn("r", F.sum(right.cast("int")).over(w)).withColumn("l", F.sum(left.cast("int")).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    two = (F.least("r", "l") >= 4) & (F.least("r", "l") >= 0.2 * F.col("n"))
    return both.withColumn("col", F.when(two & right, 1).otherwise(0)).drop("split", "r", "l", "n")


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with place, their order in the document: page by page, each column from top to bottom; a line across both columns
    parts what is above it from what is below."""
    c = columns(lines)
    wide = F.when(F.col("x1") - F.col("x0") > 0.6 * F.col("page_w"), 1).otherwise(0)
    w = W.partitionBy("doc_id", "page").orderBy("y0", "x0", "ord")
    zone = F.sum(wide).over(w.rowsBetween(W.unboundedPreceding, 0)) * 2 - wide
    c = c.withColumn("zone", zone)
    return c.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "zone", "col", "y0", "x0", "ord"))).drop("zone")


def running_lines(lines: DataFrame, edge: float = 0.12, share: float = 0.5) -> DataFrame:
    """(doc_id, text, pages): lines at the upper or lower edge whose text, digits masked, stands on two pages or more and on
    half of them."""
    at_edge = (F.col("y1") < edge * F.col("page_h")) | (F.col("y0") > (1 - edge) * F.col("page_h"))
    text = F.trim(F.regexp_replace(F.lower("text"), r"\d+", "#"))
    n = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    by = lines.filter(at_edge).select("doc_id", "page", text.alias("text")).filter("text <> ''").groupBy("doc_id", "text").agg(F.countDistinct("page").alias("pages"))
    return by.join(n, "doc_id").filter((F.col("pages") >= 2) & (F.col("pages") >= share * F.col("n"))).select("doc_id", "text", "pages")


def word_rows(words: DataFrame) -> DataFrame:
    """words (doc_id, page, text, x0, y0, x1, y1) with row: words of a page are of one row while the next centre is within 2.5
    points or 0.45 of the median height."""
    page = W.partitionBy("doc_id", "page")
    centre = (F.col("y0") + F.col("y1")) / 2
    w = words.withColumn("c", centre).withColumn("h", F.percentile_approx(F.col("y1") - F.col("y0"), 0.5).over(page))
    order = page.orderBy("c", "x0", "text")
    jump = F.col("c") - F.lag("c").over(order) > F.greatest(F.lit(2.5), 0.45 * F.col("h"))
    return w.withColumn("j", F.coalesce(jump, F.lit(False)).cast("int")).withColumn("row", F.sum("j").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("c", "h", "j")


def merged_intervals(segments: DataFrame, slack: float = 1.0) -> DataFrame:
    """(doc_id, page, kind, pos, a, b): rules (doc_id, page, kind, pos, a, b) that lie on one position, and touch, as one."""
    at = F.floor(F.col("pos") / 2) * 2
    s = segments.withColumn("pos", at)
    key = ["doc_id", "page", "kind", "pos"]
    w = W.partitionBy(*key).orderBy("a", "b")
    end = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("g", F.when(end.isNull() | (F.col("a") > end + slack), 1).otherwise(0)).withColumn("g", F.sum("g").over(w))
    return s.groupBy(*key, "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")


def large_gaps(rules: DataFrame, factor: float = 3.5, least: float = 60.0) -> DataFrame:
    """rules (doc_id, page, pos) with part: a new one begins where the distance to the rule above exceeds 3.5 times the median
    distance of the page, and 60 points."""
    w = W.partitionBy("doc_id", "page").orderBy("pos")
    d = rules.select("doc_id", "page", "pos").distinct().withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    median = F.percentile_approx("gap", 0.5).over(W.partitionBy("doc_id", "page"))
    d = d.withColumn("cut", F.coalesce(F.col("gap") > F.greatest(factor * median, F.lit(least)), F.lit(False)).cast("int"))
    return d.withColumn("part", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("cut")

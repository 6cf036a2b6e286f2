"""Headings of laid-out pages: text spans with font sizes into markdown, as windows over spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed thresholds of the data model.
MIN_SPAN_CHARS = 2
MIN_RISE = 2.0
LEVELS = 6
MOST_COLLAPSED = 0.50
MOST_SATURATED = 0.60
LEAST_GAP = 1.0


def by_document(spans: DataFrame) -> DataFrame:
    """Spans hashed by document: histograms, levels, lines, joins and windows all work inside that one exchange."""
    return spans.repartition("doc")


def size_histogram(spans: DataFrame) -> DataFrame:
    """(doc, size, chars): characters of each rounded size, image blocks and short spans left out."""
    t = X.strip(F.col("text"))
    rows = spans.where((F.coalesce("block_type", F.lit(0)) == 0) & (F.length(t) >= MIN_SPAN_CHARS))
    return rows.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum(F.length(t)).alias("chars"))


def body_size(histogram: DataFrame) -> DataFrame:
    """(doc, body): the size of most characters; ties to the smaller."""
    return histogram.groupBy("doc").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


def heading_levels(histogram: DataFrame) -> DataFrame:
    """(doc, size, level): the six largest sizes of more than two points above the body's."""
    above = histogram.join(body_size(histogram), "doc").where(F.col("size") > F.col("body") + MIN_RISE)
    return above.withColumn("level", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size")))).where(F.col("level") <= LEVELS).select("doc", "size", "level")


def text_lines(spans: DataFrame) -> DataFrame:
    """(doc, page, block, line, size, text): largest size and joined text of each line with any."""
    some = spans.where((F.coalesce("block_type", F.lit(0)) == 0) & (X.strip(F.col("text")) != ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda p: p["text"])
    rows = some.groupBy("doc", "page", "block", "line").agg(F.max(F.round("size", 1)).alias("size"), X.strip(F.array_join(parts, "")).alias("text"))
    return rows.where("text <> ''")


def stitched(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, page, block, line, level, size, text): headings' lines joined, body lines as they are.

    Within a block, lines of one heading size in a row are one heading. A bare section label and
    the heading of another size after it are one as well, at the label's level; a heading that has
    taken one in takes no other. So in a chain of labels every second run joins the one before.
    """
    rows = lines.join(levels, ["doc", "size"], "left")
    block = Window.partitionBy("doc", "page", "block").orderBy("line")
    rows = rows.withColumn("new_run", F.coalesce(F.col("level").isNull() | ~F.col("level").eqNullSafe(F.lag("level").over(block)), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new_run").over(block))
    runs = rows.groupBy("doc", "page", "block", "run").agg(
        F.min("line").alias("line"), F.min_by("text", "line").alias("first"), F.max("level").alias("level"), F.max("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"]), " ").alias("text")
    )
    w = Window.partitionBy("doc", "page", "block").orderBy("run")
    label = F.col("level").isNotNull() & X.is_bare_label(F.col("first"))
    runs = runs.withColumn("label", label).withColumn("stop", F.max(F.when(~F.col("label"), F.col("run"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # labels right before this run, back to the last run that is none
    chain = F.col("run") - 1 - F.coalesce("stop", F.lit(0))
    runs = runs.withColumn("joins", (F.col("level").isNotNull() & (chain % 2 == 1)).cast("int"))
    runs = runs.withColumn("head", F.sum(1 - F.col("joins")).over(w))
    out = runs.groupBy("doc", "page", "block", "head").agg(
        F.min("line").alias("line"), F.min_by("level", "run").alias("level"), F.min_by("size", "run").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda p: p["text"]), " ").alias("text")
    )
    body = F.col("level").isNull()
    return out.select("doc", "page", "block", "line", "level", "size", F.when(body, X.escape_heading_marks(F.col("text"))).otherwise(X.join_hyphenated(F.col("text"))).alias("text"))


def _doc_order() -> Window:
    return Window.partitionBy("doc").orderBy("page", "block", "line")


def bridged(rows: DataFrame) -> DataFrame:
    """A numeric label heading and the heading after it, at its level or deeper and no label, with no
    body between, become one at the label's level; then headings equal to the one before go."""
    w = _doc_order()
    label = F.col("level").isNotNull() & X.is_bare_label(F.col("text"))
    rows = rows.withColumn("label", label & F.col("text").rlike("^[0-9]"))
    rows = rows.withColumn("any_label", label)
    nl, nt, na = (F.lead(c).over(w) for c in ("level", "text", "any_label"))
    rows = rows.withColumn("takes", F.coalesce(F.col("label") & nl.isNotNull() & (nl >= F.col("level")) & ~na, F.lit(False)))
    rows = rows.withColumn("text", F.when(F.col("takes"), F.concat_ws(" ", "text", nt)).otherwise(F.col("text")))
    rows = rows.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False))).where("not taken")
    same = F.col("level").isNotNull() & F.col("level").eqNullSafe(F.lag("level").over(w)) & F.col("text").eqNullSafe(F.lag("text").over(w))
    return rows.withColumn("same", same).where("not same").select("doc", "page", "block", "line", "level", "size", "text")


def validate_headings(headings: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc, collapse, saturation, min_gap, first_level, valid, reasons) of documents with levels.

    Four signs of a wrong size map: no level 2, or (with three levels or more) more than half of the
    level-2 headings without a deeper one below; more than 60 % at level 6; two sizes within a
    point; a first heading below level 3.
    """
    w = _doc_order()
    h = headings.where("level is not null").withColumn("next", F.lead("level").over(w)).withColumn("i", F.row_number().over(w))
    stats = h.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("level").alias("kinds"),
        F.count_if(F.col("level") == 2).alias("h2"),
        F.count_if((F.col("level") == 2) & (F.coalesce("next", F.lit(0)) >= 3)).alias("kept"),
        F.count_if(F.col("level") == LEVELS).alias("deepest"),
        F.min_by("level", "i").alias("first_level"),
    )
    gap = F.round(F.lag("size").over(Window.partitionBy("doc").orderBy(F.desc("size"))) - F.col("size"), 1)
    gaps = levels.withColumn("gap", gap).groupBy("doc").agg(F.min("gap").alias("min_gap"))
    collapse = F.when(F.col("h2") == 0, 1.0).when(F.col("kinds") >= 3, 1 - F.col("kept") / F.col("h2")).otherwise(0.0)
    rows = gaps.join(stats, "doc", "left").withColumn("collapse", F.when(F.col("n").isNull(), 0.0).otherwise(collapse)).withColumn("saturation", F.coalesce(F.col("deepest") / F.col("n"), F.lit(0.0)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("collapse") > MOST_COLLAPSED, "collapse"),
            F.when(F.col("saturation") > MOST_SATURATED, "saturation"),
            F.when(F.col("min_gap") <= LEAST_GAP, "clustering"),
            F.when(F.col("first_level") > 3, "first-heading"),
        )
    )
    reasons = F.when(F.col("n").isNull(), F.array().cast("array<string>")).otherwise(reasons)
    return rows.withColumn("reasons", reasons).select("doc", "collapse", "saturation", "min_gap", "first_level", (F.size("reasons") == 0).alias("valid"), "reasons")


def render(rows: DataFrame) -> DataFrame:
    """(doc, markdown): headings with their marks and a blank line, a blank line after each page."""
    mark: Column = F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("text"), F.lit("\n"))
    line = F.when(F.col("level").isNotNull(), mark).otherwise(F.col("text"))
    pages = rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: F.concat(x["t"], F.lit("\n"))), "\n")
    return pages.groupBy("doc").agg(whole.alias("markdown"))


def to_markdown(spans: DataFrame) -> DataFrame:
    """(doc, markdown, valid): null markdown where another converter should take over: no text, no
    heading sizes, or a heading tree that fails validation."""
    spans = by_document(spans)
    hist = size_histogram(spans)
    levels = heading_levels(hist)
    rows = bridged(stitched(text_lines(spans), levels))
    checked = validate_headings(rows, levels).select("doc", "valid")
    docs = spans.select("doc").distinct()
    out = docs.join(checked, "doc", "left").join(render(rows), "doc", "left")
    return out.select("doc", F.when(F.col("valid"), F.col("markdown")).alias("markdown"), F.coalesce("valid", F.lit(False)).alias("valid"))

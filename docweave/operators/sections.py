"""Sections, tables of contents, and collapsing hits to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _paths(f: str) -> tuple[Column, Column]:
    return F.lower(F.array_join("heading_path", " ")), F.lower(F.lit(f))


def sections_for_dense(chunks: DataFrame, wanted: str) -> DataFrame:
    """(corpus, section_id) that a filter selects: its exact id, a heading equal to it, or a path that
    begins with it, case aside. One matching chunk selects its whole section."""
    path, f = _paths(wanted)
    hit = (F.col("section_id") == wanted) | F.exists("heading_path", lambda h: F.lower(h) == f) | F.startswith(path, f)
    return chunks.where(hit).select("corpus", "section_id").distinct()


def sections_for_sparse(chunks: DataFrame, wanted: str) -> DataFrame:
    """As ``sections_for_dense``, but the path or a heading need only contain the filter."""
    path, f = _paths(wanted)
    hit = (F.col("section_id") == wanted) | F.contains(path, f) | F.exists("heading_path", lambda h: F.contains(F.lower(h), f))
    return chunks.where(hit).select("corpus", "section_id").distinct()


def aggregate_sections(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a section that a hit lies in: score and place of its first hit, text of all its chunks."""
    first = hits.where(F.coalesce(F.col("section_id"), F.lit("")) != "").groupBy("query_id", "corpus", "section_id").agg(F.min_by("score", "place").alias("score"), F.min("place").alias("place"))
    parts = chunks.join(first.select("corpus", "section_id").distinct(), ["corpus", "section_id"], "left_semi")
    row = F.struct("char_offset", "pos", "text", "heading", "heading_path", "source_path")
    whole = parts.groupBy("corpus", "section_id").agg(F.array_sort(F.collect_list(row)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    top = F.col("parts")[0]
    head = F.coalesce(top["heading"], F.lit(""))
    whole = whole.select(
        "corpus",
        "section_id",
        head.alias("heading"),
        top["heading_path"].alias("heading_path"),
        text.alias("text"),
        F.size("parts").cast("long").alias("chunk_count"),
        top["source_path"].alias("source_path"),
        F.when(head != "", head).otherwise(F.substring(X.strip(F.regexp_replace(text, r"\s+", " ")), 1, 200)).alias("summary"),
    )
    out = first.join(whole, ["corpus", "section_id"])
    return out.withColumn("location", X.location(F.col("source_path"), F.col("heading"))).withColumn("filename", X.filename(F.col("source_path")))


def collapse_to_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a document: best score, number of hits, corpus of its first hit, whole text.

    Documents that are gone have no row. Place is by score, then first hit.
    """
    one = hits.groupBy("query_id", "source_path").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("matched_chunks"), F.min_by("corpus", "place").alias("corpus"), F.min("place").alias("first_place"))
    text = documents.select("corpus", "source_path", F.col("markdown").alias("text"))
    out = one.join(text, ["corpus", "source_path"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_place")
    return out.withColumn("place", F.row_number().over(w)).withColumn("filename", X.filename(F.col("source_path"))).withColumn("char_count", F.length("text").cast("long"))


def estimated_size(hits: DataFrame) -> DataFrame:
    """Characters of the hits' texts (summaries, where a text is missing), by query."""
    return hits.groupBy("query_id").agg(F.sum(F.length(F.coalesce("text", "summary"))).alias("chars"))


def section_map(chunks: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.groupBy("corpus", "source_path", "section_id").agg(ids.alias("chunk_ids"))


def toc(chunks: DataFrame) -> DataFrame:
    """One row a document: title, structured, chunk_count and its headings' nodes in order.

    The title is the first chunk's outermost heading, or the file's name; nodes are what follows it
    in the paths. The root counts all chunks, and those whose path is the title alone once more.
    """
    depth = F.size("heading_path")
    doc = chunks.groupBy("corpus", "source_path").agg(
        F.min_by(F.get("heading_path", F.lit(0)), "pos").alias("first"),
        F.max((depth > 0).cast("int")).alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(depth == 1).alias("titles"),
    )
    node = chunks.where(depth > 1).groupBy("corpus", "source_path", F.get("heading_path", F.lit(1)).alias("heading"))
    node = node.agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("chunk_count"))
    child = F.struct("pos", F.col("heading").alias("title"), "heading", F.lit(2).alias("level"), "chunk_count", F.lit(True).alias("structured"))
    kids = node.groupBy("corpus", "source_path").agg(F.array_sort(F.collect_list(child)).alias("kids"))
    name = X.filename(F.col("source_path"))
    out = doc.join(kids, ["corpus", "source_path"], "left")
    empty = F.array().cast("array<struct<title:string,heading:string,level:int,chunk_count:bigint,structured:boolean>>")
    drop = F.transform("kids", lambda k: F.struct(k["title"].alias("title"), k["heading"].alias("heading"), k["level"].alias("level"), k["chunk_count"].alias("chunk_count"), k["structured"].alias("structured")))
    structured = F.col("s") == 1
    title = F.when(structured, F.coalesce("first", name)).otherwise(name)
    return out.select(
        "corpus",
        "source_path",
        title.alias("title"),
        title.alias("heading"),
        F.when(structured, 1).otherwise(0).alias("level"),
        F.when(structured, F.col("n") + F.col("titles")).otherwise(F.col("n")).alias("chunk_count"),
        structured.alias("structured"),
        F.coalesce(drop, empty).alias("children"),
    )


def toc_listing(tree: DataFrame) -> DataFrame:
    return tree.select("corpus", "source_path", "title", "structured", "chunk_count", F.transform("children", lambda c: c["heading"]).alias("headings"))

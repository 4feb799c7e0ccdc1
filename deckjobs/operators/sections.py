"""Marker scripts: runs -> slides that begin at ``<marker> N:``.

Input rows are (doc_id, page, line_no, run_no, text, ..., space_before); the order of a
document is (page, line_no, run_no).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import SLIDE_NUMBER
from .scans import running

MARKER = "SLIDE"


def marker_sections(runs: DataFrame, marker: str = MARKER, block: int | None = None) -> DataFrame:
    """Runs with ``section`` (from 1); markers, their numbers and what comes before the first are gone.

    A marker and its number are two runs of one line; a section without text leaves a gap
    in the numbers. ``block`` (pages) spreads a document over tasks, see ``scans``.
    """
    line = W.partitionBy("doc_id", "page", "line_no").orderBy("run_no")
    x = runs.withColumn("_m", F.coalesce((F.col("text") == marker) & F.lead("text").over(line).rlike(SLIDE_NUMBER), F.lit(False)))
    x = x.withColumn("_n", F.coalesce(F.lag("_m").over(line), F.lit(False)))
    x = running(x, ["page", "line_no", "run_no"], {"section": F.col("_m").cast("int")}, block)
    return x.where("section > 0 and not _m and not _n").drop("_m", "_n")


def renumber_slides(sections: DataFrame) -> DataFrame:
    """Adds ``slide_no``: sections that have text, counted from 1."""
    return sections.withColumn("slide_no", F.dense_rank().over(W.partitionBy("doc_id").orderBy("section")))


def reset_leading_space(sections: DataFrame) -> DataFrame:
    """The first run of each line of a section has no space before it."""
    first = F.row_number().over(W.partitionBy("doc_id", "section", "page", "line_no").orderBy("run_no")) == 1
    return sections.withColumn("space_before", F.when(first, False).otherwise(F.col("space_before")))


def slides(runs: DataFrame, marker: str = MARKER) -> DataFrame:
    return reset_leading_space(renumber_slides(marker_sections(runs, marker)))


def slide_text(slide_runs: DataFrame) -> DataFrame:
    """doc_id, slide_no, text: lines of runs, joined by spaces."""
    item = F.struct("page", "line_no", "run_no", "space_before", "text")
    piece = F.transform(F.sort_array(F.collect_list(item)), lambda r, i: F.concat(F.when((i > 0) & r["space_before"], " ").otherwise(""), r["text"]))
    lines = slide_runs.groupBy("doc_id", "slide_no", "page", "line_no").agg(F.array_join(piece, "").alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "line"))), lambda r: r["line"])
    return lines.groupBy("doc_id", "slide_no").agg(F.array_join(ordered, " ").alias("text"))


def marker_fallback(docs: DataFrame, slide_runs: DataFrame) -> DataFrame:
    """Documents without any marker slide; they go the free-form way."""
    return docs.select("doc_id").join(slide_runs.select("doc_id").distinct(), "doc_id", "left_anti")


def prompts_union(marked: DataFrame, freeform: DataFrame) -> DataFrame:
    """Slides of either way, with the way they came."""
    return marked.withColumn("way", F.lit("marker")).unionByName(freeform.withColumn("way", F.lit("freeform")))

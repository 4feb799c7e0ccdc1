"""Shapes of plans: shuffles, columns read, and what runs outside the JVM."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from deckjobs import schemas
from deckjobs.operators import freeform, glyphs, outline, rtf, sections

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture
def static(spark):
    """Plans as they are before any stage has run."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_outline_needs_one_shuffle_by_document(static):
    lines = static.createDataFrame([], schemas.OUTLINE_LINES)
    e = outline.entries(lines)
    assert shuffles(e) == 1 and "Python" not in plan(e)
    assert shuffles(outline.corpus_profile(e)) == 1


def test_sections_need_one_line_and_one_document_shuffle(static):
    assert shuffles(sections.slides(static.createDataFrame([], schemas.RUNS))) <= 2


def scans(df):
    return len(re.findall(r"Scan ExistingRDD", plan(df)))


def test_rich_text_is_one_aggregate_by_slide(static):
    """From runs of a page to rich text: the shuffles of the sections, one scan, no palette joined back."""
    style = {"keep_colors": F.lit(True), "highlight_bold": F.lit(True), "regular_color": F.lit("#FFFFFF"), "emphasis_color": F.lit("#FFFF00")}
    font = {"type_font_name": F.lit("A"), "type_size": F.lit(9.0), "type_bold": F.lit(True), "type_italic": F.lit(False), "type_line_height": F.lit(0.0), "type_spacing": F.lit(0.0), "type_box_width": F.lit(9.0)}
    made = rtf.rich_text(sections.slides(static.createDataFrame([], schemas.RUNS)).withColumns({**style, **font}))
    assert shuffles(made) <= 2 and scans(made) == 1 and not re.search("Join|Python", plan(made))


def test_a_page_is_dealt_and_sorted_once_on_each_side(static):
    g, p, f, b = (static.createDataFrame([], x) for x in (schemas.GLYPHS, schemas.PAINTS, schemas.FILLS, schemas.PAGE_BOXES))
    lines = glyphs.page_lines(glyphs.font_flags(glyphs.glyph_clean(g)), p, glyphs.page_background(f, b))
    text = plan(lines)
    assert text.count("FlatMapCoGroupsInArrow") == 1 and "Window" not in text
    cogroup = text.split("SortMergeJoin")[0]  # what stands below is the small join of fills and boxes
    assert cogroup.count("Sort [") <= 3 and scans(lines) == 4


def test_freeform_slides_are_dealt_out_once(static):
    slides = freeform.freeform_slides(static.createDataFrame([], schemas.LINES))
    assert shuffles(slides) <= 2 and scans(slides) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_scan_reads_only_the_columns_used(static):
    docs = static.read.parquet(f"{SF}/documents.parquet")
    from deckjobs.sources.tables import src_lines

    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(src_lines(docs)))[1]
    assert read == "doc_id:bigint,text:string" and "IsNotNull(text)" in plan(src_lines(docs))


def test_blocks_are_cut_once_and_not_flattened_again_for_each_line(static):
    """A row generated from the slides asks for ``size(slides) > 0``; that must not be moved below the cutting."""
    blocks = freeform.layout_blocks(freeform.drop_small_print(static.createDataFrame([], schemas.LINES)))
    made = plan(freeform.split_blocks(blocks, only="flowing").select("doc_id", F.posexplode("slides")))
    assert made.count("ArrowEvalPython") == 1 and not re.search(r"slice\(flatten", made)
    assert plan(freeform.heading_attach(freeform.split_blocks(blocks))).count("ArrowEvalPython") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_texts_are_parsed_once_for_cues_and_verses(spark):
    from deckjobs import catalog

    for name in ("cue_numbering", "split_verse", "pack_balanced"):
        made = plan(catalog.QUERIES[name](spark, SF))
        assert "documents.parquet" not in made and "posexplode(split" not in made, name

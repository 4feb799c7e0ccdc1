"""The workloads on literal rows: what they make, and what they refuse."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deckjobs import schemas
from deckjobs.operators import outline, rtf
from deckjobs.plans import pipelines
from deckjobs.sources import fixtures

GEOMETRY = "style string, role string, force_caps_off boolean, caps string, box_w double, box_h double, box_y double, margin_l double, margin_r double, margin_t double, margin_b double, font_size double, line_height_multiple double, slide_h double, ref_y0 double, ref_h double, font_name string, ref_font_name string, ref_font_size double, label_alpha double, label_rgb string, attributes array<struct<start:int,end:int,capitalization:string>>"


def geometry(spark, *rows):
    """(style, role, box width, font size, font name, label's alpha)"""
    full = [(s, r, True, "ALL_CAPS", w, 300.0, 600.0, 0.0, 0.0, 8.0, 8.0, z, 0.0, 1080.0, 950.0, 90.0, f, "Georgia", 33.0, a, "#00FF00", [(0, 4, "ALL_CAPS")]) for s, r, w, z, f, a in rows]
    return spark.createDataFrame(full, GEOMETRY)


@pytest.fixture
def deck(spark):
    return geometry(spark, ("Deck", "title", 1800.0, 33.0, "Small", 0.0), ("Deck", "point", 1800.0, 50.0, "Big", 1.0), ("Deck", "keyword", 1800.0, 50.0, "Big", 0.0), ("Deck", "scripture", 600.0, 50.0, "Verse", 0.0))


def outline_of(spark, deck, texts, styles, **options):
    lines = spark.createDataFrame([(d, i, x) for d, ls in texts.items() for i, x in enumerate(ls)], "doc_id bigint, line_no int, line string")
    jobs = spark.createDataFrame(list(styles.items()), "doc_id bigint, style string")
    return pipelines.outline_decks(lines, jobs, fixtures.styles(spark), deck, fixtures.looks(spark), **options)


def test_outline_texts_types_labels_and_looks(spark, deck):
    lines = ["Title: Hope", "POINT 1: Hold on", "John 3:16 (NIV)", "For God so loved the world. " * 12, "Back to Point 1 when I say: now", "Back to John 3:16 NIV when I say: again", "Image: a boat", "Back to Point 9."]
    made = outline_of(spark, deck, {1: lines}, {1: "Deck"}, default_copies=True, disable_copies=True)
    got = made.cues.orderBy("cue_no").collect()
    verse = [r for r in got if r.role == "scripture" and r.source_pos is None]
    assert [(r.name, r.look_uuid, r.enabled) for r in got[:4]] == [("Title", "u1", True), ("Title", "u4", False), ("Point 1", "u2", True), ("Point 1", "u4", False)]
    assert len(verse) > 1 and all(r.texts[0] == "John 3:16 NIV" and len(r.rtf) == 2 for r in verse)
    assert "Georgia" in verse[0].rtf[0] and "\\fs66" in verse[0].rtf[0] and "Verse" in verse[0].rtf[1] and "\\fs100" in verse[0].rtf[1]
    assert "Small" in got[0].rtf[0] and "\\fs66" in got[0].rtf[0] and "Big" in got[2].rtf[0] and "\\fs100" in got[2].rtf[0]
    assert [r.label_color for r in got[:3]] == ["#FF0000", "#FF0000", "#00FF00"] and verse[0].label_color == "#FFFFFF"
    assert [tuple(a) for a in got[0].attributes[0]] == [(0, 4, "ALL_CAPS")] and verse[0].attributes[0][0].end == len("John 3:16 NIV")
    now, again = got[-2:]
    assert (now.name, now.texts, now.look_uuid) == ("now", ["Hold on"], "u4") and (again.name, again.texts) == ("again", verse[0].texts)
    w = made.warnings.first()
    assert (w.unresolved, w.skipped_images) == ("Back to Point 9", "a boat") and made.refused.count() == 0
    deckrow = made.presentations().first()
    assert deckrow.name == "My Message" and [c.cue_no for c in deckrow.cues] == list(range(1, len(got) + 1)) and deckrow.cues[0].texts == ["Hope"]


def test_every_outline_is_made_or_refused(spark, deck):
    lines = {d: ["Title: x"] for d in range(1, 6)} | {6: ["no label"], 7: ["Image: only"]}
    docs = spark.createDataFrame([(d,) for d in range(1, 9)], "doc_id bigint")
    made = outline_of(spark, deck, lines, {1: "Deck", 2: "None", 3: "Plain", 4: "Torn", 6: "Deck", 7: "Deck", 8: "Deck"}, docs=docs)
    assert {r.doc_id: r.reason for r in made.refused.collect()} == {2: "no such style", 3: "style is of kind prompts", 4: "missing templates: keyword, scripture", 5: "no job", 6: "no labels found", 8: "no labels found"}
    assert {r.doc_id: len(r.cues) for r in made.presentations().collect()} == {1: 1, 7: 0}


def test_missing_look_template_and_bad_colour_refuse(spark, deck):
    bare = outline_of(spark, deck.where("role <> 'point'"), {1: ["POINT 1: x"], 2: ["Title: y"]}, {1: "Deck", 2: "Deck"})
    assert [tuple(r) for r in bare.refused.collect()] == [(1, "no template for: point")] and [r.doc_id for r in bare.cues.collect()] == [2]
    looks = fixtures.looks(spark).where("role <> 'backto'")
    lines = spark.createDataFrame([(1, 0, "Title: x")], "doc_id bigint, line_no int, line string")
    jobs = spark.createDataFrame([(1, "Deck")], "doc_id bigint, style string")
    assert pipelines.outline_decks(lines, jobs, fixtures.styles(spark), deck, looks, default_copies=True).refused.first().reason == "no look for copies"
    red = fixtures.styles(spark).withColumn("regular_color", F.lit("red"))
    assert pipelines.outline_decks(lines, jobs, red, deck, looks).refused.first().reason == "a colour of the style is none"


def test_outline_from_glyphs_drops_raised_digits(spark):
    rows = [(1, p, i, s, "X", z, 10.0 * i, 50.0, 10.0) for p in (1, 2) for i, (s, z) in enumerate([("T", 20.0), ("itle:", 20.0), (" ", 20.0), ("2", 9.0), ("a", 20.0)])]
    got = pipelines.outline_lines(spark.createDataFrame(rows, schemas.GLYPHS)).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "Title: a"), (1, 1, "Title: a")]
    assert [e.text for e in outline.entries(spark.createDataFrame(got)).collect()] == ["a", "a"]


# ---- prompts ----


def written_page(doc, lines, size=20.0, page=1, font="X-Book"):
    """Glyphs of lines, a character each, ten points wide."""
    return [(doc, page, 1000 * n + i, c, font, size, 10.0 * i, 700.0 - 27.0 * n, 10.0) for n, line in enumerate(lines) for i, c in enumerate(line)]


def prompts(spark, glyphs, jobs, paints=(), geo=None, **options):
    g = spark.createDataFrame(glyphs, schemas.GLYPHS)
    docs = g.select("doc_id").distinct().unionByName(spark.createDataFrame([(99,)], "doc_id bigint"))
    none = lambda schema: spark.createDataFrame([], schema)
    jobs = spark.createDataFrame(jobs, "doc_id bigint, style string, colors string, max_lines int, box_width double, box_size double")
    geo = geo or geometry(spark, ("Plain", "body", 1900.0, 60.0, "Body", 0.0), ("Loud", "body", 700.0, 40.0, "Heavy", 0.0))
    return pipelines.prompt_decks(g, spark.createDataFrame(list(paints), schemas.PAINTS), none(schemas.FILLS), none(schemas.PAGE_BOXES), docs, jobs, fixtures.styles(spark), geo, **options)


LONG = ["These words of a long paragraph run on.", "They do so for a good while yet, here.", "And then another sentence follows that.", "It ends where the whole thing ends now."]


def test_limit_and_box_of_the_job_cut_freeform_slides(spark):
    glyphs = [g for d in (1, 2, 3) for g in written_page(d, LONG)]
    made = prompts(spark, glyphs, [(1, "Plain", "", 7, 1900.0, 60.0), (2, "Plain", "", 2, 600.0, 60.0), (3, "Loud", "", None, None, None)])
    n = {r.doc_id: r["count"] for r in made.cues.groupBy("doc_id").count().collect()}
    assert n[1] == 1 and n[2] > 3 and n[3] == 1
    assert all(r.way == "freeform" for r in made.cues.collect())
    said = {r.doc_id: r.t for r in made.cues.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue_no", "texts"))), lambda r: r["texts"][0]), " ").alias("t")).collect()}
    assert set(said.values()) == {" ".join(LONG)}
    assert {r.doc_id: r.note for r in made.warnings.collect()}[2].endswith("about 2 lines a slide")
    one = made.cues.where("doc_id = 3").first()
    assert "Heavy" in one.rtf[0] and "\\fs80" in one.rtf[0] and "\\paperw14000" in one.rtf[0]


def test_markers_win_and_removed_slides_go(spark):
    glyphs = written_page(1, ["Intro", "SLIDE 1:", "one", "SLIDE 2: two", "SLIDE 3: three"]) + written_page(2, ["SLIDE 1: a", "SLIDE 2: b"])
    jobs = [(1, "Plain", "", None, None, None), (2, "Plain", "", None, None, None)]
    gone = spark.createDataFrame([(1, 1), (1, 9), (2, 0)], "doc_id bigint, idx int")
    made = prompts(spark, glyphs, jobs, removals=gone)
    assert [(r.doc_id, r.name, r.texts, r.way) for r in made.cues.orderBy("doc_id", "cue_no").collect()] == [(1, "Slide 1", ["one"], "marker"), (1, "Slide 2", ["three"], "marker"), (2, "Slide 1", ["b"], "marker")]
    assert made.warnings.count() == 0
    slides = made.cues.select("doc_id", F.col("cue_no").alias("slide_no"), F.col("texts")[0].alias("text"))
    assert [tuple(r) for r in outline.prompt_review_rows(slides).orderBy("doc_id", "idx").collect()][:2] == [(1, 0, "Slide 1", "one", False), (1, 1, "Slide 2", "three", False)]


def test_every_prompt_document_is_made_or_refused(spark):
    glyphs = [g for d in (1, 2, 3, 4) for g in written_page(d, ["words"])] + written_page(5, ["  "])
    made = prompts(spark, glyphs, [(1, "Plain", "", None, None, None), (2, "None", "", None, None, None), (3, "Deck", "", None, None, None), (5, "Plain", "", None, None, None)])
    assert {r.doc_id: r.reason for r in made.refused.collect()} == {2: "no such style", 3: "style is of kind slides", 4: "no job", 5: "no text found", 99: "no job"}
    assert [(r.doc_id, r.name, len(r.cues)) for r in made.presentations().collect()] == [(1, "My Message", 1)]
    no_body = prompts(spark, glyphs[:5], [(1, "Quiet", "", None, None, None)])
    assert {r.doc_id: r.reason for r in no_body.refused.collect()}[1] == "no template for: body"


def test_colours_follow_the_way_and_the_job(spark):
    glyphs = written_page(1, ["ab"]) + written_page(2, ["ab"]) + written_page(3, ["SLIDE 1: ab"]) + written_page(4, ["SLIDE 1: ab"], font="X-Bold")
    paints = [(d, 1, 5, 0.0, 700.0, [1.0, 0.0, 0.0]) for d in (1, 2)] + [(d, 1, 5, 90.0, 700.0, [1.0, 0.0, 0.0]) for d in (3, 4)]
    made = prompts(spark, glyphs, [(1, "Plain", "", None, None, None), (2, "Plain", "style", None, None, None), (3, "Plain", "pdf", None, None, None), (4, "Plain", "", None, None, None)], paints)
    red = {r.doc_id: "\\red255\\green0\\blue0" in r.rtf[0] for r in made.cues.collect()}
    yellow = {r.doc_id: "\\red255\\green255\\blue0" in r.rtf[0] for r in made.cues.collect()}
    assert red == {1: True, 2: False, 3: True, 4: False} and yellow == {1: False, 2: True, 3: False, 4: True}
    assert {rtf.visible_text(r.rtf[0]) for r in made.cues.collect()} == {"ab"}

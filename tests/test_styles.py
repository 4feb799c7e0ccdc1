"""Style tables, cue geometry, sources, sinks and streams on literal rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from deckjobs.operators import cues, rtf, styles
from deckjobs.sources import fixtures, tables
from deckjobs.streaming.jobs import SESSIONS, incremental_convert, session_expiry
from deckjobs.streaming.jobs import review_sessions as session_reviews


def test_defaults_fill_gaps_only(spark):
    got = {r.name: r for r in styles.settings_defaults(fixtures.styles(spark)).collect()}
    q = got["Quiet"]
    assert (q.regular_color, q.emphasis_color, q.force_caps_off, q.highlight_bold, q.scripture_max_lines) == ("#FFFFFF", "#FFFF00", True, True, 5)
    assert got["Loud"].force_caps_off is False and got["Deck"].scripture_max_lines == 4


def test_missing_roles_and_looks(spark):
    s = fixtures.styles(spark)
    assert {r.name: r.missing for r in styles.missing_roles(s).collect()}["Torn"] == ["keyword", "scripture"]
    assert {r.name: r.missing for r in styles.missing_looks(s, fixtures.looks(spark)).collect()}["Deck"] == ["scripture"]


def test_seeding(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    seed = lambda existing, offered, there, legacy=("A",): sorted(r.name for r in styles.seed_styles(names("A", "B"), names(*existing), names(*offered), there, list(legacy)).collect())
    assert seed([], [], False) == ["A", "B"] and seed(["X"], [], False) == ["B"]
    assert seed(["B"], ["A"], True) == [] and seed([], [], True) == ["A", "B"]
    assert [r.name for r in styles.offered_union(names("B", "A"), names("A", "C")).collect()] == ["A", "B", "C"]


PICKS, CUES = "style string, role string, doc_id bigint, idx int, pick_seq int", "doc_id bigint, idx int, name string, has_slide boolean, look_name string"


def test_template_and_look_have_each_their_last_pick(spark):
    c = spark.createDataFrame([(1, 0, "a", True, None), (1, 1, "b", True, "L"), (1, 2, "c", False, None), (1, 3, "d", False, "M")], CUES)

    def captured(*picks):
        df = spark.createDataFrame([("S", role, 1, idx, k) for k, (role, idx) in enumerate(picks)], PICKS)
        return {r.role: (r.cue, r.look_name) for r in styles.capture_roles(df, c).collect()}, [(r.pick_seq, r.refused) for r in styles.refused_picks(df, c).orderBy("pick_seq").collect()]

    assert captured(("title", 0), ("title", 1)) == ({"title": ("b", "L")}, [])
    # a cue without a slide gives no template, but its look, or that it has none, counts
    assert captured(("title", 1), ("title", 3)) == ({"title": ("b", "M")}, [(1, "slide 4 has nothing to copy")])
    assert captured(("title", 1), ("title", 2)) == ({"title": ("b", None)}, [(1, "slide 3 has nothing to copy")])
    assert captured(("point", 9), ("point", 3)) == ({"point": (None, "M")}, [(0, "no such slide"), (1, "slide 4 has nothing to copy")])
    # for back-references the look is all; without one the earlier pick goes too
    assert captured(("backto", 3)) == ({"backto": ("d", "M")}, [])
    assert captured(("backto", 1), ("backto", 0)) == ({}, [(1, "slide 1 has no look")])
    assert captured(("backto", 1), ("backto", 7)) == ({"backto": ("b", "L")}, [(1, "no such slide")])


def test_assembly_needs_every_template(spark):
    picks = spark.createDataFrame([("S", "title", 1, 0, 1), ("S", "point", 1, 1, 2), ("S", "backto", 1, 1, 3)], PICKS)
    c = spark.createDataFrame([(1, 0, "a", True, None), (1, 1, "b", False, "L")], CUES)
    forms = spark.createDataFrame([("S", "slides", False), ("T", "prompts", False)], "style string, kind string, overwrite boolean")
    out = {r.style: r.reason for r in styles.style_assemble(styles.capture_roles(picks, c), forms, spark.createDataFrame([("T",)], "name string")).collect()}
    assert out == {"S": "missing templates: point, keyword, scripture", "T": "missing templates: body"}


def test_pair_is_centred(spark):
    row = spark.createDataFrame([(2, 50.0, 0.0, 8.0, 8.0, 600.0, 300.0, 950.0, 90.0, 1080.0)], "verse_lines int, font_size double, line_height_multiple double, margin_t double, margin_b double, box_y double, box_h double, ref_y0 double, ref_h double, slide_h double")
    r = cues.center_vertically(row).first()
    assert abs(r.verse_h - 146.0) < 1e-9 and abs((r.verse_y + r.ref_y + 90.0) / 2 - 540.0) < 1e-9


def test_attributes_stretch(spark):
    df = spark.createDataFrame([([(0, 5, "ALL_CAPS"), (0, 9, "ALL_CAPS"), (2, 9, "ALL_CAPS"), (0, 9, "NONE")], "a😀")], "a array<struct<start:int,end:int,capitalization:string>>, t string")
    assert [tuple(x) for x in df.select(cues.fit_custom_attributes(F.col("a"), F.col("t"))).first()[0]] == [(0, 3, "ALL_CAPS")]


RUNS = "doc_id bigint, slide_no int, page int, line_no int, run_no int, text string, bold boolean, italic boolean, color string, highlight boolean, space_before boolean"


def styled(spark, runs, **style):
    given = {"keep_colors": True, "highlight_bold": True, "regular_color": "#FFFFFF", "emphasis_color": "#FFFF00", **style}
    return spark.createDataFrame(runs, RUNS).withColumns({k: F.lit(v) for k, v in given.items()})


def folded(df, italic=False):
    slides = rtf.color_palette(rtf.gathered(df)).withColumn("italic", F.lit(italic))
    return rtf.rtf_state_diff(rtf.run_colors(slides)).first()


def test_palette_order_and_case(spark):
    runs = [(1, 1, 1, 1, i, w, False, False, c, h, i > 0) for i, (w, c, h) in enumerate([("a", "#ff0000", False), ("b", "#FF0000", False), ("c", "#ffffff", False), ("d", "", True)])]
    got = folded(styled(spark, runs))
    assert got.colors == ["#FFFFFF", "#ff0000", "#000000"] and got.base == 1
    assert [(r.color_at, r.highlight_at) for r in got.runs] == [(1, 0), (1, 0), (0, 0), (2, 1)]
    assert [r.control for r in got.runs] == ["\\cf2", "", "\\cf1", "\\cf3\\highlight1\\cb1"]


def test_emphasis_is_in_the_palette_only_if_bold_text_has_it(spark):
    runs = [(1, 1, 1, n, 0, "a", True, True, "#123456", True, False) for n in (1, 2)]
    on = folded(styled(spark, runs, keep_colors=False, emphasis_color="#ffffff"))
    assert on.colors == ["#FFFFFF", "#ffffff"] and [r.control for r in on.runs] == ["\\cf2", "\\cf2"]
    off = folded(styled(spark, runs, keep_colors=False, highlight_bold=False), italic=True)
    assert off.colors == ["#FFFFFF"] and [(r.control, r.first) for r in off.runs] == [("\\cf1", True), ("\\cf1", True)]


def test_rich_text_of_a_slide(spark):
    runs = [(1, 1, 1, 2, 0, "b{", False, False, "", False, False), (1, 1, 1, 1, 1, "SAVED", True, False, "#FF0000", False, True), (1, 1, 1, 1, 0, "We’re", False, True, "", False, False)]
    font = {"font_name": "Avenir", "size": 33.0, "bold": False, "italic": False, "line_height": 0.0, "spacing": 1.5, "box_width": 600.0}
    df = styled(spark, runs).withColumns({f"type_{k}": F.lit(v) for k, v in font.items()})
    r = rtf.rich_text(df.withColumn("way", F.lit("x")), ("way",)).first()
    start = "\\pard\\li0\\fi0\\ri0\\qc\\sb0\\sa30\\sl240\\slmult1\\slleading0\\f0\\b0\\i0\\ul0\\strike0\\fs66\\expnd0\\expndtw0\\CocoaLigature1\\cf1\\strokewidth0\\strokec1\\nosupersub\\ulc0\\highlight3\\cb3 "
    assert (r.way, r.text) == ("x", "We’re SAVED b{") and "\\paperw12000\\" in r.rtf and r.rtf.startswith("{\\rtf0\\ansi\\ansicpg1252{\\fonttbl\\f0\\fnil Avenir;}{\\colortbl;\\red255\\green255\\blue255;\\red255\\green0\\blue0;\\red255\\green255\\blue255;}")
    assert r.rtf.endswith(start + "\\cf1\\i We\\u8217 ?re \\cf2\\i0 SAVED\\par" + start + "\\cf1 b\\{}")
    assert rtf.rich_text(df.withColumn("regular_color", F.lit("red"))).first().rtf is None
    plain = df.limit(1).select(rtf.plain_rtf(F.lit("a\\b"), F.lit("#FFFFFF"), rtf.type_of("type_")).alias("t")).first().t
    assert rtf.visible_text(plain) == "a\\b" and plain.endswith("\\cb2 \\cf1 a\\\\b}")


def test_style_files(spark, tmp_path):
    rows = spark.createDataFrame([("S", "slides", 1, "old"), ("S", "slides", 2, "new"), ("T", "other", 1, "x")], "name string, kind string, at int, cue string")
    full = rows.select("name", "kind", F.create_map(F.lit("title"), F.encode("cue", "UTF-8")).alias("templates"), F.struct(F.lit("#FFFFFF").alias("regular_color"), F.lit(None).cast("string").alias("emphasis_color"), F.lit(None).cast("boolean").alias("force_caps_off"), F.lit(None).cast("boolean").alias("highlight_bold"), F.lit(None).cast("int").alias("scripture_max_lines")).alias("settings"), "at")
    tables.sink_styles(full, str(tmp_path / "s"), "at")
    (tmp_path / "s" / "file=S" / "broken.json").write_text("{")
    got = tables.src_styles(spark, str(tmp_path / "s")).collect()
    assert [(r.name, bytes(r.templates["title"])) for r in got] == [("S", b"new")]
    tables.sink_styles(full.where("at = 1").withColumn("name", F.concat(F.lit("New "), "name")), str(tmp_path / "s"), "at")
    tables.sink_styles(full.where("at = 1 and kind = 'slides'"), str(tmp_path / "s"), "at")
    assert sorted((r.name, bytes(r.templates["title"])) for r in tables.src_styles(spark, str(tmp_path / "s")).collect()) == [("New S", b"old"), ("S", b"old")]


def test_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0), ("a", t0 + dt.timedelta(hours=6)), ("b", t0), ("b", t0 + dt.timedelta(hours=6, seconds=1))], "token string, ts timestamp")
    assert sorted((r.token, r.n_touches) for r in session_expiry(df).collect()) == [("a", 2), ("b", 1), ("b", 1)]


H = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 1)
TOUCHES = "token string, ts timestamp, opens boolean"


def reviewed(df):
    return sorted(((r.token, r.kind, (r.first_touch - T0) / H, (r.last_touch - T0) / H, r.n_touches, r.expired_at and (r.expired_at - T0) / H) for r in df.collect()), key=repr)


def test_touches_of_swept_sessions_are_refused(spark):
    rows = [("a", 0, True), ("a", 6, False), ("a", 12 + 1 / 12, False), ("a", 18.25, False), ("a", 20, False), ("a", 30, True), ("b", 0, False), ("c", 1, True), ("c", 1, True)]
    df = spark.createDataFrame([(t, T0 + h * H, o) for t, h, o in rows], TOUCHES)
    # a touch after six hours counts until the next sweep, at a multiple of ten minutes, has gone by
    sweep = lambda h: h + 6 + 1 / 6
    assert reviewed(session_reviews(df)) == sorted([("a", "session", 0.0, 12 + 1 / 12, 3, 18 + 1 / 6), ("a", "refused", 18.25, 18.25, 1, None), ("a", "refused", 20.0, 20.0, 1, None), ("a", "session", 30.0, 30.0, 1, sweep(30)), ("b", "refused", 0.0, 0.0, 1, None), ("c", "session", 1.0, 1.0, 2, sweep(1))], key=repr)


def test_review_stream_over_batches_and_a_restart(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "state")}

    def put(*rows):
        spark.createDataFrame([(t, T0 + h * H, o) for t, h, o in rows], TOUCHES).coalesce(1).write.mode("append").parquet(at["in"])

    def run():
        out = session_reviews(spark.readStream.schema(TOUCHES).parquet(at["in"]))
        out.writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["state"]).trigger(availableNow=True).start().awaitTermination()
        return reviewed(spark.read.schema(SESSIONS).parquet(at["out"]))

    put(("a", 0, True), ("b", 1, True), ("b", 0.5, False))
    first = run()
    assert first == [("b", "refused", 0.5, 0.5, 1, None)]
    put(("a", 5, False), ("c", 9, True))  # from the checkpoint: a lives on, b is swept when the watermark has passed
    second = run()
    assert ("b", "session", 1.0, 1.0, 1, 7 + 1 / 6) in second and len(second) == 2
    put(("a", 11.5, False), ("b", 12, False), ("c", 30, True))  # both come after their sweep
    third = run()
    assert third == sorted([*second, ("a", "session", 0.0, 5.0, 2, 11 + 1 / 6), ("a", "refused", 11.5, 11.5, 1, None), ("b", "refused", 12.0, 12.0, 1, None), ("c", "session", 9.0, 9.0, 1, 15 + 1 / 6)], key=repr)


def test_incremental_conversion_takes_new_files_only(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda i: spark.createDataFrame([(i, f"Title: {i}")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(src)
    schema = "doc_id bigint, text string"
    run = lambda: incremental_convert(spark, src, schema, str(tmp_path / "state"), lambda b: b.withColumn("n", F.length("text")), out).awaitTermination()
    put(1)
    run()
    put(2)
    run()
    assert sorted((r.doc_id, r.batch) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 1)]

"""The outline grammar on literal lines."""

from __future__ import annotations

from deckjobs.operators import cues, outline

SCHEMA = "doc_id bigint, line_no int, line string"


def parse(spark, *lines):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], SCHEMA)
    return outline.entries(df).orderBy("pos").collect(), [r["line"] for r in outline.unrecognized(df).orderBy("pos").collect()]


def test_labels_and_continuations(spark):
    got, lost = parse(spark, "Sunday notes", "Title: Hope", "for  all", "12", "POINT 1: Hold on", "", "SUB POINT 2 Deeper", "TRUTH: Sin stops you", "Ephesians 2:1-10 (niv)", "16 But he came", "– again")
    assert [(e.kind, e.label, e.text or e.verse) for e in got] == [
        ("title", None, "Hope for  all"),
        ("point", "Point 1", "Hold on"),
        ("point", "Subpoint 2", "Deeper"),
        ("point", "Truth", "Sin stops you"),
        ("scripture", None, "But he came – again"),
    ]
    assert got[4].reference == "Ephesians 2:1-10 NIV" and not lost


def test_bare_marker_takes_the_next_line_whatever_it_is(spark):
    got, _ = parse(spark, "Scripture:", "Scripture:", "African   Proverb", "Go far", "Scripture:", "Title: x", "y", "Scripture:")
    assert [(e.kind, e.reference, e.verse) for e in got] == [("scripture", "African Proverb", "Go far"), ("scripture", "Title: x", "y")]


def test_image_ends_with_its_line_unless_a_quote_is_open(spark):
    got, lost = parse(spark, "Memorial stone image: “a", "b” c", "stray line", "Title: t")
    assert got[0].text == "“a b” c" and lost == ["stray line"]
    got, lost = parse(spark, "Image: plain", "stray line")
    assert got[0].text == "plain" and lost == ["stray line"]


def test_quotes_and_back_references(spark):
    got, _ = parse(spark, "Title: A", "John Ortberg quote", "Be kind", "Back to title when I say: “now”", "Back to Jerusalem they went", "Back to Point 9.")
    assert [(e.kind, e.reference or e.ref, e.verse or e.trigger) for e in got[1:]] == [("scripture", "John Ortberg", "Be kind"), ("backto", "Title", "now” Back to Jerusalem they went"), ("backto", "Point 9", "")]


def test_back_reference_takes_the_latest_before_it(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Back to Title", "Title: A", "Title: B", "Back to Title", "Back to Title: again", "Back to Point 2"])], SCHEMA)
    e = outline.entries(df)
    assert [r.source_pos for r in outline.backto_asof(e).orderBy("pos").collect()] == [None, None, None, 2, 2, None]
    assert [r.warning for r in outline.backto_unresolved(e).orderBy("pos").collect()] == ["Back to Title", "Back to Point 2"]
    made = cues.cue_numbering(cues.cue_expand(e, default_copies=True, disable_copies=True)).orderBy("cue_no").collect()
    assert [(c.name, c.look_role, c.enabled) for c in made] == [("Title", "title", True), ("Title", "backto", False), ("Title", "title", True), ("Title", "backto", False), ("Back to Title", "backto", True), ("again", "backto", True)]
    assert made[4].text == "B" and len({c.cue_id for c in made}) == 6


def test_empty_table(spark):
    assert parse(spark) == ([], [])


def test_visible_text_takes_stretches_of_characters():
    from deckjobs.operators.rtf import _TOKEN, visible_text

    assert visible_text(r"{BSrtf0{BSfonttblBSf0 x;}BSu8217 ?re BS'e9tBS'e9 aBS{bBS}BSBSc".replace("BS", "\\") + "\\par next{\\*\\x hidden}  end\\u233 }") == "’re été a{b}\\c next endé"
    assert len(_TOKEN.findall("\\b " + "word " * 1000)) == 2

"""Inputs of the deck jobs derived from the corpus tables by fixed rules, whole texts throughout.

Documents of the corpus have neither labels nor geometry; these rules add both, with
integer arithmetic and one division, so that any SQL engine derives identical rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import CAPITAL_WIDTH, PLAIN_WIDTH, advances, text_units, width_classes
from ..schemas import GLYPHS
from .shared import dealt


#: Bytes of text whose characters, a row each, one task can sort in memory.
TASK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def glyph_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the glyphs of all texts need, so that none has more of a larger corpus."""
    n = documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0]
    return 1 + (n or 0) // TASK_BYTES


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), line; texts are dealt out by document before they become lines, so that one large file is many tasks."""
    d = dealt(documents(spark, sf_dir).where("text is not null").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with labels put before or in place of them, by (7 line_no + doc_id) mod 13."""
    n, line = F.col("line_no"), F.col("line")
    k = (n * 7 + F.col("doc_id")) % 13
    number = (1 + n % 4).cast("string")
    verses = F.concat((1 + F.col("doc_id") % 21).cast("string"), F.lit(":"), (1 + n).cast("string"), F.lit("-"), (3 + n).cast("string"))
    forms = {
        0: F.concat(F.lit("Title: "), line),
        1: F.concat(F.lit("POINT "), number, F.lit(": "), line),
        2: F.concat(F.lit("CONDITION "), number, F.lit(": "), line),
        3: F.concat(F.lit("John "), verses, F.lit(" (NIV)")),
        4: F.concat(F.lit("Back to Point "), number),
        5: F.concat(F.lit("Image: “"), line),
        6: F.lit("Scripture:"),
        7: F.concat(F.lit("TRUTH: "), line),
        8: (1 + n).cast("string"),
        9: F.lit("Back to Title"),
        10: F.concat(F.lit("Mary Ann Smith quote: "), line),
    }
    labelled: Column = line
    for i, form in forms.items():
        labelled = F.when(k == i, form).otherwise(labelled)
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", labelled.alias("line"))


def doc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as runs with rule-given formats; in two of three documents every third line begins with a section marker."""
    n, d, r = F.col("line_no"), F.col("doc_id"), F.col("run_no")
    marker = F.when(d % 3 == 0, F.expr("cast(array() as array<string>)")).when(n % 9 == 0, F.array(F.lit("SLIDE"), n.cast("string"))).when(n % 3 == 0, F.array(F.lit("SLIDE"), F.concat(n.cast("string"), F.lit(":")))).otherwise(F.expr("cast(array() as array<string>)"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    x = doc_lines(spark, sf_dir).select("doc_id", (1 + F.floor(n / 20)).cast("int").alias("page"), "line_no", F.posexplode(F.concat(marker, words)).alias("run_no", "text"))
    bold = ((r + d) % 7 == 0) & (F.col("text") != "SLIDE")
    color = F.element_at(F.array(F.lit(""), F.lit("#FF0000"), F.lit("#FAE333"), F.lit("#ff0000"), F.lit("")), ((r + d) % 5 + 1).cast("int"))
    return x.withColumns({"bold": bold, "italic": (r + d) % 11 == 0, "color": color, "highlight": (r + d) % 17 == 0, "space_before": r > 0})


def geo_lines(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    """Lines with page, size, y, x0 and x1 (points) and their width in thousandths of a point.

    ``marked``: in two of three documents every third line of a page begins with a slide marker.
    """
    n = F.col("line_no")
    at = n % 20
    size = F.when(n % 10 == 0, 28).when(n % 17 == 16, 12).otherwise(20)
    y = 800 - 27 * at - 27 * F.floor(at / 4)
    line = F.when((at % 3 == 0) & (F.col("doc_id") % 3 != 0), F.concat(F.lit("SLIDE "), n.cast("string"), F.lit(": "), "line")).otherwise(F.col("line")) if marked else F.col("line")
    x = doc_lines(spark, sf_dir).select("doc_id", (1 + F.floor(n / 20)).cast("int").alias("page"), "line_no", line.alias("text"), size.alias("size"), y.cast("double").alias("y"))
    x = x.withColumn("width_milli", text_units(F.col("text")) * F.col("size")).withColumn("size", F.col("size").cast("double"))
    return x.withColumns({"x0": F.lit(57.0), "x1": 57.0 + F.col("width_milli") / 1000.0})


def char_units(c: Column) -> Column:
    """Width of one character in 1/1000 em: its class by one translation, the class's width from a list."""
    classes = width_classes()
    named = "".join(chr(0xE000 + i) * len(chars) for i, chars in enumerate(classes.values()))
    at = F.ascii(F.translate(c, "".join(classes.values()), named)) - 0xE000
    plain = F.when(c.rlike(r"^\p{Lu}"), CAPITAL_WIDTH).otherwise(PLAIN_WIDTH)
    return F.when(at.between(0, len(classes) - 1), F.get(F.array(*map(F.lit, classes)), at)).otherwise(plain)


def doc_glyphs(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    """One row for each character: doc_id, page, seq, s, font, size, x, y, w; ``src_line`` says where it is from.

    Lines are dealt out by page before they become characters. Some spaces are no-break
    spaces, tabs or gone; ``fi`` is a ligature on some lines; a replacement character and a
    line end stand behind some words.
    """
    from pyspark.sql import Window as W

    n, pos, d = F.col("line_no"), F.col("pos"), F.col("doc_id")
    x = dealt(geo_lines(spark, sf_dir, marked).select("doc_id", "page", "line_no", "size", "y", "text"), "doc_id", "page", least=glyph_tasks(spark, sf_dir))
    x = x.select("doc_id", "page", "line_no", "size", "y", F.posexplode(F.split("text", "")).alias("pos", "s")).where("s <> ''")
    x = x.withColumn("units", char_units(F.col("s")))
    before = F.sum("units").over(W.partitionBy("doc_id", "page", "line_no").orderBy("pos")) - F.col("units")
    x = x.withColumn("before", before).where(~((n % 4 == 3) & (F.col("s") == " ")))
    k = (F.floor(pos / 6) + d) % 7
    fonts = {0: "Avenir-Heavy", 1: "Avenir-Black", 2: "Helvetica-Bold", 3: "Helvetica-Oblique", 4: "Times-Italic", 5: "Avenir-HeavyOblique"}
    font = F.lit("Avenir-Book")
    for i, name in fonts.items():
        font = F.when(k == i, name).otherwise(font)
    small = F.col("s").between("0", "9") & (pos % 2 == 0)
    odd = F.when((F.col("s") == " ") & (pos % 11 == 3), "\u00a0").when((F.col("s") == " ") & (pos % 11 == 5), "\t").when((F.col("s") == "f") & (pos % 5 == 0), "ﬁ").when((F.col("s") == "q") & (pos % 3 == 0), "q\ufffd").when((F.col("s") == "z") & (pos % 4 == 0), "\r").otherwise(F.col("s"))
    return x.select(
        "doc_id",
        "page",
        ((n % 20) * 1000000 + pos).cast("long").alias("seq"),
        odd.alias("s"),
        font.alias("font"),
        F.when(small, F.col("size") * 0.5).otherwise(F.col("size")).alias("size"),
        (57.0 + F.col("before") * F.col("size") / 1000.0).alias("x"),
        (F.col("y") - pos % 3).alias("y"),
        (F.col("units") * F.col("size") / 1000.0).alias("w"),
        F.col("line_no").alias("src_line"),
    )


def page_text(spark: SparkSession, sf_dir: str, marked: bool = False, with_page: DataFrame | None = None) -> DataFrame:
    """The lines that glyphs come of, dealt out by page; ``with_page`` (doc_id, page, ...) adds what it has for a page."""
    lines = geo_lines(spark, sf_dir, marked).select("doc_id", "page", "line_no", "size", "y", "text")
    if with_page is not None:
        lines = lines.join(with_page, ["doc_id", "page"], "left")
    return dealt(lines, "doc_id", "page", least=glyph_tasks(spark, sf_dir))


#: Fonts by (pos / 6 + doc_id) mod 7.
FONTS = ("Avenir-Heavy", "Avenir-Black", "Helvetica-Bold", "Helvetica-Oblique", "Times-Italic", "Avenir-HeavyOblique", "Avenir-Book")


def glyphs_of_lines(t: pa.Table) -> pa.Table:
    """Lines of ``page_text`` -> their glyphs: the rows of ``doc_glyphs`` by whole-array steps."""
    text = t.column("text").combine_chunks()
    code = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
    n = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    line, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    pos = np.arange(len(code)) - first[line]
    units = advances()[code].astype(np.int64)
    ahead = np.concatenate([[0], np.cumsum(units)])
    before = ahead[:-1] - ahead[first][line]
    own = {c: t.column(c).to_numpy() for c in ("doc_id", "page", "line_no", "size", "y")}
    there = np.flatnonzero((own["line_no"][line] % 4 != 3) | (code != 32))
    code, line, pos, units, before = code[there], line[there], pos[there], units[there], before[there]
    doc, line_no, size, top = (own[c][line] for c in ("doc_id", "line_no", "size", "y"))
    small = (code >= 48) & (code <= 57) & (pos % 2 == 0)
    columns = {
        "doc_id": doc,
        "page": own["page"][line],
        "seq": line_no.astype(np.int64) % 20 * 1000000 + pos,
        "s": _odd(code, pos),
        "font": pa.DictionaryArray.from_arrays(pa.array(((pos // 6 + doc) % 7).astype(np.int32)), pa.array(FONTS)),
        "size": np.where(small, size * 0.5, size),
        "x": 57.0 + before * size / 1000.0,
        "y": top - pos % 3,
        "w": units * size / 1000.0,
    }
    return pa.table(columns)


def page_glyphs(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    """The rows of ``doc_glyphs``, without ``src_line``, page by page as they were drawn."""

    def run(t: pa.Table) -> pa.Table:
        g = glyphs_of_lines(t.sort_by("line_no"))
        return pa.table([c.cast(pa.string()) if pa.types.is_dictionary(c.type) else c for c in g.columns], g.column_names)

    return page_text(spark, sf_dir, marked).groupBy("doc_id", "page").applyInArrow(run, GLYPHS)


def _odd(code: np.ndarray, pos: np.ndarray) -> pa.Array:
    """Characters as texts; some spaces are others, ``f`` a ligature, ``z`` a line end, and a replacement character stands behind some ``q``."""
    is_ = lambda c, k, r: (code == ord(c)) & (pos % k == r)
    tailed = is_("q", 3, 0)
    for at, c in [(is_(" ", 11, 3), 0xA0), (is_(" ", 11, 5), 9), (is_("f", 5, 0), 0xFB01), (is_("z", 4, 0), 13)]:
        code[at] = c
    there = np.zeros(int(code.max(initial=0)) + 1, bool)
    there[code] = True
    known = np.flatnonzero(there)
    coded = (np.cumsum(there, dtype=np.int32) - 1)[code]
    coded[tailed] = len(known)
    return pa.DictionaryArray.from_arrays(pa.array(coded), pa.array([*map(chr, known.tolist()), "q\ufffd"]))


#: Up to four components of a paint by kind (1, 3 or 4 of them) and seq mod 5; the last is the grey of markers.
_QUARTERS = np.array([[(r + k) % 5 * 0.25 for k in row] for row in ((0, 0, 0, 0), (0, 1, 3, 0), (0, 2, 1, 4)) for r in range(5)] + [[0.5] * 4])


def paints_of_glyphs(t: pa.Table, marked: bool = False) -> pa.Table:
    """Glyphs of ``glyphs_of_lines`` -> the rows of ``paints`` by whole-array steps: seq, x, y, comps."""
    seq, doc = t.column("seq").to_numpy(), t.column("doc_id").to_numpy()
    marker = (seq // 1000000 % 3 == 0) & (seq % 1000000 < 12) & (doc % 3 != 0) & marked
    first, again = np.flatnonzero(marker | (seq % 4 != 3)), np.flatnonzero(seq % 50 == 0)
    s, grey = seq[first], marker[first]
    kind = np.where(grey, 0, s % 3)
    sizes = np.array([1, 3, 4])[kind]
    four = _QUARTERS[np.where(grey, 15, kind * 5 + s % 5)]
    values = np.concatenate([four[np.arange(4) < sizes[:, None]], np.full(len(again), 0.5)])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([sizes, np.ones(len(again), np.int64)]))]).astype(np.int32)
    at = np.concatenate([first, again])
    return pa.table({"seq": np.concatenate([s, seq[again] + 100000000]), "x": t.column("x").to_numpy()[at], "y": t.column("y").to_numpy()[at], "comps": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})


NO_PAINTS = pa.schema([("seq", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("comps", pa.list_(pa.float64()))]).empty_table()


def paints(glyphs: DataFrame, marked: bool = False) -> DataFrame:
    """A fill of 1, 3 or 4 components at three of four glyphs; every fiftieth is painted again.

    ``marked``: slide markers are of one grey.
    """
    s = F.col("seq")
    marker = (F.floor(s / 1000000) % 3 == 0) & (s % 1000000 < 12) & (F.col("doc_id") % 3 != 0) & F.lit(marked)
    quarter = lambda k: ((s + k) % 5).cast("double") * 0.25
    comps = F.when(s % 3 == 0, F.array(quarter(0))).when(s % 3 == 1, F.array(quarter(0), quarter(1), quarter(3))).otherwise(F.array(quarter(0), quarter(2), quarter(1), quarter(4)))
    painted = F.when(marker, F.array(F.lit(0.5))).otherwise(comps)
    paint = lambda seq, c: F.array(F.struct(seq.alias("seq"), c.alias("comps")))
    none = F.expr("cast(array() as array<struct<seq:bigint,comps:array<double>>>)")
    # both paints of a glyph in one step, so that the glyphs are derived once for them
    both = F.concat(F.when(marker | (s % 4 != 3), paint(s, painted)).otherwise(none), F.when(s % 50 == 0, paint(s + 100000000, F.array(F.lit(0.5)))).otherwise(none))
    return glyphs.select("doc_id", "page", "x", "y", F.explode(both).alias("p")).select("doc_id", "page", "p.seq", "x", "y", "p.comps")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page of every page that has a line."""
    last = F.floor((F.size(F.split("text", "\n", -1)) - 1) / 20).cast("int") + 1
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.explode(F.sequence(F.lit(1), last)).alias("page")).distinct()


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two filled boxes a page: one that covers it, dark on every second page, and a small one after it."""
    grey = F.when((F.col("doc_id") + F.col("page")) % 2 == 0, 0.25).otherwise(1.0)
    box = lambda seq, w, c: F.struct(F.lit(seq).alias("seq"), F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(w).alias("max_x"), F.lit(842.0).alias("max_y"), F.array(c).alias("comps"))
    return _pages(spark, sf_dir).select("doc_id", "page", F.explode(F.array(box(1, 595.0, grey), box(2, 100.0, F.lit(0.75)))).alias("f")).select("doc_id", "page", "f.*")


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(595.0).alias("x1"), F.lit(842.0).alias("y1"))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("token"), "ts")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touches of review sessions: each event twice, the second seven hours later for every third; every fifth opens, and so does every token's first."""
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("token"), F.col("ts").cast("timestamp").alias("ts"))
    w = W.partitionBy("token").orderBy("ts", "event_id")
    once = e.select("token", "ts", ((F.col("event_id") % 5 == 0) | (F.row_number().over(w) == 1)).alias("opens"))
    again = e.where("event_id % 3 = 0").select("token", (F.col("ts") + F.expr("interval 7 hours")).alias("ts"), F.lit(False).alias("opens"))
    return once.unionByName(again)


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where("doc_id % 5 = 0")
    return d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(100000))).alias("idx"))


def styles(spark: SparkSession) -> DataFrame:
    """A few style profiles, some with gaps to fill."""
    rows = [
        ("Plain", "prompts", ["body"], "#FFFFFF", "#FFFF00", True, True, 5),
        ("Loud", "prompts", ["body"], "#FAE333", "#FF0000", False, True, 0),
        ("Quiet", "prompts", ["body"], "  ", None, None, None, None),
        ("Deck", "slides", ["title", "point", "keyword", "scripture"], "#FFFFFF", "", None, False, 4),
        ("Torn", "slides", ["title", "point"], "", "#00FF00", True, True, -1),
        ("bad/name", "slides", [], None, None, None, None, None),
    ]
    from ..schemas import STYLES

    return spark.createDataFrame(rows, STYLES)


def looks(spark: SparkSession) -> DataFrame:
    rows = [("Deck", "title", "u1", "Title L3"), ("Deck", "keyword", "u1", "Title L3"), ("Deck", "point", "u2", "Points L3"), ("Deck", "scripture", "", "Verse L3"), ("Deck", "backto", "u4", "Default"), ("Torn", "title", "u5", "Other")]
    return spark.createDataFrame(rows, "style string, role string, uuid string, look_name string")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion job for each document, with gaps to fill."""
    i = F.col("doc_id")
    names = F.array(*map(F.lit, ("Plain", "Deck", "Loud", "Torn", "None")))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.when(i % 3 == 0, "").when(i % 3 == 1, "pdf").otherwise("style").alias("colors"),
        (i % 4 - 1).cast("int").alias("max_lines"),
        F.when(i % 5 == 0, " ").otherwise(F.concat_ws(" ", "source", "lang")).alias("name"),
        F.when(i % 2 == 0, 1440.0).otherwise(0.0).alias("box_width"),
        F.lit(50.0).alias("box_size"),
        F.when(i % 2 == 0, "prompts").otherwise("slides").alias("mode"),
        F.element_at(names, (i % 5 + 1).cast("int")).alias("style"),
    )

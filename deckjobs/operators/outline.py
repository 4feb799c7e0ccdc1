"""Labelled outlines: lines of a document -> entries (titles, points, scriptures, images, back-references).

Input rows are (doc_id, line_no, line). One shuffle by document serves the whole chain: a
label test per line, a running count of labels (the island a line belongs to), and one
aggregate per island. Documents are independent, so nothing here is wider than a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import capitalize_label, clean_verse, trim_spaces, truncate_text, unquote
from ..sources.shared import divided
from .scans import preceding, running



def trim_blank_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", trim_spaces(F.col("line"))).where("line <> ''")


def line_kind(line: Column) -> Column:
    """Which label a line is, in the order in which labels are tried; null for none."""
    caps = line.rlike(P.CAPS) & ~F.regexp_extract(line, P.CAPS, 1).isin(*P.CAPS_EXCLUDED)
    tests = [("title", line.rlike(P.TITLE)), ("image", line.rlike(P.IMAGE)), ("quote", line.rlike(P.QUOTE)), ("backto", line.rlike(P.BACK_TO) | line.rlike(P.BACK_TO_SHORT)), ("point", line.rlike(P.POINT)), ("marker", line.rlike(P.MARKER)), ("scripture", line.rlike(P.SCRIPTURE)), ("caps", caps)]
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def is_label_line(lines: DataFrame) -> DataFrame:
    return lines.withColumn("is_label", line_kind(F.col("line")).isNotNull())


def scripture_ref(line: Column) -> Column:
    """``Book verses VERSION`` of a reference line."""
    book, verses, version = (F.regexp_extract(line, P.SCRIPTURE, i) for i in (1, 2, 3))
    return F.concat(F.trim(book), F.lit(" "), F.regexp_replace(verses, r"\s+", ""), F.when(version != "", F.concat(F.lit(" "), F.upper(version))).otherwise(""))


def scripture_marker(lines: DataFrame, block: int | None = None) -> DataFrame:
    """Kinds of lines; the line after a bare ``Scripture:`` is ``forced``, a reference whatever it looks like, and bare lines go."""
    marker = F.coalesce(F.col("kind") == "marker", F.lit(False))
    x = preceding(lines.withColumn("kind", line_kind(F.col("line"))), ["line_no"], {"_m": marker}, block)
    x = x.withColumn("forced", F.coalesce("_m", F.lit(False)) & ~marker).drop("_m")
    return x.withColumn("starts", (F.col("kind").isNotNull() & ~marker) | F.col("forced"))


def outline_islands(lines: DataFrame, block: int | None = None) -> DataFrame:
    """Lines with the label they belong to (``island``, from 1); lines before the first label and bare markers are gone.

    ``block`` (lines) spreads a document over tasks, see ``scans``.
    """
    x = running(scripture_marker(trim_blank_lines(lines), block), ["line_no"], {"island": F.col("starts").cast("int")}, block)
    return x.where((F.col("island") > 0) & (F.coalesce(F.col("kind"), F.lit("")) != "marker"))


def image_island(islands: DataFrame) -> DataFrame:
    """Adds ``taken``: whether a line that follows an image label still belongs to its text, an open quotation."""
    own = W.partitionBy("doc_id", "island").orderBy("line_no")
    said = F.when(F.col("starts"), F.regexp_extract("line", P.IMAGE, 1)).otherwise(F.col("line"))
    count = lambda c: F.length(said) - F.length(F.replace(said, F.lit(c), F.lit("")))
    x = islands.withColumn("_open", F.sum(count("“") - count("”")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    least = F.min("_open").over(own.rowsBetween(W.unboundedPreceding, -1))
    first = F.first(F.when(F.col("forced"), "forced").otherwise(F.col("kind"))).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return x.withColumn("island_kind", first).withColumn("taken", F.col("starts") | (F.col("island_kind") != "image") | (least > 0)).drop("_open")


def entries(lines: DataFrame, block: int | None = None) -> DataFrame:
    """doc_id, pos, kind, text, label, reference, verse, ref, trigger: one row for each label, in order of ``pos``."""
    x = image_island(outline_islands(lines, block))
    follows = ~F.col("starts") & F.col("taken") & ((F.col("island_kind") == "image") | ~F.col("line").rlike(P.VERSE_NUMBER))
    g = x.groupBy("doc_id", "island").agg(
        F.min("line_no").alias("pos"),
        F.max(F.when(F.col("starts"), F.col("line"))).alias("head"),
        F.max("island_kind").alias("k"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(follows, F.struct("line_no", "line")))), lambda r: r["line"]), " ").alias("extra"),
    )
    h, extra, k = F.col("head"), F.col("extra"), F.col("k")
    with_extra = lambda c: trim_spaces(F.concat(c, F.lit(" "), extra))
    long = h.rlike(P.BACK_TO)
    ref = trim_spaces(F.when(long, F.regexp_extract(h, P.BACK_TO, 1)).otherwise(F.regexp_extract(h, P.BACK_TO_SHORT, 1)))
    told = F.when(long, F.regexp_extract(h, P.BACK_TO, 2)).otherwise(F.regexp_extract(h, P.BACK_TO_SHORT, 2))
    point = F.concat(F.regexp_extract(h, P.POINT, 3), F.regexp_extract(h, P.POINT, 4))
    number = F.regexp_extract(h, P.CAPS, 2)
    text = (
        F.when(k == "title", with_extra(F.regexp_extract(h, P.TITLE, 1)))
        .when(k == "image", F.when(extra != "", with_extra(F.regexp_extract(h, P.IMAGE, 1))).otherwise(F.regexp_extract(h, P.IMAGE, 1)))
        .when(k == "point", with_extra(point))
        .when(k == "caps", with_extra(F.regexp_extract(h, P.CAPS, 3)))
    )
    label = F.when(k == "point", F.concat(capitalize_label(F.replace(F.regexp_extract(h, P.POINT, 1), F.lit(" "), F.lit(""))), F.lit(" "), F.regexp_extract(h, P.POINT, 2))).when(
        k == "caps", F.concat(capitalize_label(F.regexp_extract(h, P.CAPS, 1)), F.when(number != "", F.concat(F.lit(" "), number)).otherwise(""))
    )
    reference = F.when(k == "quote", F.regexp_extract(h, P.QUOTE, 1)).when(k == "scripture", scripture_ref(h)).when(k == "forced", F.when(h.rlike(P.SCRIPTURE), scripture_ref(h)).otherwise(F.regexp_replace(h, r"\s+", " ")))
    verse = F.when(k == "quote", clean_verse(with_extra(F.regexp_extract(h, P.QUOTE, 2)))).when(k.isin("scripture", "forced"), clean_verse(extra))
    kind = F.when(k.isin("quote", "forced"), "scripture").when(k == "caps", "point").otherwise(k)
    return g.select(
        "doc_id",
        "pos",
        kind.alias("kind"),
        text.alias("text"),
        label.alias("label"),
        reference.alias("reference"),
        verse.alias("verse"),
        F.when(k == "backto", F.when(F.lower(ref) == "title", "Title").otherwise(ref)).alias("ref"),
        F.when(k == "backto", unquote(with_extra(told))).alias("trigger"),
    )


def unrecognized(lines: DataFrame) -> DataFrame:
    """Lines that follow an image label and are not part of its text."""
    return image_island(outline_islands(lines)).where("not taken").select("doc_id", F.col("line_no").alias("pos"), "line")


def entry_key(kind: Column, label: Column, reference: Column) -> Column:
    """What a later ``Back to`` calls an entry by; null for entries that cannot be called."""
    return F.when(kind == "title", "title").when(kind == "point", F.lower(label)).when(kind == "scripture", F.lower(reference))


def backto_asof(found: DataFrame) -> DataFrame:
    """Entries with ``source_pos``: for a back-reference, the latest earlier entry of its name, else null.

    A window over (document, name) in order of position; copies never count as sources.
    """
    key = F.coalesce(entry_key(F.col("kind"), F.col("label"), F.col("reference")), F.lower("ref"))
    w = W.partitionBy("doc_id", "_key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    source = F.last(F.when(F.col("kind") != "backto", F.col("pos")), ignorenulls=True).over(w)
    return found.withColumn("_key", key).withColumn("source_pos", F.when(F.col("kind") == "backto", source)).drop("_key")


def backto_unresolved(found: DataFrame) -> DataFrame:
    return backto_asof(found).where("kind = 'backto' and source_pos is null").select("doc_id", "pos", F.concat(F.lit("Back to "), F.col("ref")).alias("warning"))


def role_for_point(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.startswith("point") | low.startswith("subpoint"), "point").otherwise("keyword")


def review_rows(found: DataFrame) -> DataFrame:
    """doc_id, idx (from 0), kind, text, image: what a reviewer sees of each entry."""
    k = F.col("kind")
    shown = F.when(k == "title", "Title").when(k == "point", F.col("label")).when(k == "scripture", "Scripture").when(k == "image", "Image (add manually)").otherwise(F.concat(F.lit("Back to "), F.col("ref")))
    text = F.when(k == "scripture", F.concat(F.col("reference"), F.lit(": "), truncate_text(F.col("verse"), 100))).when(k == "backto", F.when(F.col("trigger") == "", "(same slide again)").otherwise(F.col("trigger"))).otherwise(F.col("text"))
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return found.select("doc_id", idx.alias("idx"), shown.alias("kind"), text.alias("text"), (k == "image").alias("image"))


def prompt_review_rows(slides: DataFrame) -> DataFrame:
    """slides(doc_id, slide_no, text) -> doc_id, idx (from 0), kind ('Slide N'), text (its first 160 characters), image."""
    kind = F.concat(F.lit("Slide "), F.col("slide_no").cast("string"))
    return slides.select("doc_id", (F.col("slide_no") - 1).cast("int").alias("idx"), kind.alias("kind"), truncate_text(F.col("text"), 160).alias("text"), F.lit(False).alias("image"))


def remove_slides(slides: DataFrame, removals: DataFrame) -> DataFrame:
    """Slides (or runs of slides) without those whose (doc_id, idx) is asked to go, numbered anew; idx counts from 0."""
    left = slides.join(removals.select("doc_id", (F.col("idx") + 1).alias("slide_no")).distinct(), ["doc_id", "slide_no"], "left_anti")
    return left.withColumn("slide_no", F.dense_rank().over(W.partitionBy("doc_id").orderBy("slide_no")))


def remove_rows(rows: DataFrame, removals: DataFrame) -> DataFrame:
    """Rows whose (doc_id, idx) is not asked to go, numbered anew; indexes that do not exist are ignored."""
    left = rows.join(removals.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti")
    return left.withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("idx")) - 1)


def corpus_profile(found: DataFrame) -> DataFrame:
    """Per document: entries, and how many there are of each kind."""
    count = lambda k: F.sum((F.col("kind") == k).cast("int")).alias(f"n_{k}")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_entries"), *(count(k) for k in ("title", "point", "scripture", "image", "backto")))


def freeform_note(max_lines: Column) -> Column:
    """What a document is told whose slides were found by layout."""
    return F.format_string("no slide markers: split by layout, to about %d lines a slide", max_lines)


def doc_warnings(lines: DataFrame, found: DataFrame, freeform: DataFrame | None = None) -> DataFrame:
    """Per document: unrecognised lines and unresolved back-references, each joined by ``; `` (null if none), and skipped images.

    ``freeform`` (doc_id, max_lines) are documents cut by layout; with it there is a column ``note``.
    """
    def joined(df: DataFrame, c: str, name: str) -> DataFrame:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda r: r[c])
        return df.groupBy("doc_id").agg(F.array_join(ordered, "; ").alias(name))

    images = found.where("kind = 'image'")
    out = joined(unrecognized(lines), "line", "unrecognized")
    more = [joined(backto_unresolved(found), "warning", "unresolved"), joined(images, "text", "skipped_images")]
    if freeform is not None:
        more.append(freeform.select("doc_id", freeform_note(F.col("max_lines")).alias("note")))
    for p in more:
        out = out.join(p, "doc_id", "full")
    return out


def tagged(docs: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id",), reason: Column | None = None) -> DataFrame:
    """Rows with ``reason``: null where ``found`` has a row of the same keys, else why there is none; one join, each input read once."""
    have = found.select(*keys).distinct().withColumn("_there", F.lit(True))
    empty = F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*$") if reason is None else None
    why = reason if reason is not None else F.when(empty, "no text found").otherwise("no labels found")
    return docs.join(have, list(keys), "left").withColumn("reason", F.when(F.col("_there").isNull(), why)).drop("_there")


def quarantine(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): documents with entries, and the others with the reason; parted as they are written, in one run."""
    good, bad = divided(tagged(docs, found), "quarantine")
    return good, bad.select("doc_id", "reason")


def page_quarantine(pages: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): pages (doc_id, page, ...) that have a line, and the others with the reason; parted as they are written."""
    good, bad = divided(tagged(pages, lines, ("doc_id", "page"), F.lit("no text on this page")), "pages")
    return good, bad.select("doc_id", "page", "reason")

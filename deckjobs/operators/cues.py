"""Entries -> cues: expansion, numbering, geometry, and one presentation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import collapse_ws, truncate_text, utf16_length
from .outline import backto_asof, role_for_point
from .scans import running
from .styles import BACKTO

LINE_HEIGHT, PADDING = 1.15, 15.0
# fixed values: label colours of cues whose template has none
TEXT_LABEL, OTHER_LABEL = "#FF0000", "#FFFFFF"
#: What geometry may leave out of a text box, with what is then meant; the reference box of scriptures has the same with ``ref_`` before.
TYPE = {"font_name": "'Arial-BoldMT'", "font_size": "90.0D", "bold": "true", "italic": "false", "line_height_multiple": "0.0D", "paragraph_spacing": "0.0D", "box_w": "1920.0D"}
ATTRIBUTES = "array<struct<start: int, end: int, capitalization: string>>"


def with_types(geometry: DataFrame) -> DataFrame:
    """Geometry with every column of a type, of the reference box, of the label and of ranged attributes, absent ones by default."""
    rest = {**TYPE, **{f"ref_{c}": d for c, d in TYPE.items()}, "label_alpha": "0.0D", "label_rgb": "cast(null as string)", "attributes": f"cast(array() as {ATTRIBUTES})"}
    return geometry.withColumns({c: F.expr(d) for c, d in rest.items() if c not in geometry.columns})


def type_columns(prefix: str = "") -> dict[str, Column]:
    """A text box's columns by the names that rich text has for them."""
    names = {"font_name": "font_name", "size": "font_size", "bold": "bold", "italic": "italic", "line_height": "line_height_multiple", "spacing": "paragraph_spacing", "box_width": "box_w"}
    return {k: F.col(prefix + c) for k, c in names.items()}


def text_box(geometry: DataFrame) -> DataFrame:
    """Usable width, font size and forced capitals of each role's text box (caps and force_caps_off of its style)."""
    caps = ~F.col("force_caps_off") & (F.col("caps") == "ALL_CAPS")
    return geometry.select("style", "role", (F.col("box_w") - F.col("margin_l") - F.col("margin_r")).alias("width"), F.col("font_size").alias("font_size"), caps.alias("all_caps"))


def verse_parts(found: DataFrame, boxes: DataFrame, most: Column) -> DataFrame:
    """found(doc_id, pos, style, verse) x boxes(style, width, font_size, all_caps) -> doc_id, pos, part_no, verse.

    Without a box the verse stays as it is. Equal verses of one style are split once.
    """
    x = found.join(boxes.select("style", "width", "font_size", "all_caps"), "style", "left").withColumn("most", most)
    distinct = x.where("width is not null").select("verse", "width", "font_size", "all_caps", "most").distinct()
    cut = distinct.withColumn("parts", metrics.split_verse("verse", "width", "font_size", "all_caps", "most"))
    y = x.join(cut, ["verse", "width", "font_size", "all_caps", "most"], "left").withColumn("parts", F.coalesce("parts", F.array(F.coalesce("verse", F.lit("")))))
    return y.select("doc_id", "pos", F.posexplode("parts").alias("part_no", "verse"))


def cue_expand(found: DataFrame, parts: DataFrame | None = None, default_copies: bool = False, disable_copies: bool = False) -> DataFrame:
    """Entries -> doc_id, pos, part_no, copy_no, role, look_role, name, reference, text, source_pos, enabled.

    Titles and points give a cue (and a copy after it, if asked for), scriptures one for
    each part, images none, back-references a copy of the first cue of what they name.
    ``parts`` are (doc_id, pos, part_no, verse); without it a verse is one part.
    """
    x = backto_asof(found)
    role = F.when(F.col("kind") == "title", "title").when(F.col("kind") == "scripture", "scripture").otherwise(role_for_point(F.col("label")))
    name = F.when(F.col("kind") == "title", "Title").when(F.col("kind") == "scripture", F.col("reference")).otherwise(F.col("label"))
    own = x.where("kind in ('title', 'point', 'scripture')").select("doc_id", "pos", "kind", role.alias("role"), name.alias("name"), F.when(F.col("kind") == "scripture", F.col("reference")).alias("reference"), F.col("text").alias("t"), "verse")
    if parts is None:
        whole = own.withColumn("part_no", F.lit(0)).withColumn("body", F.coalesce("t", "verse"))
    else:
        whole = own.join(parts.withColumnRenamed("verse", "part_text"), ["doc_id", "pos"], "left").withColumn("part_no", F.coalesce("part_no", F.lit(0))).withColumn("body", F.coalesce("t", "part_text", "verse"))
    copies = F.when(F.lit(default_copies) & (F.col("kind") != "scripture"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = whole.withColumn("copy_no", F.explode(copies))
    made = made.select("doc_id", "pos", "part_no", "copy_no", "role", F.when(F.col("copy_no") == 1, BACKTO).otherwise(F.col("role")).alias("look_role"), "name", "reference", F.col("body").alias("text"), F.lit(None).cast("int").alias("source_pos"), ((F.col("copy_no") == 0) | F.lit(not disable_copies)).alias("enabled"))
    back = x.where("kind = 'backto' and source_pos is not null").select("doc_id", "pos", "source_pos", "trigger", "ref")
    first = whole.where("part_no = 0").select("doc_id", F.col("pos").alias("source_pos"), "role", "reference", "body")
    again = back.join(first, ["doc_id", "source_pos"]).select("doc_id", "pos", F.lit(0).alias("part_no"), F.lit(0).alias("copy_no"), "role", F.lit(BACKTO).alias("look_role"), F.when(F.col("trigger") != "", F.col("trigger")).otherwise(F.concat(F.lit("Back to "), F.col("ref"))).alias("name"), "reference", F.col("body").alias("text"), "source_pos", F.lit(True).alias("enabled"))
    return made.unionByName(again)


def cue_numbering(cues: DataFrame, block: int | None = None) -> DataFrame:
    """Adds ``cue_no`` (from 1) and a stable ``cue_id``; ``block`` (positions) spreads a document over tasks, see ``scans``."""
    n = running(cues, ["pos", "part_no", "copy_no"], {"cue_no": F.lit(1)}, block)
    return n.withColumn("cue_no", F.col("cue_no").cast("int")).withColumn("cue_id", F.sha2(F.concat_ws("|", F.col("doc_id"), F.col("cue_no")), 256))


def label_color(alpha: Column, color: Column, fallback: str) -> Column:
    return F.when(F.coalesce(alpha, F.lit(0.0)) > 0, color).otherwise(F.lit(fallback))


def fit_custom_attributes(attributes: Column, text: Column) -> Column:
    """Attributes that cover the template's whole text and set capitals, stretched over ``text``.

    attributes: array of (start, end, capitalization); the whole is the greatest end from 0.
    """
    full = F.array_max(F.transform(F.filter(attributes, lambda a: a["start"] == 0), lambda a: a["end"]))
    kept = F.filter(attributes, lambda a: (a["start"] == 0) & (a["end"] == full) & (a["capitalization"] != "NONE"))
    return F.transform(kept, lambda a: F.struct(a["start"].alias("start"), utf16_length(text).alias("end"), a["capitalization"].alias("capitalization")))


def center_vertically(cues: DataFrame) -> DataFrame:
    """Cues with verse_lines and the geometry of the verse and reference boxes -> verse_y, verse_h, ref_y.

    The verse box is as high as its lines need, up to what the slide leaves; above the
    reference it keeps its lower edge; then the pair is centred.
    """
    multiple = F.when(F.col("line_height_multiple") > 0, F.col("line_height_multiple")).otherwise(1.0)
    need = F.col("verse_lines") * F.col("font_size") * LINE_HEIGHT * multiple + F.col("margin_t") + F.col("margin_b") + PADDING
    x = cues.withColumn("new_h", F.least(need, F.col("slide_h") - F.col("ref_h")))
    above = F.col("box_y") < F.col("ref_y0")
    x = x.withColumn("new_y", F.when(above, F.col("box_y") + F.col("box_h") - F.col("new_h")).otherwise(F.col("box_y")))
    top = F.least("new_y", "ref_y0")
    bottom = F.greatest(F.col("new_y") + F.col("new_h"), F.col("ref_y0") + F.col("ref_h"))
    x = x.withColumn("dy", (F.col("slide_h") - (bottom - top)) / 2 - top)
    return x.withColumns({"verse_y": F.col("new_y") + F.col("dy"), "verse_h": F.col("new_h"), "ref_y": F.col("ref_y0") + F.col("dy")}).drop("new_h", "new_y", "dy")


#: Columns of a cue in a presentation, those that there are.
CUE = ("cue_no", "cue_id", "pos", "part_no", "copy_no", "role", "look_role", "name", "label", "label_color", "text", "texts", "rtf", "attributes", "look_uuid", "look_name", "n_actions", "enabled", "verse_y", "verse_h", "ref_y")


def presentations(cues: DataFrame, names: DataFrame) -> DataFrame:
    """One row per document: name and its cues in order (ids, and the cues themselves)."""
    item = F.struct(*(c for c in CUE if c in cues.columns))
    g = cues.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("cues"))
    return g.join(names, "doc_id", "left").select("doc_id", "name", F.transform("cues", lambda c: c["cue_id"]).alias("cue_ids"), "cues")


def src_cues(decks: DataFrame) -> DataFrame:
    """Cues of presentations as rows, idx from 0."""
    return decks.select("doc_id", F.posexplode("cues").alias("idx", "c")).select("doc_id", "idx", "c.*")


def cue_preview(cues: DataFrame) -> DataFrame:
    """cues(doc_id, idx, elements array of text) with ``preview`` and ``n_elements``."""
    said = F.filter(F.transform("elements", collapse_ws), lambda t: t != "")
    text = F.when(F.size(said) > 0, truncate_text(F.array_join(said, " | "), 120)).otherwise("(no text)")
    return cues.select("doc_id", "idx", text.alias("preview"), F.size("elements").alias("n_elements"))


def first_per_group(actions: DataFrame) -> DataFrame:
    """actions(doc_id, idx, actions array of (kind, value)): first slide and first look of each cue."""
    first = lambda k: F.get(F.filter("actions", lambda a: a["kind"] == k), F.lit(0))["value"]
    return actions.select("doc_id", "idx", first("slide").alias("slide"), first("look").alias("look"))

"""The three workloads from end to end: glyphs or lines to presentations.

Tables that several later steps read (jobs, lines, entries, cues) are written to shared
storage once instead of being worked out anew for each; all else is left to the plan. Every
document of a corpus comes out once: with its cues, or among the refused with the reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import wrap_lines
from ..functions.text import collapse_ws
from ..operators import cues, freeform, glyphs, outline, rtf, sections, styles
from ..sources.shared import written


class Decks(NamedTuple):
    """Styled cues; documents that cannot be built, with the reason; warnings per document; names of the presentations."""

    cues: DataFrame
    refused: DataFrame
    warnings: DataFrame
    names: DataFrame

    def presentations(self) -> DataFrame:
        """One row a document that was made: its name, and its cues in order, none if it had only images."""
        made = cues.presentations(self.cues, self.names.limit(0)).drop("name")
        none = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in made.schema.fields if f.name != "doc_id"}
        return self.names.join(made, "doc_id", "left").withColumns(none)


def _each_once(reasons: DataFrame) -> DataFrame:
    """One reason for a document: the first by ``step``."""
    return reasons.groupBy("doc_id").agg(F.min_by("reason", "step").alias("reason"))


def _reason(df: DataFrame, step: int, reason: Column | str) -> DataFrame:
    return df.select("doc_id", F.lit(step).alias("step"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _names(job: DataFrame, refused: DataFrame) -> DataFrame:
    return styles.job_defaults(job).join(refused.select("doc_id"), "doc_id", "left_anti").select("doc_id", "name")


def prompt_lines(page_glyphs: DataFrame, paints: DataFrame, fills: DataFrame, boxes: DataFrame) -> DataFrame:
    """Glyphs -> lines of formatted runs: weight and slant by font, colour and highlight by ink and page; raised digits stay."""
    clean = glyphs.font_flags(glyphs.glyph_clean(page_glyphs))
    return glyphs.page_lines(clean, paints, glyphs.page_background(fills, boxes), drop_superscripts=False)


def outline_lines(page_glyphs: DataFrame) -> DataFrame:
    """Glyphs -> doc_id, line_no (from 0, over all pages), line: an outline's lines, raised digits dropped, formats ignored."""
    plain = glyphs.glyph_clean(page_glyphs).withColumns({"bold": F.lit(False), "italic": F.lit(False), "color": F.lit(""), "highlight": F.lit(False)})
    lines = glyphs.lines_of(plain)
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "line_no")) - 1
    return lines.select("doc_id", at.alias("line_no"), F.col("text").alias("line"))


def outline_decks(lines: DataFrame, jobs: DataFrame, style_table: DataFrame, geometry: DataFrame, looks: DataFrame, default_copies: bool = False, disable_copies: bool = False, center_scriptures: bool = False, docs: DataFrame | None = None, removals: DataFrame | None = None) -> Decks:
    """Labelled outlines -> numbered, styled cues with the rich text of each of their text boxes.

    lines(doc_id, line_no, line), of glyphs by ``outline_lines``; jobs as in
    ``styles.checked_jobs``; geometry(style, role, force_caps_off, caps, boxes, and what
    ``cues.with_types`` fills in); looks(style, role, uuid, look_name); docs are all documents
    (those that have lines by default). Long verses are split to the scripture box of the
    style, at most as many lines as the style says; back-references copy the first part. A
    scripture has two texts, its reference and its verse. ``removals`` (doc_id, idx) are
    entries that a reviewer took out. A document whose job does not fit its style, that has
    no entry, a cue whose role has no template, or was asked for copies whose style has no
    look for them, is refused as a whole.
    """
    job = written(styles.checked_jobs(docs if docs is not None else lines, jobs, style_table, "slides"), "jobs")
    of = job.where("reason is null").select("doc_id", "style")
    read = lines.join(of.select("doc_id"), "doc_id", "left_semi")
    found = outline.entries(read)
    if removals is not None:
        idx = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
        found = found.withColumn("idx", idx).join(removals.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti").drop("idx")
    found = written(found, "entries")
    settings = styles.settings_defaults(style_table).withColumnRenamed("name", "style")
    boxes = cues.text_box(geometry)
    full = cues.with_types(geometry)
    verses = found.where("kind = 'scripture'").join(of, "doc_id").join(settings.select("style", "scripture_max_lines"), "style", "left")
    parts = cues.verse_parts(verses, boxes.where("role = 'scripture'"), F.coalesce("scripture_max_lines", F.lit(5)))
    made = cues.cue_numbering(cues.cue_expand(found, parts, default_copies, disable_copies)).join(of, "doc_id")
    shown = styles.role_look_join(made, looks).join(boxes.select("style", "role", "all_caps", F.lit(True).alias("_known")), ["style", "role"], "left")
    shown = shown.join(full.drop("force_caps_off", "caps"), ["style", "role"], "left").join(settings.select("style", "regular_color"), "style", "left")
    scripture = F.col("role") == "scripture"
    font, over = cues.type_columns(), cues.type_columns("ref_")
    own, reference = rtf.plain_rtf(F.col("text"), F.col("regular_color"), font), rtf.plain_rtf(F.col("reference"), F.col("regular_color"), over)
    fit = lambda c: cues.fit_custom_attributes(F.col("attributes"), F.col(c))
    label = cues.label_color(F.col("label_alpha"), F.col("label_rgb"), cues.TEXT_LABEL)
    other = cues.label_color(F.col("label_alpha"), F.col("label_rgb"), cues.OTHER_LABEL)
    if center_scriptures:
        fits = (F.col("slide_h") > 0) & (F.col("box_w") - F.col("margin_l") - F.col("margin_r") > 0) & (F.col("font_size") > 0)
        known = {"verse_lines": wrap_lines("text", F.col("box_w") - F.col("margin_l") - F.col("margin_r"), "font_size", "all_caps")}
        placed = cues.center_vertically(shown.withColumns(known))
        shown = placed.withColumns({c: F.when(scripture & fits, F.col(c)) for c in ("verse_y", "verse_h", "ref_y")})
    both = {
        "texts": F.when(scripture, F.array("reference", "text")).otherwise(F.array("text")),
        "rtf": F.when(scripture, F.array(reference, own)).otherwise(F.array(own)),
        "attributes": F.when(scripture, F.array(fit("reference"), fit("text"))).otherwise(F.array(fit("text"))),
        "label": F.col("name"),
        "label_color": F.when(scripture, other).otherwise(label),
    }
    kept = [c for c in cues.CUE if c in {*shown.columns, *both}]
    styled = written(shown.withColumns(both).select("doc_id", "style", "source_pos", "_known", *kept), "cues")
    bare = styled.where("_known is null").groupBy("doc_id").agg(F.concat(F.lit("no template for: "), F.array_join(F.sort_array(F.collect_set("role")), ", ")).alias("why"))
    bad = styled.where(F.exists("rtf", lambda t: t.isNull()) & F.col("_known")).select("doc_id").distinct()
    empty = of.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    reasons = _reason(job.where("reason is not null"), 0, F.col("reason")).unionByName(_reason(empty, 1, "no labels found")).unionByName(_reason(bare, 3, F.col("why"))).unionByName(_reason(bad, 4, "a colour of the style is none"))
    if default_copies:
        with_copies = looks.where(f"role = '{styles.BACKTO}' and uuid <> ''").select("style").distinct()
        reasons = reasons.unionByName(_reason(of.join(with_copies, "style", "left_anti"), 2, "no look for copies"))
    refused = written(_each_once(reasons), "refused")
    good = styled.join(refused.select("doc_id"), "doc_id", "left_anti").drop("_known")
    return Decks(good, refused, outline.doc_warnings(read, found), _names(job, refused))


def prompt_decks(page_glyphs: DataFrame, paints: DataFrame, fills: DataFrame, boxes: DataFrame, docs: DataFrame, jobs: DataFrame, style_table: DataFrame, geometry: DataFrame, marker: str = sections.MARKER, removals: DataFrame | None = None) -> Decks:
    """Glyphs -> a cue for each slide, found by markers where a document has any, else by layout (``way``).

    jobs as in ``styles.checked_jobs``: whose style, which colours (those of the source by
    default for free-form documents alone), the limit of lines, and a box. The box that text
    is cut for is the job's, else that of the style's body, else the standard one; type is
    that of the style's body. ``removals`` (doc_id, idx) are slides that a reviewer took
    out. A document without text, or whose job does not fit its style, is refused.
    """
    return decks_of_lines(prompt_lines(page_glyphs, paints, fills, boxes), docs, jobs, style_table, geometry, marker, removals)


def decks_of_lines(page_lines: DataFrame, docs: DataFrame, jobs: DataFrame, style_table: DataFrame, geometry: DataFrame, marker: str = sections.MARKER, removals: DataFrame | None = None) -> Decks:
    """``prompt_decks`` from lines of formatted runs on."""
    full = cues.with_types(geometry).where("role = 'body'")
    body = full.join(cues.text_box(geometry).select("style", "role", F.col("width").alias("_w"), "all_caps"), ["style", "role"])
    body = body.select("style", "_w", F.col("font_size").alias("_s"), "all_caps", "attributes", *(c.alias(f"type_{k}") for k, c in cues.type_columns().items()))
    settings = styles.settings_defaults(style_table).select(F.col("name").alias("style"), "regular_color", "emphasis_color", "highlight_bold", "force_caps_off")
    checked = styles.checked_jobs(docs, jobs, style_table, "prompts").join(settings, "style", "left").join(body, "style", "left")
    own = (F.col("box_width") > 0) & (F.col("box_size") > 0)
    boxed = checked.withColumns({"box_width": F.when(own, F.col("box_width")).otherwise(F.col("_w")), "box_size": F.when(own, F.col("box_size")).otherwise(F.col("_s"))})
    reason = F.coalesce("reason", F.when(F.col("type_font_name").isNull(), "no template for: body"))
    job = written(styles.job_defaults(boxed).withColumns({"reason": reason, "all_caps": F.coalesce("all_caps", F.lit(False))}).drop("_w", "_s"), "jobs")
    of = job.where("reason is null").drop("reason", "mode", "name")
    lines = written(page_lines.join(of.select("doc_id"), "doc_id", "left_semi"), "lines")
    runs = lines.select("doc_id", "page", "line_no", F.posexplode("runs").alias("run_no", "r")).select("doc_id", "page", "line_no", "run_no", "r.*")
    scripted = sections.slides(runs, marker)
    rest = sections.marker_fallback(of, scripted)
    free = lines.join(of.select("doc_id", *freeform.JOB), "doc_id").join(rest, "doc_id", "left_semi")
    both = sections.prompts_union(scripted.drop("section"), freeform.slide_runs(freeform.freeform_slides(free)))
    if removals is not None:
        both = outline.remove_slides(both, removals)
    x = both.join(of.drop(*freeform.JOB), "doc_id").withColumn("keep_colors", styles.pdf_colors_policy(F.col("colors"), F.col("way") == "freeform"))
    made = written(rtf.rich_text(x, ("way", "style", "force_caps_off", "attributes")), "slides")
    bad = made.where("rtf is null").select("doc_id").distinct()
    empty = of.join(made.select("doc_id").distinct(), "doc_id", "left_anti")
    reasons = _reason(job.where("reason is not null"), 0, F.col("reason")).unionByName(_reason(empty, 1, "no text found")).unionByName(_reason(bad, 2, "a colour of the style or page is none"))
    refused = written(_each_once(reasons), "refused")
    fit = F.when(F.col("force_caps_off"), F.expr(f"cast(array() as {cues.ATTRIBUTES})")).otherwise(cues.fit_custom_attributes(F.col("attributes"), collapse_ws(F.col("text"))))
    numbered = made.join(refused.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id",
        "way",
        "style",
        F.col("slide_no").alias("cue_no"),
        F.sha2(F.concat_ws("|", F.col("doc_id"), F.col("slide_no")), 256).alias("cue_id"),
        F.lit("body").alias("role"),
        F.concat(F.lit("Slide "), F.col("slide_no").cast("string")).alias("name"),
        F.array("text").alias("texts"),
        F.array("rtf").alias("rtf"),
        F.array(fit).alias("attributes"),
        F.lit(True).alias("enabled"),
    )
    by_layout = made.where("way = 'freeform'").select("doc_id").distinct().join(of.select("doc_id", "max_lines"), "doc_id")
    return Decks(numbered, refused, by_layout.select("doc_id", outline.freeform_note(F.col("max_lines")).alias("note")), _names(job, refused))

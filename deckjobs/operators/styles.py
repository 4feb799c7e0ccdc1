"""Style profiles: small tables of settings, roles and looks, and the joins that use them.

Tables: styles(name, kind, roles, regular_color, emphasis_color, force_caps_off,
highlight_bold, scripture_max_lines), looks(style, role, uuid, look_name),
role_geometry(style, role, ...). They describe a few dozen styles; joins to them are left
to Spark, which broadcasts a side whose size it has found small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim_spaces, valid_style_name

# fixed values: roles that a style of each kind must have
REQUIRED = {"prompts": ["body"], "slides": ["title", "point", "keyword", "scripture"]}
BACKTO = "backto"


def required_roles(kind: Column) -> Column:
    of = lambda k: F.array(*map(F.lit, REQUIRED[k]))
    return F.when(kind == "prompts", of("prompts")).when(kind == "slides", of("slides")).otherwise(F.expr("cast(array() as array<string>)"))


def settings_defaults(styles: DataFrame) -> DataFrame:
    """Blank colours, missing switches and limits under one get their defaults; other values stay as they are."""
    blank = lambda c, d: F.when(F.coalesce(trim_spaces(F.col(c)), F.lit("")) == "", d).otherwise(F.col(c))
    return styles.withColumns(
        {
            "regular_color": blank("regular_color", "#FFFFFF"),
            "emphasis_color": blank("emphasis_color", "#FFFF00"),
            "force_caps_off": F.coalesce("force_caps_off", F.lit(True)),
            "highlight_bold": F.coalesce("highlight_bold", F.lit(True)),
            "scripture_max_lines": F.when(F.coalesce("scripture_max_lines", F.lit(0)) <= 0, 5).otherwise(F.col("scripture_max_lines")),
        }
    )


def job_defaults(jobs: DataFrame) -> DataFrame:
    """jobs(doc_id, colors, max_lines, name, box_width, box_size) with defaults for what is missing."""
    fits = F.coalesce((F.col("box_width") > 0) & (F.col("box_size") > 0), F.lit(False))
    return jobs.withColumns(
        {
            "colors": F.when(F.coalesce("colors", F.lit("")) == "", "auto").otherwise(F.col("colors")),
            "max_lines": F.when(F.coalesce("max_lines", F.lit(0)) <= 0, 7).otherwise(F.col("max_lines")),
            "name": F.when(trim_spaces(F.coalesce("name", F.lit(""))) == "", "My Message").otherwise(F.col("name")),
            "box_width": F.when(fits, F.col("box_width")).otherwise(1920.0),
            "box_size": F.when(fits, F.col("box_size")).otherwise(135.0),
        }
    )


def pdf_colors_policy(colors: Column, freeform: Column) -> Column:
    return (colors == "pdf") | ((colors != "style") & freeform)


def kind_filter(styles: DataFrame, kind: str) -> DataFrame:
    return styles.where(F.col("kind") == kind).select("name").orderBy("name")


def styles_sorted(styles: DataFrame) -> DataFrame:
    """Valid styles with their place by name, and their roles in order."""
    x = styles.where(valid_style_name(F.col("name")))
    return x.select(F.row_number().over(W.orderBy("name")).alias("place"), "name", F.array_sort("roles").alias("roles"))


def roles_sorted(styles: DataFrame) -> DataFrame:
    return styles.select("name", F.posexplode(F.array_sort("roles")).alias("place", "role"))


def missing_roles(styles: DataFrame) -> DataFrame:
    return styles.select("name", F.array_except(required_roles(F.col("kind")), F.coalesce("roles", F.expr("cast(array() as array<string>)"))).alias("missing"))


def missing_looks(styles: DataFrame, looks: DataFrame) -> DataFrame:
    """Roles (required ones and back-references) for which a style has no look."""
    have = looks.where("uuid <> ''").groupBy(F.col("style").alias("name")).agg(F.collect_set("role").alias("have"))
    x = styles.join(have, "name", "left")
    return x.select("name", F.array_except(F.concat(required_roles(F.col("kind")), F.array(F.lit(BACKTO))), F.coalesce("have", F.expr("cast(array() as array<string>)"))).alias("missing"))


def style_job_join(jobs: DataFrame, styles: DataFrame) -> DataFrame:
    """jobs(doc_id, mode, style) with ``reason`` a job cannot run, null if it can."""
    s = missing_roles(styles).join(styles, "name").select(F.col("name").alias("style"), "kind", "missing")
    x = jobs.join(s, "style", "left")
    reason = (
        F.when(F.col("kind").isNull(), "no such style")
        .when(F.col("kind") != F.col("mode"), F.concat(F.lit("style is of kind "), F.col("kind")))
        .when(F.size("missing") > 0, F.concat(F.lit("missing templates: "), F.array_join("missing", ", ")))
    )
    return x.select("doc_id", "mode", "style", reason.alias("reason"))


def checked_jobs(docs: DataFrame, jobs: DataFrame, styles: DataFrame, mode: str) -> DataFrame:
    """Every document with its job, defaults filled in, and the ``reason`` why it cannot run, null if it can.

    jobs(doc_id, style, and optionally mode, name, colors, max_lines, box_width, box_size);
    a job without a mode has the one asked for. A document without a job is refused.
    """
    known = {"mode": "string", "name": "string", "colors": "string", "max_lines": "int", "box_width": "double", "box_size": "double"}
    full = jobs.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in jobs.columns})
    full = full.withColumn("mode", F.coalesce("mode", F.lit(mode))).select("doc_id", "style", *known)
    x = docs.select("doc_id").distinct().join(full.withColumn("_job", F.lit(True)), "doc_id", "left")
    reasons = style_job_join(x.select("doc_id", "mode", "style"), styles)
    reason = F.when(F.col("_job").isNull(), "no job").when(F.col("mode") != mode, F.concat(F.lit("job is for "), F.col("mode"))).otherwise(F.col("_why"))
    y = x.join(reasons.select("doc_id", F.col("reason").alias("_why")), "doc_id", "left")
    return y.withColumn("reason", reason).drop("_job", "_why")


def role_template_join(cues: DataFrame, geometry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues with their role's geometry, cues whose role the style lacks)."""
    known = geometry.select("style", "role").distinct()
    return cues.join(geometry, ["style", "role"]), cues.join(known, ["style", "role"], "left_anti")


def role_look_join(cues: DataFrame, looks: DataFrame) -> DataFrame:
    """Cues with the look of ``look_role`` if it has an id, and two actions if so, else one."""
    have = looks.where("uuid <> ''").select("style", F.col("role").alias("look_role"), F.col("uuid").alias("look_uuid"), "look_name")
    x = cues.join(have, ["style", "look_role"], "left")
    return x.withColumn("n_actions", F.when(F.col("look_uuid").isNull(), 1).otherwise(2))


def seed_styles(defaults: DataFrame, existing: DataFrame, offered: DataFrame, offered_exists: bool, legacy: list[str]) -> DataFrame:
    """Names of default styles to add: not offered before and not there.

    Without a list of offered names, a store that has styles counts as having been offered
    the legacy ones.
    """
    spark = defaults.sparkSession
    if not offered_exists:
        old = spark.range(1).select(F.explode(F.array(*map(F.lit, legacy)) if legacy else F.expr("cast(array() as array<string>)")).alias("name"))
        offered = old.join(existing.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_semi")
    return defaults.join(offered.select("name"), "name", "left_anti").join(existing.select("name"), "name", "left_anti")


def offered_union(defaults: DataFrame, offered: DataFrame) -> DataFrame:
    return defaults.select("name").union(offered.select("name")).distinct().orderBy("name")


def pick_log(picks: DataFrame, cues: DataFrame) -> DataFrame:
    """picks(style, role, doc_id, idx, pick_seq) with what each does: ``cue``, ``look`` and the ``refused`` reason, null if it is taken.

    A pick of no cue does nothing. One of a cue without a slide gives no template, but still
    sets the role's look, or takes it away if the cue has none; one for back-references is
    about the look alone, and without one is withdrawn.
    """
    known = cues.select("doc_id", "idx", F.col("name").alias("cue"), "has_slide", F.col("look_name").alias("look"), F.lit(True).alias("_there"))
    x = picks.join(known, ["doc_id", "idx"], "left")
    back = F.col("role") == BACKTO
    said = F.concat(F.lit("slide "), (F.col("idx") + 1).cast("string"))
    reason = (
        F.when(F.col("_there").isNull(), "no such slide")
        .when(back & F.col("look").isNull(), F.concat(said, F.lit(" has no look")))
        .when(~back & ~F.col("has_slide"), F.concat(said, F.lit(" has nothing to copy")))
    )
    return x.withColumn("refused", reason)


def capture_roles(picks: DataFrame, cues: DataFrame) -> DataFrame:
    """picks(style, role, doc_id, idx, pick_seq) x cues(doc_id, idx, name, has_slide, look_name) -> style, role, doc_id, idx, cue, look_name.

    Two folds over the log of picks, each with its own last word: the template is that of
    the last pick with a slide (``doc_id``, ``idx``, ``cue``, null if there is none), the look
    that of the last pick of any cue, and gone if that cue has none. Both are greatest
    values by ``pick_seq``, so they are made up of parts. A role without a template and
    without a look is left out, as is a back-reference whose last pick was withdrawn.
    """
    x = pick_log(picks, cues).where("_there")
    back = F.col("role") == BACKTO
    template = F.max_by(F.when(back | F.col("has_slide"), F.struct("doc_id", "idx", "cue")), F.when(back | F.col("has_slide"), F.col("pick_seq")))
    folded = x.groupBy("style", "role").agg(template.alias("t"), F.max_by(F.struct("look"), "pick_seq").alias("l"))
    out = folded.select("style", "role", "t.*", F.col("l.look").alias("look_name"))
    return out.where(F.when(back, F.col("look_name").isNotNull()).otherwise(F.col("cue").isNotNull() | F.col("look_name").isNotNull()))


def refused_picks(picks: DataFrame, cues: DataFrame) -> DataFrame:
    """style, role, doc_id, idx, pick_seq, refused: picks that gave no template or were withdrawn, with the reason."""
    return pick_log(picks, cues).where("refused is not null").select("style", "role", "doc_id", "idx", "pick_seq", "refused")


def style_assemble(captured: DataFrame, forms: DataFrame, existing: DataFrame) -> DataFrame:
    """forms(style, kind, overwrite) with captured templates as a map; ``reason`` says why one is refused."""
    roles = captured.where(f"cue is not null and role <> '{BACKTO}'").groupBy("style").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "cue")))).alias("templates"))
    x = forms.join(roles, "style", "left").join(existing.select(F.col("name").alias("style"), F.lit(True).alias("there")), "style", "left")
    have = F.coalesce(F.map_keys("templates"), F.expr("cast(array() as array<string>)"))
    missing = F.array_except(required_roles(F.col("kind")), have)
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing templates: "), F.array_join(missing, ", "))).when(F.coalesce("there", F.lit(False)) & ~F.col("overwrite"), "name exists")
    return x.select("style", "kind", F.array_sort(have).alias("roles"), reason.alias("reason"))

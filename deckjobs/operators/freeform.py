"""Free-form notes: lines with geometry -> blocks by layout -> slides.

Input rows are (doc_id, page, line_no, text, x0, x1, y, size), and optionally ``runs``, the
formatted runs of the line; document order is (page, line_no). Everything about a document
is a window over its lines, and a block is one aggregate of them, so that the chain deals
the lines out once, by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics
from ..sources.shared import dealt
from .scans import preceding, running

SMALL_PRINT, HEADING, BLOCK_GAP, WIDE = 0.8, 1.2, 1.5, 0.75
MAX_LINES = 7
BOX_WIDTH, BOX_SIZE = 1920.0, 135.0
#: Columns that lines may have, the same for all of a document: its box and its limit.
JOB = ("box_width", "box_size", "all_caps", "max_lines")
FORMATS = {"bold": "boolean", "italic": "boolean", "color": "string", "highlight": "boolean"}


def _whole():
    return W.partitionBy("doc_id")


def _half() -> Column:
    return F.floor(F.col("size") * 2 + 0.5) / 2.0


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the size (to half a point) that carries most bytes of text; of equals the smaller."""
    return mode_top1(lines).select("doc_id", "body")


def mode_top1(lines: DataFrame) -> DataFrame:
    """doc_id, body, bytes: the same with its weight."""
    weight = lines.groupBy("doc_id", _half().alias("half")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    best = F.max(F.struct("bytes", (-F.col("half")).alias("minus"))).alias("b")
    return weight.groupBy("doc_id").agg(best).select("doc_id", (-F.col("b.minus")).alias("body"), F.col("b.bytes").alias("bytes"))


def drop_small_print(lines: DataFrame, spread: bool = False) -> DataFrame:
    """Lines of at least 0.8 of the body size, with ``body``; dealt out by document.

    ``spread``: the body comes of partial counts by size and is joined back, so that no
    task holds a whole document.
    """
    if spread:
        x = lines.join(body_size(lines), "doc_id")
        return x.where(F.col("size") >= SMALL_PRINT * F.col("body"))
    x = dealt(lines, "doc_id").withColumn("_half", _half())
    x = x.withColumn("_bytes", F.sum(F.octet_length("text")).over(W.partitionBy("doc_id", "_half")))
    x = x.withColumn("body", F.max_by("_half", F.struct("_bytes", -F.col("_half"))).over(_whole()))
    return x.where(F.col("size") >= SMALL_PRINT * F.col("body")).drop("_half", "_bytes")


#: Just above a quarter: the value at this share of n sorted ones is element n div 4 (from 0), for any n a document can have.
_QUARTER = "0.2500000000001D"


def lower_quartile(c: str) -> Column:
    """Element n div 4 (from 0) of the sorted values, as an aggregate: values are counted, in part before any shuffle, and only distinct ones are sorted."""
    return F.expr(f"percentile_disc({_QUARTER}) WITHIN GROUP (ORDER BY {c})")


def with_gap(kept: DataFrame, spread: bool = False) -> DataFrame:
    """Adds ``gap``: lower quartile (element n div 4) of the positive distances between lines of a page, else 1.2 sizes of the first line."""
    above = F.lag("y").over(W.partitionBy("doc_id", "page").orderBy("line_no")) - F.col("y")
    x = kept.withColumn("_g", F.when(above > 0, above))
    first = F.min_by("size", F.struct("page", "line_no"))
    if spread:
        of = x.groupBy("doc_id").agg(F.coalesce(lower_quartile("_g"), 1.2 * first).alias("gap"))
        return kept.join(of, "doc_id")
    return x.withColumn("gap", F.coalesce(F.expr(f"percentile_disc({_QUARTER}) WITHIN GROUP (ORDER BY _g) OVER (PARTITION BY doc_id)"), 1.2 * first.over(_whole()))).drop("_g")


def line_gap(kept: DataFrame) -> DataFrame:
    """doc_id, gap."""
    above = F.lag("y").over(W.partitionBy("doc_id", "page").orderBy("line_no")) - F.col("y")
    x = kept.withColumn("_g", F.when(above > 0, above))
    return x.groupBy("doc_id").agg(F.coalesce(lower_quartile("_g"), 1.2 * F.min_by("size", F.struct("page", "line_no"))).alias("gap"))


def column_width(kept: DataFrame) -> DataFrame:
    return kept.groupBy("doc_id").agg(F.max(F.col("x1") - F.col("x0")).alias("column"))


def layout_blocks(kept: DataFrame, block: int | None = None) -> DataFrame:
    """Kept lines with ``block`` (from 1): a new page, a wide gap, or a heading after other text begins one.

    ``block`` (pages) spreads a document over tasks, see ``scans``.
    """
    order = ["page", "line_no"]
    x = with_gap(kept, block is not None).withColumn("heading", F.col("size") > HEADING * F.col("body"))
    x = preceding(x, order, {"_page": "page", "_y": "y", "_heading": "heading"}, block)
    new = (F.col("page") != F.col("_page")) | (F.col("_y") - F.col("y") > BLOCK_GAP * F.col("gap")) | (F.col("heading") & ~F.col("_heading"))
    return running(x, order, {"block": F.coalesce(new, F.lit(True)).cast("int")}, block).drop("_page", "_y", "_heading")


def runs_of(lines: DataFrame) -> Column:
    """The runs of a line with their formats; of a line without runs, its words as plain ones. The first has a space before it."""
    if "runs" in lines.columns:
        given, text, formats = F.col("runs"), (lambda r: r["text"]), (lambda r: [r[c].alias(c) for c in FORMATS])
        spaced = lambda r: r["space_before"]
    else:
        plain = {"boolean": F.lit(False), "string": F.lit("")}
        given, text, formats = F.filter(F.split("text", r"[\s\x{85}\p{Z}]+"), lambda w: w != ""), (lambda w: w), (lambda w: [plain[t].alias(c) for c, t in FORMATS.items()])
        spaced = lambda w: F.lit(True)
    return F.transform(given, lambda r, i: F.struct(text(r).alias("text"), *formats(r), ((i == 0) | spaced(r)).alias("space_before")))


def gathered(blocks: DataFrame) -> DataFrame:
    """doc_id, block, runs, ends (of its lines), n, has_lower, wide, heading_only, flowing: one row a block.

    A line is wide if it fills most of the widest line; the last of a block does not count.
    A block of several lines, most of them wide, that is not all capitals is flowing text.
    """
    x = blocks.withColumn("_column", F.max(F.col("x1") - F.col("x0")).over(_whole()))
    item = F.struct("page", "line_no", runs_of(blocks).alias("runs"), (F.col("x1") - F.col("x0") >= WIDE * F.col("_column")).alias("wide"), F.col("text").rlike(r"\p{Ll}").alias("lower"), "heading")
    job = [c for c in JOB if c in blocks.columns]
    g = x.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(item)).alias("l"), *(F.first(c).alias(c) for c in job))
    of = lambda name: F.transform("l", lambda x: x[name])
    size = F.size("l")
    ends = F.aggregate(of("runs"), F.expr("cast(array() as array<int>)"), lambda acc, r: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.size(r)))
    y = g.select(
        "doc_id",
        "block",
        *job,
        F.flatten(of("runs")).alias("runs"),
        F.when(size > 0, ends).alias("ends"),
        size.cast("long").alias("n"),
        F.exists(of("lower"), lambda b: b).alias("has_lower"),
        F.size(F.filter(F.slice(of("wide"), F.lit(1), size - 1), lambda b: b)).cast("long").alias("wide"),
        F.forall(of("heading"), lambda b: b).alias("heading_only"),
    )
    return y.withColumn("flowing", (F.col("n") >= 2) & F.col("has_lower") & (3 * F.col("wide") >= 2 * (F.col("n") - 1)))


def block_stats(blocks: DataFrame) -> DataFrame:
    """doc_id, block, n, has_lower, wide, heading_only, flowing."""
    return gathered(blocks).drop("runs", "ends", *JOB)


def measure_lines(lines: DataFrame, width: float = BOX_WIDTH, size: float = BOX_SIZE) -> DataFrame:
    """doc_id, page, wrapped: lines that a page's lines take in a box."""
    x = lines.withColumn("n", metrics.wrap_lines(F.col("text"), F.lit(width), F.lit(size), F.lit(False)))
    return x.groupBy("doc_id", "page").agg(F.sum("n").cast("long").alias("wrapped"))


def sentence_units(runs: DataFrame) -> DataFrame:
    """Runs (doc_id, line_no, run_no, text, space_before) with ``unit`` (from 0) of their line's sentences."""
    w = W.partitionBy("doc_id", "line_no").orderBy("run_no")
    bare = F.regexp_replace("text", "[\"'”’)\\]]+\\z", "")
    ends = F.coalesce(F.lead("space_before").over(w), F.lit(True)) & bare.rlike("[.!?;]\\z")
    return runs.withColumn("_e", ends.cast("int")).withColumn("unit", F.coalesce(F.sum("_e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_e")


def _lists(column: pa.Array) -> list[list]:
    """Rows of an array of lists; made of all values at once, which is much cheaper than one by one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    edges = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int).tolist()
    return [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]


CUT = "struct<slides: array<array<struct<first: int, end: int>>>, need: int>"


def split_blocks(blocks: DataFrame, width: float = BOX_WIDTH, size: float = BOX_SIZE, most: int = MAX_LINES, only: str | None = None) -> DataFrame:
    """doc_id, block, flowing, heading_only, need, max_lines, slides (array of slides of lines of runs): blocks cut to at most ``most`` lines.

    A block is one row, so the cutting needs no grouping. Only texts go to Python, and ranges
    of runs come back; formats stay where they are. Blocks that are headings stay whole.
    ``need`` is the number of lines that the first slide takes. Box and limit are those of
    the document where ``blocks`` has them (``JOB``), else the ones given. ``only`` is a
    condition on ``gathered`` blocks; others are not cut.

    The cutting counts as not deterministic, so that no condition on its result is moved
    below it: a row generated from ``slides`` brings one along (``size(slides) > 0``), which
    would cut every block twice and flatten its runs anew for each line of each slide.
    """

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, spaced: pa.Array, ends: pa.Array, flowing: pa.Array, whole: pa.Array, width: pa.Array, size: pa.Array, caps: pa.Array, most: pa.Array) -> pa.Array:
        slides, lines, runs, need = [0], [0], [], []
        given = (_lists(texts), _lists(spaced), *(x.to_pylist() for x in (ends, flowing, whole, width, size, caps, most)))
        for t, s, e, f, h, w, z, c, m in zip(*given, strict=True):
            words = metrics.Words(t, s, e, metrics.Box.of(w, z, c))
            made = [words.lines] if h else metrics.split_block(words, f, m)
            for slide in made:
                runs += [words.runs(*line) for line in slide]
                lines.append(len(runs))
            slides.append(len(lines) - 1)
            need.append(sum(words.count(*line) for line in made[0]))
        spans = np.array(runs, np.int32).reshape(-1, 2)
        line = pa.StructArray.from_arrays([pa.array(spans[:, k].copy()) for k in (0, 1)], ["first", "end"])
        nested = pa.ListArray.from_arrays(pa.array(slides, pa.int32()), pa.ListArray.from_arrays(pa.array(lines, pa.int32()), line))
        return pa.StructArray.from_arrays([nested, pa.array(need, pa.int32())], ["slides", "need"])

    cut = cut.asNondeterministic()
    given = dict(zip(JOB, (F.lit(width), F.lit(size), F.lit(False), F.lit(most)), strict=True))
    box = [F.coalesce(F.col(c), given[c]) if c in blocks.columns else given[c] for c in JOB]
    of = lambda name: F.transform("runs", lambda r: r[name])
    found = gathered(blocks) if only is None else gathered(blocks).where(only)
    x = found.withColumn("_cut", cut(of("text"), of("space_before"), "ends", "flowing", F.col("heading_only") & ~F.col("flowing"), *box)).withColumn("_most", box[3])
    line = lambda at: F.transform(F.slice("runs", at["first"] + 1, at["end"] - at["first"]), lambda r, i: r.withField("space_before", (i > 0) & r["space_before"]))
    slides = F.transform(F.col("_cut.slides"), lambda slide: F.transform(slide, line))
    return x.select("doc_id", "block", "flowing", "heading_only", F.col("_cut.need").alias("need"), F.col("_most").alias("max_lines"), slides.alias("slides"))


def heading_attach(cut: DataFrame) -> DataFrame:
    """doc_id, slide_no, lines: blocks' slides in order, a lone heading set above the next block's first slide if it fits.

    A heading waits only for the next block: followed by another heading, or by nothing, it
    is a slide of its own.
    """
    w = W.partitionBy("doc_id").orderBy("block")
    x = cut.withColumn("lone", F.col("heading_only") & ~F.col("flowing"))
    before = F.lag(F.struct("lone", "need", F.element_at("slides", 1).alias("lines"))).over(w)
    x = x.withColumn("_b", before).withColumn("takes", F.coalesce(F.col("_b.lone") & ~F.col("lone") & (F.col("_b.need") + F.col("need") <= F.col("max_lines")), F.lit(False)))
    x = x.withColumn("given", F.coalesce(F.lead("takes").over(w), F.lit(False)) & F.col("lone"))
    first = F.when(F.col("takes"), F.concat(F.col("_b.lines"), F.element_at("slides", 1))).otherwise(F.element_at("slides", 1))
    all_slides = F.concat(F.array(first), F.slice("slides", 2, F.greatest(F.size("slides") - 1, F.lit(0))))
    out = x.where("not given").select("doc_id", "block", F.posexplode(all_slides).alias("part", "lines"))
    return out.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("block", "part")).alias("slide_no"), "lines")


def freeform_slides(lines: DataFrame, width: float = BOX_WIDTH, size: float = BOX_SIZE, most: int = MAX_LINES) -> DataFrame:
    return heading_attach(split_blocks(layout_blocks(drop_small_print(lines)), width, size, most))


def slide_runs(slides: DataFrame) -> DataFrame:
    """heading_attach's rows as runs: doc_id, slide_no, page (1), line_no, run_no, text, formats, space_before."""
    lines = slides.select("doc_id", "slide_no", F.posexplode("lines").alias("line_no", "r"))
    runs = lines.select("doc_id", "slide_no", F.lit(1).alias("page"), "line_no", F.posexplode("r").alias("run_no", "r"))
    return runs.select("doc_id", "slide_no", "page", "line_no", "run_no", "r.*")


def line_texts(lines: Column) -> Column:
    """Texts of a slide's lines of runs."""
    return F.transform(lines, lambda line: F.array_join(F.transform(line, lambda r, i: F.concat(F.when((i > 0) & r["space_before"], " ").otherwise(""), r["text"])), ""))

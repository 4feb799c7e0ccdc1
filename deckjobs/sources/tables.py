"""Readers and writers of the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import safe_file_name
from .shared import dealt


def src_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Positioned glyphs of a corpus; rows without a page are left out."""
    return spark.read.schema(schemas.GLYPHS).parquet(path).where("page is not null")


def src_lines(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, line_no (from 0), line."""
    return documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def src_styles(spark: SparkSession, path: str | list[str], folder: str | None = None) -> DataFrame:
    """Style files (JSON, one style each, templates in base64); files that are broken or lack a name or kind are left out.

    ``folder`` names a column for the folder that a style's own folder lies in.
    """
    x = spark.read.schema(schemas.STYLE_FILES).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    if folder:
        x = x.withColumn(folder, F.regexp_extract(F.input_file_name(), "/([^/]+)/file=[^/]*/[^/]*$", 1))
    good = x.where("_corrupt_record is null and coalesce(name, '') <> '' and kind in ('prompts', 'slides')")
    return good.select("name", "kind", F.transform_values("templates", lambda k, v: F.unbase64(v)).alias("templates"), "settings", *([folder] if folder else []))


def sink_styles(styles: DataFrame, path: str, order: str) -> None:
    """One folder for each name; of several rows of one name the last by ``order`` is written; absent fields are left out.

    A style of the same name is replaced; the other styles of the store stay.
    """
    last = styles.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    out = last.withColumn("templates", F.transform_values("templates", lambda k, v: F.base64(v))).withColumn("file", F.col("name"))
    out.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").option("ignoreNullFields", True).json(path)


#: Name of the data source of presentation files.
PRESENTATIONS = "presentations"


def unique_files(decks: DataFrame) -> DataFrame:
    """Decks with ``file``: their safe file name; of several that would have the same (case aside), all but that of the least doc_id get their id.

    So does every deck whose own name looks as if it had got one. Names are compared by a
    count for each, not by sorting all decks of a name: a default name may be that of most.
    """
    named = decks.withColumn("file", safe_file_name(F.col("name"), ""))
    least = named.groupBy(F.lower("file").alias("_name")).agg(F.min("doc_id").alias("_least"))
    x = named.join(least, F.lower("file") == F.col("_name"))
    plain = (F.col("doc_id") == F.col("_least")) & ~F.col("file").rlike(r"\(-?\d+\)\z")
    suffix = F.when(plain, "").otherwise(F.concat(F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")")))
    return x.withColumn("file", F.concat("file", suffix, F.lit(".pro"))).drop("_name", "_least")


def sink_presentations(decks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file for each deck (doc_id, name, cue_ids, cues), a line of JSON under its safe file name.

    Files become visible when the job commits, a folder for each task; a task or job that
    fails leaves none. Decks too large for a row go to ``sink_cues`` as a table of cues.
    """
    from .presentations import Presentations

    decks.sparkSession.dataSource.register(Presentations)
    body = F.to_json(F.struct("doc_id", "name", "cue_ids", "cues"))
    unique_files(decks).select("file", body.alias("body")).write.format(PRESENTATIONS).mode(mode).save(path)


def src_presentations(spark: SparkSession, path: str, schema) -> DataFrame:
    """Presentation files as decks, with the columns of ``schema``; the driver sees folders of files, never each file."""
    from .presentations import Presentations

    spark.dataSource.register(Presentations)
    return spark.read.format(PRESENTATIONS).load(path).select(F.from_json("body", schema).alias("d")).select("d.*")


def sink_cues(cues: DataFrame, path: str) -> None:
    """Cues as rows of one Parquet table, in order within a file by document and number: for decks of any size."""
    dealt(cues, "doc_id").sortWithinPartitions("doc_id", "cue_no").write.mode("overwrite").parquet(path)

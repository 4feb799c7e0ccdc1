"""Running sums and preceding rows over documents that are too long for one task.

A window over a document is one task. Here a document is cut into blocks by its leading
order column (so many lines, pages or positions each); sums run and rows precede within a
block, blocks are added up to one row each, and what a block starts from (its carry) is a
window over those rows. Carries are put back by document and block; first blocks have none,
so for documents of one block the table of carries is empty.

With ``size`` None everything is one window by document, as is best for documents that fit
a task. Both forms give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import dealt

#: Lines, pages or positions in a block, for callers that have no better number.
LINES, PAGES = 1 << 16, 1 << 10


def _value(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], size: int | None = None, key: str = "doc_id") -> DataFrame:
    """Adds the sums of all rows of the document up to this one in ``order``, whose first column is a number from which blocks are cut."""
    if size is None:
        w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    x = dealt(rows.withColumn("__cut", F.floor(F.col(order[0]) / size)), key, "__cut")
    own = W.partitionBy(key, "__cut").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)
    totals = x.groupBy(key, "__cut").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    carry = totals.withColumns({f"__{n}": F.sum(f"__{n}").over(ahead) for n in sums}).withColumn("__later", F.lag("__cut").over(W.partitionBy(key).orderBy("__cut")).isNotNull())
    carry = carry.where("__later").select(F.col(key).alias("__key"), F.col("__cut").alias("__at"), *(f"__{n}" for n in sums))
    y = x.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(carry, (F.col(key) == F.col("__key")) & (F.col("__cut") == F.col("__at")), "left")
    return y.withColumns({n: F.coalesce(F.col(n) + F.col(f"__{n}"), F.col(n), F.col(f"__{n}")) for n in sums}).drop("__cut", "__key", "__at", *(f"__{n}" for n in sums))


def preceding(rows: DataFrame, order: list[str], values: dict[str, Column], size: int | None = None, key: str = "doc_id") -> DataFrame:
    """Adds values of the row before this one in its document, null for the first."""
    if size is None:
        w = W.partitionBy(key).orderBy(*order)
        return rows.withColumns({n: F.lag(_value(c)).over(w) for n, c in values.items()})
    x = dealt(rows.withColumn("__cut", F.floor(F.col(order[0]) / size)), key, "__cut")
    own = W.partitionBy(key, "__cut").orderBy(*order)
    held = F.struct(*(_value(c).alias(n) for n, c in values.items()))
    last = x.groupBy(key, "__cut").agg(F.max_by(held, F.struct(*order)).alias("__last"))
    carry = last.withColumn("__last", F.lag("__last").over(W.partitionBy(key).orderBy("__cut"))).where("__last is not null")
    carry = carry.select(F.col(key).alias("__key"), F.col("__cut").alias("__at"), "__last")
    y = x.withColumns({**{n: F.lag(_value(c)).over(own) for n, c in values.items()}, "__first": F.row_number().over(own) == 1})
    y = y.join(carry, (F.col(key) == F.col("__key")) & (F.col("__cut") == F.col("__at")), "left")
    return y.withColumns({n: F.when(F.col("__first"), F.col(f"__last.{n}")).otherwise(F.col(n)) for n in values}).drop("__cut", "__key", "__at", "__last", "__first")

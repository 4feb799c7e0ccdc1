"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its words (cut at single spaces and line ends), weighted by how
often they occur. For sample j each term k has r, c ~ Gamma(2, 1) and b ~ U(0, 1), made of
the bits of a hash of (k, j). With weight S, t = floor(ln S / r + b) and
ln a = ln c - r (t - b) - r; the sample is the (k, t) of least a. The chance that two
texts have the same sample is their generalised Jaccard similarity, the sum of lesser
weights over the sum of greater ones, so the share of equal samples estimates it.

A sample is kept as one long: ln a in fixed point above 32 bits of (k, t). Its minimum is a
plain aggregate, and the lower half is the sample.

Defined results: null counts as empty; an empty text has the empty word as its only term;
equal texts have equal fingerprints; a null doc_id sorts first; repeated rows are documents
of their own, in order of their texts; the document after the last is the first; a table of
one document is its own next; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, ranked, shuffle_width

SAMPLES = 32
#: So many consecutive ids are dealt to the same partition.
CHUNK = 256
_BITS = 21


def _uniform(h: Column, k: int) -> Column:
    """Bits 21 k .. 21 k + 20 of a hash as a number strictly between 0 and 1."""
    bits = F.shiftrightunsigned(h, _BITS * k).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (bits.cast("double") + 0.5) / float(1 << _BITS)


def sample(term: Column, log_weight: Column, j: int) -> Column:
    """The long of sample j for a term: ordered by ln a, its lower 32 bits say which term and t."""
    h = F.xxhash64(term, F.lit(j))
    g = F.xxhash64(h)
    r = -F.log(_uniform(h, 0) * _uniform(h, 1))
    b = _uniform(h, 2)
    t = F.floor(log_weight / r + b)
    log_a = F.log(-F.log(_uniform(g, 0) * _uniform(g, 1))) - r * (t - b + 1.0)
    order = F.floor(F.greatest(F.least(log_a + 64.0, F.lit(127.0)), F.lit(0.0)) * float(1 << 24)).cast("long")
    which = term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(order, 32).bitwiseOR(which)


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """texts(keys..., words array, as_value boolean) -> keys..., fingerprint: 8 hex digits a sample; value.

    Keys may repeat an outer partitioning of ``texts``; then neither the counts of words
    nor the minima need a shuffle. A row with ``as_value`` carries a number, written as its
    only word, through the same aggregates, and gets it back as ``value``.
    """
    words = texts.select(*keys, "as_value", F.explode("words").alias("word"))
    term = F.when(F.col("as_value"), F.col("word").try_cast("bigint")).otherwise(F.xxhash64("word"))
    counts = words.groupBy(*keys, term.alias("term")).agg(F.log(F.count("*").cast("double")).alias("log_weight"))
    least = counts.groupBy(*keys).agg(F.min("term").alias("value"), *(F.min(sample(F.col("term"), F.col("log_weight"), j)).alias(f"s{j}") for j in range(samples)))
    digits = [F.lpad(F.hex(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for j in range(samples)]
    return least.select(*keys, F.lower(F.concat(*digits)).alias("fingerprint"), "value")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = [(F.substring(a, 8 * j + 1, 8) == F.substring(b, 8 * j + 1, 8)).cast("int") for j in range(samples)]
    return sum(equal[1:], equal[0]).cast("double") / samples


def chunk_order(d: DataFrame) -> DataFrame:
    """d(chunk, doc_id) -> chunk, first_id, target: the chunk before, for the first the last; one row a chunk."""
    chunks = ranked(d.groupBy("chunk").agg(F.min("doc_id").alias("first_id")), "chunk")
    last = chunks.agg(F.max("rank").alias("last"))
    at = chunks.join(F.broadcast(last), F.col("rank") <= F.col("last"))
    before = at.select("chunk", "first_id", F.when(F.col("rank") == 0, F.col("last")).otherwise(F.col("rank") - 1).alias("before"))
    return before.join(chunks.select(F.col("rank").alias("before"), F.col("chunk").alias("target")), "before").select("chunk", "first_id", "target")


def chunked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("chunk", F.coalesce(F.floor(F.col("doc_id") / CHUNK), F.lit(-(2**62))))


def with_next(d: DataFrame, order: DataFrame) -> DataFrame:
    """d(chunk, doc_id, text) -> chunk, n (place in the chunk), doc_id, text, next_text; dealt out by chunk.

    Documents are shuffled once, by ranges of ``CHUNK`` ids; the next text is mostly in
    the same range. The first documents of the ranges, one in ``CHUNK`` of dense ids, go to
    the range before them.
    """
    own = W.partitionBy("chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    spread = d.repartition(4 * shuffle_width(d.sparkSession), "chunk")
    # on the chunk alone, hashing the small side, so that the spread texts are used as they lie
    heads = order.withColumnRenamed("chunk", "c").hint("shuffle_hash")
    firsts = spread.join(heads, (F.col("chunk") == F.col("c")) & F.coalesce(F.col("doc_id") - F.col("first_id") == 0, F.col("doc_id").isNull()))
    firsts = firsts.groupBy("target").agg(F.min("text").alias("first_text"))
    dealt = spread.withColumn("n", F.row_number().over(own)).withColumn("following", F.lead("text").over(own))
    got = dealt.join(firsts, dealt["chunk"] == firsts["target"], "left")
    return got.select("chunk", "n", "doc_id", "text", F.coalesce("following", "first_text").alias("next_text"))


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has the last quarter (rounded down) of its code points replaced by the
    first as many of the next document. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    d = chunked(docs)
    order = chunk_order(d)
    length = F.length("text")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.left("text", length - quarter), F.left("next_text", quarter))
    t = with_next(d, order).select("chunk", "n", "doc_id", "text", edited.alias("edited"))
    sha = F.sha2("edited", 256)
    quarters = [F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10) for k in range(4)]
    numbers = [F.col("doc_id").cast("string"), F.length("text").cast("string"), *quarters]
    side = lambda k, w, v: F.struct(F.lit(k).alias("side"), w.alias("words"), F.lit(v).alias("as_value"))
    words = lambda c: F.split(c, "[ \n]")
    sides = [side(0, words("text"), False), side(1, words("edited"), False), *(side(2 + k, F.array(x), True) for k, x in enumerate(numbers))]
    dealt = t.withColumn("sha", sha).select("chunk", "n", F.explode(F.array(*sides)).alias("of")).select("chunk", "n", "of.*")
    signed = signatures(dealt, ["chunk", "n", "side"], samples)
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    rows = signed.groupBy("chunk", "n").agg(of(0, "fingerprint").alias("fingerprint"), of(1, "fingerprint").alias("edited_fingerprint"), of(2, "value").alias("doc_id"), of(3, "value").alias("n_chars"), *(of(4 + k, "value").alias(f"q{k}") for k in range(4)))
    hexed = F.concat(*(F.lpad(F.hex(f"q{k}"), 16, "0") for k in range(4)))
    rows = keep(rows.withColumn("edited_sha256", F.lower(hexed)))
    firsts = rows.where("n = 1").join(order.select("chunk", "target"), "chunk").select("target", F.col("fingerprint").alias("first"))
    following = F.lead("fingerprint").over(W.partitionBy("chunk").orderBy("n"))
    out = rows.withColumn("following", following).join(firsts, F.col("chunk") == F.col("target"), "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("following", "first"), samples).alias("near_next"),
    )

"""Chat formatting in budgeted windows, in DataFrame functions only.

The turns of a conversation are cut into spans by prefix sums of their token counts. A
window is the system turn, some of the last turns of the span before (history), and the
span itself; the loss mask covers the assistant texts of the span alone, so that every
target is learned from once although history is repeated.

Template of a turn: ``<turn:ROLE>`` newline TEXT ``</turn>`` newline. In roles and texts
backslash, ``<`` and ``>`` are written as ``\\b``, ``\\l`` and ``\\g``, so that no text can look
like a mark and the output can be read back exactly.

Bounds: with ``usable`` the budget less system turn and history, spans are the cells of a
grid of half that size over the prefix sums, and a turn longer than a cell is a span of its
own. A span thus exceeds ``usable`` only if one turn does, and turns are never cut; such
windows have ``over_budget`` true.

Defined results: null roles and texts are empty; a conversation's rows are in order of
(turn, role, text), null turns first; repeated rows are turns of their own; a null conv_id
is a conversation like any other; empty tables give empty results; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY_BUDGET = 256
HISTORY_TURNS = 2


def escape(c: Column) -> Column:
    for raw, name in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def unescape(c: Column) -> Column:
    for raw, name in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return c


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun, and two for the marks of a turn."""
    return F.floor((F.length(text) + 3) / 4) + 2


def windows(turns: DataFrame, budget: int = BUDGET, history_budget: int = HISTORY_BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row per window.

    Columns: conv_id, window (from 1), formatted, loss_spans (array of start and end, code
    points in ``formatted``), n_context (leading turns that only repeat), n_new, tokens,
    over_budget. All windows of functions run over conv_id, so one shuffle deals the turns;
    frames are running, so a long conversation streams through its task.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    conv = W.partitionBy("conv_id").orderBy(*order)
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", F.row_number().over(conv)).withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    t = t.withColumn("rendered", F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">\n"), escape(F.col("text")), F.lit("</turn>\n")))
    t = t.withColumn("tokens", token_estimate(F.col("text")))
    running = conv.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("system_tokens", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(running))
    t = t.withColumn("cell_size", F.greatest(F.floor((F.lit(budget - history_budget) - F.col("system_tokens")) / 2), F.lit(1)))
    t = t.withColumn("own_tokens", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    t = t.withColumn("sum", F.sum("own_tokens").over(running))
    t = t.withColumn("cell", F.floor((F.greatest(F.col("sum"), F.lit(1)) - 1) / F.col("cell_size")))
    t = t.withColumn("large", F.col("own_tokens") > F.col("cell_size"))
    begins = F.coalesce((F.col("cell") != F.lag("cell").over(conv)) | F.col("large") | F.lag("large").over(conv), F.lit(True))
    t = t.withColumn("begins", begins)
    t = t.withColumn("span", F.sum(F.col("begins").cast("int")).over(running))
    system = F.when(F.col("begins") & (F.col("span") > 1), F.first(F.when(F.col("system"), F.col("rendered")), ignorenulls=True).over(running))
    t = t.withColumn("kept_system", system)
    back = W.partitionBy("conv_id", "span").orderBy(F.desc("n"))
    t = t.withColumn("from_end", F.row_number().over(back)).withColumn("tokens_to_end", F.sum("tokens").over(back.rowsBetween(W.unboundedPreceding, 0)))
    repeats = (F.col("from_end") <= history_turns) & (F.col("tokens_to_end") <= history_budget) & ~F.col("system")
    place = F.struct(F.col("span").alias("window"), F.lit(False).alias("history"), F.col("kept_system").alias("kept_system"))
    again = F.struct((F.col("span") + 1).alias("window"), F.lit(True).alias("history"), F.lit(None).cast("string").alias("kept_system"))
    placed = t.select("conv_id", "n", "role", "rendered", "tokens", "system_tokens", F.explode(F.when(repeats, F.array(place, again)).otherwise(F.array(place))).alias("at"))
    placed = placed.select("conv_id", "at.*", "n", "role", "rendered", "tokens", "system_tokens")
    item = F.struct("n", F.col("history"), F.col("role"), F.col("rendered"), F.col("tokens"))
    w = placed.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.max("kept_system").alias("system"),
        F.max("system_tokens").alias("system_tokens"),
        F.sum((~F.col("history")).cast("int")).alias("n_new"),
        F.sum(F.col("history").cast("int")).alias("n_history"),
        F.sum("tokens").alias("tokens"),
    )
    # the turns copied from a conversation's last span have no span to go before
    w = w.where("n_new > 0")
    head = F.coalesce("system", F.lit(""))
    formatted = F.concat(head, F.array_join(F.transform("items", lambda x: x["rendered"]), ""))
    zero = F.struct(F.length(head).cast("int").alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["rendered"])
        start = acc["at"] + F.length(F.substring_index(x["rendered"], ">\n", 1)) + 2
        span = F.struct(start.cast("int").alias("start"), (end - len("</turn>\n")).cast("int").alias("end"))
        spans = F.when((x["role"] == "assistant") & ~x["history"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    has_system = F.col("system").isNotNull()
    tokens = F.col("tokens") + F.when(has_system, F.col("system_tokens")).otherwise(0)
    return w.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        F.aggregate("items", zero, step)["spans"].alias("loss_spans"),
        (F.col("n_history") + has_system.cast("int")).alias("n_context"),
        "n_new",
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and targets of each window from its text and mask: ``turns`` array of (role, text), ``targets`` array of text."""
    pieces = F.split("formatted", "</turn>\n", -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    role = lambda x: unescape(F.substring(F.substring_index(x, ">\n", 1), len("<turn:") + 1, 1 << 30))
    text = lambda x: unescape(F.substr(x, F.length(F.substring_index(x, ">\n", 1)) + F.lit(3)))
    turns = F.transform(new, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))
    targets = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows' output: number and hash of turns, and of all text under the mask."""
    r = read_back(formatted).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("targets", "").alias("loss"),
        "chars",
    )
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "all", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    every = F.array_join(F.transform("w", lambda x: x["all"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return g.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

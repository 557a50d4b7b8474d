"""Conversations as budgeted training windows with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.graph import write_table
from tidemark.session import scratch_dir

#: A turn in the output: <turn role>text</turn> and a line end. In roles and texts, "\" is written \0 and "<" is written \1, so neither mark can occur inside.
OPEN, CLOSE = "<turn ", "</turn>\n"
PARSED = r"<turn ([^<>]*)>([^<]*)</turn>\n"

#: Turn numbers, and numbers of spans, that are ordered in one task.
BLOCK = 4096


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\2"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\2"), F.lit(">")))


def tokens(text: Column) -> Column:
    """Words and signs of a text, and three for its marks: a size that Spark can count itself."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3


def _positions(t: DataFrame, span: int) -> DataFrame:
    """Every turn with its number, the tokens before it, its span, and the next span of its block: prefix sums inside blocks of turn numbers and over the blocks of a conversation."""
    t = t.withColumn("size", tokens(F.col("text")).cast("long")).withColumn("block", F.struct(F.floor(F.col("turn") / BLOCK).alias("at")))
    over_blocks = Window.partitionBy("conv").orderBy("block")
    blocks = t.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("turns_in"), F.sum("size").alias("size_in"))
    blocks = blocks.select("conv", "block", (F.sum("turns_in").over(over_blocks) - F.col("turns_in")).alias("n0"), (F.sum("size_in").over(over_blocks) - F.col("size_in")).alias("before0"))
    place = Window.partitionBy("conv", "block")
    order = place.orderBy("turn", "role", "text")
    t = t.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    t = t.join(blocks, ["conv", "block"]).withColumn("n", F.col("n") + F.col("n0")).withColumn("before", F.col("before") + F.col("before0")).drop("n0", "before0")
    t = t.withColumn("span", F.floor(F.col("before") / span))
    # Where the next span of the block begins: looked up from the rows behind by walking the block backwards.
    later = place.orderBy(F.desc("n"))
    t = t.withColumn("follower", F.lag(F.struct("span", "before")).over(later))
    t = t.withColumn("next", F.last(F.when(F.col("follower.span") != F.col("span"), F.col("follower")), ignorenulls=True).over(later))
    return t.drop("follower", "size")


def windows(turns: DataFrame, budget: int = 2048, history: int = 256, trained: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated, loss (array of start, end in code points of `formatted`).

    Prefix sums of turn tokens cut a conversation at turn borders: a turn belongs to the span its first token falls into, spans being half of what the
    budget leaves beside `history`, so a window keeps to the budget unless its system turn or a single turn is longer than such a half. Every window
    starts with the conversation's system turn (its first turn, if a system turn) and with the last turns before its span that fit into `history`;
    these are the first `n_repeated` turns. The loss mask covers the text of each `trained` turn in its own span only, so every target counts once.

    Turns go by number (null ones first), equal ones by role and text; repeated rows are turns of their own. Null roles and texts are empty, null ids form one
    conversation, an empty table has no windows; a text of any length stays whole. Other columns are not read. A turn reaches at most its own and the next window.
    The turns with their places are written once, in the shared folder. A conversation of any length is cut into blocks of turn numbers, so no task sorts all of it; turns of one number stay together.
    """
    if not 0 <= history < budget / 3:
        raise ValueError("history must stay under a third of the budget")
    span = (budget - history) // 2
    # Structs hold ids and numbers that may be null: they compare and hash like any value, so joins and windows share one partitioning.
    t = turns.select(F.struct(F.col(conv_id).alias("id")).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = write_table(_positions(t, span), scratch_dir(turns.sparkSession, "chat"))
    # A block's last span looks up where the next one begins in a table of spans, ordered in groups of them and over the groups.
    entry = F.struct("span", "before")
    begun = t.groupBy("conv", "block", "span").agg(F.min("before").alias("before"))
    spans = begun.groupBy("conv", "span").agg(F.min("before").alias("before")).withColumn("group", F.floor(F.col("span") / BLOCK))
    heads = spans.groupBy("conv", "group").agg(F.min(entry).alias("head")).select("conv", "group", F.lead("head").over(Window.partitionBy("conv").orderBy("group")).alias("beyond"))
    spans = spans.withColumn("next", F.lead(entry).over(Window.partitionBy("conv", "group").orderBy("span"))).join(heads, ["conv", "group"])
    spans = spans.select("conv", "span", F.coalesce("next", "beyond").alias("beyond"))
    carried = begun.groupBy("conv", "block").agg(F.max("span").alias("span")).join(spans, ["conv", "span"]).select("conv", "block", "beyond")
    t = t.join(carried, ["conv", "block"]).withColumn("next", F.coalesce("next", "beyond"))
    repeats = (F.col("next.before") - F.col("before") <= history) & F.col("next").isNotNull()
    system = (F.col("n") == 1) & (F.col("role") == "system")
    piece = F.struct("n", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit(">")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("trained"))
    t = t.select("conv", "n", "span", "next", system.alias("system"), piece.alias("piece"), (repeats & ~system).alias("repeats"))

    own = F.struct(F.col("span").alias("window"), F.lit(False).alias("repeated"))
    again = F.struct(F.col("next.span").alias("window"), F.lit(True).alias("repeated"))
    placed = t.select("conv", F.explode(F.when(F.col("repeats"), F.array(own, again)).otherwise(F.array(own))).alias("to"), "piece").select("conv", "to.window", "to.repeated", "piece")
    used = spans.where("span > 0").select("conv", F.col("span").alias("window"))
    systems = t.where("system").select("conv", "piece")
    placed = placed.unionByName(used.join(systems, "conv").select("conv", "window", F.lit(True).alias("repeated"), "piece"))

    rows = placed.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct(F.col("piece.n").alias("n"), "repeated", "piece"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(x["piece"]["head"], x["piece"]["body"], F.lit(CLOSE))), "")
    sized = F.transform("turns", lambda x: F.struct(F.length(x["piece"]["head"]).alias("head"), F.length(x["piece"]["body"]).alias("body"), (x["piece"]["trained"] & ~x["repeated"]).alias("target")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    walked = F.aggregate(sized, start, lambda acc, x: F.struct(
        (acc["at"] + x["head"] + x["body"] + len(CLOSE)).alias("at"),
        F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end"))))).otherwise(acc["loss"]).alias("loss")))
    return rows.select(F.col("conv.id").alias("conv_id"), "window", formatted.alias("formatted"), F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"), walked["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: conv_id, roles, texts (every turn once, in order), targets (texts under the loss mask), formatted_chars."""
    roles = F.regexp_extract_all("formatted", F.lit(PARSED), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(PARSED), F.lit(2))
    first = F.col("n_repeated") + 1
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    w = formatted.select(
        "conv_id", "window", F.transform(F.slice(roles, first, F.size(roles)), _unescape_role).alias("roles"), F.transform(F.slice(texts, first, F.size(texts)), unescape).alias("texts"),
        masked.alias("targets"), F.length("formatted").cast("long").alias("chars"),
    )
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "roles", "texts", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return g.select("conv_id", F.flatten("w.roles").alias("roles"), F.flatten("w.texts").alias("texts"), F.flatten("w.targets").alias("targets"), "formatted_chars")

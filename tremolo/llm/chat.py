"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its
context, only its reply is trainable. ``format_chat`` finds the examples; each holds
what is new since the one before (``delta``, the formatted turns between the two replies, and
``reply``) and the length of the shared prefix. ``expand`` writes every example out with its whole
context, and ``read_back`` takes conversations and loss masks from that text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Turns to a block: a long conversation is dealt out by blocks of so many rows.
BLOCK = 256
#: Broadcast at most so many ids.
BROADCAST_ROWS = 300_000


def escape(text: Column) -> Column:
    """A backslash more between ``<`` and ``|``, so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def head(role: Column) -> Column:
    """A turn's header; a role is percent-encoded, so that it can hold any character."""
    return F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))


def format_chat(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row for each example of each conversation, and one for what follows its last reply.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Out come conv_id,
    example (from 0), delta (formatted turns since the reply before, this turn's
    header included), reply (the formatted trainable text and its end mark; null for
    turns after the last reply), context_chars (of all that precedes the reply: all of it
    is masked) and mask (whether there is a reply to train on). An example's whole text is
    the deltas and replies of the examples before it, its delta and its reply.

    Null texts and roles count as empty; rows are ordered by turn, then role, then text, null
    turns first; repeated rows are turns of their own; a null conv_id is a conversation too;
    an empty table gives no rows. Blocks are ranges of ``turn``: places, examples and lengths are summed
    within them and offset by the sums of the blocks before, so that no task needs all rows of
    a long conversation. Rows without a turn are one block.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    reply = F.col("role") == trainable
    told = F.concat(escape(F.col("text")), F.lit(END + "\n"))
    delta = F.concat(head(F.col("role")), F.when(reply, F.lit("")).otherwise(told))
    rows = rows.select("conv_id", "block", "turn", "role", "text", reply.cast("long").alias("is_reply"), delta.alias("delta"), F.when(reply, told).alias("reply"))
    rows = rows.withColumn("size", (F.char_length("delta") + F.coalesce(F.char_length("reply"), F.lit(0))).cast("long"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select(
        "conv_id", "block", "delta", "reply", (F.row_number().over(order) - 1).alias("_n"),
        F.coalesce(F.sum("is_reply").over(past), F.lit(0)).alias("_r"), F.coalesce(F.sum("size").over(past), F.lit(0)).alias("_s"),
    )
    sums = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("is_reply").alias("r"), F.sum("size").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}0")
    offsets = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), before("n"), before("r"), before("s"))
    rows = inside.join(offsets, inside.conv_id.eqNullSafe(offsets._c) & (inside.block == offsets._b))
    start = F.col("_s0") + F.col("_s") + F.char_length("delta")
    rows = rows.select("conv_id", (F.col("_r0") + F.col("_r")).alias("example"), (F.col("_n0") + F.col("_n")).alias("pos"), "delta", "reply", start.alias("start"))
    made = rows.groupBy("conv_id", "example").agg(
        F.array_sort(F.collect_list(F.struct("pos", "delta"))).alias("parts"), F.max("reply").alias("reply"), F.max("start").alias("context_chars"),
    )
    delta = F.array_join(F.transform("parts", lambda p: p["delta"]), "")
    return made.select("conv_id", "example", delta.alias("delta"), "reply", "context_chars", F.col("reply").isNotNull().alias("mask"))


def expand(examples: DataFrame, block: int = 64) -> DataFrame:
    """(conv_id, example, context, reply, mask): every example with all that precedes its reply written out.

    What a conversation adds up to is as the square of its turns, and rows are as long as what they hold. Blocks
    of examples are expanded apart from one another: each starts from the text of all blocks before it. Rows
    without a reply (what follows a conversation's last) are no examples: their mask is false.
    """
    own = F.concat("delta", F.coalesce("reply", F.lit("")))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))  # a null id is a conversation too
    rows = examples.select("conv_id", "example", "delta", "reply", "mask", F.floor(F.col("example") / block).alias("_b"), own.alias("_own"), key.alias("_c"))
    near = Window.partitionBy("_c", "_b").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.array_join(F.collect_list("_own").over(near), ""))
    # Conversations of several blocks; all others need no text of earlier ones.
    long = rows.where("_b > 0").select("_c").distinct()
    many = long.count()
    if many == 0:
        return near.select("conv_id", "example", F.concat("_near", "delta").alias("context"), "reply", "mask")
    texts = rows.join(F.broadcast(long) if many <= BROADCAST_ROWS else long, "_c", "left_semi")
    texts = texts.groupBy("_c", "_b").agg(F.array_sort(F.collect_list(F.struct("example", "_own"))).alias("_rows"))
    texts = texts.select("_c", "_b", F.array_join(F.transform("_rows", lambda r: r["_own"]), "").alias("_text"))
    past = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = texts.select("_c", "_b", F.array_join(F.collect_list("_text").over(past), "").alias("_before")).where("_b > 0")
    joined = near.join(before, ["_c", "_b"], "left")
    return joined.select("conv_id", "example", F.concat(F.coalesce("_before", F.lit("")), "_near", "delta").alias("context"), "reply", "mask")


def read_back(expanded: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars): a row for each conversation, from its written examples alone.

    ``turns`` joins role, line break, text and line break of each turn, read from the longest row; ``loss`` joins what
    stands under the masks, unescaped; formatted_chars counts all examples (of a conversation without a reply,
    what was formatted).
    """
    whole = F.concat("context", F.coalesce("reply", F.lit("")))
    size = F.char_length("context") + F.coalesce(F.char_length("reply"), F.lit(0)).cast("long")
    reply = unescape(F.expr(f"substring(reply, 1, char_length(reply) - {len(END) + 1})"))
    made = expanded.groupBy("conv_id").agg(
        F.max_by(whole, "example").alias("_whole"), F.array_sort(F.collect_list(F.when(F.col("mask"), F.struct("example", reply.alias("text"))))).alias("_replies"),
        F.sum(F.when(F.col("mask"), size)).alias("_sum"), F.max(size).alias("_most"),
    )
    parts = F.filter(F.split("_whole", r"<\|im_start\|>"), lambda p: p != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.char_length(role) + 2, F.char_length(part) - F.char_length(role) - 1 - (len(END) + 1))
        return F.concat(F.url_decode(role), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.array_join(F.transform("_replies", lambda r: r["text"]), "")
    return made.select("conv_id", F.size(parts).cast("long").alias("n_turns"), F.array_join(F.transform(parts, turn), "").alias("turns"), loss.alias("loss"), F.coalesce("_sum", "_most").alias("formatted_chars"))

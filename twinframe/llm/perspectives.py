"""Chat training views: every participant's own perspective on a dialogue.

For each speaker of a conversation the turns are rendered once more with that speaker as ``assistant`` and all others
as ``user`` with their name; instructions (``system``) stay what they are and are nobody's perspective. The mask of a
view marks the spans that the assistant wrote, which are the ones to train on.

Views are kept as one row per turn, so no conversation is gathered anywhere: a turn meets the speakers of its
conversation in a join, and its place in the rendered view comes from running sums in two levels, inside blocks of
``BLOCK`` turns and over the blocks. A conversation of any length is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INSTRUCTIONS = "system"
BLOCK = 256
FIRST_BLOCK = -(1 << 60)  # of turns without a number, which come first
START, END = "<|im_start|>", "<|im_end|>\n"


def _header(role: Column, name: Column) -> Column:
    """The opening of a rendered turn: role, and the name of a user who has one."""
    return F.concat(F.lit(START), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))


def perspective_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, perspective, turn, role, name, rendered, start, train_start, train_end`` for each turn of each view.

    ``rendered`` is the turn in the view, ``start`` its offset in the whole view, and ``train_start`` and ``train_end``
    the span of the view to train on (null where the turn is another's). All offsets are in code points. A view of
    every distinct ``role`` except ``system`` is made; a null role speaks in all views as an unnamed user and has none
    of its own. A null text is an empty turn. Turns are in the order of ``turn`` (null first), then role and text; rows
    that repeat entirely repeat in the view, in any order. A null ``conv_id`` is one conversation. Conversations of
    instructions only have no view, and an empty table gives no rows. Other columns are not read.

    The number of rows is turns times speakers of the conversation, which is what the views hold.
    """
    turns = conversations.select("conv_id", "turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.filter(F.col("speaker").isNotNull() & (F.col("speaker") != INSTRUCTIONS)).select(
        F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    views = turns.join(speakers, turns["conv_id"].eqNullSafe(speakers["of"])).drop("of")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("speaker") == INSTRUCTIONS, INSTRUCTIONS).otherwise("user")
    name = F.when(~own & (F.col("speaker") != INSTRUCTIONS), F.col("speaker"))
    views = views.withColumn("role", role).withColumn("name", name)
    views = views.withColumn("head", F.length(_header(F.col("role"), F.col("name"))).cast("long"))
    views = views.withColumn("rendered", F.concat(_header(F.col("role"), F.col("name")), "text", F.lit(END)))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), "text"]
    views = views.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(FIRST_BLOCK)).cast("long"))
    key = ["conv_id", "perspective"]
    sizes = views.groupBy(*key, "block").agg(F.sum(F.length("rendered")).alias("size"))
    earlier = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(
        F.col("conv_id").alias("of"), F.col("perspective").alias("by"), F.col("block").alias("at"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    before = W.partitionBy(*key, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    views = views.withColumn("inside", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))
    views = views.join(bases, views["conv_id"].eqNullSafe(bases["of"]) & (views["perspective"] == bases["by"]) & (
        views["block"] == bases["at"])).withColumn("start", (F.col("base") + F.col("inside")).cast("long"))
    train_start = F.col("start") + F.col("head")
    trained = F.col("role") == "assistant"
    return views.select(
        "conv_id", "perspective", "turn", "role", "name", "rendered", "start",
        F.when(trained, train_start).alias("train_start"),
        F.when(trained, train_start + F.length("text")).alias("train_end"),
    )


def perspective_views(conversations: DataFrame) -> DataFrame:
    """``conv_id, perspective, n_turns, text, mask``: each view as one text with the list of its spans to train on.

    For conversations whose views fit a row; ``perspective_turns`` has no such bound.
    """
    return perspective_turns(conversations).groupBy("conv_id", "perspective").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "rendered"))), lambda x: x["rendered"]), "").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("train_start").isNotNull(), F.struct("train_start", "train_end")))).alias("mask"),
    )


def perspective_digests(conversations: DataFrame) -> DataFrame:
    """The rows of ``perspective_turns`` with a digest in the place of the rendered text."""
    return perspective_turns(conversations).withColumn("rendered_sha256", F.sha2("rendered", 256)).drop("rendered")

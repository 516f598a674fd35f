"""Chat formatting: the dialogue from every participant's perspective.

For each participant of a conversation the dialogue is rendered with that speaker's
turns as the assistant's, all others' as turns of users who bear their names, and a
mask: the code point spans that the assistant says (with the end mark), which alone
are trained on.  System turns are the setting, not a participant; every rendering
has them.

A rendering is given turn by turn, whatever its length: one row for each participant
and turn, with the offsets that the turn has in the whole rendering.  A rendering is
its turns put together in their order; ``whole`` does so, a row for each participant.

A turn is rendered as ``<|im_start|>HEAD\\nTEXT<|im_end|>\\n``, where HEAD is
``assistant``, ``system`` or ``user name=NAME``.  A mark within a name or a text is
broken by a zero-width space after its ``<|``, and line breaks in a name are blanks,
so that no text can pass for a turn.

Turns are ordered by turn, then role, then text (nulls first).  A null role is
the participant ``unknown``; a null text is empty; a conversation of system
turns alone has no participant and no row.  Repeated rows are repeated turns.
Null conversation ids are one conversation.  An empty table gives an empty one;
further columns may have any name and are not read.

A conversation of any length is dealt out over the tasks by ranges of its order;
what a range adds to the offsets is summed for each range first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BREAK = "<\u200b"


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=\|im_(?:start|end)\|>)", BREAK)


def perspectives(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col, participant, place (long, from 0), rendered, start, end, mask_start, mask_end (null where nothing is trained), one row for each participant and turn."""
    n = partitions(turns.sparkSession)
    speaker = F.coalesce(F.col(role_col), F.lit("unknown"))
    own = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), speaker.alias("speaker"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    ranged = own.repartitionByRange(n, F.col("conv").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged)
    people = written(ranged.where("speaker <> 'system'").select("conv", F.col("speaker").alias("as")).distinct())
    people_of = people.withColumnRenamed("conv", "of")
    seen = ranged.join(people_of, ranged["conv"].eqNullSafe(people_of["of"]))
    trained = F.col("speaker") == F.col("as")
    name = F.regexp_replace(_unmarked(F.col("speaker")), r"[\r\n]", " ")
    head = F.when(F.col("speaker") == "system", "system").when(trained, "assistant").otherwise(F.concat(F.lit("user name="), name))
    begin = F.concat(F.lit(OPEN), head, F.lit("\n"))
    made = seen.select("conv", "part", "as", "turn", "role", "text", trained.alias("trained"), F.char_length(begin).alias("head"), F.concat(begin, _unmarked(F.coalesce("text", F.lit(""))), F.lit(CLOSE)).alias("rendered"))
    made = made.withColumn("size", F.char_length("rendered").cast("long"))
    # Within a range of a conversation, then from range to range (of those that are cut in two: fewer than ranges).
    within = Window.partitionBy("conv", "as", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("place", F.count(F.lit(1)).over(within)).withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = made.groupBy("conv", "as", "part").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    before = Window.partitionBy("conv", "as").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv").alias("of"), F.col("as").alias("by"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("chars"))
    offsets = written(offsets.where("turns > 0"))
    same = made["conv"].eqNullSafe(offsets["of"]) & (made["as"] == offsets["by"]) & (made["part"] == offsets["in"])
    moved = made.join(offsets, same, "left").withColumn("place", F.col("place") + F.coalesce("turns", F.lit(0))).withColumn("start", F.col("start") + F.coalesce("chars", F.lit(0)))
    return moved.select(
        F.col("conv").alias(id_col),
        F.col("as").alias("participant"),
        "place",
        "rendered",
        "start",
        (F.col("start") + F.col("size")).alias("end"),
        F.when(F.col("trained"), F.col("start") + F.col("head")).alias("mask_start"),
        F.when(F.col("trained"), F.col("start") + F.col("size") - 1).alias("mask_end"),
    )


def whole(seen: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """id_col, participant, n_turns, n_trained, rendered, mask (array of start, end): perspectives() put together, a row for each participant; a rendering must fit in a row."""
    held = seen.groupBy(id_col, "participant").agg(F.sort_array(F.collect_list(F.struct("place", "rendered", "mask_start", "mask_end"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["mask_start"].isNotNull()), lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")))
    return held.select(id_col, "participant", F.size("turns").cast("long").alias("n_turns"), F.size(mask).cast("long").alias("n_trained"), F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("rendered"), mask.alias("mask"))

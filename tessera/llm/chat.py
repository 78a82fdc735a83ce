"""Chat formatting of dialogues from the side of each participant, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import text_of

SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"
HEADS, USER = {SYSTEM: "<|system|>\n", "assistant": "<|assistant|>\n"}, "<|user name={}|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 512) -> DataFrame:
    """For every participant of every conversation, the dialogue with that speaker as the assistant and the others as
    named users: ``conv, participant, part, at, n_turns, n_own, rendered, mask``.

    A turn is a header line, its text and an end sign; ``mask`` lists the participant's own texts with their end signs
    as start:end in code points of the whole dialogue, comma-joined: what a loss is taken over.  System turns are rendered
    as such and have no view of their own; a conversation of system turns alone has no row.

    A conversation is stored in parts of ``part_turns`` turn numbers, so the turns of a very long one are never in one
    place; what a participant said in any part makes a view of all parts.  ``at`` is where a part's text begins in the
    whole view: parts in order, their texts concatenated and their masks joined (empty ones left out), are one rendering
    with one mask, whatever ``part_turns`` is.  Turns go by number (null first, in part -1),
    then speaker, then text; repeated rows are repeated turns.  A null role is the speaker "unknown", a null text an
    empty one, and a null conversation id one conversation.  Other columns aren't looked at; an empty table gives an
    empty one.
    """
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("speaker"), text_of(text_col).alias("text"))
    part = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / part_turns)
    views = base.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("participant")).distinct()
    # Lengths by part: each turn as another's, and what is less or more where it is the participant's own.
    other = F.when(F.col("speaker") == SYSTEM, len(HEADS[SYSTEM])).otherwise(len(USER.format("")) + F.char_length("speaker"))
    spoken = base.groupBy(F.col("conv").alias("len_conv"), part.alias("len_part"), "speaker").agg(F.sum(other + F.char_length("text") + len(END)).alias("length"), F.sum(len(HEADS["assistant"]) - other).alias("own"))
    whole = spoken.groupBy("len_conv", "len_part").agg(F.sum("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("speaker", "own"))).alias("own"))
    viewed = whole.join(views, F.col("len_conv").eqNullSafe(F.col("of"))).select("len_conv", "len_part", F.col("participant").alias("len_participant"), (F.col("length") + F.coalesce(F.element_at("own", F.col("participant")), F.lit(0))).alias("length"))
    before = F.sum("length").over(Window.partitionBy("len_conv", "len_participant").orderBy("len_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = viewed.select("len_conv", "len_part", "len_participant", F.coalesce(before, F.lit(0)).alias("at"))
    parts = base.groupBy("conv", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))

    def head(t):
        named = F.concat(F.lit(USER.split("{}")[0]), t["speaker"], F.lit(USER.split("{}")[1]))
        return F.when(t["speaker"] == SYSTEM, F.lit(HEADS[SYSTEM])).when(t["speaker"] == F.col("participant"), F.lit(HEADS["assistant"])).otherwise(named)

    def step(state, t):
        start = state["at"] + F.char_length(head(t))
        stop = start + F.char_length(t["text"]) + len(END)
        own = F.concat(start.cast("string"), F.lit(":"), stop.cast("string"))
        return F.struct(stop.alias("at"), F.when(t["speaker"] == F.col("participant"), F.concat(state["mask"], F.array(own))).otherwise(state["mask"]).alias("mask"))

    seen = parts.join(offsets, F.col("conv").eqNullSafe(F.col("len_conv")) & (F.col("part") == F.col("len_part"))).withColumnRenamed("len_participant", "participant")
    mask = F.aggregate("turns", F.struct(F.col("at").alias("at"), F.array().cast("array<string>").alias("mask")), step, lambda state: F.array_join(state["mask"], ","))
    return seen.select(
        F.col("conv").alias(conv_col), "participant", "part", "at", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["speaker"] == F.col("participant"))).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "").alias("rendered"), mask.alias("mask"))

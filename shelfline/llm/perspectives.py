"""Chat formatting by rotating perspectives.

For every participant of a dialogue the whole dialogue is rendered once, with that participant as
the assistant and all others as users who carry their names. Only the assistant's own words are
marked for the loss. System turns belong to nobody and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import split_place
from shelfline.session import stage

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, mask_start, mask_end.

    One row for each turn and each participant of its conversation. rendered is the turn's part of
    the dialogue; the parts follow each other by `turn`. mask_start and mask_end bound the
    characters that count for the loss: the text and its end mark where role is assistant, none
    (both 0) elsewhere.

    Participants are all speakers but `system`. A null speaker is no participant and is rendered
    as a user without a name; a null text is empty. Null conversation ids are one conversation. A
    conversation without participants gives no rows. Texts are not altered. Repeated turns stay.

    The turns meet the list of participants in a join, which splits a conversation of any length;
    no conversation is gathered.
    """
    said = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(speaker).alias("_speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    people = (
        said.filter(F.col("_speaker") != SYSTEM)
        .select(F.col("conv_id").alias("_conv"), F.col("_speaker").alias("perspective"))
        .distinct()
    )
    both = said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("_speaker") == F.col("perspective")
    role = (
        F.when(own, "assistant").when(F.col("_speaker") == SYSTEM, SYSTEM).otherwise("user")
    )
    name = F.when(F.col("role") == "user", F.col("_speaker"))
    head = F.concat(
        F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n")
    )
    masked = F.col("role") == "assistant"
    start = F.char_length("_head")
    return (
        both.withColumn("role", role)
        .withColumn("name", name)
        .withColumn("_head", head)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "role",
            "name",
            F.concat("_head", "_text", F.lit(f"{CLOSE}\n")).alias("rendered"),
            F.when(masked, start).otherwise(0).alias("mask_start"),
            F.when(masked, start + F.char_length("_text") + len(CLOSE)).otherwise(0).alias("mask_end"),
        )
    )


def place_turns(rotated: DataFrame) -> DataFrame:
    """The columns of `rotate`, with place and start: a part's number and offset in its dialogue.

    mask_start + start and mask_end + start bound the mask in the whole dialogue. Null turns come
    first; equal turns are ordered by speaker, null first, and text, the same in every
    perspective. Rows that are the same in these are interchangeable.

    The parts are range partitioned by dialogue and turn, so that a long dialogue is many blocks.
    Only the blocks' sums of a dialogue come together.
    """
    speaker = (
        F.when(F.col("role") == "assistant", F.col("perspective"))
        .when(F.col("role") == SYSTEM, SYSTEM)
        .otherwise(F.col("name"))
    )
    named = F.coalesce(F.char_length("name") + len(" name="), F.lit(0))
    head = F.char_length("role") + named + len(f"{OPEN}\n")
    text = F.substring("rendered", head + 1, F.char_length("rendered"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "perspective", "turn", "_speaker", "_hash")]
    keyed = rotated.withColumns({"_speaker": speaker, "_hash": F.xxhash64(text)})
    rows = stage(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_speaker", "_hash")
        .withColumn("_at", F.monotonically_increasing_id()),
        "turns",
    )
    rows = rows.withColumn("_block", split_place("_at")[0]).withColumn("_n", F.char_length("rendered").cast("bigint"))
    sums = rows.groupBy("conv_id", "perspective", "_block").agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(
        F.col("conv_id").alias("_conv"),
        F.col("perspective").alias("_who"),
        F.col("_block").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_place"),
    )
    block = Window.partitionBy("_block", "conv_id", "perspective").orderBy("_at")
    within = F.coalesce(F.sum("_n").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("perspective") == F.col("_who"))
        & (F.col("_block") == F.col("_of"))
    )
    return (
        rows.withColumns({"_within": within, "_number": F.row_number().over(block) - 1})
        .join(blocks, same)
        .select(
            *rotated.columns,
            (F.col("_place") + F.col("_number")).alias("place"),
            (F.col("_start") + F.col("_within")).alias("start"),
        )
    )


def render_dialogues(turns: DataFrame, **columns: str) -> DataFrame:
    """conv_id, perspective, rendered, masks: each dialogue as one text for each participant.

    masks lists the start and end of what counts for the loss, in characters of the dialogue and
    in its order. `columns` are those of `rotate`. A dialogue is one value, of 2 GB at most.
    """
    part = F.struct("place", "rendered", "start", "mask_start", "mask_end")
    gathered = (
        place_turns(rotate(turns, **columns))
        .groupBy("conv_id", "perspective")
        .agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    )
    own = F.filter("_parts", lambda p: p["mask_end"] > 0)
    return gathered.select(
        "conv_id",
        "perspective",
        F.array_join(F.col("_parts.rendered"), "").alias("rendered"),
        F.transform(
            own,
            lambda p: F.struct(
                (p["start"] + p["mask_start"]).alias("start"), (p["start"] + p["mask_end"]).alias("end")
            ),
        ).alias("masks"),
    )

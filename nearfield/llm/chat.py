"""Chat formatting: one rendering of a dialogue per participant (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns of a block. A dialogue is rendered block by block, so that one of any length never has to
# fit in one row.
BLOCK_TURNS = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NO_ROLE = "unknown"


def _is_one_of(role: Column, fixed: tuple[str, ...]) -> Column:
    return role.isin(*fixed) if fixed else F.lit(False)


def rotate(turns: DataFrame, fixed_roles: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS,
           conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Every dialogue from the perspective of each of its participants, in blocks of turns.

    Returns ``(conv_id, speaker, block, n_turns, n_trained, messages, text, mask)``. In the rendering
    of a speaker, the turns of this speaker are those of ``assistant``; all others are ``user``,
    named after their own speaker; ``fixed_roles`` take no perspective and stay as they are.
    ``messages`` is an array of ``(role, name, text, trained)``, where only the speaker's turns are
    trained; ``text`` is the rendering, and ``mask`` gives its runs in order as ``length:0`` or
    ``length:1`` (characters; 1 for the speaker's words and the closing mark after them). Blocks of
    a dialogue in order make up the whole of it.

    Turns are ordered by number, then role and text; a null turn stands in block -1. A null text is
    empty, a null role is the participant ``unknown``, rows without a dialogue id are left out,
    repeated rows are repeated turns, and a dialogue of fixed roles only has no rows. Columns not
    named are not read.

    Turns are gathered per dialogue and block, never per dialogue, and only then meet the
    participants (one row per dialogue and role).
    """
    block = F.coalesce(F.floor(turns[turn_col].cast("long") / block_turns), F.lit(-1)).cast("long")
    rows = turns.filter(turns[conv_col].isNotNull()).select(
        turns[conv_col].cast("long").alias("conv_id"), block.alias("block"),
        F.struct(
            turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col], F.lit(NO_ROLE)).alias("who"),
            F.coalesce(turns[text_col], F.lit("")).alias("said"),
        ).alias("t"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    people = rows.filter(~_is_one_of(F.col("t.who"), fixed_roles)).select(
        F.col("conv_id").alias("of"), F.col("t.who").alias("speaker")).distinct()
    speaker = F.col("speaker")

    def message(t: Column) -> Column:
        own = t.who == speaker
        role = F.when(own, F.lit("assistant")).when(_is_one_of(t.who, fixed_roles), t.who).otherwise(F.lit("user"))
        name = F.when(~own & ~_is_one_of(t.who, fixed_roles), t.who)
        return F.struct(role.alias("role"), name.alias("name"), t.said.alias("text"), own.alias("trained"))

    def head(m: Column) -> Column:
        return F.concat(F.lit(OPEN), m["role"], F.coalesce(F.concat(F.lit(" name="), m["name"]), F.lit("")), F.lit("\n"))

    def runs(m: Column) -> Column:
        body = F.length(m["text"]) + F.lit(len(CLOSE))
        return F.concat(F.length(head(m)), F.lit(":0,"), body, F.lit(":"), m["trained"].cast("int"))

    seen = blocks.join(people, F.col("conv_id") == F.col("of")).select(
        "conv_id", "speaker", "block", F.transform("turns", message).alias("messages"))
    return seen.select(
        "conv_id", "speaker", "block", F.size("messages").cast("long").alias("n_turns"),
        F.size(F.filter("messages", lambda m: m["trained"])).cast("long").alias("n_trained"), "messages",
        F.concat_ws("", F.transform("messages", lambda m: F.concat(head(m), m["text"], F.lit(CLOSE)))).alias("text"),
        F.concat_ws(",", F.transform("messages", runs)).alias("mask"))


def op2_perspectives(conversations: DataFrame) -> DataFrame:
    return rotate(conversations).drop("messages")


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(floor(turn / {BLOCK_TURNS})::BIGINT, -1) AS block, turn,
         coalesce(role, '{NO_ROLE}') AS who, coalesce(text, '') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
m AS (
  SELECT conv_id, speaker, block, turn, who, said, (who = speaker)::INTEGER AS trained,
         '{OPEN}' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system'
                          ELSE 'user name=' || who END || chr(10) AS head
  FROM t JOIN p USING (conv_id))
SELECT conv_id, speaker, block, count(*) AS n_turns, sum(trained)::BIGINT AS n_trained,
       string_agg(head || said || '{CLOSE.strip()}' || chr(10), '' ORDER BY turn, who, said) AS text,
       string_agg(length(head) || ':0,' || (length(said) + {len(CLOSE)}) || ':' || trained, ','
                  ORDER BY turn, who, said) AS mask
FROM m GROUP BY conv_id, speaker, block"""

"""Chat formatting: every dialogue from the perspective of each of its participants.

For each speaker of a conversation the dialogue is rendered with that speaker as
the assistant and the others as users with their names; system turns stay as they
are. A mask marks the characters that a model is trained on: the content of the
assistant's turns.

Built-in functions only. A rendering comes in chunks of TURNS_PER_CHUNK turn
numbers, so that no row holds more of a very long conversation than that; the
chunks of a conversation in order are the whole rendering, and mask spans count
from the chunk's begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers in one row of a rendering.
TURNS_PER_CHUNK = 256

#: How a turn is written.
TURN_START, TURN_END = "<|turn|>", "<|end|>\n"
SYSTEM = "system"


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per_chunk: int = TURNS_PER_CHUNK) -> DataFrame:
    """(conv_id, speaker, chunk, n_turns, n_trained, text, mask): a row for each participant and chunk.

    ``mask`` lists the [begin, end) character spans of the speaker's own turns.
    Turns are in order of turn number, role and text; a row that repeats another is one
    turn. A null text counts as empty; rows with a null conversation are left out; a null
    role is the participant "unknown"; a null turn number comes first, in chunk
    -1. A conversation of system turns only has no participant and no rows.
    Other columns are not looked at.
    """
    rows = (
        turns.where(F.col(conv_col).isNotNull())
        .select(
            F.col(conv_col).alias("conv_id"),
            F.coalesce(F.floor(F.col(turn_col) / per_chunk), F.lit(-1)).cast("long").alias("chunk"),
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(role_col, F.lit("unknown")).alias("role"),
            F.coalesce(text_col, F.lit("")).alias("text"),
        )
        .distinct()
    )
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # nulls last by default; a null turn has a chunk of its own, so order within it is by role and text
    return chunks.join(speakers, "conv_id").transform(_render)


def _render(pairs: DataFrame) -> DataFrame:
    me = F.col("speaker")

    def head(t):
        name = F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).when(t["role"] == me, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(TURN_START), name, F.lit("\n"))

    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(head(t), t["text"], F.lit(TURN_END)).alias("whole"),
            F.length(head(t)).alias("lead"),
            F.length(t["text"]).alias("size"),
            (t["role"] == me).alias("own"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))
    mask = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["whole"])).alias("at"),
            F.when(p["own"], F.array_append(acc["spans"], F.array(acc["at"] + p["lead"], acc["at"] + p["lead"] + p["size"]))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return pairs.withColumn("parts", parts).select(
        "conv_id",
        "speaker",
        "chunk",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: p["whole"]), "").alias("text"),
        mask.alias("mask"),
    )


#: The same over the view ``conversations`` in DuckDB; spans are written as text.
PERSPECTIVES_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, COALESCE(CAST(FLOOR(turn / 256.0) AS BIGINT), -1) AS chunk, turn,
         COALESCE(role, 'unknown') AS role, COALESCE(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
seen AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
shown AS (
  SELECT conv_id, speaker, chunk, turn, role, text, role = speaker AS own,
         '<|turn|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM turns JOIN seen USING (conv_id)),
placed AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS whole,
         COALESCE(SUM(LENGTH(head || text || '<|end|>' || chr(10))) OVER (
           PARTITION BY conv_id, speaker, chunk ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + LENGTH(head) AS pos
  FROM shown)
SELECT conv_id, speaker, chunk, COUNT(*) AS n_turns, COUNT(*) FILTER (WHERE own) AS n_trained,
       STRING_AGG(whole, '' ORDER BY turn, role, text) AS text,
       COALESCE(STRING_AGG(CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + LENGTH(text) AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, chunk
"""

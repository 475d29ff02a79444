"""Chat formatting by perspective rotation: each participant in turn becomes the assistant. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control marks of the template; the opening pair is broken up where it occurs in a turn's text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: This speaker keeps its role in every perspective and takes no perspective of its own.
SYSTEM = "system"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row per conversation, participant and turn, from (conv_id, turn, role, text).

    In a row the participant speaks as the assistant, all others as named users; `loss` marks its own turns and
    [mask_start, mask_end) is the trainable span of `rendered` (empty for other speakers). Concatenating `rendered`
    in order of (turn, role, text) gives the whole dialogue; rows stay apart so that no dialogue has to fit one task.
    A null role is the speaker `unknown`, a null text is empty, a null conversation id forms a conversation of its
    own, repeated turns each give their row; a conversation with system turns alone has no perspective and no rows, nor
    has an empty table. Control marks and line ends in names and texts are broken up, so neither can forge a turn. Long
    texts are rendered whole. Other columns aren't read, whatever their names.
    """
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        clean(F.coalesce("text", F.lit(""))).alias("body"),
    )
    people = t.filter(F.col("speaker") != SYSTEM).groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("people"))
    people = people.select(F.col("conv_id").alias("_c"), "people")
    rows = t.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "turn", "speaker", "body", F.explode("people").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit(f"{OPEN}assistant\n"))
        .when(F.col("speaker") == SYSTEM, F.lit(f"{OPEN}system\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), clean(F.translate("speaker", "\n\r", "  ")), F.lit("\n")))
    )
    rows = rows.select("conv_id", "perspective", "turn", "speaker", own.alias("loss"), head.alias("_h"), "body")
    rendered = F.concat("_h", "body", F.lit(f"{CLOSE}\n"))
    start = F.when(F.col("loss"), F.length("_h")).otherwise(0)
    end = F.when(F.col("loss"), F.length("_h") + F.length("body") + len(CLOSE)).otherwise(0)
    return rows.select("conv_id", "perspective", "turn", "speaker", "loss", rendered.alias("rendered"), start.cast("long").alias("mask_start"), end.cast("long").alias("mask_end"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.conv_id, perspective, turn, speaker, body, speaker = perspective AS loss,
 CASE WHEN speaker = perspective THEN '{OPEN}assistant' WHEN speaker = '{SYSTEM}' THEN '{OPEN}system' ELSE '{OPEN}user name=' || replace(translate(speaker, chr(10) || chr(13), '  '), '<|', '< |') END || chr(10) AS h
 FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, turn, speaker, loss, h || body || '{CLOSE}' || chr(10) AS rendered,
 CAST(CASE WHEN loss THEN length(h) ELSE 0 END AS BIGINT) AS mask_start,
 CAST(CASE WHEN loss THEN length(h) + length(body) + {len(CLOSE)} ELSE 0 END AS BIGINT) AS mask_end FROM r"""

"""Multi-party perspective rotation: one training text per conversation and speaker.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant and
the others as named users; only the assistant's words (and the end marker after them) are trained
on.  `spans` holds those character ranges, `mask` the same as run lengths.

A conversation is rendered whole, whatever its turn numbers are, so a task holds the longest conversation
once per participant.  One shuffle, by conversation; SQL functions only.

Defined results: rows repeated in all of conversation, turn, role and text are one turn; other rows of
the same turn follow each other by role, then text; a null role is the speaker `unknown`, a null text is empty, a null
turn comes first (as turn -1); a row without conv_id belongs to no dialogue that can be told, so it is one of its own.
`system` turns are context for every participant and never a perspective; a conversation without participants gives no row.  Marker texts
inside a turn or a role are escaped, line breaks of a role are spaces in its header.  Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import table

CONTEXT_ROLE = "system"


def _shown(role):
    """A role as it stands in a header: it can neither end the header nor open another."""
    return F.replace(F.replace(F.translate(role, "\r\n", "  "), F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, n_trained (characters), text, mask, spans."""
    clean = turns.select(
        F.col("conv_id"),
        F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("body"),
    )
    alone = F.when(F.col("conv_id").isNull(), F.struct("turn", "role", "body"))
    dialogues = clean.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_set(F.struct("turn", "role", "body"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.col("turns.role"), lambda r: r != CONTEXT_ROLE)))
    views = dialogues.select("conv_id", "turns", F.explode(speakers).alias("perspective"))

    def piece(t):
        own = t["role"] == F.col("perspective")
        head = (
            F.when(own, F.lit("<|assistant|>\n"))
            .when(t["role"] == CONTEXT_ROLE, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), _shown(t["role"]), F.lit("|>\n")))
        )
        body = F.concat(t["body"], F.lit("<|end|>"))
        return F.struct(own.alias("own"), head.alias("head"), body.alias("body"))

    views = views.withColumn("pieces", F.transform("turns", piece)).drop("turns")

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        here = F.concat(start.cast("string"), F.lit(":"), stop.cast("string"))
        spans = F.when(p["own"], F.concat(acc["spans"], F.array(here))).otherwise(acc["spans"])
        trained = acc["n"] + F.when(p["own"], F.length(p["body"])).otherwise(0)
        return F.struct((stop + 1).alias("at"), trained.alias("n"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("spans"))
    views = views.withColumn("walk", F.aggregate("pieces", zero, step))
    mask = F.transform(
        "pieces",
        lambda p: F.concat(
            F.lit("0x"), F.length(p["head"]).cast("string"), F.when(p["own"], F.lit(" 1x")).otherwise(F.lit(" 0x")), F.length(p["body"]).cast("string")
        ),
    )
    return views.select(
        "conv_id",
        "perspective",
        F.size("pieces").cast("long").alias("n_turns"),
        F.col("walk.n").cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "\n").alias("text"),
        F.array_join(mask, " ").alias("mask"),
        F.array_join("walk.spans", ",").alias("spans"),
    )


def op4_chat_rotation(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat_rotation": op4_chat_rotation}
ORACLE_SQL = {
    "op4_chat_rotation": r"""
        WITH t AS (
          SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
                 replace(coalesce(text, ''), '<|', '<\|') AS body FROM conversations),
        p AS (SELECT *, CASE WHEN conv_id IS NULL THEN {'turn': turn, 'role': role, 'body': body} END AS alone FROM t),
        v AS (SELECT DISTINCT conv_id, alone, role AS perspective FROM p WHERE role <> 'system'),
        x AS (
          SELECT v.conv_id, v.alone, v.perspective, p.turn, p.role, p.body || '<|end|>' AS body, p.role = v.perspective AS own,
                 CASE WHEN p.role = v.perspective THEN '<|assistant|>' || chr(10)
                      WHEN p.role = 'system' THEN '<|system|>' || chr(10)
                      ELSE '<|user name=' || replace(replace(translate(p.role, chr(13) || chr(10), '  '), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10) END AS head
          FROM v JOIN p ON v.conv_id IS NOT DISTINCT FROM p.conv_id AND v.alone IS NOT DISTINCT FROM p.alone),
        y AS (
          SELECT *, sum(length(head) + length(body) + 1) OVER (
                      PARTITION BY conv_id, alone, perspective ORDER BY turn, role, body ROWS UNBOUNDED PRECEDING) AS upto FROM x)
        SELECT conv_id, perspective, count(*)::BIGINT AS n_turns,
               sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS n_trained,
               string_agg(head || body, chr(10) ORDER BY turn, role, body) AS text,
               string_agg('0x' || length(head) || CASE WHEN own THEN ' 1x' ELSE ' 0x' END || length(body), ' ' ORDER BY turn, role, body) AS mask,
               string_agg(CASE WHEN own THEN (upto - 1 - length(body))::BIGINT || ':' || (upto - 1)::BIGINT END, ',' ORDER BY turn, role, body) AS spans
        FROM y GROUP BY conv_id, alone, perspective
    """
}

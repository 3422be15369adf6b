"""Chat formatting by relational expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged into blocks
with an array aggregation, and the blocks are concatenated:

    <|turn|>role<|text|>text<|next|>text of the same role<|end|>

Escaping is reversible: in texts and roles every ``<|`` and every ``</s>``-like or bracketed control string
is broken by ESCAPE after its first character, and ESCAPE itself is doubled, so that no control string of
this or of another common template is left inside a text. The loss mask is a list of (start, length) in code
points over the formatted text; it covers each assistant text once and no marker.

Scale: one shuffle by conversation with map-side collection; no Python. A conversation becomes one row, so
memory follows the longest conversation.

Edge cases: null text is empty; a null role is the empty role; a null conv_id is a conversation of its own;
turns order by (turn with nulls first, role, text), so repeated rows and equal turn numbers give one result;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
ESCAPE = "\\"
#: First characters of control strings of this and of other templates: markers never survive in a text.
OPENERS = ("<", "[")


def escaped(text: Column) -> Column:
    """text with ESCAPE doubled and every opener followed by ESCAPE; unescaped() undoes it."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for opener in OPENERS:
        out = F.replace(out, F.lit(opener), F.lit(opener + ESCAPE))
    return out


def unescaped(text: Column) -> Column:
    """The openers' ESCAPE goes first: after an opener there is always exactly one that belongs to it."""
    out = text
    for opener in reversed(OPENERS):
        out = F.replace(out, F.lit(opener + ESCAPE), F.lit(opener))
    return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def merged(rows: DataFrame) -> DataFrame:
    """conv_id and blocks: array of (role, texts), one for each run of adjacent turns with one role."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns, opens = F.col("turns"), F.col("opens")
    is_open = lambda i: F.coalesce(F.get(turns, i - 1)["role"] != turns[i]["role"], F.lit(True))
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn("opens", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), is_open))
        .select(
            "conv_id",
            F.transform(
                opens,
                lambda at, k: F.struct(
                    turns[at]["role"].alias("role"),
                    F.transform(F.slice(turns, at + 1, F.coalesce(F.get(opens, k + 1), F.size(turns)) - at), lambda t: t["text"]).alias("texts"),
                ),
            ).alias("blocks"),
        )
    )


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask (array of start, length) for each conversation."""
    safe = merged(rows).select(
        "conv_id",
        F.transform(
            "blocks",
            lambda b: F.struct(escaped(b["role"]).alias("role"), F.transform(b["texts"], escaped).alias("texts"), (b["role"] == loss_role).alias("loss")),
        ).alias("blocks"),
    )
    span = "array<struct<start:bigint,length:bigint>>"
    mask = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast(span).alias("mask"))

    def over_text(state: Column, text: Column) -> Column:
        length = F.length(text).cast("long")
        one = F.array(F.struct(state["at"].alias("start"), length.alias("length")))
        return F.struct((state["at"] + length + len(NEXT)).alias("at"), F.concat(state["mask"], one).alias("mask"))

    def over_block(state: Column, b: Column) -> Column:
        begin = state["at"] + len(TURN) + F.length(b["role"]) + len(TEXT)
        inner = F.aggregate(b["texts"], mask(begin), over_text)
        spans = F.when(b["loss"], F.concat(state["mask"], inner["mask"])).otherwise(state["mask"])
        return F.struct((inner["at"] - len(NEXT) + len(END)).alias("at"), spans.alias("mask"))

    text = lambda b: F.concat(F.lit(TURN), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))
    return safe.select(
        "conv_id",
        F.array_join(F.transform("blocks", text), "").alias("formatted"),
        F.aggregate("blocks", mask(F.lit(0)), over_block, lambda state: state["mask"]).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, "<[|]turn[|]>"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substring_index(b, END, 1), "<[|]text[|]>"))
    turns = F.transform(parts, lambda p: F.transform(F.split(p[1], "<[|]next[|]>"), lambda x: F.struct(unescaped(p[0]).alias("role"), unescaped(x).alias("text"))))
    return F.flatten(turns)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    out = format_conversations(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS joins
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT conv_id, turn, role, text, joins, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS x,
         replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') AS y FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length(x) + CASE WHEN joins THEN 8 ELSE 16 + length(y) + 7 END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

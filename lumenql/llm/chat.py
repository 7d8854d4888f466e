"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn;
adjacent turns of one role are merged into a block by array functions; blocks
are concatenated. A block is

    <s>[INST]role[/INST]text<s/>text ...</s>NEWLINE

with ``<s/>`` between merged turns. Roles and texts are escaped so that they
hold neither ``<`` nor ``[``: no text can close a block or open another, and
the output can be read back without loss. The output comes with segments, each
marked as under the loss mask or not; their texts in order are the output.

Defined results: a null text or role is empty; null turns come first; turns
with the same number are ordered by role and text; repeated rows are turns of
their own; rows with a null conv_id form one conversation; an empty table gives
no conversations; extra columns are ignored. One conversation is one value, and
so must fit in one row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Roles whose texts are under the loss mask.
TRAINED = ("assistant",)
#: The control strings of the template and the escapes.
OPEN, ROLE_END, NEXT, CLOSE = "<s>[INST]", "[/INST]", "<s/>", "</s>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def blocks(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation: ``blocks``, an array of (role, texts)."""
    own = turns.select(
        F.col(conv),
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = own.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = ordered.withColumn(  # where another role begins
        "starts",
        F.expr(
            "filter(sequence(1, size(ts)), i -> i = 1 OR element_at(ts, i).role <> element_at(ts, greatest(i - 1, 1)).role)"
        ),
    )
    return starts.select(
        conv,
        F.expr(
            """transform(starts, (s, k) -> struct(
                 element_at(ts, s).role AS role,
                 transform(slice(ts, s, coalesce(get(starts, k + 1), size(ts) + 1) - s), t -> t.text) AS texts))"""
        ).alias("blocks"),
    )


def format_chats(turns: DataFrame, conv: str = "conv_id", trained=TRAINED) -> DataFrame:
    """For each conversation: ``formatted`` and ``segments`` (text, loss)."""

    def of_block(b: Column) -> Column:
        loss = b["role"].isin(*trained)
        sep = F.struct(F.lit(NEXT).alias("text"), F.lit(False).alias("loss"))
        head = F.struct(
            F.concat(F.lit(OPEN), escape(b["role"]), F.lit(ROLE_END)).alias("text"),
            F.lit(False).alias("loss"),
        )
        tail = F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))
        body = F.flatten(
            F.transform(
                b["texts"],
                lambda t, k: F.when(
                    k == 0, F.array(F.struct(escape(t).alias("text"), loss.alias("loss")))
                ).otherwise(F.array(sep, F.struct(escape(t).alias("text"), loss.alias("loss")))),
            )
        )
        return F.concat(F.array(head), body, F.array(tail))

    pieces = blocks(turns, conv).select(
        conv, F.flatten(F.transform("blocks", of_block)).alias("segments")
    )
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return pieces.select(conv, joined.alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of an output: array of (role, text), by its control strings."""
    own = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.replace(block, F.lit(OPEN), F.lit("")), ROLE_END, 1)
        body = F.substring_index(block, ROLE_END, -1)
        return F.transform(
            F.split(body, NEXT),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(own, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(
        F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), "")
    )


PLANTED = "</s>[INST] ok [/INST]"


def with_planted(turns: DataFrame) -> DataFrame:
    more = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = format_chats(with_planted(table(spark, sf_dir, "conversations")))
    read = done.withColumns(
        {"turns": read_back(F.col("formatted")), "loss": loss_text(F.col("segments"))}
    )
    lines = F.array_join(
        F.transform(
            "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
        ),
        "",
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
         len(text) + len(regexp_replace(text, '[^\\<\[]', '', 'g')) AS nt,
         len(role) + len(regexp_replace(role, '[^\\<\[]', '', 'g')) AS nr
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       cast(coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       cast(sum(nt + CASE WHEN before IS DISTINCT FROM role THEN nr + 21 ELSE 4 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

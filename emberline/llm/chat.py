"""Chat formatting, in Spark expressions only.

A conversation's turn structs are collected and sorted, neighbours of one role
are merged by array functions, and each block becomes::

    <s>[role]\\ntext<+>text</s>\\n

``<+>`` parts merged turns. ``< [ ] \\`` inside roles and texts are written
``\\l \\q \\p \\b``, so no text can hold a control string, and unescaping gives
back every turn exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

OPEN, HEAD_END, JOIN, END = "<s>[", "]\n", "<+>", "</s>\n"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\q"), ("]", "\\p")]


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):  # the backslash itself comes last
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_runs``.

    ``loss_runs`` covers ``formatted`` from its first character: an array of
    ``(learn, chars)`` runs, ``learn`` true over the texts of ``loss_role`` only
    (headers, separators and ends are never learned).

    Null roles and texts count as empty, a null conversation id is one
    conversation, null turns come first, rows that tie on ``turn`` go by role
    and text, repeated rows all stay, other columns are ignored, and an empty
    table gives no rows. A conversation is one output value, so its turns meet
    in one row; nothing else is gathered."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # islands of one role: their first indexes, then one slice per island
    heads = sorted_turns.withColumn("heads", F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])))
    merged = heads.select("conv_id", F.transform("heads", lambda h, k: F.struct(
        escape(F.element_at("turns", h)["role"]).alias("role"),
        F.element_at("turns", h)["role"].alias("plain"),
        F.transform(F.slice("turns", h, F.coalesce(F.get("heads", k + 1), F.size("turns") + 1) - h),
                    lambda x: escape(x["text"])).alias("texts"))).alias("blocks"))

    def run(learn, chars):
        return F.struct(learn.alias("learn"), chars.cast("long").alias("chars"))

    def block_runs(b):
        learn = b["plain"] == F.lit(loss_role)
        head = run(F.lit(False), F.length(b["role"]) + F.lit(len(OPEN) + len(HEAD_END)))
        bodies = F.flatten(F.transform(b["texts"], lambda x, i: F.array(
            run(F.lit(False), F.when(i > 0, F.lit(len(JOIN))).otherwise(F.lit(0))), run(learn, F.length(x)))))
        return F.concat(F.array(head), bodies, F.array(run(F.lit(False), F.lit(len(END)))))

    return merged.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(
            F.lit(OPEN), b["role"], F.lit(HEAD_END), F.array_join(b["texts"], JOIN), F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("blocks", block_runs)).alias("loss_runs"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, "</s>\n", -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, HEAD_END, -1), r"<\+>", -1),
        lambda x: F.struct(unescape(F.substring(F.substring_index(b, HEAD_END, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
                           unescape(x).alias("text")))))


def masked_texts(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, in order, unescaped."""
    ends = F.transform(runs, lambda r, i: F.struct(
        r["learn"].alias("learn"), r["chars"].alias("chars"),
        F.aggregate(F.slice(runs, 1, i), F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("start")))
    learned = F.filter(ends, lambda r: r["learn"])
    return F.transform(learned, lambda r: unescape(
        F.substring(formatted, (r["start"] + 1).cast("int"), r["chars"].cast("int"))))


PROBE_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written, read back
    from the written strings and digested."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE_TEXT).alias("text"))
    out = staged(format_chat(conv.unionByName(probe)), "chat")
    back = out.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"),
                      F.array_join(masked_texts(F.col("formatted"), F.col("loss_runs")), "").alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER w AS before,
    length(role) + length(role) - length(translate(role, '\<[]', '')) AS role_chars,
    length(text) + length(text) - length(translate(text, '\<[]', '')) AS text_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before IS NULL OR before <> role THEN role_chars + 11 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

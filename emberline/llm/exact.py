"""Exact dedup by progressive refinement, in DataFrame functions only.

Length first, then a hash of the first characters, then the hash of the whole
text. Each step looks only at rows whose group of the step before has more
than one row, so full contents are grouped only where a copy is still possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, read_table, staged

PREFIX_CHARS = 256
# Lengths from here on share one class of the first step (they only lose its
# shortcut), so the table of lengths has at most this many rows.
LENGTH_CLASSES = 1 << 18


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest id among equal normalised texts. Null texts are
    empty texts (and equal to each other), null ids never become a ``keep_id``
    unless the whole group has none, rows that repeat an id share its decision,
    other columns are ignored, an empty table gives no rows.

    1. count rows by length (partial sums; at most LENGTH_CLASSES groups);
    2. rows of lengths met twice: count by (length, prefix hash);
    3. rows of (length, prefix) met twice: group by the hash of the full text.

    A group holding a third of all rows is counted by partial aggregates and
    joined back by broadcast (see ``attach_groups``); texts never shuffle, only
    the scan reads them."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    brief = staged(text.select(
        F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("head")), "lengths")
    total = brief.count()
    cls = F.least("len", F.lit(LENGTH_CLASSES - 1)).alias("cls")
    met = brief.groupBy(cls).agg(F.count("*").alias("n")).where("n > 1").select("cls")
    heads = staged(
        brief.withColumn("cls", F.least("len", F.lit(LENGTH_CLASSES - 1)))
        .join(F.broadcast(met), "cls", "left_semi")
        .groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1"), "heads")
    rows = staged(text.select(
        "doc_id", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("head"),
        F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")), "digests")
    survivors = attach_groups(rows, heads, ["len", "head"], "n", total, "inner")
    groups = staged(survivors.groupBy("len", "head", "sha").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    out = attach_groups(rows, groups, ["len", "head", "sha"], "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents, dropped rows included."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

"""Reading the driver tables: one parquet file per table under ``sf_dir``.

Queries select the columns they need right after the scan so the parquet
reader only decodes those (``ReadSchema`` in the plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

# Fixed value: turns per conversation must stay below this for prompt ids.
TURN_SPAN = 1_000_000


# Tables whose rows carry long texts: tokenising them is CPU-heavy.
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's scan; text tables are spread over all cores when the file
    has fewer splits than cores (planning only, no job; column pruning still
    reaches the scan through the round-robin exchange)."""
    if name not in TABLES:
        raise KeyError(name)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def keys_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The key column of a table in its files' order, not spread: a narrow scan
    that an index can use as it is when the files are in key order."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(key)


def doc_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a prompt: ``(prompt_id = doc_id, prompt = text)``."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns shaped as prompt records: a user turn fills ``text``,
    a system turn fills ``prompt``, an assistant turn fills neither (empty
    string / null), so P1 and P3 both have work to do. ``prompt_id`` is the
    turn's key ``conv_id * TURN_SPAN + turn``, monotone in (conv_id, turn)."""
    conv = table(spark, sf_dir, "conversations")
    turn = F.when(F.col("turn") < TURN_SPAN, F.col("turn")).otherwise(F.raise_error(F.lit("turn out of range")))
    return conv.select(
        (F.col("conv_id") * F.lit(TURN_SPAN) + turn).cast("long").alias("prompt_id"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("text"),
        F.when(F.col("role") == "system", F.col("text")).alias("prompt"),
    )

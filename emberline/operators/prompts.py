"""Prompt choice, filtering and first-K."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy_string


def choose_prompt(df: DataFrame, text_col: str = "text", prompt_col: str = "prompt") -> DataFrame:
    """P1, row level: ``text`` when truthy, else ``prompt``; an empty string
    falls through, a blank string such as ``" "`` is kept."""
    chosen = F.coalesce(truthy_string(F.col(text_col)), truthy_string(F.col(prompt_col)))
    keep = [c for c in df.columns if c not in (text_col, prompt_col)]
    return df.select(*keep, chosen.alias("prompt"))


def choose_prompt_column(df: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """P2, column level: the whole table uses ``text`` when that column exists,
    else ``prompt``; a table with neither is an error."""
    if "text" in df.columns:
        src = "text"
    elif "prompt" in df.columns:
        src = "prompt"
    else:
        raise ValueError("Batch must contain 'text' or 'prompt'")
    return df.select(F.col(id_col), F.col(src).alias("prompt"))


def drop_empty(df: DataFrame) -> DataFrame:
    """Rows where neither field gave a prompt are dropped, not failed."""
    return df.filter(F.col("prompt").isNotNull())


def first_k(df: DataFrame, k: int | None, key: str = "prompt_id") -> DataFrame:
    """L1 / L2: first ``k`` rows by ``key`` (TakeOrderedAndProject: each task
    keeps its own top ``k``, so only ``k`` rows per task cross the network).
    ``0``/``None`` means no limit."""
    if not k:
        return df
    return df.orderBy(key).limit(k)


def limit_raw(df: DataFrame, k: int | None, key: str = "prompt_id") -> DataFrame:
    """L2: first ``k`` raw records, taken *before* the prompt choice and the
    empty filter (so fewer than ``k`` prompts may remain)."""
    return first_k(df, k, key)


def head_per_split(df: DataFrame, n: int, split_col: str = "split", key: str = "vec_id") -> DataFrame:
    """L3: first ``n`` rows of each split by ``key``. Spark plans a
    WindowGroupLimit below the shuffle, so each task ships at most ``n`` rows
    per split even when a split holds most of the table."""
    w = Window.partitionBy(split_col).orderBy(key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")

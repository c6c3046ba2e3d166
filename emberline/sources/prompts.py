"""Prompt sources (S1, S4) and file-order line numbering.

A prompt file has one JSON object per line with a ``text`` and/or ``prompt``
key. Lines that hold only white space (as Python's ``strip`` sees it) are
skipped; any other line that is not a JSON object fails the job. The reader
keeps ``prompt_id`` = 0-based line number in file order (files sorted by
path), so outputs can be joined back and first-K means the same thing on any
cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_non_blank
from ..session import has_at_most, prepare, scratch_path

# Rows of a split table that are broadcast (about 100 bytes each).
SPLIT_ROWS = 2_000_000

PROMPT_FIELDS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("prompt", T.StringType()),
])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no long, value string)`` for every line of the text files under
    ``path``, numbered in file order without shuffling the lines.

    Each file split's lines are consecutive in ``monotonically_increasing_id``;
    a per-split table (count, first id) ordered by (file, block start) gives
    each split its offset. It is counted once and stored, and broadcast while
    it is proven to be within SPLIT_ROWS (128 MB splits: over 200 TB), so the
    lines do not shuffle. A line whose split is not in the table (a scan cut
    otherwise) fails the job."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = raw.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"))
    # One row per file split: ordered over the split table only.
    w = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_block", "_mid0",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    stored = scratch_path(spark, "splits")
    offsets.write.parquet(stored)
    table = spark.read.parquet(stored)
    if has_at_most(table, SPLIT_ROWS):
        table = F.broadcast(table)
    lines = raw.join(table, ["_file", "_block"], "left")
    at = F.col("_off") + F.col("_mid") - F.col("_mid0")
    return lines.select(
        F.when(at.isNull(), F.raise_error(F.lit("text split without an offset")).cast("long")).otherwise(at).alias("line_no"),
        F.col("value"),
    )


# A line that is one JSON value stays whole between brackets and between braces; a line that
# closes either of them early, or goes on after its value, breaks at least one of the two.
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
VARIANTS = "struct<text: variant, prompt: variant>"


def _strict_fields(lines: DataFrame) -> DataFrame:
    """``(line_no, value, text, prompt, problem)`` of lines, by the rules of a
    strict parser and as JVM expressions; ``problem`` is null for a good line.

    A line is read as the only element of a list and as the only field of an
    object, so text after the value, a list, ``null`` or a bare value do not
    pass. Fields are variants: they keep their JSON type, and a repeated key's
    last value counts. A field must be a string, null or missing."""
    value = F.col("value")
    read = lines.select(
        "line_no", "value",
        F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"array<{VARIANTS}>", STRICT).alias("_list"),
        F.from_json(F.concat(F.lit('{"line":'), value, F.lit("}")), "line struct<_none: string>", STRICT).alias("_inside"))
    kinds = read.select("line_no", "value", F.get("_list", F.lit(0)).alias("_r"), (
        (F.size("_list") == 1) & F.get("_list", F.lit(0)).isNotNull() & F.col("_inside.line").isNotNull()).alias("_whole")).withColumns(
        {f"_kind_{name}": F.schema_of_variant(f"_r.{name}") for name in ("text", "prompt")})
    problem = F.when(F.coalesce("_whole", F.lit(False)), F.lit(None)).otherwise(F.lit("not a JSON object"))
    for name in ("text", "prompt"):
        kind = F.col(f"_kind_{name}")
        problem = F.coalesce(problem, F.when(~kind.isin("STRING", "VOID"), F.lit(f"'{name}' is not a string")))
    return kinds.select("line_no", "value", *[
        F.when(F.col(f"_kind_{name}") == "STRING", F.variant_get(f"_r.{name}", "$", "string")).alias(name)
        for name in ("text", "prompt")], problem.alias("problem"))


def bad_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, value, problem)`` of the non-blank lines a strict read rejects."""
    found = _strict_fields(lines.filter(is_non_blank("value")))
    return found.where("problem is not null").select("line_no", "value", "problem")


def read_prompt_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``(prompt_id, text, prompt)`` for every non-blank line, before the
    prompt choice. The default reads a field of any type as text; ``strict``
    fails the job at a line with text after its object, a list, ``null``, or a
    ``text`` or ``prompt`` that is not a string (see ``bad_lines`` for a report).
    Both parse in the JVM."""
    lines = read_lines(spark, path).filter(is_non_blank("value"))
    prepare(spark)
    if strict:
        # every column stands behind the check, so no filter or projection above leaves it out
        failed = F.raise_error(F.concat(F.lit("Malformed prompt line "), F.col("line_no").cast("string"), F.lit(": "), F.col("problem")))
        bad = F.col("problem").isNotNull()
        return _strict_fields(lines).select(
            F.when(bad, failed.cast("long")).otherwise(F.col("line_no")).alias("prompt_id"),
            *[F.when(bad, failed.cast("string")).otherwise(F.col(name)).alias(name) for name in ("text", "prompt")])
    rec = F.from_json("value", PROMPT_FIELDS, {"mode": "FAILFAST"})
    return lines.select(
        F.col("line_no").alias("prompt_id"),
        F.when(rec.isNull(), F.raise_error(F.concat(F.lit("Malformed prompt line "), F.col("line_no").cast("string"))))
        .otherwise(rec).alias("_r"),
    ).select("prompt_id", "_r.text", "_r.prompt")


def read_prompts(spark: SparkSession, path: str, max_prompts: int | None = None, strict: bool = False) -> DataFrame:
    """S1 + P1 + P3 + L1: ``(prompt_id, prompt)`` of usable prompts in file
    order; ``max_prompts`` counts usable prompts, ``0``/``None`` = all."""
    from ..operators.prompts import choose_prompt, drop_empty, first_k

    df = drop_empty(choose_prompt(read_prompt_records(spark, path, strict)))
    if max_prompts:
        df = first_k(df, max_prompts)
    return df


def require_rows(df: DataFrame, message: str = "No prompts loaded") -> DataFrame:
    """S4 guard: fail fast when the table is empty (one short job)."""
    if df.isEmpty():
        raise RuntimeError(message)
    return df


def prompt_count(df: DataFrame) -> DataFrame:
    """S4 count as a one-row table (``n_prompts``)."""
    return df.agg(F.count(F.lit(1)).alias("n_prompts"))


def observe_count(df: DataFrame, name: str = "prompts"):
    """S4 without a second scan: attach an ``Observation`` that counts rows as
    they flow through the job's own action. Returns ``(df, observation)``;
    after the action, ``observation.get["n_prompts"]`` is the count (the
    "Loaded N prompts" figure)."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_prompts")), obs

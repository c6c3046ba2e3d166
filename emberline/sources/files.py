"""Generic file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines; schema inferred unless given (give it in production:
    inference is an extra pass over the data)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_csv(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """S3: CSV with a header row (quotes in values doubled); a given schema
    avoids the inference pass."""
    reader = spark.read.option("header", header).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Any prompt table Spark reads: ``parquet`` (default), ``json``, ``csv``,
    ``orc``, ``text``."""
    if fmt == "json":
        return read_json(spark, path, schema)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def prompts_from_table(df: DataFrame, id_col: str) -> DataFrame:
    """A keyed prompt table in any format -> ``(prompt_id, prompt)``: the
    column-level choice (P2: ``text`` when present, else ``prompt``), then
    the empty filter (P3, empty strings count as missing)."""
    from pyspark.sql import functions as F

    from ..operators.prompts import choose_prompt_column

    chosen = choose_prompt_column(df.withColumnRenamed(id_col, "prompt_id") if id_col != "prompt_id" else df)
    return chosen.filter(F.col("prompt").isNotNull() & (F.col("prompt") != ""))

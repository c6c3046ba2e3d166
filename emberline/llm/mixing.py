"""Mixing sources to target weights by entropy balancing.

Among all document rates ``r`` in [0, 2], take those closest (in relative
entropy) to one copy each whose words meet every source's target::

    minimise  sum r log r - r   subject to  sum over source (words * r) = target

The convex dual has one multiplier per source; its optimum tilts the rates
exponentially, ``r = min(2, exp(m * words))``. Newton steps on all sources at
once are aggregates over (source, size) classes: documents of one source and
size share a rate, so the classes are all an iteration reads.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, read_table, staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def word_count(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+``: each starts after white space or at the start."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    trimmed = F.rtrim(F.regexp_replace(padded, "^ +", " "))
    return (F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order (null last) weigh ``weights``, repeating, and
    share ``share`` of all words; a target stops at ``most`` times its source's
    size, and the excess is shared again by weight until none is above. Each
    sharing is one aggregate over the sources; it ends after as many rounds as
    targets reach their limit in turn."""
    # the position of a source needs one order over all sources: one narrow row each
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = staged(sizes.select("source", "source_size", weight.alias("weight"),
                                (F.col("source_size") * most).alias("limit")), "sources")
    whole = table.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level = 0.0
    while True:
        full = F.col("limit") <= F.col("weight") * level
        row = table.agg(F.sum(F.when(full, F.col("limit"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w"),
                        F.count(F.when(full, 1)).alias("n")).first()
        if not row["w"]:
            break
        again = (share * whole - (row["held"] or 0.0)) / row["w"]
        if again <= level:
            break
        level = again
    return table.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def solve_dual(classes: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = 1e-9,
               max_steps: int = 60) -> DataFrame:
    """Newton steps on the dual of every source: ``(source, source_size, target, m)``.

    ``classes``: ``(source, size, docs)``. Each step is one aggregate of value
    and slope by source, and one small table written; a bracket on every
    multiplier turns a step that leaves it into a bisection, so it cannot
    diverge. Sources at their limit need no multiplier: every rate is ``most``."""
    scale = staged(classes.where("size > 0").groupBy("source").agg(F.max("size").alias("top"), F.min("size").alias("low")),
                   "scale")
    state = targets.join(scale, targets["source"].eqNullSafe(scale["source"]), "left").select(
        targets["source"], "source_size", "target", "top", "low",
        ((F.col("target") >= most * F.col("source_size")) | F.col("top").isNull()).alias("done"),
        F.lit(0.0).alias("m"),
        # exp(m * size) passes every float below lo and reaches `most` for all sizes above hi
        (F.lit(-745.0) / F.col("low")).alias("lo"), (F.lit(float(np.log(most))) / F.col("low")).alias("hi"))
    state = staged(state, "dual")
    for _ in range(max_steps):
        if state.where("not done").isEmpty():
            break
        open_rows = state.where("not done").withColumnRenamed("source", "s")
        tilt = F.exp(F.col("m") * F.col("size"))
        words = F.col("docs") * F.col("size")
        step = classes.join(open_rows, classes["source"].eqNullSafe(open_rows["s"])).groupBy("s").agg(
            F.sum(words * F.least(tilt, F.lit(most))).alias("value"),
            F.sum(F.when(tilt < most, words * F.col("size") * tilt).otherwise(0.0)).alias("slope"))
        joined = state.join(step, state["source"].eqNullSafe(step["s"]), "left")
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("m")).otherwise(F.col("hi"))
        moved = joined.withColumns({"lo2": lo, "hi2": hi, "newton": F.col("m") - gap / F.nullif("slope", F.lit(0.0))})
        inside = (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        close = (F.abs(gap) <= F.greatest(F.lit(0.25), F.col("target") * tolerance)) | (F.col("hi2") - F.col("lo2") < 1e-15)
        state = staged(moved.select(
            "source", "source_size", "target", "top", "low",
            (F.col("done") | F.coalesce(close, F.lit(False))).alias("done"),
            F.when(F.col("done") | close, F.col("m")).when(inside, F.col("newton"))
            .otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("m"),
            F.when(F.col("done"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(F.col("hi2")).alias("hi")), "dual")
    return state.select("source", "source_size", "target", "m")


def _round_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size class of one source. What rounding gains or
    loses on a class is carried, in words, to the next smaller size, so the
    source ends within half its smallest document of its target."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    copies = np.zeros(len(pdf), np.int64)
    owed = 0.0
    for k, (size, docs, rate, most) in enumerate(zip(pdf["size"], pdf["docs"], pdf["rate"], pdf["most"])):
        exact = docs * rate * size + owed
        copies[k] = 0 if size == 0 else min(int(docs * most), max(0, int(np.floor(exact / size + 0.5))))
        owed = exact - copies[k] * size
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": pdf["source_size"],
                         "target": pdf["target"], "base": copies // pdf["docs"].to_numpy(),
                         "extra": copies % pdf["docs"].to_numpy()})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, taken``.

    Null texts have size 0 and are never taken, a null source is a source of
    its own (the last), null or repeated ids are rows like any other, other
    columns are ignored, an empty table gives no rows. Documents of a source
    and size share one rate, and those whose id hashes lowest get the odd
    copies, so reruns agree. The rounding of a source reads one row per size it
    has: that is bounded by its longest text, not by its documents."""
    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              word_count(F.col(text_col)).alias("size")), "sizes")
    classes = staged(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    dual = solve_dual(classes, staged(source_targets(sizes, weights, share, most), "targets"), most)
    d = dual.withColumnRenamed("source", "s")
    full = F.col("target") >= most * F.col("source_size")
    rated = classes.join(d, classes["source"].eqNullSafe(d["s"])).select(
        "source", "size", "docs", "source_size", "target", F.lit(float(most)).alias("most"),
        F.when(full, F.lit(most)).otherwise(F.least(F.exp(F.col("m") * F.col("size")), F.lit(most))).alias("rate"))
    whole = staged(rated.groupBy("source").applyInPandas(
        _round_source, "source string, size long, source_size long, target double, base long, extra long"), "copies")
    # ranks inside (source, size), then the class facts: both by keys that hash buckets split
    placed = ranked(rows.withColumn("k", F.xxhash64("source", F.col("source").isNull(), "size")), ["k"], ["doc_id"], rows.count())
    facts = whole.select(F.xxhash64("source", F.col("source").isNull(), "size").alias("k"), "source_size", "target", "base", "extra")
    copies = F.col("base") + (F.col("rank") < F.col("extra")).cast("long")
    return placed.join(facts, "k").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                                          (copies * F.col("size")).alias("taken"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")

"""The next-token count model, fitted on Spark.

Stands in for pretrained weights: token pairs of a corpus are counted, the
count table is the model. Greedy decoding needs the arg-max successor of each
context; sampling needs the nucleus (top-p) candidates with their weights.
Ties are always broken by count descending, then token ascending (binary
string order), the same in Spark and in the SQL oracle.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detokenise, tokens
from ..session import has_at_most, join_small, stored
from .indexing import rank_within


def tokenise(df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``tokens array<string>`` and ``n_tokens`` (the true length, what
    an attention mask would sum to)."""
    return df.withColumn(out, tokens(text_col)).withColumn("n_tokens", F.size(out).cast("long"))


def token_lengths(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """I3 with batch padding: ``padded_len`` = longest prompt in the batch.
    Batches are bounded by the batch size, so the window per batch is small."""
    w = Window.partitionBy(batch_col)
    return df.withColumn("padded_len", F.max("n_tokens").over(w))


def fit_window(df: DataFrame, max_len: int, tokens_col: str = "tokens", out: str = "window") -> DataFrame:
    """I4: keep the last ``max_len`` tokens (the model's context length) and
    flag over-long prompts instead of failing the whole job."""
    n = F.size(tokens_col)
    start = F.greatest(n - F.lit(max_len) + F.lit(1), F.lit(1))
    return (df.withColumn(out, F.when(n == 0, F.array().cast("array<string>"))
                          .otherwise(F.slice(tokens_col, start, F.least(n, F.lit(max_len)))))
              .withColumn("over_limit", n > F.lit(max_len)))


def token_pairs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(ctx, next_token) for every adjacent token pair of every text. Pairs
    are built inside each row (``arrays_zip`` of two slices): no window, no
    shuffle before the count."""
    t = df.select(tokens(text_col).alias("_t"))
    n = F.size("_t")
    zipped = F.arrays_zip(F.slice("_t", 1, n - 1).alias("ctx"), F.slice("_t", 2, n - 1).alias("next_token"))
    return (t.select(F.explode(F.when(n > 1, zipped)).alias("p"))
              .select(F.col("p.ctx").alias("ctx"), F.col("p.next_token").alias("next_token")))


def fit_next_token(df: DataFrame, text_col: str = "text", min_count: int = 1, top_k: int | None = None) -> DataFrame:
    """The count model ``(ctx, next_token, cnt)``. Counting is a hash
    aggregate with map-side partial counts, so a very common context costs no
    more than a rare one. ``min_count`` and ``top_k`` prune the model before it
    is broadcast; ``top_k`` ranks with the skew-safe :func:`rank_within`."""
    counts = token_pairs(df, text_col).groupBy("ctx", "next_token").agg(F.count(F.lit(1)).alias("cnt"))
    if min_count > 1:
        counts = counts.filter(F.col("cnt") >= min_count)
    if top_k:
        ranked = rank_within(counts, ["ctx"], [F.col("cnt").desc(), F.col("next_token").asc()], "_r")
        counts = ranked.filter(F.col("_r") < top_k).drop("_r")
    return counts


def argmax_model(counts: DataFrame) -> DataFrame:
    """Greedy successor per context: highest count, then smallest token.
    ``min(struct(-cnt, token))`` is a plain aggregate (partial + final), not a
    window, so no context is ever gathered into one task."""
    best = counts.groupBy("ctx").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("next_token"))).alias("b"))
    return best.select("ctx", F.col("b.next_token").alias("next_token"), (-F.col("b.neg")).alias("cnt"))


# Weights at T != 1 are whole numbers: this many steps for a context's most
# frequent successor, one at least for any other. Sums of whole numbers do not
# depend on their order, so an edge candidate is the same in every plan.
GRID = 1 << 30


def _weighted(counts: DataFrame, temperature: float) -> DataFrame:
    """Adds ``w``: the count at T = 1, else ``(cnt / largest)^(1/T)`` on the grid."""
    if temperature == 1.0:
        return counts.select("ctx", "next_token", "cnt", F.col("cnt").alias("w"))
    top = counts.groupBy("ctx").agg(F.max("cnt").alias("_top"))
    r = F.col("cnt").cast("double") / F.col("_top")
    power = 1.0 / temperature
    if power == int(power) and power <= 16:  # products: the same bits everywhere
        share = r
        for _ in range(int(power) - 1):
            share = share * r
    else:
        share = F.pow(r, F.lit(power))
    w = F.greatest(F.floor(share * F.lit(float(GRID))), F.lit(1)).cast("long")
    return counts.join(top, "ctx").select("ctx", "next_token", "cnt", w.alias("w"))


def _fraction(top_p: float) -> tuple[int, int]:
    frac = Fraction(str(top_p)).limit_denominator(1000)
    return frac.numerator, frac.denominator


def _nucleus_window(counts: DataFrame, top_p: float) -> DataFrame:
    """Contexts of bounded size: one window per context, running mass before
    each candidate in (count desc, token asc) order; the mass that is kept
    comes from the same partitioning."""
    num, den = _fraction(top_p)
    ctx = Window.partitionBy("ctx")
    w = ctx.orderBy(F.col("cnt").desc(), F.col("next_token"))
    ranked = counts.select("ctx", "next_token", "cnt", "w",
                           F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                           .alias("lo"),
                           F.sum("w").over(ctx).alias("_total"))
    kept = ranked.filter(F.lit(den) * F.col("lo") < F.lit(num) * F.col("_total"))
    return kept.select("ctx", "next_token", "cnt", "w", "lo", F.sum("w").over(ctx).alias("mass"))


# Characters of a token by which the tokens of one level are cut into parts; any prefix keeps their order.
PREFIX = 3


def _ranked_parts(rows: DataFrame, largest: int) -> DataFrame:
    """Adds ``_r``, the place of a token among those of its (ctx, cnt), to rows that
    have ``m``, how many of them are kept; those of parts beyond ``m`` go.

    Tokens are counted by (ctx, cnt, prefix); a running count over the prefixes
    says where each part starts, so only the tokens inside one part are sorted
    together. Parts above ``largest`` rows take the skew-safe :func:`rank_within`."""
    cut = rows.withColumn("_p", F.substring("next_token", 1, PREFIX))
    before = Window.partitionBy("ctx", "cnt").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("ctx", "cnt", "m", "_p").agg(F.count(F.lit(1)).alias("_k"))
    parts = stored(parts.withColumn("_at", F.coalesce(F.sum("_k").over(before), F.lit(0))).filter(
        F.col("_at") < F.col("m")).drop("m"), "parts")
    group = ["ctx", "cnt", "_p"]
    inside = Window.partitionBy(*group).orderBy("next_token")
    small = cut.join(parts.filter(F.col("_k") <= largest), group).withColumn("_place", F.row_number().over(inside) - 1)
    large = parts.filter(F.col("_k") > largest)
    if not large.isEmpty():
        small = small.unionByName(rank_within(cut.join(large, group), group, [F.col("next_token")], "_place"))
    return small.withColumn("_r", F.col("_at") + F.col("_place")).drop("_p", "_k", "_at", "_place")


def _nucleus_levels(counts: DataFrame, top_p: float, placed: bool, largest: int) -> DataFrame:
    """Hot contexts: work by count level. All tokens of one (ctx, cnt) level
    share a weight, so the running mass is a window over levels (at most
    ~sqrt(2 * total) per context); whole levels are kept or dropped without
    ranking and only the straddling level ranks its tokens, by
    :func:`_ranked_parts` (one level may be spread over many tasks). ``placed``
    ranks the tokens of every kept level, since each needs its place."""
    num, den = _fraction(top_p)
    levels = counts.groupBy("ctx", "cnt", "w").agg(F.count(F.lit(1)).alias("k"))
    w_before = Window.partitionBy("ctx").orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("ctx")
    mass = F.col("w") * F.col("k")
    lv = levels.select("ctx", "cnt", "w", "k", F.coalesce(F.sum(mass).over(w_before), F.lit(0)).alias("before"),
                       F.sum(mass).over(w_all).alias("total"))
    x = F.lit(num) * F.col("total") - F.lit(den) * F.col("before")
    y = F.lit(den) * F.col("w")
    m = F.when(x <= 0, F.lit(0)).otherwise(F.least(F.col("k"), F.floor((x - 1) / y).cast("long") + 1))
    lv = stored(lv.select("ctx", "cnt", "k", "before", m.alias("m"), F.sum(m * F.col("w")).over(w_all).alias("mass")).filter(
        F.col("m") > 0), "levels")
    j = counts.join(lv, ["ctx", "cnt"])
    if placed:
        place = _ranked_parts(j, largest).filter(F.col("_r") < F.col("m"))
        return place.select("ctx", "next_token", "cnt", "w", (F.col("before") + F.col("_r") * F.col("w")).alias("lo"), "mass")
    whole = j.filter(F.col("m") == F.col("k")).select("ctx", "next_token", "cnt", "w")
    cut = _ranked_parts(j.filter(F.col("m") < F.col("k")), largest)
    return whole.unionByName(cut.filter(F.col("_r") < F.col("m")).select("ctx", "next_token", "cnt", "w"))


# Hash classes of contexts whose rows are counted before any context's are.
CLASSES = 1 << 17


def _hot_contexts(counts: DataFrame, hot_successors: int, max_hot_broadcast: int) -> DataFrame:
    """``ctx`` of the contexts above ``hot_successors`` rows. Rows are counted by
    hash class first; contexts are counted only in classes with that many."""
    cls = F.pmod(F.xxhash64("ctx"), F.lit(CLASSES)).cast("int")
    keyed = counts.select("ctx", cls.alias("_class"))
    full = stored(keyed.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > hot_successors).select("_class"), "classes")
    some = join_small(keyed, full, "_class", max_rows=max_hot_broadcast)
    return stored(some.groupBy("ctx").agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > hot_successors).select("ctx"), "hot")


def nucleus(counts: DataFrame, temperature: float = 1.0, top_p: float = 0.9,
            hot_successors: int = 100_000, max_hot_broadcast: int = 200_000, placed: bool = False) -> DataFrame:
    """Candidates ``(ctx, next_token, cnt, weight)`` whose probability mass
    *before* them (count desc, token asc) is below ``top_p``; weight =
    cnt^(1/T), on a grid of whole numbers. The test is exact integer
    arithmetic at every temperature, so both routes below give the same rows.
    ``placed`` adds ``lo``, the weight before the candidate, and ``mass``, the
    weight of all candidates of its context: a draw ``u`` in [0, 1) takes the
    candidate with ``lo <= u * mass < lo + weight``.

    Hot groups are split off explicitly: contexts above ``hot_successors``
    distinct successors (few, and their number is checked before the list is
    broadcast) take the level route, all others one bounded window per context.
    The weighted counts, the list, and the rows of hot contexts are written
    tables, each computed once."""
    if temperature <= 0:
        raise ValueError("temperature must be > 0 for sampling; use argmax_model for greedy decoding")
    counts = stored(_weighted(counts.select("ctx", "next_token", "cnt"), temperature), "weighted")
    hot = _hot_contexts(counts, hot_successors, max_hot_broadcast)
    extra = ["lo", "mass"] if placed else []
    columns = ["ctx", "next_token", "cnt", "w", *extra]
    if hot.isEmpty():
        kept = _nucleus_window(counts, top_p)
    else:
        hot_b = F.broadcast(hot) if has_at_most(hot, max_hot_broadcast) else hot
        many = stored(counts.join(hot_b, "ctx", "left_semi"), "hot-rows")
        kept = (_nucleus_window(counts.join(hot_b, "ctx", "left_anti"), top_p).select(*columns)
                .unionByName(_nucleus_levels(many, top_p, placed, hot_successors).select(*columns)))
    return kept.select("ctx", "next_token", "cnt", F.col("w").cast("double").alias("weight"), *extra)


def detokenise_text(df: DataFrame, tokens_col: str = "tokens", out: str = "detok") -> DataFrame:
    """Tokens back to text, end marker removed."""
    return df.withColumn(out, detokenise(tokens_col))

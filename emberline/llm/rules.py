"""Quality rules: counts of words, symbols and repetitions for every text, and
a robust fence around the texts of each language and source.

The fence is a minimum-covariance-determinant estimate: of a group's vectors,
the share that can be enclosed with the smallest determinant. Concentration
steps find it: order all vectors by their distance from the present estimate,
estimate anew from the nearest share, until the determinant no longer falls.
A step is one aggregate: counts and moments by (group, distance bin) say where
the share ends and what the estimate of all bins before it is. Matrices are
columns of the groups' table, so neither rows nor groups pass the driver.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, attach_groups, fold, read_table, staged

BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows

LEAST_GROUP = 100  # rows for an estimate; smaller groups of a language are taken together
SHARE = 0.75  # of a group's rows, what the determinant is minimal over
STEPS = 12
# Quantiles 0.5, 0.975 and 0.999999 of the chi-square distribution with four degrees of freedom.
CHI_HALF, CHI_MOST, CHI_FENCE = 3.356694, 11.143287, 33.376842
# Least standard deviation of each transformed statistic (logarithms of: code points a word; symbols,
# repeated lines, repeated words in a hundred words, and one). Most texts have none of the last three,
# and a spread of nothing would reject the first that has one; a quoted or repeated passage is no fault.
FLOOR = [0.08, 0.3, 1.0, 1.0]
BINS = 32  # of the squared distance, for each factor of e
DIMS = range(4)
TRIANGLE = [(i, j) for i in DIMS for j in range(i + 1)]


# ---- counts --------------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, in nested functions too."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three that the text has twice or more.

    Windows are 64-bit hashes; their upper bits with the position below sort as
    plain numbers, and neighbours that agree there are candidates. Candidates
    are sorted by the whole hash: those beside an equal one are repeated, and
    each covers what of its three words the next repeated one does not."""
    n = F.size(words)
    hashes = F.when(n > 2, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def candidates(hashed: Column) -> Column:
        mask = F.pow(F.lit(2.0), F.length(F.bin(F.size(hashed)))).cast("long") - 1
        return _let(mask, lambda m: _let(
            F.sort_array(F.transform(hashed, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))),
            lambda packed: F.transform(
                F.filter(packed, lambda x, i: _alike(x, F.get(packed, i - 1), m) | _alike(x, F.get(packed, i + 1), m)),
                lambda x: x.bitwiseAND(m).cast("int"))))

    def covered(hashed: Column) -> Column:
        pairs = F.array_sort(F.transform(candidates(hashed), lambda i: F.struct(F.get(hashed, i).alias("h"), i.alias("i"))))
        places = _let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))), lambda x: x["i"])))
        return _let(places, lambda at: F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    return _let(hashes, covered)


def _alike(x: Column, y: Column, mask: Column) -> Column:
    return F.coalesce(F.bitwise_not(mask).bitwiseAND(x.bitwiseXOR(y)) == 0, F.lit(False))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the group columns ``g0, g1, ...`` as text, and the counts of every whole text."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      *[F.col(c).cast("string").alias(f"g{k}") for k, c in enumerate(by)],
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(BLANKS))
    words = cut.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return words.select(
        "doc_id", *[f"g{k}" for k in range(len(by))], F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda full: F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words")).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


# ---- estimates -----------------------------------------------------------

def _vector() -> list[Column]:
    n = F.col("n_words").cast("double")
    return [F.log(F.col("word_chars") / n), *[F.log1p(100 * F.col(c) / n) for c in
                                              ("n_symbols", "n_dup_lines", "n_repeat_words")]]


def _grouped(rows: DataFrame, levels: int, total: int) -> DataFrame:
    """Adds ``key`` and ``size``: a row's group by all its columns if that has
    LEAST_GROUP rows; else by all but the last column, among the rows whose own
    group was too small, and so on; at last all rows left, which go by the
    largest group if they are too few."""
    own = rows.withColumn("__own", F.to_json(F.struct(*[f"g{k}" for k in range(levels)], F.lit(0).alias("z"))))
    groups = staged(own.groupBy("__own", *[f"g{k}" for k in range(levels)]).agg(F.count("*").alias("__n")), "groups")
    known = groups.withColumn("key", F.when(F.col("__n") >= LEAST_GROUP, F.col("__own")))
    for upto in range(levels - 1, -1, -1):
        wider = F.to_json(F.struct(*[f"g{k}" for k in range(upto)], F.lit(levels - upto).alias("z")))
        left = known.where("key is null").withColumn("__wider", wider)
        sums = left.groupBy("__wider").agg(F.sum("__n").alias("__sum"))
        if upto:
            sums = sums.where(F.col("__sum") >= LEAST_GROUP)
        found = left.drop("key").join(sums, "__wider", "left").withColumn("key", F.when(F.col("__sum").isNotNull(), F.col("__wider")))
        known = known.where("key is not null").unionByName(found.select(*known.columns))
    sizes = staged(known.groupBy("key").agg(F.sum("__n").alias("size")), "sizes")
    largest = sizes.orderBy(F.desc("size"), "key").first()  # one row
    if largest is not None:  # the rows left in the end, if too few, go by the largest group
        joined = known.join(sizes.where(F.col("size") >= LEAST_GROUP).select("key", F.lit(True).alias("__big")), "key", "left")
        known = joined.withColumn("key", F.when(F.col("__big"), F.col("key")).otherwise(largest["key"]))
        sizes = known.groupBy("key").agg(F.sum("__n").alias("size"))
    facts = staged(known.join(sizes, "key").select("__own", "__n", "key", "size"), "keys")
    return attach_groups(own, facts, ["__own"], "__n", total).drop("__own", "__n")


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, covariance with its floor as a Cholesky factor, and determinant,
    from ``n``, ``s{i}`` and ``s{i}{j}``; arrays ``m`` and ``l`` (rows of the triangle)."""
    out = sums.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in DIMS], *[
        (F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")).alias(f"c{i}{j}")
        for i, j in TRIANGLE])
    out = out.withColumns({f"c{i}{i}": F.greatest(f"c{i}{i}", F.lit(0.0)) + FLOOR[i] ** 2 for i in DIMS})
    return _factored(out, keys)


def _factored(cov: DataFrame, keys: list[str]) -> DataFrame:
    out = cov
    for i, j in TRIANGLE:
        rest = fold([F.col(f"c{i}{j}"), *[F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]], lambda a, b: a - b)
        # the floor keeps every pivot positive; rounding may not
        value = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", value)
    return out.select(*keys, F.array(*[f"m{i}" for i in DIMS]).alias("m"),
                      F.array(*[f"l{i}{j}" for i, j in TRIANGLE]).alias("l"),
                      fold([F.col(f"l{i}{i}") * F.col(f"l{i}{i}") for i in DIMS], lambda a, b: a * b).alias("det"))


def _distance(rows: DataFrame, m: str, factor: str, out: str) -> DataFrame:
    """Squared Mahalanobis distance of ``x0..`` by forward substitution."""
    at = {ij: k for k, ij in enumerate(TRIANGLE)}
    for i in DIMS:
        rest = fold([F.col(f"x{i}") - F.col(m)[i], *[F.col(factor)[at[i, j]] * F.col(f"__y{j}") for j in range(i)]],
                    lambda a, b: a - b)
        rows = rows.withColumn(f"__y{i}", rest / F.col(factor)[at[i, i]])
    return rows.withColumn(out, fold([F.col(f"__y{i}") * F.col(f"__y{i}") for i in DIMS], lambda a, b: a + b)).drop(
        *[f"__y{i}" for i in DIMS])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in DIMS],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in TRIANGLE])


def _nearest(rows: DataFrame, keys: list[str], cut: Column) -> DataFrame:
    """Estimates anew from the distance bins that pass ``cut``, which sees
    ``bin``, ``size``, ``below`` (rows of nearer bins) and ``median`` (the bin of it).
    ``rows`` have ``d2``; there are some hundred bins a key at most."""
    bins = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS).cast("int"))
    cells = _moments(bins, [*keys, "size", "bin"])
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("below", F.sum("n").over(upto) - F.col("n"))
    cells = cells.withColumn("median", F.max(F.when(2 * F.col("below") < F.col("size"), F.col("bin"))).over(
        Window.partitionBy(*keys)))
    names = ["n", *[f"s{i}" for i in DIMS], *[f"s{i}{j}" for i, j in TRIANGLE]]
    return _estimate(cells.where(cut).groupBy(*keys, "size").agg(*[F.sum(c).alias(c) for c in names]), [*keys, "size"])


def _quartiles(vectors: DataFrame) -> DataFrame:
    """First estimate of each group: medians and quartile ranges of the single
    statistics, from counts in bins of 1/64."""
    cells = vectors.select("key", "size", F.posexplode(F.array(*[f"x{i}" for i in DIMS])).alias("dim", "x")).groupBy(
        "key", "size", "dim", F.floor(F.col("x") * 64).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("key", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum("n").over(upto) / F.col("size")
    marks = cells.withColumn("part", part).groupBy("key", "size", "dim").agg(*[
        (F.min(F.when(F.col("part") >= q, F.col("bin"))) / 64.0).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    spread = F.pow((F.col("q2") - F.col("q0")) / 1.349, 2)
    wide = marks.groupBy("key", "size").agg(
        *[F.max(F.when(F.col("dim") == i, F.col("q1"))).alias(f"m{i}") for i in DIMS],
        *[F.max(F.when(F.col("dim") == i, spread)).alias(f"c{i}{i}") for i in DIMS])
    wide = wide.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") + FLOOR[i] ** 2 if i == j else F.lit(0.0) for i, j in TRIANGLE})
    return _factored(wide, ["key", "size"])


def _starts(*estimates: DataFrame) -> DataFrame:
    """Estimates of one group as one row, so that a step reads each vector once."""
    rows = fold([e.select("key", "size", F.lit(k).alias("start"), "m", "l", "det") if "start" not in e.columns else e
                 for k, e in enumerate(estimates)], DataFrame.unionByName)
    return rows.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("start", "m", "l", "det"))).alias("starts"))


def robust_estimates(vectors: DataFrame, total: int) -> DataFrame:
    """Minimum-covariance-determinant estimate of every group of ``vectors
    (key, size, x0..x3)``: ``(key, size, m, l)``. Two first estimates, by
    quartiles and by all rows; concentration steps; the one with the smaller
    determinant; then anew from all rows within the 0.975 quantile of it."""
    state = staged(_starts(_quartiles(vectors), _estimate(_moments(vectors, ["key", "size"]), ["key", "size"])), "mcd")
    vectors = vectors.drop("size")
    for _ in range(STEPS):
        rows = attach_groups(vectors, state, ["key"], "size", total).withColumn("s", F.explode("starts")).select(
            "key", "size", "s.start", "s.m", "s.l", *[f"x{i}" for i in DIMS])
        next_state = staged(_starts(_nearest(_distance(rows, "m", "l", "d2"), ["key", "start"],
                                             F.col("below") < SHARE * F.col("size"))), "mcd")
        before = state.select("key", F.explode("starts").alias("a")).select("key", "a.start", F.col("a.det").alias("was"))
        after = next_state.select("key", F.explode("starts").alias("b")).select("key", "b.start", "b.det")
        state = next_state
        if before.join(after, ["key", "start"]).where("det < 0.999 * was").isEmpty():
            break
    best = state.select("key", "size", F.array_min(F.transform(
        "starts", lambda s: F.struct(s["det"], s["start"], s["m"], s["l"]))).alias("b")).select(
        "key", "size", F.col("b.m").alias("m"), F.col("b.l").alias("l"))
    rows = _distance(attach_groups(vectors, staged(best, "mcd"), ["key"], "size", total), "m", "l", "d2")
    # distances are widened where the middle of the group is farther off than that of a normal one, never
    # narrowed: a statistic that most texts have none of is nearer, and its floor would be undone
    wider = F.greatest(F.lit(1.0), F.exp((F.col("median") + 1) / BINS) / CHI_HALF)
    return _nearest(rows, ["key"], F.exp(F.col("bin") / BINS) <= CHI_MOST * wider).select("key", "size", "m", "l")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of every whole text, ``base_failed``, ``distance`` and ``kept``.

    ``base_failed``: fewer than LEAST_WORDS words, or more than MOST_REPEATED
    per cent of them in windows of three words that the text has twice or more.
    Of the others, ``distance`` is the squared Mahalanobis distance from the
    robust estimate of the texts of the same ``by`` columns, and texts beyond
    the chi-square quantile CHI_FENCE are not kept.

    Null texts are empty: no words, so base_failed. Null languages and sources
    are a value like any other. Groups under LEAST_GROUP rows are taken together
    by the columns before (see ``_grouped``); a table under it has no estimate,
    and its rows are kept, with a null distance. Repeated rows and null ids are
    rows like any other, equal statistics get equal verdicts, an empty table
    gives no rows. Only the named columns are read, so others may have any name."""
    counts = staged(text_counts(docs, id_col, text_col, by), "counts")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = counts.where("not base_failed").withColumns({f"x{i}": x for i, x in enumerate(_vector())})
    total = passed.count()
    vectors = staged(_grouped(passed, len(by), total), "vectors")
    fit = vectors.where(F.col("size") >= LEAST_GROUP).select("key", "size", *[f"x{i}" for i in DIMS])
    estimates = staged(robust_estimates(fit, total), "fences")
    found = attach_groups(vectors.drop("size"), estimates, ["key"], "size", total)
    judged = _distance(found, "m", "l", "distance").withColumn(
        "kept", F.coalesce(F.col("distance") <= CHI_FENCE, F.lit(True))).select(*columns, "kept", "distance")
    failed = counts.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents."""
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")

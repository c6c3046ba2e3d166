"""Quality by the perplexity of a character n-gram model of trusted text.

The model is interpolated modified Kneser-Ney: raw counts at the highest order,
continuation counts below, three discounts for each order from the counts of
counts. All of it are aggregates and joins on hashed n-grams, sharded by their
hash. A document's perplexity is the sum over its distinct n-grams of count
times log probability; documents above a quantile of their language's trusted
documents are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import has_at_most
from .common import HOT_KEYS, attach_groups, bit_map, byte_slices, maybe_in, read_table, salted_join, staged, text_bytes

ORDER = 4
QUANTILE = 0.99
FREQUENT = 1 << 18  # n-grams whose probabilities every task has (6 MB)
BLOCK_BYTES = 16 << 20  # texts whose other n-grams are listed together
RARE_CELLS = 1 << 20  # or fewer of them, with so many n-grams by text
SLICE_BYTES = 1 << 20  # of them, those whose arrays are made at once
MOST_WRONG = 100_000  # ids of a list that is broadcast
HELD = 5  # one in HELD trusted documents sets thresholds and is not trained on
_BEGIN, _END = 0x10FFFE, 0x10FFFF  # noncharacters that stand around every text


class Cells(NamedTuple):
    """N-grams of a slice of texts. ``distinct`` has a row of code points for each
    different n-gram; its cells are ``first[i]:first[i + 1]``, one for each text
    that holds it, in order: ``text`` and ``count``. ``events`` counts each
    text's n-grams."""

    distinct: np.ndarray
    first: np.ndarray
    text: np.ndarray
    count: np.ndarray
    events: np.ndarray


def cells(raw: np.ndarray, offsets: np.ndarray, order: int) -> Cells:
    """One n-gram for each event (a character of a text, or its end), with
    ``order - 1`` begins before the text. Characters are numbered in the slice,
    so an n-gram and its text are one whole number, and one sort of plain
    numbers groups them. The two noncharacters that stand for begin and end
    count as the one before them where a text has them itself."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    n = len(offsets) - 1
    sizes = np.diff(chars) + order  # order - 1 begins and one end
    ends = np.cumsum(sizes)
    line = np.full(int(ends[-1]) if n else 0, _BEGIN, np.uint32)
    line[ends - 1] = _END
    line[np.arange(len(codes)) + np.repeat(np.arange(n) * order + order - 1, np.diff(chars))] = np.minimum(codes, _BEGIN - 1)
    event = np.ones(len(line), bool)
    for k in range(order - 1):
        event[ends - sizes + k] = False
    at = np.flatnonzero(event)
    events = sizes - order + 1
    owner = np.repeat(np.arange(n), events)
    met = np.zeros(_END + 1, bool)
    met[line] = True
    letters = np.flatnonzero(met).astype(np.uint32)
    place = np.zeros(_END + 1, np.uint32)
    place[letters] = np.arange(len(letters), dtype=np.uint32)
    small = place[line]
    bits, low = max(1, (len(letters) - 1).bit_length()), max(1, (n - 1).bit_length())
    if order * bits + low <= 64:
        key = np.zeros(len(at), np.uint64)
        for k in range(order - 1, -1, -1):
            key = key << np.uint64(bits) | small[at - k]
        key = np.sort(key << np.uint64(low) | owner.astype(np.uint64))
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        text = (key[start] & np.uint64((1 << low) - 1)).astype(np.int64)
        gram = key[start] >> np.uint64(low)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
        shifts = np.arange(order - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
        distinct = letters[((gram[first][:, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    else:
        rows = np.stack([line[at - k] for k in range(order - 1, -1, -1)], axis=1)
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        key = np.sort(which.ravel() * n + owner)
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        text, gram = key[start] % n, key[start] // n
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
    return Cells(distinct, np.append(first, len(start)), text, np.diff(np.append(start, len(key))), events)


def _strings(distinct: np.ndarray) -> list[str]:
    order = distinct.shape[1]
    text = np.ascontiguousarray(distinct, np.uint32).tobytes().decode("utf-32-le")
    return [text[k:k + order] for k in range(0, len(text), order)]


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(g, c)``: the distinct n-grams of all texts and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0, SLICE_BYTES):
                found = cells(*text_bytes(part.column(0)), order)
                sums = np.diff(np.concatenate([[0], np.cumsum(found.count)])[found.first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_strings(found.distinct), pa.string()), pa.array(sums, pa.int64())], names=["g", "c"])

    return texts.mapInArrow(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(table: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from counts of counts."""
    row = table.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [max(1, row[f"n{k}"]) for k in (1, 2, 3, 4)]  # tiny corpora have empty classes
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]


def _by_count(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


class KneserNey:
    """Tables of one model, one pair for each order ``k``: ``seen`` (n-gram ->
    discounted share) and ``rest`` (context, all but its last character -> mass
    left to the order below)."""

    def __init__(self, counts: DataFrame, order: int = ORDER) -> None:
        self.order = order
        self.seen, self.rest = {}, {}
        self.counts = table = staged(counts, "ngrams")
        for k in range(order, 0, -1):
            d = _discounts(table)
            if k > 1:
                cut = table.select("g", "c", F.substring("g", 1, k - 1).alias("ctx"))
                left = cut.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(_by_count(d)).alias("held"))
                share = cut.join(left, "ctx").select(
                    F.col("g").alias(f"g{k}"), ((F.col("c") - _by_count(d)) / F.col("total")).alias(f"a{k}"))
                self.rest[k] = staged(left.select(F.col("ctx").alias(f"c{k}"), (F.col("held") / F.col("total")).alias(f"r{k}")), "rest")
                self.seen[k] = staged(share, "seen")
                # the order below counts in how many n-grams it is the ending
                table = staged(table.groupBy(F.substring("g", 2, k - 1).alias("g")).agg(F.count("*").alias("c")), "ngrams")
            else:
                row = table.agg(F.sum("c").alias("total"), F.sum(_by_count(d)).alias("held"), F.count("*").alias("v")).first()
                total = row["total"] or 1
                self.floor = (row["held"] or 1.0) / total / ((row["v"] or 0) + 1)  # one share for all that is unseen
                self.seen[1] = staged(table.select(F.col("g").alias("g1"), ((F.col("c") - _by_count(d)) / total).alias("a1")), "seen")

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The FREQUENT most frequent n-grams of the training text, sorted, and
        their log probabilities: a table of bounded size."""
        top = self.counts.orderBy(F.desc("c"), "g").limit(FREQUENT)
        table = self.log_probabilities(top).orderBy("g").toArrow()
        names = np.array(table["g"].to_pylist(), dtype=f"U{self.order}")
        logp = table["logp"].to_numpy().astype(np.float64)
        order_ = np.argsort(names)
        return names[order_], logp[order_]

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """``(g, logp)`` of n-grams ``(g)``."""
        out, n = grams.select("g"), self.order
        p = F.lit(self.floor)
        for k in range(1, n + 1):
            out = out.withColumn(f"g{k}", F.substring("g", n - k + 1, k)).join(self.seen[k], f"g{k}", "left")
            if k > 1:
                out = out.withColumn(f"c{k}", F.substring("g", n - k + 1, k - 1)).join(self.rest[k], f"c{k}", "left")
            held = F.coalesce(f"r{k}", F.lit(1.0)) if k > 1 else F.lit(1.0)
            p = F.coalesce(f"a{k}", F.lit(0.0)) + held * p
        return out.select("g", F.log(p).alias("logp"))


def _varints(values: np.ndarray) -> bytes:
    """Small numbers, seven bits to a byte, low bits first."""
    sizes = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = sizes > k
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[(ends - sizes)[has] + k] = ((values[has] >> (7 * k)) & 0x7F).astype(np.uint8) | more
    return out.tobytes()


def _from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    values = np.zeros(len(stops), np.int64)
    for k in range(5):
        has = starts + k <= stops
        values[has] |= (raw[(starts + k)[has]].astype(np.int64) & 0x7F) << (7 * k)
    return values


BLOCKS = ("block long, doc_id array<long>, lang array<string>, events array<long>, base array<double>, "
          "grams array<string>, entries array<int>, held binary")
SCORED = "doc_id long, lang string, events long, perplexity double"


def _packed(gram: np.ndarray, text: np.ndarray, count: np.ndarray, grams: int) -> tuple[np.ndarray, bytes]:
    """Cells, sorted by n-gram and text, as one small number each: the gap to
    the n-gram's text before and a count up to 4; larger counts go on in entries
    without a gap. Returns the entries of each n-gram and all of them packed."""
    head = np.diff(gram, prepend=-1) > 0
    gap = np.where(head, text, np.diff(text, prepend=0))
    entries = (count + 3) // 4
    ends = np.cumsum(entries)
    values = np.full(int(entries.sum()), 3, np.int64)
    values[ends - 1] = count - 4 * (entries - 1) - 1
    values[ends - entries] += gap << 2
    return np.bincount(gram, entries, minlength=grams).astype(np.int32), _varints(values)


class _Block:
    """Texts taken together: their sums so far, and the cells of n-grams that
    are not in the list of frequent ones."""

    def __init__(self) -> None:
        self.size, self.rare, self.ids, self.langs = 0, 0, [], []
        self.events, self.base, self.names, self.cells, self.grams = [], [], [], [], 0

    def add(self, part: pa.RecordBatch, frequent: np.ndarray, logp: np.ndarray, order: int) -> None:
        raw, offsets = text_bytes(part.column(2))
        found = cells(raw, offsets, order)
        names = np.array(_strings(found.distinct), dtype=f"U{order}")
        at = np.minimum(np.searchsorted(frequent, names), max(0, len(frequent) - 1))
        known = frequent[at] == names if len(frequent) else np.zeros(len(names), bool)
        gram = np.repeat(np.arange(len(names)), np.diff(found.first))
        value = np.where(known, logp[at] if len(logp) else 0.0, 0.0)
        self.base.append(np.bincount(found.text, value[gram] * found.count, minlength=part.num_rows))
        rare = ~known[gram]
        place = np.cumsum(~known) - 1 + self.grams
        self.cells.append(tuple(x.astype(np.int32) for x in (
            place[gram[rare]], found.text[rare] + len(self.ids), found.count[rare])))
        self.rare += int(rare.sum())
        self.names.append(names[~known])
        self.grams += int((~known).sum())
        self.ids += part.column(1).to_pylist()
        self.langs += part.column(3).to_pylist()
        self.events.append(found.events)
        self.size += len(raw)

    def row(self, block: int) -> list:
        names, same = np.unique(np.concatenate(self.names), return_inverse=True)
        gram, text, count = (np.concatenate(x) for x in zip(*self.cells))
        self.cells.clear()
        gram = same.astype(np.int32)[gram]
        order_ = np.argsort(gram * np.int64(len(self.ids)) + text)
        entries, held = _packed(gram[order_], text[order_], count[order_], len(names))
        return [block, self.ids, self.langs, np.concatenate(self.events), np.concatenate(self.base), names.tolist(), entries, held]


def _blocks(rows: DataFrame, model: KneserNey) -> DataFrame:
    """One row for each block of about BLOCK_BYTES of text: its rows, what their
    frequent n-grams sum to, its other distinct n-grams once each, and which
    rows hold those how often."""
    schema, order = to_arrow_schema(StructType.fromDDL(BLOCKS)), model.order
    state = rows.sparkSession.sparkContext.broadcast(model.frequent())  # FREQUENT n-grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, _Block()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held.row(block), schema)], schema=schema)

        for batch in batches:
            for part in byte_slices(batch, 2, SLICE_BYTES):
                block = part.column(0)[0].as_py() if block is None else block
                held.add(part, *state.value, order)
                if held.size >= BLOCK_BYTES or held.rare >= RARE_CELLS:
                    yield emit()
                    block, held = None, _Block()
        if held.ids:
            yield emit()

    return rows.select(F.monotonically_increasing_id(), "doc_id", "text", "lang").mapInArrow(run, BLOCKS)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The perplexities of each block, with the log probabilities of its other n-grams."""
    for batch in batches:
        for row in range(batch.num_rows):
            block = {name: batch.column(name)[row] for name in batch.schema.names}
            events, base, entries = (block[n].values.to_numpy(zero_copy_only=False) for n in ("events", "base", "entries"))
            total = base
            if block["facts"].is_valid:
                facts, logp = block["facts"].values, np.zeros(len(entries))
                logp[facts.field("pos").to_numpy(zero_copy_only=False)] = facts.field("logp").to_numpy(zero_copy_only=False)
                values = _from_varints(block["held"].as_py())
                upto, ends = np.cumsum(values >> 2), np.cumsum(entries)
                text = upto - np.repeat(np.concatenate([[0], upto[ends[:-1] - 1]]), entries)
                total = base + np.bincount(text, np.repeat(logp, entries) * ((values & 3) + 1), minlength=len(events))
            yield pa.RecordBatch.from_arrays([
                block["doc_id"].values, block["lang"].values, pa.array(events), pa.array(np.exp(-total / events))],
                names=[part.split()[0] for part in SCORED.split(", ")])


def perplexities(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang, events, perplexity)`` for every document.

    Texts are read once, in blocks that are stored: which rows are in a block,
    and where, does not change if a task is run again. The model's FREQUENT most
    frequent n-grams are with every task. A block's other distinct n-grams meet
    the model in their shard and bring their log probabilities back; each has
    one row a block, however frequent it is. Null texts are empty (one
    event, the end), a null language is the empty one, null and repeated ids
    are rows like any other."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    blocks = staged(_blocks(rows, model), "blocks")
    grams = blocks.select("block", F.posexplode("grams").alias("pos", "g"))
    logp = model.log_probabilities(grams.select("g").distinct())
    facts = grams.join(logp, "g").groupBy("block").agg(F.collect_list(F.struct("pos", "logp")).alias("facts"))
    return blocks.drop("grams").join(facts, "block", "left").mapInArrow(_finish, SCORED)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER, quantile: float = QUANTILE,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, lang, perplexity, threshold, kept)`` for every document.

    ``trusted (doc_id)`` names the documents the model and the thresholds are
    made from, all of them: four in five (by hashed id) train the model, and
    the rest, which it has not seen, give each language its threshold, the
    ``quantile`` of their perplexities (of all languages together where one has
    none). Without trusted text every document is kept. An empty
    table gives no rows; other columns are ignored."""
    ids = staged(trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("k")),
                 "trusted")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "k", F.xxhash64("doc_id"))
    train = ids.where(F.pmod(F.col("k"), F.lit(HELD)) > 0)
    own = maybe_in(rows, staged(bit_map(train, "k"), "map"), "k").where("__maybe").select("doc_id", "text")
    own = own.where("doc_id is not null")
    # what the bitmap lets through wrongly is a short list, and no text shuffles; else an id may be that of many rows
    wrong = staged(own.select("doc_id").distinct().join(train.select("doc_id"), "doc_id", "left_anti"), "wrong")
    if has_at_most(wrong, MOST_WRONG):
        texts = own.join(F.broadcast(wrong), "doc_id", "left_anti").select("text")
    else:
        often = own.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(1000, own.count() // HOT_KEYS))
        texts = salted_join(own, train.select("doc_id"), "doc_id", staged(often, "often"), ["text"]).select("text")
    model = KneserNey(count_ngrams(texts, order), order)
    scores = staged(perplexities(docs, model, id_col, text_col, lang_col), "perplexity")
    measured = scores.join(ids.where(F.pmod(F.col("k"), F.lit(HELD)) == 0), "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    limits = measured.groupBy("lang").agg(limit.alias("threshold"))
    whole = measured.agg(limit.alias("t")).first()["t"]
    limits = scores.groupBy("lang").agg(F.count("*").alias("n")).join(limits, "lang", "left")
    out = attach_groups(scores, staged(limits, "limits"), ["lang"], "n", scores.count())
    threshold = F.coalesce("threshold", F.lit(whole).cast("double"))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"),
                      F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the perplexity of their language's trusted text."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return classify(read_table(spark, sf_dir, "documents"), trusted_ids(labels))

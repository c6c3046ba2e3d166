"""Best-fit packing of tokenised documents into fixed-size sequences.

What fits where depends on lengths alone, and there are at most ``capacity``
different ones. So the plan is made on the histogram of lengths (a bounded
table, whatever the corpus size): documents above a third of the capacity are
matched greedily, at most two to a bin; smaller ones go best-fit into the gaps
left, longest first. The plan says, for each length, which ranks go to which
bins; ranking the pieces and looking their rank up is done on Spark.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read_table, staged

CAPACITY = 1024
EOS_ID = 2
# Fixed values of the public tokenizer file: its special token.
SPECIAL_TOKENS = {"<|endoftext|>": 50256}

_ENCODERS: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    """The vocabulary, loaded once per worker. ``.json`` files are read by
    ``tokenizers``; ``.tiktoken`` rank files by ``tiktoken``, which gives the
    same ids about four times as fast (tested against the ``.json`` file)."""
    if path not in _ENCODERS:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: tok.encode(text, add_special_tokens=False).ids
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                    special_tokens=SPECIAL_TOKENS)
            _ENCODERS[path] = lambda text: enc.encode(text, allowed_special="all")
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
               eos: int = EOS_ID, vocabulary: str | None = None) -> DataFrame:
    """Token pieces ``(doc_id, piece, start, length, ids_crc32)``: the ids of
    each text and an end id, cut only when longer than ``capacity``; then the
    first piece takes the remainder and all others are full."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray([*encode(text.as_py() or ""), eos], dtype="<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                at = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    out.append((doc, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at = end
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Place ``count`` pieces of each length. Returns segments ``(length, first
    rank, ranks, per bin, first bin, offset)``: consecutive ranks of a length
    that fill consecutive bins, ``per bin`` to each, from ``offset`` on.

    Works on groups of alike bins, never on single pieces: each length splits
    at most one group, so time and result are bounded by ``capacity``."""
    left = {n: c for n, c in histogram.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first bin, bins)]
    order: list[int] = []
    bins = 0

    def put(length: int, count: int, per: int, first: int, offset: int) -> None:
        segments.append((length, ranks[length], count, per, first, offset))
        ranks[length] += count
        left[length] -= count

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                bisect.insort(order, room)
                gaps[room] = []
            gaps[room].append((first, count))

    # above a third: at most two fit a bin; each takes the longest partner that fits
    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
                at -= 1
            if at < 0:
                count = left[a]
                put(a, count, 1, bins, 0)
                leave(capacity - a, bins, count)
            elif large[at] == a:
                count = left[a] // 2
                put(a, 2 * count, 2, bins, 0)
                leave(capacity - 2 * a, bins, count)
            else:
                b = large[at]
                count = min(left[a], left[b])
                put(a, count, 1, bins, 0)
                put(b, count, 1, bins, a)
                leave(capacity - a - b, bins, count)
            bins += count
    # the rest, longest first: each into the tightest gap that takes it
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):  # no gap: new bins
                per = capacity // n
                count = max(1, left[n] // per)
                leave(capacity, bins, count)
                bins += count
                continue
            room = order[at]
            first, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], order[at]
            per = min(room // n, left[n])
            used = min(count, left[n] // per)
            put(n, used * per, per, first, capacity - room)
            leave(room - per * n, first, used)
            leave(room, first + used, count - used)
    return segments


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset`` (gapless from 0).

    ``pieces`` needs ``doc_id, piece, length`` with lengths of 1 to
    ``capacity``, as ``cut_pieces`` gives; other columns stay. Null or repeated
    ids are placed like any other piece; an empty table gives no rows. Only
    the length histogram (``capacity`` rows at most) reaches the driver, and
    only the plan made from it is broadcast. A length that a third of all
    pieces share is ranked in hash buckets."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for length, *segment in plan_bins(counts, capacity):
        by_length.setdefault(length, []).append(tuple(segment))
    plan = spark.createDataFrame(
        list(by_length.items()),
        "length int, segments array<struct<lo: long, ranks: long, per: long, bin: long, at: long>>")
    rows = ranked(pieces, ["length"], ["doc_id", "piece"], sum(counts.values()), "__rank")
    found = rows.join(F.broadcast(plan), "length").withColumn("__s", F.element_at(F.filter(
        "segments", lambda s: (s["lo"] <= F.col("__rank")) & (F.col("__rank") < s["lo"] + s["ranks"])), 1))
    place = F.col("__rank") - F.col("__s.lo")
    return found.select(
        *pieces.columns,
        (F.col("__s.bin") + F.floor(place / F.col("__s.per"))).cast("long").alias("sequence_id"),
        (F.col("__s.at") + place % F.col("__s.per") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   eos: int = EOS_ID, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece. Null texts
    are empty texts (one end id); other columns are ignored."""
    return pack(staged(cut_pieces(docs, id_col, text_col, capacity, eos, vocabulary), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         "sequence_id", "offset")

"""Alignment of two tokenizers over the same bytes.

Both tokenizations of a text are lists of byte ranges that cover the same
bytes. Offsets at which a token of each ends are shared cuts. They are found by
divide and conquer: of an interval, look for a common end near its middle (the
ends of A nearest the middle, bisected into the ends of B), split there and go
on in both halves; an interval without one is a group. All intervals of a block
of texts take a step together, as array work.

How often two ids are linked is counted over the corpus. A block of about
``BLOCK_BYTES`` of text names each id pair once, whatever its number of texts
and links, so the pairs that travel to the counts and back are few and no pair
can hold more than one row a block.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import byte_slices, read_table, staged

# Text of one block: what the arrays of a task hold at once. A longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_SIDES: dict[str, "Side"] = {}


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable
    bytes stand for themselves, all others follow from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def _byte_level(path: str):
    """Texts to ids by a byte-level ``.json`` vocabulary, a space before each
    text and special tokens as plain text. Where the file is nothing but
    byte-level words and merges in the order of their ids, ``tiktoken`` reads
    them as ranks and gives the same ids at a third of the time (tested);
    otherwise ``tokenizers`` does it."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    words = spec["model"]["vocab"]
    merged = [words["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if plain and not spec.get("normalizer") and all(a < b for a, b in zip(merged, merged[1:])):
        import public_tokenizers
        import tiktoken

        alphabet = byte_level_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in words.items() if t not in special}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, np.int64)
                          for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Side:
    """One tokenizer: ids of texts, and each id's bytes. ``.json`` files are
    byte-level and get a space before the text; ``.model`` files add their own."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.encode = _byte_level(path)
            alphabet = byte_level_alphabet()
            names = {i: t for t, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
            known = [names.get(i, "") for i in range(max(names) + 1)]
            values = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in known]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)]
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            values = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p)
                      else p.replace("▁", " ").encode() for p in pieces]
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(values), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """All bytes of many ids, joined."""
        sizes = self.sizes[ids]
        return self.raw[np.arange(int(sizes.sum())) + np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)]


def _side(path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of many non-empty ranges, and where each range begins."""
    counts = stop - first
    heads = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(first - heads, counts), heads


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, edge_a: np.ndarray, edge_b: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A and of B: does it end at a shared cut? ``edge_a``
    and ``edge_b`` number the last tokens of the texts, which end together."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    cut_a[edge_a], cut_b[edge_b] = True, True
    far = np.iinfo(np.int64).max
    # an interval: its tokens lo..hi of each side; hi ends at the interval's end
    lo_a, hi_a = np.concatenate([[0], edge_a[:-1] + 1]), edge_a
    lo_b, hi_b = np.concatenate([[0], edge_b[:-1] + 1]), edge_b
    while True:
        inner = (lo_a < hi_a) & (lo_b < hi_b)  # else a group: one side has a single token
        lo_a, hi_a, lo_b, hi_b = lo_a[inner], hi_a[inner], lo_b[inner], hi_b[inner]
        if not len(lo_a):
            return cut_a, cut_b
        middle = (lo_a + hi_a - 1) // 2
        at_a, at_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        reach, todo = 0, np.arange(len(lo_a))
        while len(todo):  # windows around the middle, each twice as wide as the one before
            m = middle[todo]
            first, stop = np.maximum(lo_a[todo], m - reach), np.minimum(hi_a[todo], m + reach + 1)
            tried, heads = _ranges(first, stop)
            met = np.searchsorted(ends_b, ends_a[tried])  # bisect
            off = 2 * np.abs(tried - np.repeat(m, stop - first)) + (tried > np.repeat(m, stop - first))
            off[ends_b[met] != ends_a[tried]] = far
            nearest = np.minimum.reduceat(off, heads)
            hit = np.flatnonzero((off == np.repeat(nearest, stop - first)) & (off != far))
            at_a[todo[nearest != far]], at_b[todo[nearest != far]] = tried[hit], met[hit]
            todo = todo[(nearest == far) & ((first > lo_a[todo]) | (stop < hi_a[todo]))]
            reach = 2 * reach + 1
        split = at_a >= 0
        at_a, at_b = at_a[split], at_b[split]
        cut_a[at_a], cut_b[at_b] = True, True
        halves = [np.stack(pair, 1).ravel() for pair in (
            (lo_a[split], at_a + 1), (at_a, hi_a[split]), (lo_b[split], at_b + 1), (at_b, hi_b[split]))]
        lo_a, hi_a, lo_b, hi_b = halves


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens whose byte ranges overlap, as token numbers. Inside
    a group each end but the last belongs to one side alone, and the pair that
    overlaps just before an end is the token that ends there and the other
    side's token around it."""
    group_b = np.flatnonzero(cut_b)
    own_a = np.flatnonzero(~cut_a)
    own_b = np.flatnonzero(~cut_b)
    a = np.concatenate([np.flatnonzero(cut_a), own_a, np.searchsorted(ends_a, ends_b[own_b])])
    b = np.concatenate([group_b, np.searchsorted(ends_b, ends_a[own_a]), own_b])
    return a, b


@functools.lru_cache(maxsize=4)
def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..top with room for one more character, and their lengths."""
    numbers = [str(i).encode() for i in range(top + 1)]
    width = len(numbers[-1]) + 1
    table = np.frombuffer(b"".join(n.ljust(width) for n in numbers), np.uint8).reshape(-1, width)
    return table, np.array([len(n) for n in numbers])


def group_strings(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray,
                  edge_a: np.ndarray, edge_b: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    upto_a, upto_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    # place of a token in the text's list: those of A in its group before those of B
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], upto_b])[group_a]
    place_b = np.arange(len(ids_b)) + upto_a[group_b]
    ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    marks[place_a] = np.where(cut_a, ord("|"), ord(","))
    marks[place_b] = np.where(cut_b, ord(";"), ord(","))
    table, sizes = _decimals(1 << int(ids.max()).bit_length())
    sizes = sizes[ids]
    out = table[ids]
    out[np.arange(len(ids)), sizes] = marks
    flat = out[np.arange(out.shape[1]) <= sizes[:, None]]
    stops = np.cumsum(sizes + 1)[place_b[edge_b]]
    raw = flat.tobytes()
    return [raw[a:b - 1] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]


BLOCKS = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "n_links array<long>, groups array<string>, cells array<int>, pair binary, times binary, "
          "pairs array<long>, counts array<long>")


def _smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def align_block(texts: list[str | None], one: Side, two: Side) -> dict[str, list | bytes]:
    """All texts of a block: counts and digests for each, the id pairs of the
    block with how often they are linked, and each text's share of them."""
    full = [k for k, text in enumerate(texts) if text]
    whole = [b" " + texts[k].encode() for k in full]
    lengths = np.array([len(w) for w in whole], np.int64)
    tokens = [s.encode([texts[k] for k in full]) for s in (one, two)]
    same = np.ones(len(full), bool)
    for side, lists in zip((one, two), tokens):  # texts that do not come back byte by byte
        same &= lengths == [int(side.sizes[ids].sum()) for ids in lists]
    for side, lists in zip((one, two), tokens):
        at = np.flatnonzero(same)
        if len(at):
            hit = side.bytes_of(np.concatenate([lists[k] for k in at])) == np.frombuffer(b"".join(whole[k] for k in at), np.uint8)
            same[at] = np.logical_and.reduceat(hit, np.cumsum(lengths[at]) - lengths[at])
    good = [full[k] for k in np.flatnonzero(same)]
    tokens = [[lists[k] for k in np.flatnonzero(same)] for lists in tokens]
    n = len(texts)
    out = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links", "cells")}
    digests = [""] * n
    nothing = np.zeros(0, np.int64)
    if not good:
        return {**out, "groups": digests, "pair": b"", "times": b"", "pairs": nothing, "counts": nothing}
    ids_a, ids_b = (np.concatenate(t).astype(np.int64) for t in tokens)
    edge_a, edge_b = (np.cumsum([len(x) for x in t]) - 1 for t in tokens)
    ends_a, ends_b = np.cumsum(one.sizes[ids_a]), np.cumsum(two.sizes[ids_b])
    cut_a, cut_b = shared_cuts(ends_a, ends_b, edge_a, edge_b)
    a, b = links(ends_a, ends_b, cut_a, cut_b)
    doc = np.searchsorted(edge_a, a)
    pairs, pair, counts = np.unique(ids_b[b] << 32 | ids_a[a], return_inverse=True, return_counts=True)
    cells, times = np.unique(doc * len(pairs) + pair, return_counts=True)
    out["n_a"][good], out["n_b"][good] = np.diff(edge_a, prepend=-1), np.diff(edge_b, prepend=-1)
    out["n_groups"][good] = np.diff(np.cumsum(cut_a)[edge_a], prepend=0)
    out["n_links"][good] = np.bincount(doc, minlength=len(good))
    out["cells"][good] = np.bincount(cells // len(pairs), minlength=len(good))
    for k, text in zip(good, group_strings(ids_a, ids_b, cut_a, cut_b, edge_a, edge_b)):
        digests[k] = hashlib.sha256(text).hexdigest()
    width = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
    return {**out, "groups": digests, "pair": (cells % len(pairs)).astype(width).tobytes(),
            "times": _smallest(times).tobytes(), "pairs": pairs, "counts": counts}


def align_blocks(docs: DataFrame, id_col: str, text_col: str, vocabularies: tuple[str, str]) -> DataFrame:
    """One row a block of texts (see ``BLOCKS``). ``cells`` counts a text's
    distinct pairs; ``pair`` (numbers into ``pairs``) and ``times`` hold them."""
    names = [part.split()[0] for part in BLOCKS.split(", ")]
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        one, two = (_side(path) for path in vocabularies)
        for batch in batches:
            for part in byte_slices(batch, 2, BLOCK_BYTES):
                block = align_block(part.column(2).to_pylist(), one, two)
                block |= {"block": part.column(0)[0].as_py(), "doc_id": part.column(1).to_pylist()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[name]], schema.field(name).type) for name in names], schema=schema)

    rows = docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, BLOCKS)


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's sums over its pairs, from the facts of its block's pairs."""
    names = [part.split()[0] for part in ALIGNED.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            block = {name: batch.column(name)[row] for name in batch.schema.names}
            arrays = {n: block[n].values.to_numpy(zero_copy_only=False)
                      for n in ("n_a", "n_b", "n_groups", "n_links", "cells", "pairs")}
            total, best = np.zeros(len(arrays["pairs"]), np.int64), np.zeros(len(arrays["pairs"]), np.int64)
            if block["facts"].is_valid:
                facts = block["facts"].values
                at = facts.field("pos").to_numpy(zero_copy_only=False)
                total[at] = facts.field("n").to_numpy(zero_copy_only=False)
                best[at] = facts.field("best").to_numpy(zero_copy_only=False)
            width = np.uint16 if len(total) <= 1 << 16 else np.uint32
            pair = np.frombuffer(block["pair"].as_py(), width)
            raw = block["times"].as_py()
            times = np.frombuffer(raw, f"u{max(1, len(raw) // max(1, len(pair)))}").astype(np.int64)
            stops = np.cumsum(arrays["cells"])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[pair] * times)])[np.concatenate([[0], stops])])
                    for x in (best, total)]
            columns = [block["doc_id"].values, *(arrays[n] for n in ("n_a", "n_b", "n_groups", "n_links")), *sums,
                       block["groups"].values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n == "groups_sha256" else pa.int64()) for n, c in zip(names, columns)],
                names=names)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Groups and links between two tokenizations, one row for every row.

    ``n_a, n_b``: tokens; ``n_groups``: intervals between shared cuts;
    ``n_links``: pairs of tokens whose byte ranges overlap; ``n_best``: links
    whose id pair is linked as often, over all rows, as any pair of its B id;
    ``count_sum``: over the links, how often their id pair is linked;
    ``groups_sha256``: digest of the groups' ids.

    Null and empty texts, and texts that either vocabulary does not give back
    byte by byte, have no tokens: zeros and an empty digest. Repeated rows and
    null ids count and are returned like any other row; an empty table gives no
    rows. Only id and text are read, so other columns' names do not matter."""
    blocks = staged(align_blocks(docs, id_col, text_col, vocabularies or default_vocabularies()), "blocks")
    pairs = blocks.select("block", F.posexplode("pairs").alias("pos", "code"), "counts").select(
        "block", "pos", "code", F.get("counts", F.col("pos")).alias("n"))
    counts = staged(pairs.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    token = F.shiftright("code", 32).alias("b")
    best = counts.groupBy(token).agg(F.max("n").alias("most"))  # at most B's vocabulary: 32,000 rows
    facts = counts.withColumn("b", token).join(F.broadcast(best), "b").select(
        "code", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    back = pairs.drop("n").join(facts, "code").groupBy("block").agg(
        F.collect_list(F.struct("pos", "n", "best")).alias("facts"))
    return blocks.drop("counts").join(back, "block", "left").mapInArrow(_finish, ALIGNED)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE (A) against pieces with byte fallback (B)."""
    return align(read_table(spark, sf_dir, "documents"))

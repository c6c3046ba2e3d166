"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric. Pivots cut the sets into regions, sets near a
border go to all regions a link could reach, and regions are joined exactly,
with document pivots and the triangle inequality where they are large. Almost
all documents lie at distance 1 from any document pivot, which would send
every one to every region; so the first level takes single shingles as pivots
(see ``set_components``), and document pivots work inside their regions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    HOT_KEYS, SpanHash, attach_groups, bit_map, byte_slices, connected, dropped, lowered, maybe_in, mix64, ranked, read_table,
    salted_join, staged, text_bytes, words)



class Link(NamedTuple):
    """Sets of shingles of ``words`` words link when den * intersection >= num * union."""

    words: int
    num: int
    den: int


OP7 = Link(3, 90, 100)
FREQUENT = 1 << 20  # frequent shingles that are put last in the order, at most
FREQUENT_FROM = 16  # sets a shingle must be seen in to be one of them
SKETCH = 64  # counters of a set's sketch
SLICE_BYTES = 1 << 19  # of text, whose shingles a task makes at once
BLOCK = 1 << 10  # members of a region that one task compares with as many others
MET = 1 << 16  # pairs of sketches a task holds at once

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = OP7.words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted: ``(hashes, counts)``.
    Texts of fewer words have their whole sequence as one shingle; texts
    without words have none."""
    low = lowered(raw)
    starts, stops, counts = words(low, offsets)
    w = SpanHash(low).of(starts, stops)
    n = len(counts)
    first = np.cumsum(counts) - counts
    full = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(n), full)
    at = np.repeat(first, full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = mix64(h + w[at + k] * _K[k % len(_K)])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hs = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            hs[more] = mix64(hs[more] + w[first[short[more]] + k] * _K[k % len(_K)] + np.uint64(1))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix64(hs)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(doc[new], minlength=n)


def set_ids(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit id per set: equal sets, equal ids. 0 for empty sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + _K[3]), dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    ids = mix64((total[ends[1:]] - total[ends[:-1]]) + counts.astype(np.uint64) * _K[4])
    ids[counts == 0] = 0
    return ids


def prefix_sizes(counts: np.ndarray, link: Link) -> np.ndarray:
    """How many first shingles, in any one order of all shingles, two linked
    sets cannot both miss: each set less its least overlap, and one."""
    return np.where(counts > 0, counts - (counts * link.num + link.den - 1) // link.den + 1, 0)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def _prefixes(docs: DataFrame, frequent: np.ndarray, times: int, link: Link) -> DataFrame:
    """``(doc_id, th, sid, n, prefix, sketch)`` with ``times`` the prefix needed, in
    the order: frequent shingles last, else by hash.

    The sketch counts a set's shingles in SKETCH classes of their hash. Shared
    shingles share a class, so the sum of the lesser counts is at least the
    intersection: the (weighted Jaccard) distance of two sketches is a metric
    too, and never above the distance of their sets."""
    state = docs.sparkSession.sparkContext.broadcast(frequent)  # 8 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state.value
        for batch in batches:
            for part in byte_slices(batch, 2, SLICE_BYTES):
                h, counts = shingle_sets(*text_bytes(part.column(2)), link.words)
                ids = set_ids(h, counts)
                cell = np.repeat(np.arange(len(counts)), counts) * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64)
                sketch = pa.ListArray.from_arrays(
                    np.arange(len(counts) + 1, dtype=np.int32) * SKETCH,
                    pa.array(np.bincount(cell, minlength=len(counts) * SKETCH).astype(np.int32)))
                take = np.minimum(prefix_sizes(counts, link) * times, counts)
                if len(last):
                    at = np.searchsorted(last, h)
                    at[at == len(last)] = 0
                    doc = np.repeat(np.arange(len(counts)), counts)
                    h = h[np.lexsort((h, last[at] == h, doc))]
                first = np.cumsum(counts) - counts
                place = np.arange(len(h)) - np.repeat(first, counts)
                h = h[place < np.repeat(take, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids.view(np.int64)), pa.array(counts.astype(np.int32)),
                     _lists(h, take), sketch], names=["doc_id", "th", "sid", "n", "prefix", "sketch"])

    return docs.select("doc_id", "th", "text").mapInArrow(
        run, "doc_id long, th long, sid long, n int, prefix array<long>, sketch array<int>")


def frequent_shingles(prefixes: DataFrame) -> np.ndarray:
    """The shingles that most sets hold among the first of theirs, sorted: a
    list of bounded length. It only fixes the order in which shingles are
    taken; any list gives the same links."""
    sets = prefixes.where("n > 0").groupBy("sid").agg(F.any_value("prefix").alias("prefix"))
    often = sets.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(
        F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "t").limit(FREQUENT).select("t").toArrow()
    return np.sort(often["t"].to_numpy().astype(np.int64).view(np.uint64))


def _sets(docs: DataFrame, wanted: DataFrame, link: Link) -> DataFrame:
    """``(sid, set)`` of the wanted sets ``(sid, th)``, once each. ``th`` is the hash
    of a text that has the set; only texts that the bitmap of these hashes lets
    through have their shingles made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0, SLICE_BYTES):
                h, counts = shingle_sets(*text_bytes(part.column(0)), link.words)
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, counts).view(np.int64)), _lists(h, counts)],
                                                 names=["sid", "set"])

    some = maybe_in(docs.select("text", "th"), staged(bit_map(wanted, "th"), "map"), "th").where("__maybe")
    few = some.select("text").mapInArrow(run, "sid long, set array<long>").groupBy("sid").agg(F.any_value("set").alias("set"))
    return few.join(wanted, "sid", "left_semi")


def _often(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """Keys that hold more than 1/HOT_KEYS of the rows; fewer than a thousand are never many."""
    if total <= 1000:
        return None
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(1000, total // HOT_KEYS))


def _joined(pairs: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """Pairs ``(a, b)`` with both sides' ``value`` as ``x`` and ``y``."""
    total = pairs.count()
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))
    near = maybe_in(facts.select("sid", value), staged(bit_map(ends, "sid"), "map"), "sid").where("__maybe")
    one = salted_join(pairs, near.select(F.col("sid").alias("a"), F.col(value).alias("x")), "a", _often(pairs, "a", total), ["b"])
    return salted_join(one, near.select(F.col("sid").alias("b"), F.col(value).alias("y")), "b", _often(pairs, "b", total), ["a"])


def _sketched(pairs: DataFrame, uniques: DataFrame) -> DataFrame:
    """``(a, b, both, either)`` of the sketches: no more than the sets differ."""
    both = F.aggregate(F.zip_with("x.sketch", "y.sketch", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
    size = F.col("x.n") + F.col("y.n")  # a sketch's counters sum to the size of its set
    pairs = staged(pairs, "pairs")
    facts = uniques.select("sid", F.struct("n", "sketch").alias("fact"))
    out = _joined(pairs, facts, "fact").select("a", "b", both.alias("both"), size.alias("__s"))
    out = staged(out.select("a", "b", "both", (F.col("__s") - F.col("both")).alias("either")), "sketched")
    dropped(pairs)
    return out


def _verified(docs: DataFrame, uniques: DataFrame, pairs: DataFrame, link: Link) -> DataFrame:
    """Of the pairs ``(a, b)``, whose sketches allow a link, those that link by the
    exact similarity of their whole sets."""
    pairs = staged(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    ends = staged(ends.join(uniques.select("sid", "th"), "sid"), "ends")
    sets = staged(_sets(docs, ends, link), "sets")
    both = F.size(F.array_intersect("x", "y"))
    out = staged(_links(_joined(pairs, sets, "set").select(
        "a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("either")), link), "links")
    dropped(pairs, ends, sets)
    return out


def _links(measured: DataFrame, link: Link) -> DataFrame:
    return measured.where(F.col("both") * link.den >= F.col("either") * link.num).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _grouped(regions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions with each set's component so far as ``grp`` and their number of
    members as ``many``, without those that are all one component and done; and
    the components as links, one for each set, for the next time."""
    comp = connected(links)
    named = comp.select(F.col("id").alias("sid"), F.col("component").alias("__c"))
    now = staged(regions.drop("grp", "many").join(named, "sid", "left").withColumn("grp", F.coalesce("__c", "sid")).drop("__c"), "grouped")
    mixed = now.groupBy("region").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = staged(mixed.select("region", "n"), "mixed")
    total = now.count()
    hot = mixed.where(F.col("n") > max(1000, total // HOT_KEYS)) if total > 1000 else None
    out = staged(salted_join(now, mixed.select("region", F.col("n").alias("many")), "region", hot, ["sid"]), "regions")
    dropped(now, mixed)
    return out, comp.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _close(link: Link, stop: int):
    """Pairs ``(a, b)`` of sets in one seat (rows sorted by seat and rank) that may
    link: each member that asks (``side`` 0 or 2, rank below ``stop``) with the
    members after it (``side`` 1 or 2), where components differ, the rings touch
    and sizes and sketches allow it. Only such pairs leave the task."""
    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        seat, sid, n, rank, grp, ring, side = (rows[c].to_numpy() for c in ("seat", "sid", "n", "rank", "grp", "ring", "side"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        new = np.flatnonzero(np.concatenate([[True], seat[1:] != seat[:-1]]))
        ends = np.repeat(np.append(new[1:], len(seat)), np.diff(np.append(new, len(seat))))
        asks = np.flatnonzero((rank < stop) & (side != 1))
        after = ends[asks] - asks - 1
        total = np.cumsum(after)
        at = 0
        while at < len(asks):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MET, side="right")))
            some = after[at:to]
            i = np.repeat(asks[at:to], some)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
            at = to
            may = (side[j] != 0) & (grp[i] != grp[j]) & (np.abs(ring[i] - ring[j]) <= 1) & (
                np.minimum(n[i], n[j]) * link.den >= np.maximum(n[i], n[j]) * link.num)
            i, j = i[may], j[may]
            x, y = sketch[i], sketch[j]
            apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)  # the sets differ in as many shingles at least
            size = n[i] + n[j]
            near = (size - apart) * link.den >= (size + apart) * link.num
            a, b = sid[i[near]], sid[j[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            seat = rows["seat"].to_numpy()
            whole = int(np.flatnonzero(seat != seat[-1])[-1]) + 1 if len(seat) and seat[0] != seat[-1] else 0
            if whole:
                yield from compared(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield from compared(held)

    return run


def _met(regions: DataFrame, uniques: DataFrame, start: int, width: int, link: Link) -> DataFrame:
    """``(a, b)``: the members of ranks from ``start`` with those after them, where
    ``_close`` leaves a chance. A region is cut into blocks of BLOCK ranks, and
    each block that asks meets each from it on in a seat of their own: a task
    holds two blocks at most and makes no rows but the pairs found."""
    block = F.floor(F.col("rank") / BLOCK).cast("int")
    last = F.floor((F.col("many") - 1) / BLOCK).cast("int")
    stop = start + width

    def seat(i, j, side: int):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    asked = F.filter(F.sequence(F.lit(start // BLOCK), F.greatest(F.least(block, F.lit((stop - 1) // BLOCK)), F.lit(start // BLOCK))), lambda k: k < block)
    asks = F.filter(F.sequence(block, last), lambda k: (k > block) & (F.col("rank") < stop))
    seats = F.concat(F.transform(asked, lambda k: seat(k, block, 1)), F.transform(asks, lambda k: seat(block, k, 0)),
                     F.when(block <= (stop - 1) // BLOCK, F.array(seat(block, block, 2))).otherwise(F.array()))
    sketch = F.expr("unhex(array_join(transform(sketch, v -> lpad(hex(least(v, 255)), 2, '0')), ''))")
    rows = regions.where((F.col("rank") >= start) & (F.col("many") > start + 1)).join(uniques.select("sid", sketch.alias("sketch")), "sid")
    dealt = rows.select("region", "sid", F.col("n").cast("long").alias("n"), "rank", "grp", "ring", "sketch", F.explode(seats).alias("s")).select(
        F.xxhash64("region", "s.i", "s.j").alias("seat"), "sid", "n", "rank", "grp", "ring", "s.side", "sketch")
    return dealt.repartition("seat").sortWithinPartitions("seat", "rank").mapInArrow(
        _close(link, stop), "a long, b long").distinct()


def set_components(docs: DataFrame, uniques: DataFrame, link: Link) -> DataFrame:
    """``(id, component)`` over set ids: the components of all links.

    1. Pivots of one shingle each: a set lies at distance 1 - 1/n from the
       pivots of its own shingles and at 1 from all others. Linked sets share
       a shingle among the first ``prefix`` of theirs, so a set goes to these
       regions only. Regions of two sets are pairs; regions with the same
       members are one region.
    2. In every larger region one set is the pivot. Its distance to all members
       is measured on the sketches, a metric space in which no distance is
       larger, so what is too far apart there cannot link; members that may be
       within the radius are verified on the whole sets.
    3. Members that are still of different components meet in rounds: the next
       32, 1024, 8192 ... members of the region are compared with those after them,
       but only where the triangle inequality over the pivot leaves a chance
       (rings of the radius, and one ring to each side), sizes allow a link,
       and the components differ. They meet inside a task that holds a block of
       the region (``_met``), so pairs that sketches rule out are never rows.
       Regions of one component leave.
    Every pair of a region is measured, known to be connected, or ruled out,
    so no link between components is lost."""
    cells = uniques.select("sid", "n", F.explode("prefix").alias("t"))
    buckets = staged(cells.groupBy("t").agg(
        F.count("*").alias("k"), F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.min("n").alias("small"),
        F.max("n").alias("large"), F.bit_xor(F.xxhash64("sid")).alias("sig")).where("k > 1"), "buckets")
    fits = F.col("small") * link.den >= F.col("large") * link.num
    twos = buckets.where((F.col("k") == 2) & fits).select(*_pair("lo", "hi")).distinct()
    total = uniques.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    more = buckets.where("k > 2")
    members = salted_join(cells, more.select("t", F.xxhash64("sig", "k").alias("region")), "t",
                          more.where(F.col("k") > max(1000, total // HOT_KEYS)), ["sid"]).select("region", "sid", "n").distinct()
    members = staged(members, "members")
    held = members.count()
    regions = staged(ranked(members, ["region"], ["sid"], held), "regions")
    dropped(members)
    hot = _often(regions, "region", held)
    hot = hot if hot is None else staged(hot, "hot")

    first = regions.where("rank = 0").select("region", F.col("sid").alias("p"))
    around = staged(salted_join(regions, first, "region", hot, ["sid"]), "around")
    sketched = _sketched(around.where("sid <> p").select(*_pair("sid", "p")).unionByName(twos).distinct(), uniques)
    links = _verified(docs, uniques, _links(sketched, link), link)
    # rings as wide as the radius; whole numbers, so that no rounding moves a set
    ring = F.floor((F.col("either") - F.col("both")) * link.den / (F.col("either") * (link.den - link.num)))
    rings = sketched.select("a", "b", ring.cast("int").alias("ring"))
    placed = around.withColumns({"a": F.least("sid", "p"), "b": F.greatest("sid", "p")}).join(rings, ["a", "b"], "left").select(
        "region", "sid", "n", "rank", F.coalesce("ring", F.lit(0)).alias("ring"))
    members, (regions, forest) = regions, _grouped(placed, links)
    dropped(buckets, members, around, sketched, links)

    start, width = 1, 32
    while True:
        top = regions.agg(F.max("rank").alias("r")).first()["r"]
        if top is None or top <= start:
            return connected(forest)
        close = staged(_met(regions, uniques, start, width, link), "met")
        new = _verified(docs, uniques, close, link) if not close.isEmpty() else None
        if new is not None and not new.isEmpty():
            before, (regions, linked) = regions, _grouped(regions, forest.unionByName(new))
            dropped(before, forest, new)
            forest = linked
        dropped(close)
        start, width = start + width, width * 32


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Link = OP7) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` and ``copies``
    (rows with the same set).

    Documents link when the Jaccard similarity of their shingle sets is at
    least ``num / den`` of ``link``; a component is named by its smallest id. Null and empty
    texts have no shingles and link with nothing (null ids then have a null
    component), equal sets always link, repeated ids are rows like any other,
    other columns are ignored, an empty table gives no rows. Sets are known by
    64-bit hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("th"))
    first = staged(_prefixes(rows, np.zeros(0, np.uint64), 2, link).select("sid", "n", "prefix"), "prefixes")
    frequent = frequent_shingles(first)
    dropped(first)
    found = staged(_prefixes(rows, frequent, 1, link), "prefixes")
    uniques = staged(found.where("n > 0").groupBy("sid").agg(
        F.any_value("n").alias("n"), F.any_value("th").alias("th"), F.any_value("prefix").alias("prefix"), F.any_value("sketch").alias("sketch"),
        F.min("doc_id").alias("least"),
        F.count("*").alias("copies")), "uniques")
    comp = set_components(rows, uniques, link).select(F.col("id").alias("sid"), "component")
    named = staged(uniques.select("sid", "least", "copies").join(comp, "sid", "left").withColumn(
        "component", F.coalesce("component", "sid")), "named")
    names = staged(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    hot = names.where(F.col("n") > max(1000, named.count() // HOT_KEYS))
    facts = staged(salted_join(named, names.select("component", "component_id"), "component", hot, ["sid"]).select(
        "sid", "component_id", "copies"), "facts")
    dropped(named, names)
    whole = attach_groups(found.where("n > 0").select("doc_id", "sid", "n"), facts, ["sid"], "copies", found.count())
    none = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                       F.lit(1).cast("long").alias("copies"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "copies").unionByName(none)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word Jaccard of at least 0.9."""
    out = ngram_join(read_table(spark, sf_dir, "documents"), link=OP7)
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "copies")

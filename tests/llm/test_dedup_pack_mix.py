"""Exact dedup, packing and mixing against brute force on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from emberline.llm import exact, mixing, packing

SCHEMA = "doc_id long, text string, source string, length int, keep_id string, rank long, n double"
ROWS = [
    (5, "a  b", "s1", 1, "x", 1, 0.0), (3, "a\tb", "s1", 1, None, 2, 0.0), (4, "a b", None, 2, "y", 3, 0.0),
    (1, None, "s2", None, "z", 4, 0.0), (2, "", "s2", None, "z", 4, 0.0), (None, "null id", "s2", 0, "z", 5, 0.0),
    (None, "null id", "s2", 0, "z", 5, 0.0), (7, "twice", "s3", 0, "z", 5, 0.0), (7, "twice", "s3", 0, "z", 5, 0.0),
    (8, "long " * 30_000, "s3", 0, "z", 5, 0.0), (9, "long " * 30_000 + "x", "s1", 0, "z", 5, 0.0),
    (10, "p" * 300 + "one", "s1", 0, "z", 5, 0.0), (11, "p" * 300 + "two", "s1", 0, "z", 5, 0.0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_exact_groups_edge_cases(docs):
    got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
                 for r in exact.exact_groups(docs).collect())
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ROWS]
    want = []
    for row, text in zip(ROWS, norm):
        ids = [r[0] for r, t in zip(ROWS, norm) if t == text]
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        want.append((row[0] or -1, keep, len(ids), row[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_exact_groups_empty(spark, docs):
    assert exact.exact_groups(docs.limit(0)).collect() == []


def test_one_hot_group(spark):
    rows = [(k, "same" if k % 3 else f"own {k}") for k in range(3000)]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["keep_id"], r["group_size"]) for r in got.where("group_size > 1").collect()} == {(1, 2000)}
    assert got.where("kept").count() == 1001


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    check_packing(rows, 1024)
    want = []
    for doc, text, *_ in ROWS:
        ids = np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        want += [(doc or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = [(r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_ids_are_those_of_the_json_vocabulary(spark):
    import public_tokenizers

    odd = ["<|endoftext|> inside", " \n\n  x", "it's 1234 don't", "naïve café — ß", "a" * 3000, " \x0b\x85", "日本語 😀"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").union(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"))
    fast, plain = (packing.cut_pieces(docs, vocabulary=v) for v in (
        None, public_tokenizers.path("byte_bpe_50k.json")))
    assert fast.exceptAll(plain).count() == 0 and plain.exceptAll(fast).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_bins_places_all_pieces_tightly(seed):
    rng = np.random.default_rng(seed)
    capacity = 1024
    sizes = rng.integers(1, capacity + 1, 4000) if seed % 2 else np.minimum(rng.lognormal(5, 1.2, 4000).astype(int) + 1, capacity)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(sizes, return_counts=True))}
    bins, placed = defaultdict(list), defaultdict(int)
    for length, lo, ranks, per, first, offset in packing.plan_bins(histogram, capacity):
        assert lo == placed[length]
        placed[length] += ranks
        for r in range(ranks):
            bins[first + r // per].append((offset + r % per * length, length))
    assert dict(placed) == histogram
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    # best-fit decreasing, one piece at a time, as the yardstick
    gaps = []
    for n in sorted(sizes, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    assert len(bins) <= len(gaps) * 1.005 + 1


def brute_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [3, 1, 2] * len(sizes)))
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in full]
        level = (total - sum(2.0 * sizes[s] for s in full)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2.0 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= over


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(3)
    names = ["b", "a", "ä", None, "c", "zz"]
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40) if k % 50 else 900)), names[int(k**1.3) % 6 if k % 3 else 0], k)
            for k in range(1500)] + [(None, None, "a", 1), (2, "x y", "b", 1), (2, "x y", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(dict(sizes))
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.002 * t)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=1e-3)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in out}


def test_mixing_rates_are_tilted_exponentially(spark):
    classes = spark.createDataFrame([("s", 10, 40), ("s", 100, 20), ("s", 400, 5)], "source string, size long, docs long")
    targets = spark.createDataFrame([("s", 4400, 5000.0)], "source string, source_size long, target double")
    m = mixing.solve_dual(classes, targets).first()["m"]
    rate = {n: min(2.0, np.exp(m * n)) for n in (10, 100, 400)}
    assert sum(d * n * rate[n] for n, d in ((10, 40), (100, 20), (400, 5))) == pytest.approx(5000, abs=0.3)


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert sorted(r["taken"] for r in mixing.mix(nothing).collect()) == [0, 0]

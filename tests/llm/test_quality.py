"""The n-gram model against a plain Python one, and what the classifier keeps."""

import math
from collections import Counter

import duckdb
import pytest

from conftest import SF_CHECK, SF_SMALL
from emberline.llm import quality

TEXTS = [t for (t,) in duckdb.sql(f"select text from '{SF_SMALL}/documents.parquet' order by doc_id limit 60").fetchall()]
DOCS = [(k, t, "en") for k, t in enumerate(TEXTS)] + [
    (900, None, None), (904, "a\U0010FFFEb\U0010FFFFc", "en"), (901, "", None), (902, "a" * 3000, "x"), (903, "long " * 20_000, "en"), (None, "é😀", "en")]
TRAIN = TEXTS[:30]


def plain_model(order):
    """Interpolated modified Kneser-Ney, one dictionary at a time."""
    def grams(text):
        text = (text or "").replace("\U0010FFFE", "\U0010FFFD").replace("\U0010FFFF", "\U0010FFFD")
        s = "\U0010FFFE" * (order - 1) + text + "\U0010FFFF"
        return [s[i - order + 1:i + 1] for i in range(order - 1, len(s))]

    tables = {order: Counter(g for t in TRAIN for g in grams(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    total, held, less = {}, {}, {}
    for k, table in tables.items():
        n = [max(1, sum(v == m for v in table.values())) for m in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        less[k] = [min(max(m + 1 - (m + 2) * y * n[m + 1] / n[m], 0.05), m + 0.95) for m in range(3)]
        total[k], held[k] = Counter(), Counter()
        for g, v in table.items():
            total[k][g[:-1]] += v
            held[k][g[:-1]] += less[k][min(v, 3) - 1]

    def p(gram):
        x = held[1][""] / total[1][""] / (len(tables[1]) + 1)
        for k in range(1, order + 1):
            g = gram[-k:]
            seen = (tables[k][g] - less[k][min(tables[k][g], 3) - 1]) / total[k][g[:-1]] if g in tables[k] else 0.0
            rest = held[k][g[:-1]] / total[k][g[:-1]] if k > 1 and total[k][g[:-1]] else 1.0
            x = seen + rest * x
        return x

    return lambda text: math.exp(-sum(math.log(p(g)) for g in grams(text)) / len(grams(text)))


@pytest.mark.parametrize("order, frequent, block", [(2, 1 << 18, 1 << 24), (4, 1 << 18, 1 << 24), (4, 300, 20_000), (4, 0, 1)])
def test_perplexities_are_those_of_the_plain_model(spark, monkeypatch, order, frequent, block):
    monkeypatch.setattr(quality, "FREQUENT", frequent)
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    model = quality.KneserNey(quality.count_ngrams(train, order), order)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, model).collect()}
    plain = plain_model(order)
    assert len(got) == len(DOCS)
    for doc, text, _ in DOCS:
        assert got[doc] == pytest.approx(plain(text), rel=1e-9)


def test_counts_over_many_code_points(spark):
    text = "".join(chr(0x10000 + k) for k in range(70_000))
    got = quality.count_ngrams(spark.createDataFrame([(text,)], "text string"), 2)
    assert got.count() == 70_001 and got.agg({"c": "max"}).first()[0] == 1


def test_clean_documents_stay(spark):
    out = quality.op4_quality(spark, SF_CHECK)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    kept = {r["quality"]: r["k"] for r in out.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).withColumnRenamed(
        "count(kept)", "k").collect()}
    assert out.count() == 1000 and set(kept) == {0, 1}
    rate = {r["quality"]: r["r"] for r in out.join(labels, "doc_id").groupBy("quality").agg(
        quality.F.avg(quality.F.col("kept").cast("double")).alias("r")).collect()}
    assert rate[1] >= 0.97 and rate[0] <= 0.3


def test_training_texts_either_way(spark, monkeypatch):
    """Ids that only the bitmap takes for trusted do not train, listed or joined."""
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "en")] * 3, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "doc_id long")
    want = Counter((r["doc_id"], round(r["perplexity"], 9)) for r in quality.classify(docs, trusted).collect())
    everything = quality.F.lit(True)
    with monkeypatch.context() as m:
        m.setattr(quality, "maybe_in", lambda rows, bitmap, col, flag="__maybe": rows.withColumn(flag, everything))
        assert Counter((r["doc_id"], round(r["perplexity"], 9)) for r in quality.classify(docs, trusted).collect()) == want
        m.setattr(quality, "MOST_WRONG", 0)
        assert Counter((r["doc_id"], round(r["perplexity"], 9)) for r in quality.classify(docs, trusted).collect()) == want


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "x", "en"), (None, "", "en")], "doc_id long, text string, lang string")
    nobody = spark.createDataFrame([], "doc_id long")
    assert {r["kept"] for r in quality.classify(docs, nobody).collect()} == {True}
    assert quality.classify(docs.limit(0), nobody).count() == 0


@pytest.mark.parametrize("order, letters", [(4, 5), (4, 70_000), (2, 300)])
def test_cells_of_many_texts(order, letters):
    """Packed numbers and rows of code points give the same cells, and they come back packed."""
    import random

    import numpy as np
    import pyarrow as pa

    from emberline.llm.common import text_bytes

    rng = random.Random(order)
    alphabet = [chr(0x4E00 + k) if k < 0x8000 else chr(0x10000 + k) for k in range(letters)]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(50)] + ["", "a" * 50]
    if letters > 1000:
        texts.append("".join(alphabet))
    found = quality.cells(*text_bytes(pa.array(texts)), order)
    want = Counter()
    for k, t in enumerate(texts):
        s = "\U0010FFFE" * (order - 1) + t + "\U0010FFFF"
        want.update((s[i:i + order], k) for i in range(len(t) + 1))
    grams = quality._strings(found.distinct)
    owner = np.repeat(np.arange(len(grams)), np.diff(found.first))
    assert Counter({(grams[g], t): c for g, t, c in zip(owner, found.text.tolist(), found.count.tolist())}) == want
    assert found.events.tolist() == [len(t) + 1 for t in texts]
    entries, held = quality._packed(owner, found.text, found.count, len(grams))
    values = quality._from_varints(held)
    assert len(values) == entries.sum() and sum((values & 3) + 1) == found.events.sum()


def test_memory_of_one_block(spark):
    """2 MB of text: what its arrays hold at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from emberline.llm.common import byte_slices, text_bytes

    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(580)]
    raw, offsets = text_bytes(pa.array(texts))
    assert len(raw) > 1_900_000
    tracemalloc.start()
    block = quality._Block()
    rows = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts), pa.array(["en"] * len(texts))],
                           names=["row", "doc_id", "text", "lang"])
    for part in byte_slices(rows, 2, quality.SLICE_BYTES):
        block.add(part, np.zeros(0, "U4"), np.zeros(0), quality.ORDER)
    block.row(0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20

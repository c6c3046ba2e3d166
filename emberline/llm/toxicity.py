"""Toxic spans by a linear-chain conditional random field.

Labels come per document, so token labels are made first: in toxic documents,
tokens whose word or stem is met almost only in toxic documents. On these a
two-state CRF is trained (words and stems as features, transitions between the
states). For every document, forward-backward gives each token's marginal;
marginals make the spans, and their sum, peak and odds make the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, byte_slices, lowered, mix64, read_table, runs, text_bytes
from .ngram_join import shingle_sets

# The classifier is fitted on a bounded sample of labelled rows.
FIT_TOXIC, FIT_CLEAN = 1500, 3000  # documents of each label, at most
FIT_CHARS = 20_000  # longer documents are not sampled
FIT_FEATURES = 20_000
STEMS = (4, 5, 6, 7, 8, 9, 10)  # bytes
SUPPORT, LIFT, PURE = 3, 4.0, 0.9
SURE = 5.0  # standard deviations above what chance gives
THRESHOLD = 0.7
FAINT = 0.05  # marginals below this are background

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


KINDS = (0, *STEMS)  # the word itself, then its stems


def tokens(raw: np.ndarray, offsets: np.ndarray, kinds=KINDS):
    """Runs of letters, and the hashes of each one's word and stems (0 where a
    word is shorter than the stem): ``(starts, stops, counts, keys)``."""
    low = lowered(raw)
    if len(raw) > 1:  # capital Latin-1 letters in UTF-8
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][capital] += 32
    starts, stops, counts = runs(_LETTER[raw], offsets)
    spans = SpanHash(low)
    keys = []
    for n in kinds:
        if n == 0:
            keys.append(spans.of(starts, stops))
            continue
        has = stops - starts >= n
        stem = np.zeros(len(starts), np.uint64)
        stem[has] = mix64(spans.of(starts[has], starts[has] + n) + np.uint64(n))
        keys.append(stem)
    return starts, stops, counts, keys


@dataclass
class Crf:
    keys: np.ndarray  # feature hashes, sorted
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # log potentials of 0->1, 1->0, 1->1 against 0->0
    doc: np.ndarray  # document scorer: intercept and weights

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)  # most tokens have no feature: one look tells
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def active(self, keys: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(token, feature) pairs for each kind of key."""
        out = []
        for k in keys:
            near = np.flatnonzero(self.seen[(k & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.keys, k[near])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == k[near] if len(self.keys) else np.zeros(len(near), bool)
            out.append((near[hit], at[hit]))
        return out

    def emissions(self, n: int, active) -> np.ndarray:
        e = np.full(n, self.bias)
        for token, feature in active:
            e[token] += self.weights[feature]
        return np.clip(e, -30, 30)


def forward_backward(e: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of state 1 given what stands up to each token (its own emission
    included), and given what follows. Two states need only their ratio; all
    documents step together, longest first."""
    a01, a10, a11 = np.exp(moves)
    x = np.exp(e)
    f, g = np.empty(len(e)), np.ones(len(e))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return f, g
    first = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # documents longer than t
    ahead = np.full(len(order), 0.0)
    for t in range(int(size[0])):
        at = first[:live[t]] + t
        r = ahead[:live[t]]
        r = x[at] * (a01 + a11 * r) / (1 + a10 * r)
        f[at] = r
        ahead = r
    last = first + size - 1
    back = np.ones(len(order))
    for t in range(1, int(size[0])):
        m = live[t]
        at = last[:m] - t
        r = x[at + 1] * back[:m]
        r = (a10 + a11 * r) / (1 + a01 * r)
        g[at] = r
        back[:m] = r
    return f, g


def doc_inputs(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a document's marginals say: their sum, peak and odds of any. What
    every token has a little of does not count, or length alone would add up."""
    p = np.where(p >= FAINT, p, 0.0)
    edges = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0.0], np.cumsum(p)])
    odds = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-6)))])
    peak = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        peak[full] = np.maximum.reduceat(p, edges[:-1][full])
    n = np.maximum(counts, 1)
    s = np.diff(total[edges])
    return np.column_stack([np.ones(len(counts)), np.log1p(s), peak, np.minimum(np.diff(odds[edges]), 20.0) / 5,
                            np.sqrt(np.maximum(s, 0) / n)])


def fit(texts: list[str], toxic: np.ndarray, rates: tuple[float, float], epochs: int = 12) -> Crf | None:
    """Train on a bounded sample. ``rates``: how many labelled documents each
    sampled clean and toxic one stands for."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    # one slice of text and one kind of key at a time: the driver holds no more
    sample = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = [text_bytes(part.column(0)) for part in byte_slices(sample, 0)]
    counts = np.concatenate([tokens(*part, kinds=())[2] for part in parts])

    def keys_of(kind: int) -> np.ndarray:
        return np.concatenate([tokens(*part, kinds=(kind,))[3][0] for part in parts])

    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    # a text and its near copies are one witness: those with the same least shingle
    least = np.arange(len(texts), dtype=np.uint64)
    at = 0
    for part in parts:
        h, sizes = shingle_sets(*part)
        least[at:at + len(sizes)][sizes > 0] = h[(np.cumsum(sizes) - sizes)[sizes > 0]]
        at += len(sizes)
    single = np.zeros(len(texts), bool)
    single[np.unique(least, return_index=True)[1]] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind in KINDS:
        k = keys_of(kind)
        use = single[doc] & (k != 0)
        order = np.lexsort((doc[use], k[use]))
        a, b = k[use][order], doc[use][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # once for each document
        key, at = np.unique(a[new], return_inverse=True)
        t = np.bincount(at, toxic[b[new]], minlength=len(key))
        c = np.bincount(at, minlength=len(key)) - t
        enough = t >= min(SUPPORT, toxic.sum())
        found.append((key[enough], t[enough], c[enough]))
    key, t, c = (np.concatenate(x) for x in zip(*found))
    nt, nc = max(1, (toxic & single).sum()), max(1, (~toxic & single).sum())
    lift = ((t + 0.5) / nt) / ((c + 0.5) / nc)
    chance = (t + c) * nt / (nt + nc)
    chosen = np.flatnonzero((t >= min(SUPPORT, nt)) & (lift >= LIFT) & (t >= chance + SURE * np.sqrt(chance)))
    chosen = chosen[np.argsort(-t[chosen] * np.log(lift[chosen]), kind="stable")[:FIT_FEATURES]]
    key, inverse = np.unique(key[chosen], return_index=True)
    pure = ((t / nt) / (t / nt + c / nc))[chosen][inverse] >= PURE
    model = Crf(key, np.zeros(len(key)), -4.0, np.array([-1.0, 0.0, 0.0]), np.zeros(5))
    active = [pair for kind in KINDS for pair in model.active([keys_of(kind)])]
    y = np.zeros(len(doc))
    for token, feature in active:
        y[token[pure[feature]]] = 1.0
    y *= toxic[doc]

    starts = np.concatenate([[0], np.cumsum(counts)])
    weight = np.where(toxic, 1.0, min(10.0, rates[0] / max(rates[1], 1e-9)))
    rng = np.random.default_rng(5)
    state = [model.weights, np.array([model.bias]), model.moves]
    m, v = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    pairs_t = np.concatenate([a for a, _ in active])
    pairs_f = np.concatenate([b for _, b in active])
    order = np.argsort(pairs_t, kind="stable")
    pairs_t, pairs_f = pairs_t[order], pairs_f[order]
    step = 0
    by_size = np.argsort(counts, kind="stable")
    groups = np.array_split(by_size, max(1, len(texts) // 300))
    for _ in range(epochs):
        for which in rng.permutation(len(groups)):
            docs = np.sort(groups[which])
            n = counts[docs]
            if not n.sum():
                continue
            tok = np.repeat(starts[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            local = np.full(len(doc), -1)
            local[tok] = np.arange(len(tok))
            use = local[pairs_t] >= 0
            lt, lf = local[pairs_t[use]], pairs_f[use]
            e = np.full(len(tok), state[1][0])
            np.add.at(e, lt, state[0][lf])
            e = np.clip(e, -30, 30)
            f, g = forward_backward(e, n, state[2])
            odds = f * g
            w = np.repeat(weight[docs], n)
            yy = y[tok]
            de = w * (yy - odds / (1 + odds))
            inner = np.ones(len(tok), bool)
            inner[np.cumsum(n)[n > 0] - 1] = False
            i = np.flatnonzero(inner)
            a01, a10, a11 = np.exp(state[2])
            xg = np.exp(e[i + 1]) * g[i + 1]
            joint = np.column_stack([np.ones(len(i)), a01 * xg, a10 * f[i], a11 * f[i] * xg])
            joint /= joint.sum(axis=1, keepdims=True)
            prev, nxt = yy[i], yy[i + 1]
            seen = np.column_stack([(1 - prev) * nxt, prev * (1 - nxt), prev * nxt])
            dm = (w[i, None] * (seen - joint[:, 1:])).sum(axis=0)
            heads = np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0]
            start_p = odds[heads] / (1 + odds[heads])
            dm[0] += (w[heads] * (yy[heads] - start_p)).sum()  # the state before a text is 0
            scale = 1.0 / max(1.0, weight[docs].sum())
            grads = [np.bincount(lf, de[lt], minlength=len(key)) * scale - 1e-4 * state[0],
                     np.array([de.sum() * scale]), dm * scale]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                state[k] = state[k] + 0.15 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
            state[2] = np.clip(state[2], -8, 8)
    model = Crf(key, state[0], float(state[1][0]), state[2], np.zeros(5))
    f, g = forward_backward(model.emissions(len(doc), active), counts, model.moves)
    x = doc_inputs(f * g / (1 + f * g), counts)
    sample_weight = np.where(toxic, rates[1], rates[0])
    sample_weight = sample_weight / sample_weight.mean()
    beta = np.zeros(5)
    for _ in range(30):  # Newton steps of a small ridge logistic fit
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (sample_weight * (toxic - q)) - 0.05 * beta
        hess = (x * (sample_weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(5)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -5, 5)
    model.doc = beta
    return model


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Crf | None:
    """Train on ``labels (doc_id, toxic)`` rows given (leave held-out rows out
    before): the rows of each label with the lowest hashed ids, so reruns
    agree. Only the sampled texts, a bounded set, reach the driver."""
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
              for t, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    ids = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "__id")
    got = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= FIT_CHARS)).join(F.broadcast(ids), "__id").select(
        "__id", "text", "toxic").orderBy("__id", "text").limit(FIT_TOXIC + FIT_CLEAN).toArrow()
    toxic = np.asarray(got["toxic"].to_pylist(), dtype=bool)
    per = [sizes.get(t, 0) / max(1, int((toxic == t).sum())) for t in (False, True)]
    return fit(got["text"].to_pylist(), toxic, (per[0], per[1]))


SCHEMA = "doc_id long, score double, spans array<struct<start: int, length: int, p: float>>"


def score_texts(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, score, spans)`` for every document, whole texts, no shuffle.

    ``spans`` are the tokens whose marginal is at least 0.5: first character,
    characters, marginal. Null texts count as empty and score like any text
    without toxic tokens; without labels of both kinds there is no model and
    every score is 0. Null or repeated ids are rows like any other, other
    columns are ignored, an empty table gives no rows."""
    state = docs.sparkSession.sparkContext.broadcast(model)  # FIT_FEATURES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = state.value
        for batch in batches:
            for part in byte_slices(batch, 1):
                yield _score(crf, part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Crf | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, all columns as they are, no
    shuffle. Without a model every row stays."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                ids = pa.array(np.arange(part.num_rows))
                scored = _score(state.value, pa.RecordBatch.from_arrays([ids, part.column(text)], names=["k", "text"]))
                yield part.filter(pa.compute.less(scored.column("score"), threshold))

    return docs.mapInArrow(run, docs.schema)


_SPAN = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("p", pa.float32())])


def _score(crf: Crf | None, part: pa.RecordBatch) -> pa.RecordBatch:
    if crf is None:
        score = np.zeros(part.num_rows)
        spans = pa.ListArray.from_arrays(np.zeros(part.num_rows + 1, np.int32), pa.array([], _SPAN))
    else:
        raw, offsets = text_bytes(part.column(1))
        starts, stops, counts, keys = tokens(raw, offsets)
        f, g = forward_backward(crf.emissions(len(starts), crf.active(keys)), counts, crf.moves)
        p = f * g / (1 + f * g)
        score = 1 / (1 + np.exp(-np.clip(doc_inputs(p, counts) @ crf.doc, -30, 30)))
        toxic = np.flatnonzero(p >= 0.5)
        owner = np.searchsorted(np.cumsum(counts), toxic, side="right")
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        spans = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype(np.int32),
            pa.StructArray.from_arrays([
                pa.array((chars[starts[toxic]] - chars[offsets[owner]]).astype(np.int32)),
                pa.array((chars[stops[toxic]] - chars[starts[toxic]]).astype(np.int32)),
                pa.array(p[toxic].astype(np.float32))], fields=list(_SPAN)))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(score), spans], names=["doc_id", "score", "spans"])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that never saw the held-out third."""
    docs = read_table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where(~held_out())
    scored = score_texts(docs, fit_on_labels(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")

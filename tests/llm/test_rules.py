"""Counts against plain Python; the robust estimate against the same steps in NumPy."""

import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF_CHECK
from emberline.llm import rules

TEXTS = [None, "", " \n ", "a b c a b c", "a a a a", "a b c d a b c\nx\n\nx\n x\r\nx", "z " * 6000, "€ # \x0b\x0c ü|",
         "one two three four " * 30, "\n".join(["same line here"] * 70), "p q r s t u v w p q r x q r s"]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(repeated), failed)


def estimate(x, keep):
    cov = np.cov(x[keep].T, bias=True) + np.diag(np.square(rules.FLOOR))
    return x[keep].mean(axis=0), cov


def distances(x, fit):
    d = x - fit[0]
    return np.einsum("ij,ij->i", d @ np.linalg.inv(fit[1]), d)


def fence(x):
    """Squared distances of all rows from their group's estimate."""
    def bins(d):
        return np.floor(np.log(d + 1e-9) * rules.BINS)

    def quartile(v, q):
        return np.floor(np.sort(v)[int(np.ceil(q * len(v))) - 1] * 64) / 64

    q = np.array([[quartile(v, p) for p in (0.25, 0.5, 0.75)] for v in x.T])
    fits = [(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2 + np.square(rules.FLOOR))),
            estimate(x, np.ones(len(x), bool))]
    for _ in range(rules.STEPS):
        new = []
        for fit in fits:
            b = bins(distances(x, fit))
            below = np.array([(b < v).sum() for v in b])
            new.append(estimate(x, below < rules.SHARE * len(x)))
        shrunk = [np.linalg.det(n[1]) < 0.999 * np.linalg.det(f[1]) for n, f in zip(new, fits)]
        fits = new
        if not any(shrunk):
            break
    d = distances(x, min(fits, key=lambda f: np.linalg.det(f[1])))
    b = bins(d)
    median = max(v for v in b if 2 * (b < v).sum() < len(x))
    wider = max(1.0, np.exp((median + 1) / rules.BINS) / rules.CHI_HALF)
    return distances(x, estimate(x, np.exp(b / rules.BINS) <= rules.CHI_MOST * wider))


def vector(c):
    return [np.log(c[1] / c[0]), *(np.log1p(100 * c[k] / c[0]) for k in (2, 3, 4))]


def test_counts(spark):
    schema = "doc_id long, text string, lang string, source string, words string, key string, size long, n_words long, x0 int"
    rows = [(k, t, None, "s", "w", "k", 1, 2, 3) for k, t in enumerate(TEXTS)] + [(None, TEXTS[3], "en", None, "", "", 0, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r[0], *r[1:7]) for r in rules.quality_rules(docs).collect()), key=str)
    assert got == sorted(((r[0], *counts(r[1])) for r in rows), key=str)
    assert rules.quality_rules(docs.limit(0)).collect() == []
    # too few rows for an estimate: what does not fail is kept
    assert {r["kept"] for r in rules.quality_rules(docs).where("not base_failed").collect()} <= {True}


def test_whole_table(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in rules.op12_quality_rules(spark, SF_CHECK).collect()}
    want = {k: counts(d["text"]) for k, d in docs.items()}
    assert {k: tuple(r[1:7]) for k, r in got.items()} == want
    passed = [k for k in want if not want[k][5]]
    own = Counter((docs[k]["lang"], docs[k]["source"]) for k in passed)
    group = {k: g if own[g := (docs[k]["lang"], docs[k]["source"])] >= rules.LEAST_GROUP else g[:1] for k in passed}
    sizes = Counter(group.values())
    group = {k: g if sizes[g] >= rules.LEAST_GROUP else () for k, g in group.items()}
    sizes = Counter(group.values())
    largest = max(sizes, key=lambda g: sizes[g])
    group = {k: g if sizes[g] >= rules.LEAST_GROUP else largest for k, g in group.items()}
    for g in set(group.values()):
        ids = [k for k in passed if group[k] == g]
        for k, d in zip(ids, fence(np.array([vector(want[k]) for k in ids]))):
            assert got[k]["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)
            assert got[k]["kept"] == (d <= rules.CHI_FENCE)
    assert not any(r["kept"] for r in got.values() if r["base_failed"])


def test_finds_outliers_of_a_hot_group(spark):
    """A group with a tenth of symbol texts, another whose texts all have symbols."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(80)]
        hot, odd = k % 3 == 0, k % 30 == 1
        extra = ["#$%"] * 20 if odd and not hot else ["|"] * int(rng.integers(6, 12)) if hot else []
        rows.append((k, " ".join(words + extra), None if hot else "en", "s"))
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k, kept in got.items() if not kept} == {k for k in got if k % 30 == 1 and k % 3}

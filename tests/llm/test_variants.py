"""Spelling variants against SQL, and against all pairs on small vocabularies."""

import random
import zlib
from collections import Counter

import duckdb
import pytest

from conftest import SF_SMALL
from emberline.llm import variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(rows):
    import re

    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("region", [variants.REGION, 3])
def test_equals_sql(spark, monkeypatch, region):
    monkeypatch.setattr(variants, "REGION", region)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({variants.OP11_SQL})").fetchall(), key=str)
    assert rows_of(variants.op11_spelling_variants(spark, SF_SMALL)) == want


@pytest.mark.parametrize("region", [variants.REGION, 4])
def test_one_hot_family(spark, monkeypatch, region):
    """Most words in few regions: short alphabets, shared beginnings, letters in rows."""
    monkeypatch.setattr(variants, "REGION", region)
    monkeypatch.setattr(variants, "PARTIAL", 50)
    rng = random.Random(3)
    rows = []
    for doc_id in range(40):
        words = ["anfang" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(120)]
        words += ["a" * rng.randint(4, 9) for _ in range(20)] + ["Ende" + rng.choice("nrs×")] * 3
        rows.append((doc_id, " ".join(words)))
    assert rows_of(variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark):
    long = "x" * 3000
    rows = [(1, "Straße straße STRASSE strasse-strasse 日本 naïve"), (1, "Straße straße STRASSE strasse-strasse 日本 naïve"),
            (None, "strabe strabe strabe naïve naive"), (None, "naïve naive naive"), (3, None), (4, ""), (5, "12 ab cd"),
            (6, f"{long} {long} {long} {long}y {long}y {long}y {long}y {long}y {long}y {long}y"),
            (7, "Éclair Éclair Éclair éclair éclair éclair")]
    schema = "doc_id long, text string, word string, n long, head string, size long, least int, root string"
    docs = spark.createDataFrame([(*r, "w", 1, "h", 2, 3, "r") for r in rows], schema)
    assert rows_of(variants.spelling_variants(docs)) == brute(rows)
    assert rows_of(variants.spelling_variants(docs.limit(0))) == []


def test_ties_and_chains(spark):
    text = " ".join(["abcde"] * 3 + ["abcdef"] * 6 + ["abcdeg"] * 6 + ["abcdefg"] * 12 + ["abcdefgh"] * 24)
    got = {r["word"]: r for r in variants.spelling_variants(
        spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()}
    assert (got["abcde"]["form"], got["abcde"]["root"], got["abcde"]["n_near"]) == ("abcdef", "abcdefgh", 2)
    assert (got["abcdefgh"]["form"], got["abcdefgh"]["root"], got["abcdefgh"]["form_n"]) == (None, "abcdefgh", None)

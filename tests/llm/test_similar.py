"""N-gram join and line dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_SMALL
from emberline.llm import lines, ngram_join


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, families=6, members=60, words=80):
    """Chains and balls of near copies, some just above and some below the radius."""
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{k}" for k in range(500)]
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for m in range(members):
            text = list(base) if m % 3 else list(rows[-1][1].split()) if rows and m else list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009 + f, " ".join(text)))
    return rows


def run_join(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect())


def test_join_equals_brute_force_on_families(spark):
    rows = near_copies(5)
    assert run_join(spark, rows) == brute_components(rows)


def test_join_edge_cases(spark):
    rows = [(4, None), (3, ""), (2, " \t"), (9, "One two"), (8, "one\x0bTWO"), (7, "one"), (6, "ONE"), (5, "É x y"), (1, "é x y"),
            (None, "a b c d"), (12, "a b c d"), (12, "a b c d"), (13, "a b c e"), (None, "only null"),
            (20, "long word " * 5000), (21, "long word " * 5000 + "end")]
    assert run_join(spark, rows) == brute_components(rows)
    assert run_join(spark, []) == Counter()


def test_join_on_sample_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert run_join(spark, rows) == brute_components(rows)


def test_frequent_shingles_only_change_the_order(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 2)
    rows = near_copies(8, families=3, members=30)
    assert run_join(spark, rows) == brute_components(rows)


def test_regions_of_any_number_of_blocks(spark, monkeypatch):
    rows = near_copies(12, families=2, members=70)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "MET", 50)
    assert run_join(spark, rows) == brute_components(rows)


def test_sets_just_outside_the_radius_are_no_rows(spark, monkeypatch):
    """240 texts of one template, all apart, and a few copies: pairs that only meet
    in a region stay inside its task."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(140)]
    rows = [(k, " ".join(shared + [f"o{k}x{j}" for j in range(12)])) for k in range(240)]
    rows += [(500 + k, rows[k][1] + " end") for k in range(0, 240, 60)]
    rng.shuffle(rows)
    held, stage = [], ngram_join.staged

    def counted(df, name):
        out = stage(df, name)
        if set(out.columns) >= {"a", "b"}:
            held.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "staged", counted)
    assert run_join(spark, rows) == brute_components(rows)
    assert max(held) <= 10 * len(rows)


# ---- lines -------------------------------------------------------------------

def python_shingles(line):
    import re

    out, at = set(), 0
    step = re.compile(r"\S[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+")
    while at < len(line):
        out.add(line[at:at + lines.SHINGLE])
        at = step.match(line, at).end()
    return out


def brute_lines(rows, threshold=0.8):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    distinct, first = [], {}
    for k in order:
        for pos, line in enumerate((rows[k][1] or "").split("\n")):
            line = line.strip(" \t\r\f\x0b")
            if line and line not in first:
                first[line] = (k, pos)
                distinct.append((line, python_shingles(line)))
    parent = {x: x for x, _ in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            x, y = distinct[a][1], distinct[b][1]
            both = len(x & y)
            if both * 1000 >= round(threshold * 1000) * (len(x) + len(y) - both):
                ra, rb = find(distinct[a][0]), find(distinct[b][0])
                parent[max(ra, rb, key=lambda r: (order.index(first[r][0]), first[r][1]))] = min(
                    ra, rb, key=lambda r: (order.index(first[r][0]), first[r][1]))
    out = []
    for k, (i, text) in enumerate(rows):
        if text is None:
            out.append((i, None))
            continue
        kept = []
        for pos, line in enumerate(text.split("\n")):
            bare = line.strip(" \t\r\f\x0b")
            if not bare or first[find(bare)] == (k, pos):
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return Counter(out)


def run_lines(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, pos int").repartition(4)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines_kept", "lines_dropped"]
    rows = got.collect()
    for r in rows:
        solid = sum(bool(x.strip(" \t\r\f\x0b")) for x in (r["text"] or "").split("\n"))
        assert r["lines_kept"] == solid
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "lom", "stu")]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 14, 25)))) for _ in range(25)]
    rows = []
    for k in range(60):
        own = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(words)
            own.append(rng.choice(("", "  ", "")) + " ".join(w) + rng.choice(("", "\r")))
        rows.append((k, "\n".join(own)))
    assert run_lines(spark, rows) == brute_lines(rows)


def test_line_edge_cases(spark):
    rows = [(3, None), (2, ""), (1, "a\n\na\n \nb"), (4, "a"), (None, "b\nnull id first"), (6, "x" * 50_000 + "\nown"),
            (7, "x" * 50_000), (8, "\n\n"), (9, "über alles line one two three"), (10, "tail\nüber alles line one two three")]
    assert run_lines(spark, rows) == brute_lines(rows)
    assert run_lines(spark, []) == Counter()


def test_lines_of_repeated_rows(spark):
    """A table loaded twice keeps what it keeps loaded once; names may clash with any of ours."""
    rows = [(5, "same\n\nrow", 1), (5, "same\n\nrow", 2), (5, "same\n\nrow", 2), (None, "no id", 3), (None, "no id", 3), (6, "row\nown", 4),
            (7, None, 5), (7, None, 5), (8, "", 6), (8, "", 6)]
    columns = "doc_id long, text string, dh int"
    docs = spark.createDataFrame(rows, columns)
    for name in ("h", "gone", "later", "row", "parts", "solid", "__maybe", "__page", "component", "key", "a", "first", "n"):
        docs = docs.withColumn(name, F.lit(name))
    got = lines.dedup_lines(docs.repartition(3))
    assert got.columns == [*docs.columns, "lines_kept", "lines_dropped"]
    found = Counter((r["doc_id"], r["text"], r["lines_kept"], r["lines_dropped"]) for r in got.collect())
    assert found == Counter([(5, "same\n\nrow", 2, 0), (5, "", 0, 2), (5, "", 0, 2), (None, "no id", 1, 0), (None, "", 0, 1),
                             (6, "own", 1, 1), (7, None, 0, 0), (7, None, 0, 0), (8, "", 0, 0), (8, "", 0, 0)])
    assert {r["gone"] for r in got.collect()} == {"gone"}
    # the copies' empty texts aside, the same as of the table loaded once
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    once = Counter(tuple(r) for r in lines.dedup_lines(base).select("doc_id", "text").collect())
    both = lines.dedup_lines(base.unionByName(base)).where("not (lines_kept = 0 and lines_dropped > 0)")
    assert Counter(tuple(r) for r in both.select("doc_id", "text").collect()) == Counter(
        {k: n for k, n in once.items() if k[1].strip()})


def test_shards_and_buckets_of_any_size(spark, monkeypatch):
    """Shards that go on as rows and buckets cut into blocks give the same."""
    rows = template_lines(5, 200, 130, 50)[0] + [(1000 + k, x) for k, (_, x) in enumerate(template_lines(6, 120, 50, 20)[0])]
    want = brute_lines(rows)
    for name, value in (("SHARD_CELLS", 1), ("BUCKET", 16), ("CELLS", 500), ("CHUNK_LINES", 7), ("WIDE", 5)):
        with monkeypatch.context() as m:
            m.setattr(lines, name, value)
            assert run_lines(spark, rows) == want, name


def test_a_bucket_of_many_lines(spark):
    """50,000 lines of one template, all apart: no pair of the bucket is made, none of the planted copies lost."""
    rows, planted = template_lines(9, 50_000, 130, 50)
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, "\n".join(x for _, x in rows[k * 500:k * 500 + 500])) for k in range(len(rows) // 500 + 1)], "doc_id long, text string")
    got = lines.dedup_lines(docs).agg(F.sum("lines_kept"), F.sum("lines_dropped")).first()
    assert tuple(got) == (50_000, planted)


def test_a_line_in_every_document(spark):
    rows = [(k, f"the one line that all of them hold\nmine is number {k * 7919} {k * 104729}") for k in range(1500)]
    got = run_lines(spark, rows)
    assert sum(t.startswith("the one") for _, t in got) == 1 and got[(0, rows[0][1])] == 1


def test_one_changed_letter_links(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(120):
        line = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(12, 26)))
        at = rng.choice([i for i, c in enumerate(line) if c != " "])
        rows += [(2 * k, line), (2 * k + 1, line[:at] + "#" + line[at + 1:])]
    blankless = "".join(rng.choice(letters) for _ in range(200))
    rows += [(900, blankless), (901, "x" + blankless), (902, "漢字" * 2 + blankless)]
    got = run_lines(spark, rows)
    assert sum(n for (_, text), n in got.items() if text) == 121
    assert got == brute_lines(rows)


def template_lines(seed, members, shared, own):
    """Lines of one template, all below 0.8 of each other, and a near copy of every seventh."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    part = "".join(rng.choice(letters) for _ in range(shared))
    lines_, copies = [], []
    for k in range(members):
        line = part + "".join(rng.choice(letters) for _ in range(own))
        lines_.append(line)
        if k % 7 == 0:
            copies.append(line[:-2] + "##")
    rows = [(k, x) for k, x in enumerate(lines_ + copies)]
    return rows, len(copies)


def test_near_copies_among_template_lines(spark):
    for shared, own in ((130, 50), (50, 20)):
        rows, planted = template_lines(shared, 300, shared, own)
        got = run_lines(spark, rows)
        assert sum(n for (_, text), n in got.items() if not text) == planted
        assert got == brute_lines(rows)


def test_line_work_holds_bounded_slices(monkeypatch):
    """3 MB of short texts in one batch: lines are made of 512 KB at a time, and cells
    leave a task 3 MB at a time (and what one slice adds)."""
    seen, make = [], lines.line_spans

    def measured(raw, offsets):
        seen.append(len(raw))
        return make(raw, offsets)

    class Texts:  # hands back the Arrow function itself
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(lines, "line_spans", measured)
    rng = random.Random(2)
    texts = ["\n".join(f"line {rng.random()} of {rng.random()}" for _ in range(25)) for _ in range(3000)]
    batches = pa.table({"text": texts}).to_batches()
    out = list(lines._packed_cells(Texts(), 4, 0.8)(iter(batches)))
    assert sum(seen) == sum(len(t) for t in texts) and max(seen) <= 1 << 19
    held = [sum(len(x.as_py()) for x in b.column(1)) for b in out]
    assert sum(held) > 10 << 20 and max(held) <= 8 << 20


def test_long_lines_of_a_template_are_no_pairs(spark, monkeypatch):
    """The sketch of long lines is as fine as they need: lines far apart are not verified."""
    rows, planted = template_lines(21, 90, 900, 260)
    held, stage = [], lines.staged

    def counted(df, name):
        out = stage(df, name)
        if name == "pairs":
            held.append(out.count())
        return out

    monkeypatch.setattr(lines, "staged", counted)
    assert run_lines(spark, rows) == brute_lines(rows)
    assert len(held) == 3 and held[1] <= 2 * planted


def test_a_pair_of_many_buckets_is_said_once(monkeypatch):
    monkeypatch.setattr(lines, "FOUND", 4)
    names = ["seat", "side", "a", "grp", "size", "odd", "fine"]
    rows = [(seat, 0, a, a, 30, b"\0" * 32, b"") for seat in range(9) for a in (3, 7)]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    out = pa.Table.from_batches(lines._close(0.8)(iter([batch]))).to_pylist()
    assert out == [{"a": 3, "b": 7}]


def test_shingles_are_made_from_bounded_slices(spark, monkeypatch):
    """3 MB of short texts in one batch: no step holds more than 512 KB of them."""
    seen, make = [], ngram_join.shingle_sets

    def measured(raw, offsets, size):
        seen.append(len(raw))
        return make(raw, offsets, size)

    class Docs:  # hands back the Arrow function itself
        sparkSession = spark

        def select(self, *names):
            self.names = names or self.names
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(ngram_join, "shingle_sets", measured)
    texts = [f"text {k} " + "of many words " * 70 for k in range(3000)]
    table = pa.table({"doc_id": range(3000), "th": range(3000), "text": texts})
    docs = Docs()
    docs.names = ("doc_id", "text")
    run = ngram_join._prefixes(docs, np.zeros(0, np.uint64), 2, ngram_join.OP7)
    out = list(run(table.select(list(docs.names)).to_batches()))
    assert sum(b.num_rows for b in out) == 3000 and sum(seen) == sum(len(t) for t in texts)
    assert max(seen) <= 1 << 19


def test_sets_are_made_of_texts_that_have_them_only(spark):
    """The filter on text hashes comes before the shingles; the sets are whole."""
    rows = [(k, f"alpha beta {k} gamma delta {k} epsilon") for k in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text"))
    found = ngram_join._prefixes(docs, np.zeros(0, np.uint64), 1, ngram_join.OP7).where("doc_id in (3, 77)")
    wanted = spark.createDataFrame(found.select("sid", "th").collect(), "sid long, th long")
    sets = ngram_join._sets(docs, wanted, ngram_join.OP7)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("__map")
    got = {r["sid"]: sorted(r["set"]) for r in sets.collect()}
    assert set(got) == {r["sid"] for r in wanted.collect()} and {len(s) for s in got.values()} == {5}

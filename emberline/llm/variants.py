"""Spelling variants: words one edit apart, grouped under the most frequent.

Two words one edit apart agree before it and after it. Cut in the middle of the
shorter length, they share the first part or the last, so a word is sent to the
regions of its first and of its last part only. A region with too many words is
cut the same way again, inside what its words do not share yet, until it is
small or only a single code point is left, which the alphabet bounds.

Inside a region the vocabulary is a sorted list. Rows of the edit matrix, cut to
the band of one edit, belong to prefixes: words that follow each other reuse the
rows of their longest common prefix, and when a row has no entry left within one
edit, the whole range of words with that prefix is skipped. Rows of all words of
many regions are computed together, one prefix length after the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, byte_slices, read_table, staged

LEAST_LENGTH, LEAST_COUNT = 5, 3
EVERY = 97  # of the checksums, those divisible by it lose a code point
REGION = 4_000  # words of a region that one task compares at once
CELLS = 1 << 17  # code points of the regions a task takes together
PARTIAL = 100_000  # words counted in a task before they are sent on

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_FAR = 9  # any distance beyond one edit


def _counted(doc_id: int | None, text: str, counts: Counter) -> None:
    """Adds one text's words. In Latin-1 a code point of a run is one byte and
    ``lower`` changes only A-Z; all other code points end a run either way."""
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        if start is not None:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            counts[run] += n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of whole texts: see ``spelling_variants`` for what a word is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in byte_slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    _counted(doc_id, text.as_py() or "", counts)
                    if len(counts) >= PARTIAL:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- regions -------------------------------------------------------------

KEY = ["least", "head", "tail"]


def first_regions(words: DataFrame) -> DataFrame:
    """Each word among words of its length and one more, and of its length and
    one less: regions of first parts and of last parts. ``least`` is the shorter
    length, ``head`` and ``tail`` what all words of the region share, and pairs
    that share ``bar`` code points or more at the front belong elsewhere."""
    n = F.length("word")
    least = words.withColumn("least", F.explode(F.array(n, n - 1))).where(F.col("least") >= LEAST_LENGTH)
    return _halves(least.withColumns({"head": F.lit(""), "tail": F.lit(""), "bar": F.lit(1 << 30)}))


def _halves(rows: DataFrame) -> DataFrame:
    """A region's words in the regions of the first and of the last half of what
    they do not share yet."""
    have, end = F.length("head"), F.length("tail")
    free = F.col("least") - have - end
    cut = (have + F.floor(free / 2)).cast("int")
    keep = (end + free - F.floor(free / 2)).cast("int")
    front = F.struct(F.substring("word", F.lit(1), cut).alias("head"), F.col("tail").alias("tail"), F.col("bar").alias("bar"))
    back = F.struct(F.col("head").alias("head"), F.substring("word", F.length("word") - keep + 1, keep).alias("tail"),
                    F.least("bar", cut).alias("bar"))
    return rows.withColumn("__part", F.explode(F.array(front, back))).select(
        "word", "n", "least", "__part.head", "__part.tail", "__part.bar")


FOUND = "word string, n_near long, form string, form_n long"


def _near_in_regions(regions: list[tuple[list[bytes], list[int], int, int, int, int]]
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(region, word, other)`` numbers of all pairs one edit apart, both ways
    round, for regions ``(words, counts, least length, shared at the front,
    shared at the end, bar)``. Words of the least length look for others; pairs
    of longer words are another region's."""
    which = np.repeat(np.arange(len(regions)), [len(r[0]) for r in regions])
    middles = [w[head:len(w) - tail] for words, _, _, head, tail, _ in regions for w in words]
    shorter = np.array([len(w) == least for words, _, least, *_ in regions for w in words])
    sizes = np.array([len(m) for m in middles])
    width = int(sizes.max()) + 3
    letters = np.zeros((len(middles), width), np.uint8)  # 0 is no letter
    letters[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(middles), np.uint8)
    order = np.lexsort([*letters[:, :width - 3].T[::-1], which])
    letters, sizes, which = letters[order], sizes[order], which[order]
    # longest common prefix with the word before; none at a region's first word
    same = letters[1:] == letters[:-1]
    shared = np.where(which[1:] == which[:-1], np.argmin(same, axis=1), 0)
    shared = np.minimum(np.concatenate([[0], shared]), sizes)
    fresh = np.concatenate([[True], which[1:] != which[:-1]])
    # rows of the edit matrix: (prefix, word) with distances to the word's first depth-1, depth, depth+1 letters
    prefix = np.flatnonzero(fresh)  # a prefix is known by the first word that has it
    query = np.flatnonzero(shorter[order])
    node = (np.cumsum(fresh) - 1)[query]
    band = np.tile(np.array([_FAR, 0, 1], np.int8), (len(query), 1))
    found = []
    for depth in range(width):
        # words that end with this prefix
        gap = sizes[query] - depth + 1
        ends = (sizes[prefix[node]] == depth) & (gap >= 0) & (gap <= 2)
        hit = np.flatnonzero(ends)
        hit = hit[band[hit, gap[hit]] == 1]
        found.append(np.stack([order[query[hit]], order[prefix[node[hit]]]]))
        # prefixes one letter longer, and which of them follow each prefix
        longer = np.flatnonzero((sizes > depth) & ((shared <= depth)))
        if not len(longer) or not len(query):
            break
        last = np.append(prefix[1:], len(sizes))
        low, high = np.searchsorted(longer, prefix), np.searchsorted(longer, last)
        count = (high - low)[node]
        rows = np.repeat(np.arange(len(query)), count)
        child = np.arange(len(rows)) + np.repeat(low[node] - (np.cumsum(count) - count), count)
        query, band = query[rows], band[rows]
        letter = letters[longer[child], depth]
        new = np.empty_like(band)
        left = np.full(len(query), _FAR, np.int8)
        for k in range(3):  # against the word's letter number depth + k - 1
            own = letters[query, depth + k - 1] if depth + k >= 1 else np.zeros(len(query), np.uint8)
            step = band[:, k] + (own != letter)
            if k < 2:
                step = np.minimum(step, band[:, k + 1] + 1)
            new[:, k] = left = np.minimum(np.minimum(step, left + 1), _FAR)
        near = new.min(axis=1) <= 1  # else the range of this prefix is skipped
        prefix, node, query, band = longer, child[near], query[near], new[near]
    word, other = np.concatenate(found, axis=1)
    back = ~shorter[other]
    word, other = np.append(word, other[back]), np.append(other, word[back])
    group = np.repeat(np.arange(len(regions)), [len(r[0]) for r in regions])[word]
    return group, word, other


def _common_prefix(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _best(regions: list) -> pa.RecordBatch:
    """For each word with near words in its region: how many, and the best."""
    words = [w for r in regions for w in r[0]]
    counts = [n for r in regions for n in r[1]]
    out: dict[int, list] = {}
    for region, word, other in zip(*(x.tolist() for x in _near_in_regions(regions))):
        if _common_prefix(words[word], words[other]) < regions[region][5]:
            rank = (-counts[other], words[other])
            seen = out.setdefault(word, [0, rank])
            seen[0] += 1
            seen[1] = min(seen[1], rank)
    return pa.RecordBatch.from_arrays([
        pa.array([words[k].decode("latin-1") for k in out], pa.string()),
        pa.array([n for n, _ in out.values()], pa.int64()),
        pa.array([best[1].decode("latin-1") for _, best in out.values()], pa.string()),
        pa.array([-best[0] for _, best in out.values()], pa.int64())], names=["word", "n_near", "form", "form_n"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region, taken some whole regions at a time."""
    key, words, counts = None, [], []
    ready: list[tuple] = []
    cells = 0
    for batch in batches:
        for *now, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if len(words) > 1:
                    ready.append((words, counts, key[0], len(key[1]), len(key[2]), key[3]))
                    cells += sum(map(len, words))
                if cells > CELLS:
                    yield _best(ready)
                    ready, cells = [], 0
                key, words, counts = now, [], []
            words.append(word.encode("latin-1"))
            counts.append(n)
    if len(words) > 1:
        ready.append((words, counts, key[0], len(key[1]), len(key[2]), key[3]))
    if ready:
        yield _best(ready)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, form, form_n)`` for each word of ``(word, n)`` that has
    near words: how many, and the most frequent of them (ties: the smallest)."""
    rows = staged(first_regions(words), "regions")
    found = None
    while True:
        total = rows.count()
        sizes = staged(rows.groupBy(*KEY).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        rows = attach_groups(rows, sizes, KEY, "size", total, how="inner")
        whole = (F.col("size") <= REGION) | (F.col("least") - F.length("head") - F.length("tail") < 2)
        ordered = rows.where(whole).repartition(*KEY).sortWithinPartitions(*KEY).select(*KEY, "bar", "word", "n")
        part = ordered.mapInArrow(_scan, FOUND)
        found = staged(part if found is None else found.unionByName(part), "near")
        rows = staged(_halves(rows.where(~whole)), "regions")
        if rows.isEmpty():
            break
    best = F.min(F.struct(-F.col("form_n"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.col1")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)`` whose forms lead nowhere in a
    circle: steps doubled until no word moves."""
    held = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = held.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = staged(held.join(up, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        held = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return held


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words with the word they are probably a spelling of: ``word, form, root,
    n, n_near, form_n``.

    A word is a run ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case, of
    LEAST_LENGTH code points or more and seen LEAST_COUNT times or more; where
    EVERY divides the checksum of id and run, the run has first lost a code
    point. ``form`` is the most frequent near word (ties: the smallest in
    code-point order) if it is at least twice as frequent, ``root`` where
    following forms ends.

    Null and empty texts have no words. Rows without an id count, with their
    runs as they are; repeated rows count as often as they are there. An empty
    table gives no rows. Only id and text are read, so other columns' names do
    not matter."""
    words = staged(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words)
    taken = F.col("form_n") >= 2 * F.col("n")
    rows = staged(words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("form_n")).alias("form_n")), "forms")
    return rows.join(roots(rows.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
                                                                       ELSE c // 2 END) AS c
    FROM range(256) r(b))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL),
hexed AS (SELECT *, hex(doc_id || ':' || run) AS h FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i:
      (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS crc
  FROM hexed, bits),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN crc % 97 = 0 THEN left(run, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2)
                ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
        FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -n, 'w': other}) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN -top.m >= 2 * w.n THEN top.w END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -top.m >= 2 * w.n THEN -top.m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM words
  UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k USING (word) JOIN forms e ON k.at = e.word AND e.form IS NULL
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))

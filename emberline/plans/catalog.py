"""Named queries over the driver tables: ``QUERIES[name](spark, sf_dir)``
returns a DataFrame and ``ORACLE[name]`` is the DuckDB SQL of the same table.

Every query reads the whole tables it names (no id subsets, no row caps);
limits appear only where first-K is the operator under test. Queries that
exercise a sink write to a fresh folder under the shared checkpoint dir and
read the result back.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import batching as bt
from ..operators import embed as em
from ..operators import generate as gen
from ..operators import metrics as mt
from ..operators import prompts as pr
from ..operators import sampling as smp
from ..operators import sweep as sw
from ..operators import textmodel as tm
from ..operators import training as tr
from ..session import released, scratch_path, stored
from ..sinks import writers as wr
from ..sources import files as fs
from ..sources import prompts as src
from ..streaming import metrics as sm
from ..streaming import score as st
from . import oracle as sql
from .tables import conversation_records, doc_prompts, keys_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Job settings of the registered runs. 200 tokens, top_p 0.9,
# batch sizes 8 and 2 workers are the reference configs' values; 128 tokens
# per text for the encoder; 128 rows x workers per training step; lr 0.1.
GREEDY = gen.SamplingParams(temperature=0.0, max_tokens=200)
JOINED = GREEDY
WITH_STOP = gen.SamplingParams(temperature=0.0, max_tokens=40, stop=(".",))
SAMPLED = gen.SamplingParams(temperature=1.0, top_p=0.9, max_tokens=40, n=3)
REFERENCE = gen.SamplingParams(temperature=0.2, top_p=0.9, max_tokens=200)
BATCH_SIZE = 8
WORKERS = 2
MAX_MODEL_LEN = 2048
FIRST_K = 100
SMOKE_ROWS = 64
VAL_PCT = 20
TRAIN_ROWS = 128
SWEEP_LRS = (0.05, 0.1, 0.5)
SWEEP_MOMENTA = (0.0, 0.9)
FIT_EPOCHS = 10


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- helpers
def doc_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.fit_next_token(table(spark, sf_dir, "documents").select("text"))


def conversation_file(spark: SparkSession, sf_dir: str) -> str:
    """Conversation turns as a prompt JSONL (``text``/``prompt`` keys, nulls
    written), shards ordered by turn key."""
    path = scratch_path(spark, "conv-prompts")
    wr.write_ordered(conversation_records(spark, sf_dir), "prompt_id", path)
    return path


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.drop_empty(pr.choose_prompt(conversation_records(spark, sf_dir)))


def r6(c) -> F.Column:
    return F.round(c, 6)


MD5_BUCKET = "CAST(('0x' || substr(md5(CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT) % {n}"
CONV_REC_SQL = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS text,
       CASE WHEN role = 'system' THEN text END AS prompt FROM conversations"""
CONV_CHOSEN_SQL = f"""SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS prompt_id,
       coalesce(nullif(text, ''), nullif(prompt, '')) AS prompt FROM ({CONV_REC_SQL})"""
DOC_PROMPTS_SQL = "SELECT doc_id AS prompt_id, text AS prompt FROM documents"
CONV_KEY_PROMPTS_SQL = f"""SELECT conv_id * 1000000 + turn AS prompt_id, coalesce(nullif(text, ''), nullif(prompt, ''))
       AS prompt FROM ({CONV_REC_SQL}) WHERE coalesce(nullif(text, ''), nullif(prompt, '')) IS NOT NULL"""
SPLIT_SQL = ("SELECT vec_id, embedding, label, CASE WHEN " + MD5_BUCKET.format(col="vec_id", n=100)
             + f" < {VAL_PCT} THEN 'val' ELSE 'train' END AS split FROM embeddings")
LONG_X_SQL = f"""x AS (SELECT vec_id, label, split, unnest(embedding)::DOUBLE AS xv,
       unnest(range(len(embedding))) AS dim FROM ({SPLIT_SQL})),
kk AS (SELECT max(label) + 1 AS k FROM embeddings),
classes AS (SELECT range AS cls FROM range((SELECT k FROM kk)))"""
GRAD_SQL = f"""{LONG_X_SQL},
g AS (SELECT cls, dim, avg(xv * (1.0 / (SELECT k FROM kk) - CASE WHEN label = cls THEN 1.0 ELSE 0.0 END)) AS grad
      FROM x, classes WHERE split = 'train' GROUP BY cls, dim)"""


# ---------------------------------------------------------------- sources
@query("prompt_scan", """SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS prompt_id, text AS prompt
FROM documents WHERE regexp_matches(text, '\\S')""")
def prompt_scan(spark, sf_dir):
    """Documents written as JSONL shards, read back as prompts."""
    path = scratch_path(spark, "doc-prompts")
    wr.write_ordered(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", path)
    return src.read_prompts(spark, path)


@query("json_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_scan(spark, sf_dir):
    """Generic JSON scan with an inferred schema (round trip)."""
    path = scratch_path(spark, "doc-json")
    wr.write_results(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return fs.read_json(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query("csv_double_parquet", "SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value * 2 AS value, props FROM events")
def csv_double_parquet(spark, sf_dir):
    """S3 + P5 + K3: events, all columns -> CSV (``props`` needs quoting) ->
    read with a schema -> value*2 -> Parquet."""
    csv_path = scratch_path(spark, "events-csv")
    pq_path = scratch_path(spark, "events-doubled")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    wr.write_csv(events, csv_path)
    back = fs.read_csv(spark, csv_path, schema=events.schema)
    wr.write_parquet(back.withColumn("value", F.col("value") * 2), pq_path)
    return spark.read.parquet(pq_path).withColumn("ts", F.col("ts").cast("string"))


@query("prompt_count", f"SELECT count(*) AS n_prompts FROM ({CONV_CHOSEN_SQL}) WHERE prompt IS NOT NULL")
def prompt_count(spark, sf_dir):
    """Load guard + count of usable prompts from the conversation JSONL."""
    prompts = src.require_rows(src.read_prompts(spark, conversation_file(spark, sf_dir)))
    return src.prompt_count(prompts)


# ---------------------------------------------------------------- prompts
@query("prompt_choose", CONV_CHOSEN_SQL)
def prompt_choose(spark, sf_dir):
    """Row-level choice, ``text`` if truthy else ``prompt`` (nulls kept)."""
    return pr.choose_prompt(src.read_prompt_records(spark, conversation_file(spark, sf_dir)))


@query("prompt_column", "SELECT doc_id AS prompt_id, text AS prompt FROM documents")
def prompt_column(spark, sf_dir):
    """Column-level choice on a table that has ``text``."""
    return pr.choose_prompt_column(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), "text"))


@query("prompt_filter", f"SELECT * FROM ({CONV_CHOSEN_SQL}) WHERE prompt IS NOT NULL")
def prompt_filter(spark, sf_dir):
    """Rows with neither field are dropped."""
    return src.read_prompts(spark, conversation_file(spark, sf_dir))


@query("prompt_strict", f"SELECT * FROM ({CONV_CHOSEN_SQL}) WHERE prompt IS NOT NULL")
def prompt_strict(spark, sf_dir):
    """S1 by the rules of a strict parser, in the JVM."""
    return src.read_prompts(spark, conversation_file(spark, sf_dir), strict=True)


@query("first_k_valid", f"SELECT * FROM ({CONV_CHOSEN_SQL}) WHERE prompt IS NOT NULL ORDER BY prompt_id LIMIT {FIRST_K}")
def first_k_valid(spark, sf_dir):
    """L1: first K usable prompts in file order."""
    return src.read_prompts(spark, conversation_file(spark, sf_dir), max_prompts=FIRST_K)


@query("first_k_raw", f"SELECT * FROM (SELECT * FROM ({CONV_CHOSEN_SQL}) ORDER BY prompt_id LIMIT {FIRST_K}) "
                      "WHERE prompt IS NOT NULL")
def first_k_raw(spark, sf_dir):
    """L2: first K raw records, then the choice and the empty filter."""
    recs = pr.limit_raw(src.read_prompt_records(spark, conversation_file(spark, sf_dir)), FIRST_K)
    return pr.drop_empty(pr.choose_prompt(recs))


@query("head_per_split", f"""SELECT vec_id, label, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY vec_id) AS rn FROM ({SPLIT_SQL})) WHERE rn <= {SMOKE_ROWS}""")
def head_per_split(spark, sf_dir):
    """L3: first 64 rows of each split (smoke mode)."""
    emb = tr.split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", VAL_PCT)
    return pr.head_per_split(emb, SMOKE_ROWS).select("vec_id", "label", "split")


# ---------------------------------------------------------------- batching
DOC_BATCH_SQL = f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx,
       CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_SIZE} AS BIGINT) AS batch_id FROM documents"""


def doc_batches(spark, sf_dir, rows=None):
    """Documents' keys, or ``rows`` of one per document, with their batches."""
    keys = keys_of(spark, sf_dir, "documents", "doc_id")
    return bt.assign_batches(keys if rows is None else rows, "doc_id", BATCH_SIZE, keys=keys)


@query("batch_assign", DOC_BATCH_SQL)
def batch_assign(spark, sf_dir):
    """B1: row i -> batch i // 8 without a single-partition window."""
    return doc_batches(spark, sf_dir).select("doc_id", "row_idx", "batch_id")


@query("batch_profile", f"SELECT batch_id, count(*) AS batch_rows FROM ({DOC_BATCH_SQL}) GROUP BY batch_id")
def batch_profile(spark, sf_dir):
    """B2: rows per batch."""
    return bt.batch_profile(doc_batches(spark, sf_dir))


WORKER_SQL = f"SELECT doc_id, batch_id, batch_id % {WORKERS} AS worker_id FROM ({DOC_BATCH_SQL})"


@query("worker_assign", WORKER_SQL)
def worker_assign(spark, sf_dir):
    """Batch i -> worker i % 2."""
    return bt.assign_workers(doc_batches(spark, sf_dir), WORKERS).select("doc_id", "batch_id", "worker_id")


@query("placement_spread", f"""SELECT count(*) AS n_workers, CAST(sum(rows) AS BIGINT) AS total_rows,
  CAST(sum(batches) AS BIGINT) AS total_batches, max(rows) AS max_rows, min(rows) AS min_rows,
  round(max(rows) / avg(rows), 6) AS skew
FROM (SELECT worker_id, count(*) AS rows, count(DISTINCT batch_id) AS batches FROM ({WORKER_SQL}) GROUP BY worker_id)""")
def placement_spread(spark, sf_dir):
    """B4 + A4: spread of work over workers."""
    return bt.placement_report(bt.assign_workers(doc_batches(spark, sf_dir), WORKERS))


def _double_value(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[["event_id", "batch_id"]].copy()
    out["batch_rows"] = len(pdf)
    out["value"] = pdf["value"] * 2
    return out


@query("map_batches_double", """WITH b AS (SELECT event_id, value,
  CAST((row_number() OVER (ORDER BY event_id) - 1) // 32 AS BIGINT) AS batch_id FROM events)
SELECT event_id, batch_id, count(*) OVER (PARTITION BY batch_id) AS batch_rows, value * 2 AS value FROM b""")
def map_batches_double(spark, sf_dir):
    """Vectorised batch map over exact global batches of 32 rows."""
    ev = bt.assign_batches(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 32)
    return bt.map_batches(ev.select("event_id", "batch_id", "value"), _double_value,
                          "event_id long, batch_id long, batch_rows long, value double", 32, batch_col="batch_id")


@query("standardise_embeddings", f"""WITH {LONG_X_SQL},
st AS (SELECT dim, avg(xv) AS mean, stddev_pop(xv) AS std FROM x WHERE split = 'train' GROUP BY dim)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round((xv - mean) / std, 6) AS value FROM x JOIN st USING (dim)""")
def standardise_embeddings(spark, sf_dir):
    """Per-dimension (x - mean) / std, constants from the train split."""
    emb = tr.split(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", VAL_PCT)
    out = tr.standardise(emb, tr.constants_row(emb.filter(F.col("split") == "train")))
    return em.explode_vectors(out, "vec_id", "features").select("vec_id", "dim", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- text model
@query("next_token_counts", f"WITH {sql.model_ctes()} SELECT ctx, next_token, cnt FROM counts")
def next_token_counts(spark, sf_dir):
    """Token-pair counts over all documents."""
    return doc_model(spark, sf_dir)


@query("next_token_argmax", f"WITH {sql.model_ctes()} SELECT ctx, next_token, cnt FROM am")
def next_token_argmax(spark, sf_dir):
    """Greedy successor per context (count desc, token asc)."""
    return tm.argmax_model(doc_model(spark, sf_dir))


TOKEN_LEN_SQL = f"""WITH b AS (SELECT doc_id, len({sql.tokens_sql('text')}) AS n_tokens,
  CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_SIZE} AS BIGINT) AS batch_id FROM documents)
SELECT doc_id, n_tokens, batch_id, max(n_tokens) OVER (PARTITION BY batch_id) AS padded_len FROM b"""


@query("token_lengths", TOKEN_LEN_SQL)
def token_lengths(spark, sf_dir):
    """Token count per text and padded length per batch."""
    lengths = tm.tokenise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
    return tm.token_lengths(doc_batches(spark, sf_dir, lengths)).select("doc_id", "n_tokens", "batch_id", "padded_len")


@query("context_window", f"""WITH t AS (SELECT doc_id, {sql.tokens_sql('text')} AS tk FROM documents)
SELECT doc_id, len(tk) AS n_tokens, len(tk[greatest(len(tk) - {MAX_MODEL_LEN} + 1, 1):]) AS window_len,
  len(tk) > {MAX_MODEL_LEN} AS over_limit, md5(array_to_string(tk[greatest(len(tk) - {MAX_MODEL_LEN} + 1, 1):], ' '))
  AS window_md5 FROM t""")
def context_window(spark, sf_dir):
    """I4: last 2048 tokens per prompt, over-long prompts flagged."""
    t = tm.tokenise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = tm.fit_window(t, MAX_MODEL_LEN)
    return w.select("doc_id", "n_tokens", F.size("window").cast("long").alias("window_len"), "over_limit",
                    F.md5(F.concat_ws(" ", "window")).alias("window_md5"))


@query("nucleus_candidates", f"""WITH {sql.model_ctes()},
c AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY ctx ORDER BY cnt DESC, next_token
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(cnt) OVER (PARTITION BY ctx) AS total FROM counts)
SELECT ctx, next_token, cnt FROM c WHERE 10 * before < 9 * total""")
def nucleus_candidates(spark, sf_dir):
    """Top-p 0.9 candidates at temperature 1 (exact integer test)."""
    return tm.nucleus(doc_model(spark, sf_dir), 1.0, 0.9).select("ctx", "next_token", "cnt")


@query("generate_greedy", sql.greedy_sql(DOC_PROMPTS_SQL, GREEDY.max_tokens))
def generate_greedy(spark, sf_dir):
    """I1 + I5 + I9: greedy completions of every document, model loaded per worker."""
    model = tm.argmax_model(doc_model(spark, sf_dir))
    predictor = gen.NextTokenPredictor(spark, model, GREEDY)
    return gen.long_form(gen.generate(doc_prompts(spark, sf_dir), predictor, BATCH_SIZE))


@query("generate_n", sql.sampled_sql(DOC_PROMPTS_SQL, SAMPLED.max_tokens, SAMPLED.n))
def generate_n(spark, sf_dir):
    """I6 + I7: n = 3 nucleus samples per prompt (T = 1, top_p = 0.9); draws
    from md5(prompt_id:sample:step)."""
    model = tm.nucleus(doc_model(spark, sf_dir), SAMPLED.temperature, SAMPLED.top_p, placed=True)
    predictor = gen.NextTokenPredictor(spark, model, SAMPLED)
    return gen.long_form(gen.generate(doc_prompts(spark, sf_dir), predictor, BATCH_SIZE))


@query("generate_reference", f"""SELECT r.prompt_id, d.text AS prompt, CAST(1 AS BIGINT) AS n_completions, generated_text,
  finish_reason, num_tokens FROM ({sql.sampled_sql(DOC_PROMPTS_SQL, REFERENCE.max_tokens, 1, weight=sql.WEIGHT_T02)}) r
JOIN documents d ON d.doc_id = r.prompt_id""")
def generate_reference(spark, sf_dir):
    """I1 + I6 + P4 with the settings every reference config uses (T = 0.2,
    top_p = 0.9, 200 tokens, one completion): result rows beside their prompt."""
    model = tm.nucleus(doc_model(spark, sf_dir), REFERENCE.temperature, REFERENCE.top_p, placed=True)
    res = gen.generate(doc_prompts(spark, sf_dir), gen.NextTokenPredictor(spark, model, REFERENCE), BATCH_SIZE)
    return res.select("prompt_id", "prompt", F.size("generated_text").cast("long").alias("n_completions"),
                      F.col("generated_text")[0].alias("generated_text"), F.col("finish_reason")[0].alias("finish_reason"),
                      F.col("num_tokens")[0].cast("long").alias("num_tokens"))


@query("generate_n_joined", sql.sampled_sql(DOC_PROMPTS_SQL, SAMPLED.max_tokens, SAMPLED.n))
def generate_n_joined(spark, sf_dir):
    """I6 + I7 by interval joins: the same samples with no model in the workers.
    Contexts above 1,000 successors take the level route of the nucleus."""
    placed = tm.nucleus(doc_model(spark, sf_dir), SAMPLED.temperature, SAMPLED.top_p, hot_successors=1_000, placed=True)
    released(spark)
    model = gen._stored(placed, "nucleus")
    released(spark, placed)
    return smp.generate_sampled(doc_prompts(spark, sf_dir), model, SAMPLED, own=True)


@query("finish_reasons", sql.greedy_sql(DOC_PROMPTS_SQL, WITH_STOP.max_tokens, WITH_STOP.stop))
def finish_reasons(spark, sf_dir):
    """I8: stop string '.', 40-token cap: both finish reasons occur."""
    model = tm.argmax_model(doc_model(spark, sf_dir))
    predictor = gen.NextTokenPredictor(spark, model, WITH_STOP)
    return gen.long_form(gen.generate(doc_prompts(spark, sf_dir), predictor, BATCH_SIZE))


@query("detokenise_roundtrip", f"""WITH t AS (SELECT doc_id, {sql.tokens_sql('text')} AS tk FROM documents)
SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(list_filter(tk, lambda x: x <> '</s>'), ' ')) AS detok_md5 FROM t""")
def detokenise_roundtrip(spark, sf_dir):
    """Tokens back to text (end marker dropped)."""
    t = tm.detokenise_text(tm.tokenise(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return t.select("doc_id", "n_tokens", F.md5("detok").alias("detok_md5"))


@query("generate_joined", sql.greedy_sql(DOC_PROMPTS_SQL, JOINED.max_tokens))
def generate_joined(spark, sf_dir):
    """Greedy decoding by text doubling (model stays a partitioned table)."""
    model = tm.argmax_model(doc_model(spark, sf_dir))
    return gen.generate_joined(doc_prompts(spark, sf_dir), model, JOINED)


# ---------------------------------------------------------------- embedding
@query("truncate_tokens", f"""WITH t AS (SELECT doc_id, {sql.tokens_sql('text')} AS tk FROM documents)
SELECT doc_id, len(tk[1:{em.MAX_TOKENS}]) AS n_kept, len(tk) > {em.MAX_TOKENS} AS truncated,
  md5(array_to_string(tk[1:{em.MAX_TOKENS}], ' ')) AS kept_md5 FROM t""")
def truncate_tokens(spark, sf_dir):
    """First 128 tokens per text."""
    t = em.truncate_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_kept"), "truncated",
                    F.md5(F.concat_ws(" ", "tokens")).alias("kept_md5"))


EMBED_SQL = f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, embedding FROM embeddings),
nv AS (SELECT count(*) AS n FROM embeddings),
t AS (SELECT doc_id, unnest({sql.tokens_sql('text')}[1:{em.MAX_TOKENS}]) AS tok FROM documents),
s AS (SELECT doc_id, {MD5_BUCKET.format(col='tok', n='(SELECT n FROM nv)')} AS slot FROM t),
x AS (SELECT doc_id, unnest(embedding)::DOUBLE AS xv, unnest(range(len(embedding))) AS dim FROM s JOIN v USING (slot))
SELECT doc_id, CAST(dim AS BIGINT) AS dim, round(avg(xv), 6) AS value FROM x GROUP BY doc_id, dim"""


def _vectors(spark, sf_dir):
    vecs = em.vector_slots(table(spark, sf_dir, "embeddings"))
    n = vecs.count()
    return vecs, n


@query("embed_mean_pool", EMBED_SQL)
def embed_mean_pool(spark, sf_dir):
    """Masked mean of the first 128 token vectors per document."""
    vecs, n = _vectors(spark, sf_dir)
    out = em.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), vecs, n)
    return out.select("doc_id", "dim", r6(F.col("value")).alias("value"))


@query("embed_pad_to_batch", f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, embedding FROM embeddings),
nv AS (SELECT count(*) AS n FROM embeddings),
b AS (SELECT doc_id, {sql.tokens_sql('text')}[1:{em.MAX_TOKENS}] AS tk,
  (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_SIZE} AS batch_id FROM documents),
p AS (SELECT doc_id, tk, max(len(tk)) OVER (PARTITION BY batch_id) AS padded FROM b),
t AS (SELECT doc_id, padded, unnest(tk) AS tok FROM p),
s AS (SELECT doc_id, padded, {MD5_BUCKET.format(col='tok', n='(SELECT n FROM nv)')} AS slot FROM t),
x AS (SELECT doc_id, padded, unnest(embedding)::DOUBLE AS xv, unnest(range(len(embedding))) AS dim FROM s JOIN v USING (slot))
SELECT doc_id, CAST(dim AS BIGINT) AS dim, round(sum(xv) / max(padded), 6) AS value FROM x GROUP BY doc_id, dim""")
def embed_pad_to_batch(spark, sf_dir):
    """Unmasked mean over the batch's padded length (zero rows count)."""
    vecs, n = _vectors(spark, sf_dir)
    kept = table(spark, sf_dir, "documents").select("doc_id", F.size(F.slice(tokens("text"), 1, em.MAX_TOKENS)).alias("k"))
    batched = doc_batches(spark, sf_dir, kept)
    padded = batched.groupBy("batch_id").agg(F.max("k").alias("padded"))
    lengths = stored(batched.select("doc_id", "batch_id").join(padded, "batch_id").select("doc_id", "padded"), "padded")
    slots = em.token_slots(table(spark, sf_dir, "documents"), n, "doc_id")
    if n < 1 << 31:  # slots pass the join, not texts
        slots = slots.withColumn("slots", F.col("slots").cast("array<int>"))
    # the lengths are the built side, whatever their size: nothing is sorted or passes the driver
    out = em.embed(slots.join(lengths.hint("shuffle_hash"), "doc_id"), vecs, n, pad_to="padded")
    return out.select("doc_id", "dim", r6(F.col("value")).alias("value"))


def _encoded(spark, sf_dir, keep=()):
    vecs, _ = _vectors(spark, sf_dir)
    encoder = em.MeanPoolEncoder(spark, vecs)
    docs = table(spark, sf_dir, "documents")
    if not keep:
        return em.encode(docs.select("doc_id", "text"), encoder, batch_size=BATCH_SIZE)
    slots = em.token_slots(docs, encoder.n_vectors, "doc_id", keep=("n_chars",))
    return em.encode(doc_batches(spark, sf_dir, slots), encoder, keep=keep, batch_col="batch_id")


@query("encode_predictor", EMBED_SQL)
def encode_predictor(spark, sf_dir):
    """The same pooling through the predictor harness (NumPy per batch)."""
    out = em.explode_vectors(_encoded(spark, sf_dir).filter(F.size("embedding") > 0))
    return out.filter(~F.isnan("value")).select("doc_id", "dim", r6(F.col("value")).alias("value"))


BATCH_STATS_SQL = f"""WITH b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_SIZE} AS batch_id
  FROM documents),
per AS (SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS num_texts,
  (SELECT CAST(max(len(embedding)) AS BIGINT) FROM embeddings) AS embedding_dim, sum(n_chars / 1e6) AS t
  FROM b GROUP BY batch_id)"""


def _batch_stats(spark, sf_dir):
    enc = _encoded(spark, sf_dir, keep=("batch_id", "n_chars"))
    return em.batch_stats(enc.withColumn("inference_time", F.col("n_chars") / F.lit(1e6)))


@query("batch_stats", BATCH_STATS_SQL + """
SELECT batch_id, num_texts, embedding_dim, round(t, 6) AS inference_time,
  round(CASE WHEN t > 0 THEN num_texts / t END, 6) AS throughput FROM per""")
def batch_stats(spark, sf_dir):
    """Texts, dimension, time (sum(n_chars)/1e6, fixed) and throughput per batch."""
    s = _batch_stats(spark, sf_dir)
    return s.select("batch_id", "num_texts", "embedding_dim", r6(F.col("inference_time")).alias("inference_time"),
                    r6(F.col("throughput")).alias("throughput"))


@query("run_totals", BATCH_STATS_SQL + """
SELECT CAST(sum(num_texts) AS BIGINT) AS total_texts, count(*) AS num_batches, round(sum(t), 6) AS total_time,
  round(sum(num_texts) / sum(t), 6) AS overall_throughput,
  round(avg(CASE WHEN t > 0 THEN num_texts / t END), 6) AS avg_batch_throughput FROM per""")
def run_totals(spark, sf_dir):
    """A1 + A2: overall throughput and the unweighted mean batch throughput."""
    t = mt.run_totals(_batch_stats(spark, sf_dir))
    return t.select("total_texts", "num_batches", r6(F.col("total_time")).alias("total_time"),
                    r6(F.col("overall_throughput")).alias("overall_throughput"),
                    r6(F.col("avg_batch_throughput")).alias("avg_batch_throughput"))


@query("outcome_rollup", sql.greedy_sql(DOC_PROMPTS_SQL, WITH_STOP.max_tokens, WITH_STOP.stop, final="""
SELECT finish_reason, count(*) AS completions, CAST(sum(num_tokens) AS BIGINT) AS total_tokens,
  CAST(max(num_tokens) AS BIGINT) AS max_tokens FROM gen GROUP BY finish_reason"""))
def outcome_rollup(spark, sf_dir):
    """A3: completions and tokens per finish reason."""
    return mt.outcome_rollup(finish_reasons(spark, sf_dir))


# ---------------------------------------------------------------- training
def _split_embeddings(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    emb = emb.withColumn("features", F.transform("embedding", lambda v: v.cast("double")))
    return tr.split(emb, "vec_id", VAL_PCT)


@query("train_val_split", f"SELECT vec_id, label, split FROM ({SPLIT_SQL})")
def train_val_split(spark, sf_dir):
    """Fixed train / validation membership from md5(vec_id)."""
    return _split_embeddings(spark, sf_dir).select("vec_id", "label", "split")


@query("train_batches", f"""SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_idx,
  CAST((row_number() OVER (ORDER BY vec_id) - 1) // {TRAIN_ROWS * WORKERS} AS BIGINT) AS step_id
FROM ({SPLIT_SQL}) WHERE split = 'train'""")
def train_batches(spark, sf_dir):
    """Global mini-batches of 128 x 2 rows -> step_id."""
    train = _split_embeddings(spark, sf_dir).filter(F.col("split") == "train").select("vec_id")
    return tr.train_batches(train, "vec_id", TRAIN_ROWS, WORKERS).select("vec_id", "row_idx", "step_id")


@query("loss_at_zero", "SELECT round(ln(max(label) + 1), 6) AS loss, count(*) AS n_rows FROM embeddings")
def loss_at_zero(spark, sf_dir):
    """Cross-entropy of the zero model = ln(K) over all rows."""
    df = _split_embeddings(spark, sf_dir)
    k = tr.num_classes(df)
    d = tr.feature_dim(df)
    res = tr.pass_stats(df, tr.np.zeros((1, k, d)), split_col=None)
    loss = res["loss"][(0, "train")]
    # the pass result is two numbers on the driver; shown next to the row count
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(round(loss, 6)).alias("loss"), "n_rows")


@query("gradient_at_zero", f"WITH {GRAD_SQL} SELECT CAST(cls AS BIGINT) AS class, CAST(dim AS BIGINT) AS dim, "
                           "round(grad, 6) AS grad FROM g")
def gradient_at_zero(spark, sf_dir):
    """T4: data-parallel mean gradient at W = 0 over train rows."""
    df = _split_embeddings(spark, sf_dir)
    k, d = tr.num_classes(df), tr.feature_dim(df)
    g = tr.gradient(df, tr.np.zeros((k, d)))
    return tr.weights_frame(spark, g).select("class", "dim", r6(F.col("weight")).alias("grad"))


@query("fit_one_step", f"WITH {GRAD_SQL} SELECT CAST(cls AS BIGINT) AS class, CAST(dim AS BIGINT) AS dim, "
                       "round(-0.1 * grad, 6) AS weight FROM g")
def fit_one_step(spark, sf_dir):
    """Smoke mode, one step (lr 0.1, momentum 0.9 from zero)."""
    df = _split_embeddings(spark, sf_dir)
    w, _ = tr.fit_softmax(df, epochs=1, max_steps=1)
    return tr.weights_frame(spark, w).select("class", "dim", r6(F.col("weight")).alias("weight"))


ONE_STEP_SCORES_SQL = f"""{GRAD_SQL},
sc AS (SELECT x.vec_id, x.label, x.split, g.cls, sum(x.xv * (-1.0 * g.grad)) AS s FROM x JOIN g USING (dim)
       GROUP BY x.vec_id, x.label, x.split, g.cls)"""


@query("eval_accuracy", f"""WITH {ONE_STEP_SCORES_SQL},
pred AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS r FROM sc) WHERE r = 1)
SELECT split, count(*) AS n, round(avg(CASE WHEN cls = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY split""")
def eval_accuracy(spark, sf_dir):
    """Accuracy per split of the one-step model (predictions in the JVM)."""
    df = _split_embeddings(spark, sf_dir)
    w, _ = tr.fit_softmax(df, epochs=1, max_steps=1)
    return tr.evaluate(tr.predict(df, w))


@query("fit_softmax", f"""WITH {LONG_X_SQL}, {sql.steps_ctes(FIT_EPOCHS)}
SELECT CAST(cls AS BIGINT) AS class, CAST(dim AS BIGINT) AS dim, round(w, 6) AS weight FROM w{FIT_EPOCHS}""")
def fit_softmax(spark, sf_dir):
    """T5: 10 epochs of momentum SGD; final weights in long form."""
    df = _split_embeddings(spark, sf_dir)
    w, _ = tr.fit_softmax(df, epochs=FIT_EPOCHS)
    return tr.weights_frame(spark, w).withColumn("weight", r6(F.col("weight")))


def _history(spark, history):
    out = tr.history_frame(spark, history)
    return out.withColumns({c: r6(F.col(c)) for c in ("loss", "accuracy", "val_loss", "val_accuracy")})


@query("fit_history", f"WITH {LONG_X_SQL}, {sql.steps_ctes(FIT_EPOCHS)}\n" + "\nUNION ALL ".join(
    f"""SELECT CAST({e} AS BIGINT) AS epoch, CAST(0.1 AS DOUBLE) AS lr, round(a.loss, 6) AS loss, round(a.accuracy, 6) AS accuracy,
  round(b.loss, 6) AS val_loss, round(b.accuracy, 6) AS val_accuracy FROM m{e} a, m{e + 1} b
WHERE a.split = 'train' AND b.split = 'val'""" for e in range(FIT_EPOCHS)))
def fit_history(spark, sf_dir):
    """T6 + T8: per-epoch lr, loss and accuracy."""
    df = _split_embeddings(spark, sf_dir)
    _, hist = tr.fit_softmax(df, epochs=FIT_EPOCHS)
    return _history(spark, hist)


MINI_EPOCHS = 2
# the steps of every epoch, numbered through; validation rows at the end of each epoch
MINI_SQL = f"""{LONG_X_SQL},
order_ AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // {TRAIN_ROWS * WORKERS} AS step_id
           FROM ({SPLIT_SQL}) WHERE split = 'train'),
ns AS (SELECT max(step_id) + 1 AS n FROM order_),
batches AS MATERIALIZED (SELECT 0 AS trial_id, CAST(e.e * n + step_id AS INTEGER) AS t, x.vec_id, x.label, x.xv, x.dim
  FROM x JOIN order_ USING (vec_id), ns, range({MINI_EPOCHS}) AS e(e)),
{sql.walk_cte("walk", "SELECT 0 AS trial_id, cls, dim, CAST(0 AS DOUBLE) AS w FROM classes, (SELECT DISTINCT dim FROM x)",
              "SELECT * FROM batches")},
{sql.loss_ctes("met", "SELECT * FROM batches", "SELECT * FROM walk")},
{sql.loss_ctes("val", f"SELECT 0 AS trial_id, CAST(e.e * n AS INTEGER) AS t, vec_id, label, xv, dim FROM x, ns, "
                      f"range(1, {MINI_EPOCHS} + 1) AS e(e) WHERE split = 'val'", "SELECT * FROM walk")}"""


@query("fit_minibatch", f"""WITH RECURSIVE {MINI_SQL},
per AS (SELECT t // (SELECT n FROM ns) AS epoch, sum(met.n * loss) / sum(met.n) AS loss, sum(met.n * accuracy) / sum(met.n) AS accuracy
        FROM met GROUP BY 1)
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(0.1 AS DOUBLE) AS lr, round(per.loss, 6) AS loss, round(per.accuracy, 6) AS accuracy,
  round(val.loss, 6) AS val_loss, round(val.accuracy, 6) AS val_accuracy
FROM per, val, ns WHERE val.t = (epoch + 1) * ns.n""")
def fit_minibatch(spark, sf_dir):
    """T2 + T5: momentum SGD over global mini-batches of 128 x 2 rows, the
    step table written partitioned by step (each step reads one folder)."""
    df = _split_embeddings(spark, sf_dir)
    steps = tr.step_table(df, "vec_id", TRAIN_ROWS, WORKERS)
    _, hist = tr.fit_softmax(df, epochs=MINI_EPOCHS, steps=steps)
    return _history(spark, hist)


LOCAL_WORKERS, LOCAL_ROWS = 4, 32
LOCAL_SQL = f"""{LONG_X_SQL},
own AS MATERIALIZED (SELECT vec_id, worker AS trial_id, CAST((row_number() OVER (PARTITION BY worker ORDER BY vec_id) - 1)
    // {LOCAL_ROWS} AS INTEGER) AS t
  FROM (SELECT vec_id, {MD5_BUCKET.format(col="vec_id", n=LOCAL_WORKERS)} AS worker FROM ({SPLIT_SQL}) WHERE split = 'train')),
mine AS MATERIALIZED (SELECT trial_id, t, x.vec_id, x.label, x.xv, x.dim FROM x JOIN own USING (vec_id)),
sizes AS (SELECT trial_id, count(*) AS n, max(t) + 1 AS steps FROM own GROUP BY trial_id),
zero AS (SELECT cls, dim, CAST(0 AS DOUBLE) AS w FROM classes, (SELECT DISTINCT dim FROM x)),
{sql.walk_cte("one", "SELECT trial_id, cls, dim, w FROM zero, sizes", "SELECT * FROM mine")},
mean1 AS MATERIALIZED (SELECT cls, dim, sum(n * w) / sum(n) AS w FROM one JOIN sizes ON one.trial_id = sizes.trial_id
  AND one.t = sizes.steps GROUP BY ALL),
{sql.walk_cte("two", "SELECT trial_id, cls, dim, w FROM mean1, sizes", "SELECT * FROM mine")},
mean2 AS MATERIALIZED (SELECT cls, dim, sum(n * w) / sum(n) AS w FROM two JOIN sizes ON two.trial_id = sizes.trial_id
  AND two.t = sizes.steps GROUP BY ALL)"""


@query("fit_local", f"""WITH RECURSIVE {LOCAL_SQL}
SELECT CAST(cls AS BIGINT) AS class, CAST(dim AS BIGINT) AS dim, round(w, 6) AS weight FROM mean2""")
def fit_local(spark, sf_dir):
    """T2 + T5, one job per epoch: two rounds of local SGD, 4 workers by key hash, steps of 32 rows."""
    w, _ = tr.fit_local(_split_embeddings(spark, sf_dir), "vec_id", 2, LOCAL_WORKERS, LOCAL_ROWS)
    return tr.weights_frame(spark, w).withColumn("weight", r6(F.col("weight")))


# ---------------------------------------------------------------- sweep
TRIALS = sw.grid(lr=list(SWEEP_LRS), momentum=list(SWEEP_MOMENTA))
TRIALS_SQL = "(VALUES " + ", ".join(f"({t['trial_id']}, {t['lr']}, {t['momentum']})" for t in TRIALS) + \
    ") AS tv(trial_id, lr, momentum)"
SWEEP_SQL = f"""WITH {ONE_STEP_SCORES_SQL},
tr AS (SELECT * FROM {TRIALS_SQL}),
ts AS (SELECT tr.trial_id, tr.lr, tr.momentum, sc.vec_id, sc.label, sc.cls, tr.lr * sc.s AS s
       FROM sc, tr WHERE sc.split = 'val'),
per AS (SELECT trial_id, lr, momentum, vec_id, ln(sum(exp(s))) - max(CASE WHEN cls = label THEN s END) AS loss,
        arg_max(cls, s) AS pred, max(label) AS label FROM ts GROUP BY trial_id, lr, momentum, vec_id),
res AS (SELECT CAST(trial_id AS BIGINT) AS trial_id, CAST(lr AS DOUBLE) AS lr, CAST(momentum AS DOUBLE) AS momentum,
        CAST(1 AS BIGINT) AS epochs, round(avg(loss), 6) AS loss,
        round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM per GROUP BY trial_id, lr, momentum)"""


def _sweep(spark, sf_dir):
    df = _split_embeddings(spark, sf_dir)
    res = sw.sweep(df, TRIALS, epochs=1)
    return res.select("trial_id", "lr", "momentum", "epochs", r6(F.col("loss")).alias("loss"),
                      r6(F.col("accuracy")).alias("accuracy"))


@query("sweep_step", SWEEP_SQL + " SELECT * FROM res")
def sweep_step(spark, sf_dir):
    """H1 + H2: six trials (lr x momentum) trained together, one step;
    validation loss and accuracy per trial."""
    return _sweep(spark, sf_dir)


@query("best_trial", SWEEP_SQL + " SELECT * FROM res WHERE NOT isnan(loss) ORDER BY loss, trial_id LIMIT 1")
def best_trial(spark, sf_dir):
    """H3: best trial by (loss, min); ties to the lowest trial id."""
    return sw.best_trial(_sweep(spark, sf_dir), "loss", "min")


SWEEP_STEPS = 3


def _sweep_rows(rows: str, steps: int) -> str:
    return f"""SELECT CAST(m.trial_id AS BIGINT) AS trial_id, t.lr, t.momentum, CAST({steps} AS BIGINT) AS epochs,
  round(m.loss, 6) AS loss, round(m.accuracy, 6) AS accuracy FROM m{steps} m JOIN trials0 t USING (trial_id)
WHERE m.split = 'val' {rows}"""


@query("sweep_momentum", f"WITH {LONG_X_SQL}, {sql.steps_ctes(SWEEP_STEPS, TRIALS_SQL)}, res AS ({_sweep_rows('', SWEEP_STEPS)})"
       " SELECT *, CAST(row_number() OVER (ORDER BY loss, trial_id) AS BIGINT) AS place FROM res")
def sweep_momentum(spark, sf_dir):
    """H2 + H3 over three steps: momentum takes part, and the trials' places show it."""
    res = sw.sweep(_split_embeddings(spark, sf_dir), TRIALS, epochs=SWEEP_STEPS)
    res = res.withColumns({c: r6(F.col(c)) for c in ("loss", "accuracy")})
    # one row a trial: the grid is small whatever the data
    return res.withColumn("place", F.row_number().over(Window.orderBy("loss", "trial_id")).cast("long"))


@query("sweep_halving", f"WITH {LONG_X_SQL}, {sql.steps_ctes(SWEEP_STEPS, TRIALS_SQL, halve=True)}\n" + "\nUNION ALL ".join(
    [*(_sweep_rows(f"AND m.trial_id NOT IN (SELECT trial_id FROM m{e + 1})", e) for e in range(1, SWEEP_STEPS)),
     _sweep_rows("", SWEEP_STEPS)]))
def sweep_halving(spark, sf_dir):
    """H2: the same trials, the worse half leaving after each step."""
    res = sw.sweep(_split_embeddings(spark, sf_dir), TRIALS, epochs=SWEEP_STEPS, halve=True)
    return res.withColumns({c: r6(F.col(c)) for c in ("loss", "accuracy")})


# ---------------------------------------------------------------- sinks
@query("jsonl_sink", sql.greedy_sql(DOC_PROMPTS_SQL, WITH_STOP.max_tokens, WITH_STOP.stop))
def jsonl_sink(spark, sf_dir):
    """K1: results written as sharded JSONL and read back."""
    model = tm.argmax_model(doc_model(spark, sf_dir))
    res = gen.generate(doc_prompts(spark, sf_dir), gen.NextTokenPredictor(spark, model, WITH_STOP), BATCH_SIZE)
    path = scratch_path(spark, "results-jsonl")
    wr.write_results(res, path)
    back = spark.read.schema(gen.RESULT_SCHEMA).json(path)
    return gen.long_form(back)


@query("ordered_export", "SELECT *, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS file_pos FROM documents")
def ordered_export(spark, sf_dir):
    """K2: range-partitioned, sorted shards; read in file-name order they are
    globally ordered."""
    path = scratch_path(spark, "ordered")
    docs = table(spark, sf_dir, "documents")
    wr.write_ordered(docs, "doc_id", path)
    lines = src.read_lines(spark, path)
    return lines.select(F.from_json("value", docs.schema).alias("r"), "line_no").select(
        "r.*", F.col("line_no").alias("file_pos"))


@query("run_partition", """SELECT 'job-7' AS run_id, event_type, count(*) AS n, round(sum(value * 2), 6) AS total FROM events
GROUP BY event_type UNION ALL
SELECT 'local' AS run_id, event_type, count(*) AS n, round(sum(value * 3), 6) AS total FROM events GROUP BY event_type""")
def run_partition(spark, sf_dir):
    """K4: run-keyed output; rerunning 'local' replaces only its own folder."""
    path = scratch_path(spark, "runs")
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    wr.write_results(ev.withColumn("value", F.col("value") * 1), path, run_id=wr.LOCAL_RUN)
    wr.write_results(ev.withColumn("value", F.col("value") * 2), path, run_id="job-7")
    wr.write_results(ev.withColumn("value", F.col("value") * 3), path, run_id=wr.LOCAL_RUN)
    back = spark.read.schema("event_id long, event_type string, value double, run_id string").json(path)
    return back.groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("run_record", BATCH_STATS_SQL + f""",
rep AS (SELECT count(*) AS num_batches, CAST(sum(num_texts) AS BIGINT) AS total_texts, round(sum(t), 6) AS total_time,
  round(sum(num_texts) / sum(t), 6) AS overall_throughput,
  round(avg(CASE WHEN t > 0 THEN num_texts / t END), 6) AS avg_batch_throughput, max(embedding_dim) AS embedding_dim FROM per)
SELECT 'report' AS part, 'mean-pool-md5' AS model, CAST({WORKERS} AS BIGINT) AS num_actors,
  CAST({BATCH_SIZE} AS BIGINT) AS batch_size, num_batches, CAST(-1 AS BIGINT) AS batch_id, total_texts AS num_texts,
  embedding_dim, total_time AS inference_time, overall_throughput AS throughput, avg_batch_throughput FROM rep
UNION ALL
SELECT 'batch', '', 0, 0, 0, batch_id, num_texts, embedding_dim, round(t, 6),
  round(CASE WHEN t > 0 THEN num_texts / t END, 6), 0.0 FROM per""")
def run_record(spark, sf_dir):
    """K5: run folder written (config, report, full batch table) and read back:
    the report row and every batch row."""
    path = scratch_path(spark, "run")
    wr.write_run(_batch_stats(spark, sf_dir), path, lambda stored: mt.run_record(
        stored, "mean-pool-md5", {"batch_size": BATCH_SIZE, "max_tokens": em.MAX_TOKENS}, BATCH_SIZE, WORKERS),
        config={"batch_size": BATCH_SIZE, "workers": WORKERS})
    report = spark.read.json(os.path.join(path, "report")).select(
        F.lit("report").alias("part"), "model", F.col("num_actors").cast("long"), F.col("batch_size").cast("long"),
        F.col("num_batches").cast("long"), F.lit(-1).cast("long").alias("batch_id"),
        F.col("total_texts").cast("long").alias("num_texts"), F.col("embedding_dim").cast("long"),
        r6(F.col("total_time")).alias("inference_time"), r6(F.col("overall_throughput")).alias("throughput"),
        r6(F.col("avg_batch_throughput")).alias("avg_batch_throughput"))
    batches = spark.read.parquet(os.path.join(path, "batches")).select(
        F.lit("batch").alias("part"), F.lit("").alias("model"),
        *[F.lit(0).cast("long").alias(c) for c in ("num_actors", "batch_size", "num_batches")],
        "batch_id", "num_texts", "embedding_dim", r6(F.col("inference_time")).alias("inference_time"),
        r6(F.col("throughput")).alias("throughput"), F.lit(0.0).alias("avg_batch_throughput"))
    return report.unionByName(batches)


# ---------------------------------------------------------------- streaming
def _stream(spark, sf_dir, max_files):
    prompts = conversation_prompts(spark, sf_dir)
    in_dir = scratch_path(spark, "stream-in")
    out_dir = scratch_path(spark, "stream-out")
    wr.write_ordered(prompts, "prompt_id", in_dir)
    model = tm.argmax_model(doc_model(spark, sf_dir))
    predictor = gen.NextTokenPredictor(spark, model, WITH_STOP)
    st.score_stream(spark, in_dir, out_dir, predictor, BATCH_SIZE, max_files=max_files)
    return gen.long_form(st.read_scored(spark, out_dir))


@query("stream_score", sql.greedy_sql(CONV_KEY_PROMPTS_SQL, WITH_STOP.max_tokens, WITH_STOP.stop))
def stream_score(spark, sf_dir):
    """V1: prompts scored by a Structured Streaming query (available-now)."""
    return _stream(spark, sf_dir, None)


@query("stream_bounded", sql.greedy_sql(CONV_KEY_PROMPTS_SQL, WITH_STOP.max_tokens, WITH_STOP.stop))
def stream_bounded(spark, sf_dir):
    """V2: the same stream with at most one file per micro-batch."""
    return _stream(spark, sf_dir, 1)


@query("stream_metrics", sql.greedy_sql(CONV_KEY_PROMPTS_SQL, WITH_STOP.max_tokens, WITH_STOP.stop, final="""
SELECT finish_reason, count(*) AS completions, CAST(sum(num_tokens) AS BIGINT) AS total_tokens,
  CAST(max(num_tokens) AS BIGINT) AS max_tokens FROM gen GROUP BY finish_reason"""))
def stream_metrics(spark, sf_dir):
    """V1 + A3: outcome rollup kept as the state of the running stream, a file a micro-batch."""
    in_dir, out_dir = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-metrics")
    wr.write_ordered(conversation_prompts(spark, sf_dir), "prompt_id", in_dir)
    predictor = gen.NextTokenPredictor(spark, tm.argmax_model(doc_model(spark, sf_dir)), WITH_STOP)
    sm.metrics_stream(spark, in_dir, out_dir, predictor, BATCH_SIZE, max_files=1)
    return sm.read_rollup(spark, out_dir)

"""DuckDB SQL that computes the same tables as the Spark queries.

Tokens, tie-breaks and rounding follow the Spark side exactly:
tokens = split on runs of ASCII white space, empty ones dropped; ties by count
descending then token ascending (binary order); averages rounded to 6 places.
"""

from __future__ import annotations

# Fixed value: the token separator, same as functions.text.TOKEN_SPLIT.
SPLIT = r"[ \t\n\x0B\f\r]+"


def tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{SPLIT}'), lambda x: x <> '')"


def model_ctes() -> str:
    """CTEs ``docs``, ``counts`` and ``am`` (arg-max) over all documents."""
    return f"""
docs AS MATERIALIZED (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents),
pairs AS (SELECT unnest(tk[1:len(tk)-1]) AS ctx, unnest(tk[2:len(tk)]) AS next_token FROM docs WHERE len(tk) > 1),
counts AS MATERIALIZED (SELECT ctx, next_token, count(*) AS cnt FROM pairs GROUP BY ctx, next_token),
am AS MATERIALIZED (SELECT ctx, next_token, cnt FROM (
    SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY cnt DESC, next_token) AS r FROM counts) WHERE r = 1)"""


def greedy_sql(prompts_sql: str, max_tokens: int, stops: tuple[str, ...] = (), final: str | None = None) -> str:
    """Greedy walk as a recursive CTE. ``prompts_sql`` yields
    ``(prompt_id, prompt)``; the result is the long form
    ``(prompt_id, sample, generated_text, finish_reason, num_tokens)``.

    The recursion carries only the current token and, with stop strings, the
    last few characters needed to see a stop string complete; the text is
    assembled once at the end."""
    span = max((len(x) for x in stops), default=1)
    if stops:
        probe = "(CASE WHEN w.step = 0 THEN a.next_token ELSE w.tail || ' ' || a.next_token END)"
        hit = " OR ".join(f"instr({probe}, '{x}') > 0" for x in stops)
        full_hits = ", ".join(f"nullif(instr(txt, '{x}'), 0)" for x in stops)
        stop_at = f"coalesce(least({full_hits}), 0)" if len(stops) > 1 else f"coalesce({full_hits}, 0)"
    else:
        probe = "''"
        hit = "false"
        stop_at = "0"
    select_final = final or "SELECT * FROM gen"
    return f"""
WITH RECURSIVE {model_ctes()},
prompts AS ({prompts_sql}),
starts AS (SELECT prompt_id, {tokens_sql('prompt')}[-1] AS tok FROM prompts),
walk AS (
    SELECT prompt_id, 0 AS step, tok, '' AS tail, false AS hit FROM starts
    UNION ALL
    SELECT w.prompt_id, w.step + 1, a.next_token,
           right({probe}, {span}), {hit}
    FROM walk w JOIN am a ON a.ctx = w.tok
    WHERE w.step < {max_tokens} AND NOT w.hit
),
agg AS (
    SELECT prompt_id, max(step) AS step,
           coalesce(string_agg(tok, ' ' ORDER BY step) FILTER (WHERE step > 0), '') AS txt
    FROM walk GROUP BY prompt_id),
cut AS (SELECT prompt_id, step, txt, {stop_at} AS stop_at FROM agg),
gen AS (
    SELECT prompt_id, CAST(0 AS BIGINT) AS sample,
           CASE WHEN stop_at > 0 THEN substring(txt, 1, stop_at - 1) ELSE txt END AS generated_text,
           CASE WHEN stop_at > 0 THEN 'stop' WHEN step >= {max_tokens} THEN 'length' ELSE 'stop' END AS finish_reason,
           CAST(step AS BIGINT) AS num_tokens
    FROM cut)
{select_final}
"""


# Weights at T = 0.2, the fifth power of a count's share on the grid (same product as in Spark).
WEIGHT_T02 = ("greatest(CAST(floor((r * r * r * r * r) * 1073741824.0) AS BIGINT), 1)")


def sampled_sql(prompts_sql: str, max_tokens: int, n: int, top_num: int = 9, top_den: int = 10,
                weight: str = "cnt") -> str:
    """Nucleus sampling as a recursive CTE, at T = 1 or with the ``weight`` of
    another temperature: candidates kept while ``den * before < num * total``; the draw ``u = md5(prompt_id:sample:step)``
    picks the candidate whose cumulative interval holds ``u * mass``."""
    u = ("(CAST(('0x' || substr(md5(CAST(prompt_id AS VARCHAR) || ':' || CAST(sample AS VARCHAR) || ':' "
         "|| CAST(step + 1 AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)")
    return f"""
WITH RECURSIVE {model_ctes()},
shares AS (SELECT *, CAST(cnt AS DOUBLE) / max(cnt) OVER (PARTITION BY ctx) AS r FROM counts),
weighted AS (SELECT ctx, next_token, cnt, {weight} AS w FROM shares),
nuc AS MATERIALIZED (
    SELECT ctx, next_token, w,
           coalesce(sum(w) OVER (PARTITION BY ctx ORDER BY cnt DESC, next_token
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(w) OVER (PARTITION BY ctx) AS total
    FROM weighted),
cand AS MATERIALIZED (
    SELECT ctx, next_token, CAST(before AS DOUBLE) AS lo, CAST(before + w AS DOUBLE) AS hi,
           CAST(sum(w) OVER (PARTITION BY ctx) AS DOUBLE) AS mass
    FROM nuc WHERE {top_den} * before < {top_num} * total),
prompts AS ({prompts_sql}),
starts AS (SELECT prompt_id, {tokens_sql('prompt')}[-1] AS tok FROM prompts),
walk AS (
    SELECT prompt_id, CAST(r.s AS BIGINT) AS sample, 0 AS step, tok FROM starts, range({n}) AS r(s)
    UNION ALL
    SELECT w.prompt_id, w.sample, w.step + 1, c.next_token
    FROM (SELECT prompt_id, sample, step, tok, {u} AS u FROM walk WHERE step < {max_tokens}) w
    JOIN cand c ON c.ctx = w.tok AND c.lo <= w.u * c.mass AND w.u * c.mass < c.hi
),
agg AS (
    SELECT prompt_id, sample, max(step) AS step,
           coalesce(string_agg(tok, ' ' ORDER BY step) FILTER (WHERE step > 0), '') AS txt
    FROM walk GROUP BY prompt_id, sample)
SELECT prompt_id, sample, txt AS generated_text,
       CASE WHEN step >= {max_tokens} THEN 'length' ELSE 'stop' END AS finish_reason,
       CAST(step AS BIGINT) AS num_tokens
FROM agg
"""


# ---- training: momentum SGD of the softmax classifier ----------------------
# Rows ``x (vec_id, label, split, xv, dim)`` and ``classes (cls)`` come before these CTEs.

def _softmax(scores: str) -> str:
    """Scores of a row and class to probability, log of it, and whether the class is the prediction."""
    return f"""SELECT *, exp(s - top) / z AS p, s - top - ln(z) AS lp,
    row_number() OVER (PARTITION BY trial_id, vec_id ORDER BY s DESC, cls) = 1 AS best FROM (
    SELECT *, sum(exp(s - top)) OVER (PARTITION BY trial_id, vec_id) AS z FROM (
      SELECT *, max(s) OVER (PARTITION BY trial_id, vec_id) AS top FROM ({scores})))"""


def steps_ctes(steps: int, trials: str = "(VALUES (0, 0.1, 0.9)) AS tv(trial_id, lr, momentum)", halve: bool = False) -> str:
    """Full-batch steps, one after the other: weights ``w0..``, class
    probabilities ``p0..`` and metrics ``m0..`` (by trial and split) before each
    step and after the last."""
    out = [f"""trials0 AS (SELECT trial_id, CAST(lr AS DOUBLE) AS lr, CAST(momentum AS DOUBLE) AS momentum FROM {trials}),
w0 AS MATERIALIZED (SELECT trial_id, lr, momentum, cls, dim, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS v
  FROM trials0, classes, (SELECT DISTINCT dim FROM x))"""]
    for e in range(steps + 1):
        scores = f"""SELECT w.trial_id, x.vec_id, x.label, x.split, w.cls, sum(x.xv * w.w) AS s
      FROM x JOIN w{e} w USING (dim) GROUP BY ALL"""
        out.append(f"p{e} AS MATERIALIZED ({_softmax(scores)})")
        out.append(f"""m{e} AS MATERIALIZED (SELECT trial_id, split, avg(-lp) AS loss, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM (SELECT trial_id, split, vec_id, max(lp) FILTER (WHERE cls = label) AS lp, bool_or(best AND cls = label) AS hit
        FROM p{e} GROUP BY ALL) GROUP BY ALL)""")
        if e == steps:
            break
        stay = "" if not halve or e == 0 else f"""WHERE w.trial_id IN (SELECT trial_id FROM (
    SELECT trial_id, row_number() OVER (ORDER BY round(loss, 9), trial_id) AS r, count(*) OVER () AS n FROM m{e} WHERE split = 'val')
    WHERE r <= (n + 1) // 2)"""
        out.append(f"""g{e} AS MATERIALIZED (SELECT trial_id, cls, dim, avg(xv * (p - CASE WHEN p.label = cls THEN 1.0 ELSE 0.0 END)) AS g
  FROM x JOIN p{e} p USING (vec_id) WHERE x.split = 'train' GROUP BY ALL),
w{e + 1} AS MATERIALIZED (SELECT w.trial_id, lr, momentum, w.cls, w.dim, w - lr * (momentum * v + g) AS w, momentum * v + g AS v
  FROM w{e} w JOIN g{e} g ON w.trial_id = g.trial_id AND w.cls = g.cls AND w.dim = g.dim {stay})""")
    return ",\n".join(out)


def walk_cte(name: str, start: str, rows: str, lr: float = 0.1, momentum: float = 0.9) -> str:
    """Mini-batch steps as a recursion: models ``(trial_id, t, cls, dim, w, v)``
    walk the steps ``t`` of their rows ``(trial_id, t, vec_id, label, xv, dim)``;
    a model without a next step is not carried on."""
    scores = """SELECT w.trial_id, r.vec_id, r.label, w.cls, sum(r.xv * w.w) AS s
        FROM r JOIN now w ON w.trial_id = r.trial_id AND w.dim = r.dim GROUP BY ALL"""
    return f"""{name} AS (
  SELECT trial_id, 0 AS t, cls, dim, w, CAST(0 AS DOUBLE) AS v FROM ({start})
  UNION ALL
  (WITH now AS (SELECT * FROM {name}),
   r AS (SELECT k.* FROM ({rows}) k JOIN (SELECT DISTINCT trial_id, t FROM now) n ON k.trial_id = n.trial_id AND k.t = n.t),
   p AS ({_softmax(scores)}),
   g AS (SELECT r.trial_id, p.cls, r.dim, avg(r.xv * (p.p - CASE WHEN r.label = p.cls THEN 1.0 ELSE 0.0 END)) AS g
         FROM r JOIN p ON r.trial_id = p.trial_id AND r.vec_id = p.vec_id GROUP BY ALL)
   SELECT w.trial_id, w.t + 1, w.cls, w.dim, w.w - {lr} * ({momentum} * w.v + g.g), {momentum} * w.v + g.g
   FROM now w JOIN g ON w.trial_id = g.trial_id AND w.cls = g.cls AND w.dim = g.dim))"""


def loss_ctes(name: str, rows: str, models: str) -> str:
    """``{name} (trial_id, t, n, loss, accuracy)`` of models on rows of their own
    ``(trial_id, t)``."""
    scores = f"""SELECT w.trial_id, w.t, r.vec_id, r.label, w.cls, sum(r.xv * w.w) AS s
    FROM ({rows}) r JOIN ({models}) w ON w.trial_id = r.trial_id AND w.t = r.t AND w.dim = r.dim GROUP BY ALL"""
    by = _softmax(scores).replace("trial_id, vec_id", "trial_id, t, vec_id")
    return f"""{name} AS MATERIALIZED (SELECT trial_id, t, count(*) AS n, avg(-lp) AS loss, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM (SELECT trial_id, t, vec_id, max(lp) FILTER (WHERE cls = label) AS lp, bool_or(best AND cls = label) AS hit
        FROM ({by}) GROUP BY ALL) GROUP BY ALL)"""

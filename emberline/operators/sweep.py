"""Parameter search (H1-H3): a trial grid, all trials trained in one data
pass per step, best trial by metric and mode."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .training import feature_dim, lr_at, num_classes, pass_stats


def grid(**lists) -> list[dict]:
    """H1: every combination of the given value lists; ``trial_id`` follows
    the order of the product (first list slowest)."""
    names = list(lists)
    return [dict(zip(names, vals), trial_id=i) for i, vals in enumerate(itertools.product(*[lists[n] for n in names]))]


def grid_frame(spark: SparkSession, trials: list[dict]) -> DataFrame:
    cols = [c for c in trials[0] if c != "trial_id"]
    rows = [(t["trial_id"], *[float(t[c]) for c in cols]) for t in trials]
    return spark.createDataFrame(rows, ", ".join(["trial_id long"] + [f"{c} double" for c in cols]))


def sweep(df: DataFrame, trials: list[dict], epochs: int, vec_col: str = "features", label_col: str = "label",
          metric_split: str = "val", halve: bool = False) -> DataFrame:
    """H2: momentum SGD for every trial at once. Weights are stacked to
    (trial, class, dim) and broadcast; each step is one pass over the data
    that returns all trials' gradients, so rows are never copied per trial.
    With ``halve``, after every step but the last the better half of the trials
    (rounded up; by loss of ``metric_split`` to 9 places, NaN last, ties to the lower id)
    goes on and the rest leave the stack, so later passes carry fewer models.
    Returns ``(trial_id, lr, momentum, epochs, loss, accuracy)``: the steps a
    trial took and the metrics of ``metric_split`` after the last of them."""
    spark = df.sparkSession
    k = num_classes(df, label_col)
    d = feature_dim(df, vec_col)
    live = sorted(trials, key=lambda t: t["trial_id"])
    w = np.zeros((len(live), k, d))
    v = np.zeros_like(w)
    stats = pass_stats(df, w, vec_col=vec_col, label_col=label_col)
    rows = []

    def leave(t: int, steps: int) -> None:
        trial = live[t]
        rows.append((int(trial["trial_id"]), float(trial["lr"]), float(trial["momentum"]), int(steps),
                     float(stats["loss"].get((t, metric_split), float("nan"))),
                     float(stats["accuracy"].get((t, metric_split), float("nan")))))

    for epoch in range(epochs):
        rates = np.array([lr_at(epoch, t["lr"]) for t in live])[:, None, None]
        v = np.array([t["momentum"] for t in live])[:, None, None] * v + stats["grad"]
        w = w - rates * v
        stats = pass_stats(df, w, vec_col=vec_col, label_col=label_col)
        if halve and epoch + 1 < epochs:
            loss = [round(stats["loss"].get((t, metric_split), float("nan")), 9) for t in range(len(live))]
            order = sorted(range(len(live)), key=lambda t: (np.isnan(loss[t]), loss[t], t))
            stay = sorted(order[:(len(live) + 1) // 2])
            for t in sorted(order[(len(live) + 1) // 2:]):
                leave(t, epoch + 1)
            place = {old: new for new, old in enumerate(stay)}
            stats = {"grad": stats["grad"][stay], "n": {},
                     **{m: {(place[t], name): x for (t, name), x in stats[m].items() if t in place} for m in ("loss", "accuracy")}}
            live, w, v = [live[t] for t in stay], w[stay], v[stay]
    for t in range(len(live)):
        leave(t, epochs)
    return spark.createDataFrame(rows, "trial_id long, lr double, momentum double, epochs long, loss double, "
                                       "accuracy double")


def best_trial(results: DataFrame, metric: str = "loss", mode: str = "min") -> DataFrame:
    """H3: the best row by ``metric`` (``min`` or ``max``); NaN and null
    metrics are dropped first; ties go to the lowest ``trial_id``."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    ok = results.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    key = F.col(metric).asc() if mode == "min" else F.col(metric).desc()
    return ok.orderBy(key, F.col("trial_id").asc()).limit(1)

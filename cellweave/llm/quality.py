"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Statistics of a text are Spark expressions.  On a bounded, deterministic sample of labelled rows a
few boosted trees are grown; every path from a root to a node is a rule, a conjunction of
comparisons of statistics.  A lasso logistic regression weighs the rules, most of them with zero.
What is left is one Spark expression: intercept plus the weights of the rules that hold, through
the logistic function.  No text leaves the JVM to be scored.

The sample has at most ``max_rows`` rows (default 8000), those of least hash of the id; that bound
is a parameter of the fit alone, and every document is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, col, documents, fresh, remainder


def shared_parts(text: Column) -> tuple[Column, Column]:
    """What several statistics share: the number of words, at least 1, and the lines."""
    t = F.coalesce(text, F.lit(""))
    return F.greatest(F.regexp_count(t, F.lit(WORD)), F.lit(1)).cast("double"), F.split(t, "\n", -1)


def statistics(text: Column, words: Column | None = None, lines: Column | None = None) -> dict[str, Column]:
    """Statistics of a text; a null text counts as empty.  ``words`` and ``lines``: columns that already
    hold ``shared_parts``."""
    if words is None or lines is None:
        words, lines = shared_parts(text)
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    per_char = lambda rx: F.regexp_count(t, F.lit(rx)) / n
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "chars_per_word": n / words,
        "upper": per_char(r"\p{Lu}"),
        "digits": per_char(r"\p{N}"),
        "odd_marks": per_char(r"[^\p{L}\p{N}\s.,;:'()-]"),
        "bars": F.regexp_count(t, F.lit(r"[|]")) / words,
        "stops": F.regexp_count(t, F.lit(r"[.!?]+(?=\s|$)")) / words,
        "doubled_marks": F.regexp_count(t, F.lit(r"([^\p{L}\p{N}\s])\1")) / words,
        "long_words": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]{20,}")) / words,
        "line_words": words / F.size(lines),
        "fresh_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules are tuples of (statistic, sign, threshold): sign 1 means above it, -1 at most it."""

    rules: tuple[tuple[tuple[str, int, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def columns(self, stats: dict[str, Column]) -> Column:
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, sign, at in rule:
                holds = holds & (stats[name] > F.lit(at) if sign > 0 else stats[name] <= F.lit(at))
            total = total + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, names: list[str], x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += w * _holds(rule, names, x)
        return 1 / (1 + np.exp(-total))


def _holds(rule, names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, at in rule:
        v = x[:, names.index(name)]
        out &= v > at if sign > 0 else v <= at
    return out


def _grow(x, grad, hess, cuts, rows, depth, path, rules, out):
    """One regression tree on gradients; notes each node's path, adds each leaf's step to out."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best, gain = None, 1e-3
    if depth:
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            cell = np.searchsorted(at, x[rows, j])  # cell c: above at[c-1], at most at[c]
            gs = np.cumsum(np.bincount(cell, grad[rows], len(at) + 1))[:-1]
            hs = np.cumsum(np.bincount(cell, hess[rows], len(at) + 1))[:-1]
            ns = np.cumsum(np.bincount(cell, minlength=len(at) + 1))[:-1]
            score = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            score[(ns < 5) | (len(rows) - ns < 5)] = -1
            k = int(score.argmax())
            if score[k] > gain:
                best, gain = (j, float(at[k])), score[k]
    if path:
        rules.add(tuple(sorted(path)))
    if best is None:
        out[rows] -= 0.3 * g / (h + 1)
        return
    j, at = best
    low = x[rows, j] <= at
    for sign, part in ((-1, rows[low]), (1, rows[~low])):
        tight = [p for p in path if not (p[0] == j and p[1] == sign)]  # a later cut implies the earlier
        _grow(x, grad, hess, cuts, part, depth - 1, [*tight, (j, sign, at)], rules, out)


def _lasso(r, y, penalty, start, steps=250):
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    w, b = start
    v, c, t = w.copy(), b, 1.0
    size = 1 / (np.linalg.norm(r, 2) ** 2 / len(y) / 4 + 0.25)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + c)))
        e = (p - y) / len(y)
        w2 = v - size * (r.T @ e)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - size * penalty, 0)
        b2 = c - size * e.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, seed: int = 4) -> RuleEnsemble:
    """Rules from boosted trees, weighed by the lasso; the penalty is the best of a path on a fifth
    of the rows held back.  With one class or no rows, the ensemble is the share of ones alone."""
    if len(y) < 20 or y.min() == y.max():
        share = min(0.999, max(0.001, (y.sum() + 1) / (len(y) + 1)))
        return RuleEnsemble((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 48)))
        cuts.append(q[:-1] if len(q) and q[-1] >= x[:, j].max() else q)
    f, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        step = np.zeros(len(y))
        own = set()
        _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), cuts, rows, depth, [], own, step)
        found |= own
        f += step  # rows outside the subsample keep their value
    rules = [tuple((names[j], s, a) for j, s, a in r) for r in sorted(found)]
    m = np.stack([_holds(r, names, x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    keep, seen = [], set()
    for i in range(m.shape[1]):
        share, print_ = m[:, i].mean(), m[:, i].astype(bool).tobytes()
        if 0.002 < share < 0.998 and print_ not in seen:
            seen.add(print_)
            keep.append(i)
    rules, m = [rules[i] for i in keep], m[:, keep]
    held = np.arange(len(y)) % 5 == 0
    start, best = (np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean())))), None
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        start = _lasso(m[~held], y[~held], penalty, start)
        p = np.clip(1 / (1 + np.exp(-(m[held] @ start[0] + start[1]))), 1e-9, 1 - 1e-9)
        loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] * 0.98:
            best = (loss, penalty, start)
    w, b = _lasso(m, y, best[1], best[2])
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 8000) -> RuleEnsemble:
    """Fits on the labelled rows whose crc32(id) mod 4 isn't 2, ``max_rows`` at most."""
    ids = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull() & (remainder(col(id_col), 4) != 2))
    ids = ids.groupBy(col(id_col).cast("long").alias("label_id")).agg(F.max(col(label_col)).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    stats = statistics(col(text_col))
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col))
    # at most max_rows rows of 12 bytes are broadcast
    rows = rows.join(F.broadcast(ids), F.col("id") == F.col("label_id")).select("id", "label", *[c.alias(k) for k, c in stats.items()])
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(*stats)).alias("s")).select("id", "label", "s.*")  # repeated rows: one each
    got = rows.toPandas().sort_values("id")
    return fit_rules(got[list(stats)].to_numpy(float), got["label"].to_numpy(float), list(stats))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) added, a narrow projection.

    Null and empty texts are scored like an empty text; repeated rows score alike; an empty table
    stays empty.  The statistics get a name that ``docs`` doesn't have and go again.
    """
    name, words, lines = fresh(docs, "text_stats", "text_words", "text_lines")
    stats = statistics(col(text_col), col(words), col(lines))
    shared = docs.withColumns(dict(zip((words, lines), shared_parts(col(text_col)), strict=True)))  # once for all statistics
    # a generator of one row: what is filtered above it can't be pushed below, where each rule would count anew
    wide = shared.withColumn(name, F.explode(F.array(F.struct(*[c.alias(k) for k, c in stats.items()]))))
    out = wide.withColumn(score_col, model.columns({k: F.col(f"{name}.{k}") for k in stats}))
    return out.select(*[col(c) for c in docs.columns if c != score_col], score_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with the columns they had."""
    (name,) = fresh(docs, "quality_score")
    scored = score_quality(docs, train(docs, labels), score_col=name)
    return scored.where(col(name) >= threshold).select(*[col(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels come only from rows whose crc32(doc_id as
    text) mod 4 is not 2.  Null and empty texts have a score; no documents give no rows."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

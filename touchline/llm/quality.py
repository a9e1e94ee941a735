"""Quality classifier: a sparse rule ensemble.

Trees are grown by boosting on statistics of the texts in a bounded labelled sample; every path from a root is a
conjunctive rule (thresholds on statistics). A lasso logistic regression over the rules leaves a few with a weight,
and these are compiled into one Spark column expression, which scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.labelled import FIT_ROWS, fit_sample, logistic

#: Trees and their depth, candidate thresholds of a statistic, lasso penalty.
TREES, DEPTH, BINS, LASSO = 24, 3, 32, 0.004


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, JVM expressions only. Null counts as empty; all are 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    chars = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "log_chars": F.log1p(F.length(text)),
        "words": F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "lines_per_word": F.size(lines) / F.greatest(F.size(words), F.lit(1)),
        "upper": count(r"\p{Lu}") / chars,
        "digits": count("[0-9]") / chars,
        "symbols": count(r"[^\p{L}\p{N}\s.,]") / chars,
        "bars": count(r"\|") / chars,
        "stops": count(r"[.!?]") / chars,
        "commas": count(",") / chars,
    }


def with_statistics(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    return docs.select(*keep, F.struct(*(c.cast("double").alias(k) for k, c in statistics(F.col(text_col)).items())).alias("stat"))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is_above, threshold) that hold together, and the rule's weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def applies(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        at = np.ones(len(x), bool)
        for name, above, cut in self.conditions:
            at &= (x[:, names.index(name)] > cut) == above
        return at

    def column(self, stat: Column) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            out &= stat[name] > cut if above else stat[name] <= cut
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stat: Column) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total += F.when(rule.column(stat), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, path: tuple = ()) -> tuple[list[tuple], np.ndarray]:
    """Grow one tree on second-order gain: its paths (also inner ones) and the step it adds for each row."""
    value = -gradient.sum() / (hessian.sum() + 1.0)
    step = np.full(len(x), value)
    paths = [path] if path else []
    if depth == 0 or len(x) < 20:
        return paths, step
    best = (1e-3, None, None)
    whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
    for k, edges in enumerate(cuts):
        if not len(edges):
            continue
        at = np.searchsorted(edges, x[:, k])  # bin i: above edges[i - 1]
        g, h = (np.bincount(at, v, len(edges) + 1).cumsum() for v in (gradient, hessian))
        left, below = g[:-1], h[:-1]
        gain = left**2 / (below + 1.0) + (g[-1] - left) ** 2 / (h[-1] - below + 1.0) - whole
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], k, edges[i])
    _, k, cut = best
    if k is None:
        return paths, step
    above = x[:, k] > cut
    for side in (False, True):
        rows = above == side
        more, inner = tree_rules(x[rows], gradient[rows], hessian[rows], names, cuts, depth - 1, (*path, (names[k], side, float(cut))))
        paths += more
        step[rows] = inner
    return paths, step


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Rules from boosted trees, then lasso logistic weights. Labels of one kind only give a constant score."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, BINS))) for k in range(x.shape[1])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rng, paths = np.random.default_rng(7), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        rows = rng.random(len(y)) < 0.7
        gradient, hessian = p - y, p * (1 - p)
        found, _ = tree_rules(x[rows], gradient[rows], hessian[rows], names, cuts, depth)
        # the step is taken for all rows, by the leaves of the grown tree
        leaves = [q for q in found if not any(len(r) > len(q) and r[: len(q)] == q for r in found)]
        for q in leaves:
            at = Rule(q).applies(x, names)
            inside = at & rows
            total[at] += 0.5 * -gradient[inside].sum() / (hessian[inside].sum() + 1.0)
        paths |= dict.fromkeys(found)
    rules = [Rule(q) for q in paths]
    hold = np.stack([r.applies(x, names) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    w, b = logistic(hold, y, lasso)
    return RuleEnsemble(tuple(Rule(r.conditions, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6), b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_ROWS) -> RuleEnsemble:
    """Fit on at most limit labelled rows outside of the held-out fold; only their statistics reach the driver."""
    sample = with_statistics(fit_sample(docs, labels, label, limit), "doc_id", "label").select("doc_id", "label", "stat.*").toPandas().sort_values("doc_id")
    names = [c for c in sample.columns if c not in ("doc_id", "label")]
    return fit_rules(sample[names].to_numpy(float), sample["label"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1) and predicted (1 where score >= threshold).

    Null and empty texts have statistics of 0 and are scored by them. Repeated rows are scored each; other columns of
    docs are not used. An empty table gives an empty result.
    """
    stats = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return stats.select("doc_id", model.score(F.col("stat")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

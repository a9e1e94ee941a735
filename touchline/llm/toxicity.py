"""Toxicity: a weighted finite-state pattern grammar.

A lexicon transducer maps words to classes: insult and threat (weighted stems), target, negation, reported speech.
Clause transducers over these classes are composed into one automaton whose states say what the clause has shown so far;
its output is the weight of the matched clause: an insult counts in full, more beside a target, less under negation and
in reported speech; a threat counts only beside a target. A text's score is a logistic function of its clauses.
Stems and their weights, and the logistic function, are learned from a bounded labelled sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, tidy
from touchline.llm.labelled import FIT_ROWS, fit_sample, logistic

# Chosen words of the closed classes (English, French, German, Spanish): a starting lexicon, not values to match.
THREATS = "kill hurt destroy shoot stab burn crush smash tuer tuerai töten umbringen matar matare".split()
TARGETS = "you your youre u he she they him her them tu toi vous du dich dir ihr tú te usted ustedes".split()
NEGATIONS = "not no never isnt arent wasnt dont doesnt cannot ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says wrote called calls quoted claims reported according dit sagte dijo laut selon según".split()
# Chosen insults that are known before labels are seen.
INSULTS = "idiot moron stupid clown loser trash scum pathetic disgusting worthless".split()
CLAUSE_END = ".!?;:"
STRIP = ".,!?;:\"'()[]{}*&%$#|-_<>«»“”‘’"

INSULT, THREAT, TARGET, NEGATION, REPORT = range(5)
#: Weight of a known insult before labels are seen, factors of the clause grammar, reach of a negation in words.
PRIOR, BY_TARGET, NEGATED, REPORTED, REACH = 3.0, 1.5, 0.3, 0.5, 3
#: Stems are prefixes of these lengths. A stem needs so many different toxic texts, and so large a share of toxic ones; all
#: that the bounded sample has are kept.
STEM, SUPPORT, SHARE = range(3, 13), 4, 0.6
#: Words whose class a worker remembers before it forgets them all.
MEMO = 100_000


@dataclass
class Grammar:
    stems: dict[str, float]
    slope: float = 1.0
    clauses: float = 0.0
    intercept: float = -2.0
    memo: dict[str, tuple[int, float] | None] = field(default_factory=dict, repr=False)

    def classify(self, word: str) -> tuple[int, float] | None:
        """The lexicon transducer: class and weight of a lower-case word without punctuation."""
        for kind, words in ((NEGATION, _NEGATIONS), (TARGET, _TARGETS), (REPORT, _REPORTS), (THREAT, _THREATS)):
            if word in words:
                return kind, PRIOR
        found = [w for n in (len(word), *STEM) if (w := self.stems.get(word[:n])) is not None]
        return (INSULT, max(found)) if found else None

    def of(self, token: str) -> tuple[int, float] | None:
        try:
            return self.memo[token]
        except KeyError:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = out = self.classify(token.strip(STRIP))
            return out

    def clause_weights(self, text: str) -> list[float]:
        """Weights of the clauses of a text that match the grammar."""
        tokens = text.lower().split()
        kinds = list(map(self.memo.get, tokens)) if self.memo else [None] * len(tokens)
        fresh = [i for i, (k, t) in enumerate(zip(kinds, tokens, strict=True)) if k is None and t not in self.memo]
        for i in fresh:
            kinds[i] = self.of(tokens[i])
        at = [i for i, k in enumerate(kinds) if k is not None]
        if not any(kinds[i][0] in (INSULT, THREAT) for i in at):
            return []
        # state of the composed automaton within a clause
        out, weight, target, report, threat, negated_to, last = [], 0.0, False, False, 0.0, -1, -1

        def close() -> None:
            total = (weight + (threat if target else 0.0)) * (BY_TARGET if target and weight else 1.0) * (REPORTED if report else 1.0)
            if total > 0:
                out.append(total)

        for i in at:
            if last >= 0 and any(t[-1] in CLAUSE_END for t in tokens[last:i]):
                close()
                weight, target, report, threat, negated_to = 0.0, False, False, 0.0, -1
            kind, w = kinds[i]
            if kind == INSULT:
                weight += w * (NEGATED if i <= negated_to else 1.0)
            elif kind == THREAT:
                threat += w * (NEGATED if i <= negated_to else 1.0)
            elif kind == TARGET:
                target = True
            elif kind == NEGATION:
                negated_to = i + REACH
            else:
                report = True
            last = i
        close()
        return out

    def features(self, text: str) -> tuple[float, float]:
        found = self.clause_weights(text)
        return (math.log1p(sum(found)), math.log1p(len(found))) if found else (0.0, 0.0)

    def probability(self, total: float, clauses: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * total + self.clauses * clauses + self.intercept))))


_THREATS, _TARGETS, _NEGATIONS, _REPORTS = frozenset(THREATS), frozenset(TARGETS), frozenset(NEGATIONS), frozenset(REPORTS)


def stem_set(text: str) -> set[str]:
    words = {t.strip(STRIP) for t in set(text.lower().split())}
    return {w[:n] for w in words for n in STEM if len(w) >= n}


def count_stems(sample: DataFrame) -> DataFrame:
    """stem, n (texts that hold it), t (toxic ones); counted by task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=8 << 20):
            n, t = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stems = stem_set(text)
                n.update(stems)
                if label:
                    t.update(stems)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([t[k] for k in keys], pa.int64())], names=["stem", "n", "t"])

    return sample.select("text", "label").mapInArrow(run, "stem string, n bigint, t bigint").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def choose_stems(counted: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of stems: smoothed log odds. Of stems that extend each other, the surest, and then the longest, stays."""

    def sure(n: int, t: int) -> float:  # lower end of a 90 % interval of the share
        p, z = t / n, 1.64
        return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)

    chosen = {w: PRIOR for w in INSULTS}
    taken: dict[str, int] = {}
    for stem, n, t in sorted(counted, key=lambda r: (-sure(r[1], r[2]), -len(r[0]), r[0])):
        longer = sum(v for k, v in taken.items() if k.startswith(stem))
        if any(stem[:k] in taken for k in range(1, len(stem))) or t - longer < max(SUPPORT, 0.1 * t):
            continue
        taken[stem] = t
        chosen[stem] = max(chosen.get(stem, 0.0), math.log((t + 0.5) / (n - t + 0.5)) + math.log((clean + 1) / (toxic + 1)))
    return {k: v for k, v in chosen.items() if v > 0}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = FIT_ROWS) -> Grammar:
    """Fit on at most limit labelled rows outside of the held-out fold; stems, and two numbers a row, reach the driver."""
    sample = fit_sample(docs, labels, label, limit)
    toxic, clean = (sum(r["n"] for r in rows if r["label"] == k) for rows in [sample.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()] for k in (1, 0))
    counted = count_stems(sample.select("text", "label").distinct()).where((F.col("t") >= SUPPORT) & (F.col("t") >= SHARE * F.col("n"))).collect()
    grammar = Grammar(choose_stems([tuple(r) for r in counted], toxic, clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["label", "total", "clauses"])

    rows = sample.select("text", "label").mapInArrow(run, "label double, total double, clauses double").toPandas().sort_values(["label", "total", "clauses"])
    if rows["label"].nunique() == 2:
        (grammar.slope, grammar.clauses), grammar.intercept = logistic(rows[["total", "clauses"]].to_numpy(float), rows["label"].to_numpy(float), steps=800)
    return grammar


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), n_clauses (matched), predicted (1 where score >= threshold).

    Null and empty texts match no clause and get the score of such texts. Repeated rows are scored each; other columns
    of docs are not used. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [grammar.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([grammar.probability(*f) for f in found], pa.float64()), pa.array([round(math.expm1(f[1])) for f in found], pa.int64())],
                names=["doc_id", "score", "n_clauses"],
            )

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, n_clauses bigint")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns stay, and no row moves."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for piece in slices([batch], text_col):
                keep = [grammar.probability(*grammar.features(t)) < threshold for t in piece.column(at).to_pylist()]
                yield batch.slice(first, len(keep)).filter(pa.array(keep, pa.bool_()))
                first += len(keep)
        grammar.memo.clear()
        tidy()

    return docs.mapInArrow(run, docs.schema)

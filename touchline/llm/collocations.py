"""Phrase collocation mining by weighted acyclic automata.

Every task counts the phrases of its texts, shard by shard: n-grams of a shard are sorted and become a count transducer
whose paths are (lang, word, word, ...) and whose weights are occurrences (automata.py). A shard's transducer is cut at
bounds that all shards share, and each prefix range goes to one place, where the transducers of all shards are united
with the sum of their weights. Bounds are phrases, so the range of a frequent first word is cut inside. A range also
holds the proper prefixes of its lower bound, so the count of every prefix of a phrase stands on its own path.

A phrase is scored by the counts of its parts. The first part is a prefix, read on the path; the rest is looked up:
distinct rests go to the range that holds them, where their acceptor is composed with the range's transducer.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.automata import Automaton, Trie, binary_array, numbered, trie_of, union, weights_of
from touchline.llm.common import slices, small_batches, stored, tidy
from touchline.llm.text import words

#: Words of a shard, bytes of text that a range stands for, bytes of text from which bounds are drawn, arcs united at once.
SHARD_WORDS, RANGE_BYTES, BOUND_BYTES, UNION_ARCS = 1 << 20, 4 << 20, 16 << 20, 4 << 20
#: Every so many phrases of the drawn texts is a possible bound.
BOUND_STEP = 64
NO_LANG = "und"
_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_WORD = ~_SPLIT
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Bounds = Sequence[Sequence[bytes]]


class _Shard:
    """Words of a task's texts until there are enough for a transducer."""

    def __init__(self, order: int, most: int) -> None:
        self.order, self.most = order, most
        self.clear()

    def clear(self) -> None:
        self.words: list[pa.LargeBinaryArray] = []
        self.langs: list[pa.LargeBinaryArray] = []
        self.lang_of: list[np.ndarray] = []
        self.linked: list[np.ndarray] = []
        self.size = self.rows = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[Trie]:
        """batch: text, lang."""
        w = words(batch.column(0), _WORD, lower=False, hashed=False)
        if not len(w.start):
            return
        self.words.append(binary_array(_LOWER[w.data[_WORD[w.data]]], w.end - w.start))
        broken = np.cumsum(_SPLIT[w.data])[w.start]
        linked = np.zeros(len(w.start), bool)  # with the word that follows
        linked[:-1] = (broken[1:] == broken[:-1]) & (w.row[1:] == w.row[:-1])
        self.linked.append(linked)
        self.lang_of.append(self.rows + w.row)
        self.langs.append(batch.column(1).cast(pa.large_binary()))
        self.size += len(w.start)
        self.rows += batch.num_rows
        if self.size >= self.most:
            yield from self.tries()

    def tries(self) -> Iterator[Trie]:
        """One trie for every `most` words; the last words of one are read again by the next, but counted once."""
        if self.size:
            vocab, ids = numbered(pa.concat_arrays(self.words + self.langs))
            lang = ids[self.size :][np.concatenate(self.lang_of)]
            ids, linked = ids[: self.size], np.concatenate(self.linked)
            n, self.words = self.size, []
            for lo in range(0, n, self.most):
                hi = min(lo + self.most, n)
                yield _trie(vocab, lang[lo:hi], ids[lo : hi + self.order - 1], linked[lo : hi + self.order - 1], self.order)
        self.clear()


def _trie(vocab: pa.LargeBinaryArray, lang: np.ndarray, ids: np.ndarray, linked: np.ndarray, order: int) -> Trie:
    """Counts of (lang), (lang, word), ... of all phrases of up to order words that start at the first len(lang) words."""
    labels, weights, parents = [], [], []
    at, arc = np.arange(len(lang)), np.zeros(len(lang), np.int64)
    for d in range(order + 1):
        key, arc, n = np.unique(arc * len(vocab) + (ids[at + d - 1] if d else lang), return_inverse=True, return_counts=True)
        labels.append(key % len(vocab))
        parents.append(key // len(vocab))
        weights.append(n)
        if d:
            on = linked[at + d - 1]
            at, arc = at[on], arc[on]
    return Trie(vocab, labels, weights, parents)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"))


def range_bounds(rows: DataFrame, order: int, ranges: int, total: int) -> Bounds:
    """Lower bounds of about so many prefix ranges, from phrases of a bounded draw of the texts. They decide where counts
    are summed, not which: every bound gives the same result. The first is the empty sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(order, SHARD_WORDS)
        for batch in slices(batches):
            for trie in shard.add(batch):
                yield _drawn(trie)
        for trie in shard.tries():
            yield _drawn(trie)

    drawn = rows.sample(min(1.0, BOUND_BYTES / max(total, 1)), seed=11).mapInArrow(run, "path array<binary>")
    paths = sorted(tuple(bytes(x) for x in r["path"]) for r in drawn.collect())
    chosen = [paths[len(paths) * i // ranges] for i in range(1, ranges)] if paths else []
    return [(), *sorted(set(chosen))]


def _drawn(trie: Trie) -> pa.RecordBatch:
    """Every BOUND_STEP-th path of the last level that has any."""
    d = max(d for d, x in enumerate(trie.labels) if len(x))
    at, path = np.arange(BOUND_STEP // 2, len(trie.labels[d]), BOUND_STEP), []
    for k in range(d, -1, -1):
        path.append(trie.labels[k][at])
        at = trie.parents[k][at]
    symbols = trie.vocab.take(pa.array(np.stack(path[::-1], 1).ravel()))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(symbols) + 1, d + 1), pa.int32()), symbols.cast(pa.binary()))], names=["path"])


@dataclass
class Counts:
    """Count transducers by prefix range: a stored table (range, automaton), the ranges' lower bounds, words of a phrase at most."""

    table: DataFrame
    bounds: Bounds
    order: int


def count_phrases(docs: DataFrame, order: int = 3, least: int = 1, text_col: str = "text", lang_col: str = "lang") -> Counts:
    """How often each phrase of up to order words occurs by lang, of those that occur at least so often.

    A-Z is lower-cased; pieces end at . , ; : ! ? and line breaks, words at spaces and tabs; phrases lie within a piece, and
    overlapping ones all count. The sequence (lang) alone counts the words of that lang.
    Null texts are empty, a null lang is `und`. Rows that repeat count again; ids are not used; other columns neither.
    Texts of any length are taken whole. An empty table gives a table without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, text_col, lang_col)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bounds = range_bounds(rows, order, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES)), total)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(order, SHARD_WORDS)

        def cut(tries: Iterator[Trie]) -> Iterator[pa.RecordBatch]:
            for trie in tries:
                out = [(i, piece.packed()) for i, piece in trie.pieces(bounds)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["range", "automaton"])

        for batch in slices(batches):
            yield from cut(shard.add(batch))
        yield from cut(shard.tries())
        tidy()

    def unite(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Automaton] = []
        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("automaton")):
                parts.append(Automaton.read(blob.as_py()))
                if sum(map(len, parts)) > UNION_ARCS and len(parts) > 1:
                    parts = [Automaton.read(union(parts).packed())]
        merged = union(parts).heavy(least)
        if len(merged):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([merged.packed()], pa.binary())], names=["range", "automaton"])
        tidy()

    table = rows.mapInArrow(shards, "range int, automaton binary").groupBy("range").applyInArrow(unite, "range int, automaton binary")
    return Counts(stored(table, "phrase-counts"), bounds, order)


def part_counts(counts: Counts, parts: DataFrame) -> DataFrame:
    """Distinct (lang, part) of parts with their count n (part: words joined by spaces); those that were not counted are missing."""
    bounds, order = counts.bounds, counts.order

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [(a.encode(), *b.encode().split(b" ")) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(bounds, p) - 1 for p in paths], pa.int32())], names=["lang", "part", "range"])

    def compose(asked: pa.Table, held: pa.Table) -> pa.Table:
        lang, part = asked.column("lang").to_pylist(), asked.column("part").to_pylist()
        paths = pa.array([[a.encode(), *b.encode().split(b" ")][: order + 2] for a, b in zip(lang, part, strict=True)], pa.list_(pa.binary()))
        keep = np.array([len(x) <= order + 1 for x in paths.to_pylist()], bool)
        n = np.zeros(len(lang), np.int64)
        for blob in held.column("automaton"):
            n[keep] = weights_of(paths.filter(pa.array(keep)), Automaton.read(blob.as_py()))
        found = pa.array(n > 0)
        return pa.table({"lang": pa.array(lang, pa.string()).filter(found), "part": pa.array(part, pa.string()).filter(found), "n": pa.array(n).filter(found)})

    asked = parts.select("lang", "part").where("lang is not null and part is not null").distinct().mapInArrow(route, "lang string, part string, range int")
    return asked.groupBy("range").cogroup(counts.table.groupBy("range")).applyInArrow(compose, "lang string, part string, n bigint")


def _arcs(counts: Counts) -> DataFrame:
    """One row per counted phrase of two words or more: lang, phrase, a, n, sub (phrases of two words or more inside it),
    cuts (k, l: count of the first k words, rest)."""
    bounds = counts.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie = union([Automaton.read(blob.as_py())])
                vocab = trie.vocab.to_pylist()
                words_ = [v.decode() for v in vocab]
                own = trie.split(bounds[number], vocab, trie.firsts())
                for d in range(2, len(trie.labels)):
                    at = np.arange(own[d][0], len(trie.labels[d]))
                    path, weight = [], []
                    for k in range(d, -1, -1):
                        path.append(trie.labels[k][at].tolist())
                        weight.append(trie.weights[k][at].tolist())
                        at = trie.parents[k][at]
                    out: dict[str, list] = {x: [] for x in ("lang", "phrase", "a", "n", "subs", "cuts")}
                    for p, w in zip(zip(*path[::-1], strict=True), zip(*weight[::-1], strict=True), strict=True):
                        s = [words_[x] for x in p[1:]]
                        out["lang"].append(words_[p[0]])
                        out["phrase"].append(" ".join(s))
                        out["a"].append(w[-1])
                        out["n"].append(w[0])
                        out["subs"].append([" ".join(s[i : i + m]) for m in range(2, d) for i in range(d - m + 1)])
                        out["cuts"].append([{"k": k, "l": w[k], "rest": " ".join(s[k:])} for k in range(1, d)])
                    for lo in range(0, len(out["a"]), 10_000):
                        yield pa.RecordBatch.from_pydict({k: v[lo : lo + 10_000] for k, v in out.items()}, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("n", pa.int64()), ("subs", pa.list_(pa.string())), ("cuts", pa.list_(pa.struct([("k", pa.int32()), ("l", pa.int64()), ("rest", pa.string())])))])
    return counts.table.mapInArrow(run, "lang string, phrase string, a bigint, n bigint, subs array<string>, cuts array<struct<k: int, l: bigint, rest: string>>")


def association(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts below 10**13 (a is at most l and at most r)."""
    a, l, r = (x.cast("decimal(13,0)") for x in (a, l, r))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), l * r).cast("long")


def collocations(docs: DataFrame, order: int = 3, least: int = 10, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `top` phrases of 2 to order words of each lang: lang, rank, phrase, a, l, r, n, score.

    See count_phrases() for words, pieces and defined cases. A phrase occurs a >= least times. Of its cuts into a first part
    (l times) and the rest (r times) the one of the lowest association() counts, of ties the one after fewer words. A phrase
    inside a longer one that occurs in covered hundredths of its occurrences or more is left out. Order: score and a descending,
    then phrase in byte order. A lang without such phrases has no rows.
    """
    counts = count_phrases(docs, order, max(least, 1), text_col, lang_col)
    found = stored(_arcs(counts), "phrases")
    cuts = found.select("lang", "phrase", "a", "n", F.explode("cuts").alias("cut")).select("lang", "phrase", "a", "n", "cut.k", "cut.l", F.col("cut.rest").alias("part"))
    rests = stored(part_counts(counts, cuts).withColumnRenamed("n", "r"), "rests")
    scored = cuts.join(rests.hint("merge"), ["lang", "part"]).withColumn("score", association(F.col("a"), F.col("l"), F.col("r")))
    cut = F.struct("score", "k", "l", "r", "a", "n")
    none = F.lit(None)
    inside = found.select("lang", F.explode("subs").alias("phrase"), none.cast(_CUT).alias("cut"), F.col("a").alias("longer"))
    both = scored.select("lang", "phrase", cut.cast(_CUT).alias("cut"), none.cast("long").alias("longer")).unionByName(inside)
    best = both.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    best = best.where(f"cut is not null and (longer is null or 100 * longer < {covered} * cut.a)").select("lang", "phrase", "cut.*")
    order_by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order_by))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_CUT = "struct<score: bigint, k: int, l: bigint, r: bigint, a: bigint, n: bigint>"

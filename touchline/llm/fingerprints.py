"""Document fingerprints by consistent weighted sampling.

Terms of a text are its pairs of consecutive words (the word, if there is one only), weighted by their occurrences. For
each of a fingerprint's samples, a term of weight w draws r and c from Gamma(2, 1) and b from [0, 1), takes
t = floor(ln w / r + b) and stands at ln c - r (t + 1 - b); the term that stands lowest is the sample, together with its t.
Draws depend on the term and the sample's number alone, so two texts take the same (term, t) with a probability equal to the
generalised Jaccard similarity of their weights, sum of minima by sum of maxima.

Draws are read from two tables of 2**16 entries by two 16-bit fields of the term's hash under the sample's own multiplier:
one of c, one of (r, b). Terms that draw the same are told apart by their hashes, so no term is preferred.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, small_batches, stored, tidy
from touchline.llm.text import grams, mix, white_space_words, words

#: Samples of a fingerprint (two bytes each, four hexadecimal digits in a column), words of a term, terms worked on at once.
SAMPLES, DIGITS, TERM_WORDS, CHUNK = 128, 4, 2, 1 << 15
#: Bytes of text of a range of documents; beyond so many ranges they get longer (they are sorted by Spark and streamed).
RANGE_BYTES, MOST_RANGES = 8 << 20, 50_000
_WORD = white_space_words()
#: Places are kept as 31-bit fixed-point numbers: (place + SHIFT) * SCALE. ln c is above -12, r (t + 1 - b) below 100.
SHIFT, SCALE = 120.0, float(1 << 23)
_LOW = np.uint64(0xFFFFFFFF)


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1): x with 1 - (1 + x) exp(-x) = u, by halving."""
    low, high = np.zeros_like(u), np.full_like(u, 64.0)
    for _ in range(64):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class Sampler:
    """Tables of draws and the multipliers of the samples: the same in every process."""

    def __init__(self, samples: int) -> None:
        rng = np.random.default_rng(20260711)
        quantiles = (np.arange(1 << 16) + 0.5) / (1 << 16)
        self.log_c = np.log(_gamma2(quantiles))
        self.r, self.b = rng.permutation(_gamma2(quantiles)), rng.permutation(quantiles)
        self.factors = rng.integers(0, 1 << 64, samples, dtype=np.uint64) | np.uint64(1)
        # weight 1: t is 0; the place in the upper half of a word, to be added up
        self.of_c = np.round((self.log_c + SHIFT) * SCALE).astype(np.uint64) << np.uint64(32)
        self.of_r = np.round(self.r * (1 - self.b) * SCALE).astype(np.uint64) << np.uint64(32)

    def least(self, term: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """By document (its terms start at first[i], none is without) and sample: the hash of the sampled (term, t), 32 bits."""
        out = np.empty((len(first), len(self.factors)), np.uint32)
        own = mix(term) & _LOW
        more = np.flatnonzero(weight > 1)
        log_w, more_own, high = np.log(weight[more].astype(float)), own[more], np.uint64(48)
        field, middle = np.uint64(0xFFFF), np.uint64(32)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(self.factors):
                h = term * factor
                at_c, at_r = h >> high, (h >> middle) & field
                place = self.of_c[at_c]
                place -= self.of_r[at_r]
                place |= own
                if len(more):
                    c, r, b = self.log_c[at_c[more]], self.r[at_r[more]], self.b[at_r[more]]
                    t = np.floor(log_w / r + b)
                    stand = np.round((c - r * (t + 1 - b) + SHIFT) * SCALE).astype(np.uint64) << middle
                    place[more] = stand | mix(more_own + (t.astype(np.uint64) << middle)) & _LOW
                out[:, k] = np.minimum.reduceat(place, first) & _LOW
        return out


_samplers: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def weighted_terms(texts: pa.LargeStringArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes, their occurrences, and the row of each, by row: runs of `size` words, A-Z lower-cased; all words if there are fewer."""
    w = words(texts, _WORD, lower=True)
    n = np.diff(w.first)
    whole = np.zeros(len(w.hash), bool)
    g = grams(w.hash, size)
    whole[: len(g)] = w.row[: len(g)] == w.row[size - 1 :] if len(g) else False
    at = np.flatnonzero(whole)
    term, row = g[at], w.row[at]
    for i in np.flatnonzero((n > 0) & (n < size)).tolist():
        short = grams(w.hash[w.first[i] : w.first[i] + n[i]], int(n[i]))
        term, row = np.append(term, short), np.append(row, i)
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return term[head], np.diff(np.append(head, len(term))), row[head]


def signatures(texts: pa.LargeStringArray, samples: int, size: int) -> list[bytes]:
    """A fingerprint per text: the low 16 bits of each sample; empty for a text without words."""
    term, weight, row = weighted_terms(texts, size)
    out = [b""] * len(texts)
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.empty(0, np.int64)
    ends, lo = np.append(head[1:], len(row)), 0
    while lo < len(head):
        hi = max(lo + 1, int(np.searchsorted(ends, head[lo] + CHUNK, side="right")))
        s = slice(int(head[lo]), int(ends[hi - 1]))
        found = sampler(samples).least(term[s], weight[s], head[lo:hi] - head[lo]).astype(">u2")
        for i, r in enumerate(row[head[lo:hi]].tolist()):
            out[r] = found[i].tobytes()
        lo = hi
    return out


def alike(a: bytes, b: bytes) -> float:
    """Share of samples that two fingerprints have in common; two empty ones are alike, an empty one is like no other."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, ">u2"), np.frombuffer(b, ">u2")
    return float(np.count_nonzero(x == y)) / len(x)


def as_digits(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def likeness(a: Column, b: Column) -> Column:
    """alike() of two columns of fingerprints (hexadecimal digits) of equal length, in built-in functions."""
    places = F.sequence(F.lit(0), (F.length(a) / DIGITS).cast("int") - 1)
    same = F.size(F.filter(places, lambda i: F.substring(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, i * DIGITS + 1, F.lit(DIGITS))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / (F.length(a) / DIGITS))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, size: int = TERM_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint. Equal texts have equal fingerprints, whatever row or table they are in.

    Null texts are empty; a text without words has an empty fingerprint. Texts are taken whole. Ids may repeat or be null;
    other columns aren't used. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures(batch.column(1), samples, size), pa.binary())], names=["doc_id", "fingerprint"])
        tidy()

    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint binary")
    return made.select("doc_id", as_digits("fingerprint"))


FIELDS = (
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()),
    ("near_next", pa.float64()), ("range", pa.int32()), ("edge", pa.int32()), ("text", pa.string()),
)
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, range int, edge int, text string"
#: edge: 0 a whole row, 1 the first document of a range with its text, 2 the last one, which hasn't met its next.
WHOLE, FIRST, LAST = 0, 1, 2


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by as many of the following text, or all it has."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _edits(ids: list, texts: list[str], prints: list[bytes], following: list[str], next_prints: list[bytes], samples: int, size: int) -> dict[str, list]:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    marks = signatures(pa.array(new, pa.large_string()), samples, size)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).digest() for t in new], "fingerprint": prints, "edited_fingerprint": marks,
        "near_edited": [alike(a, b) for a, b in zip(prints, marks, strict=True)], "near_next": [alike(a, b) for a, b in zip(prints, next_prints, strict=True)],
    }


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    n = len(rows["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(rows.get(name, [None] * n), kind) for name, kind in FIELDS], schema=pa.schema(list(FIELDS)))


def edit_distances(docs: DataFrame, samples: int = SAMPLES, size: int = TERM_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs its fingerprint, that of its edited text, and how like it is to that and to the next document's.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document
    is the one that follows by id (and a hash of the text, where rows repeat an id; nulls come first); the first one follows
    the last. edited() makes the edited text. A single row follows itself. See fingerprints() for null, empty and long texts.

    Rows are dealt by ranges of ids and sorted there, so a document meets its next one in its task, but for the last of a
    range: these and the first of each range are met in a second, small step.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // RANGE_BYTES), MOST_RANGES))
    key = F.xxhash64("text")
    dealt = rows.withColumn("key", key).repartitionByRange(ranges, F.asc_nulls_first("doc_id"), "key").sortWithinPartitions(F.asc_nulls_first("doc_id"), "key").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = signatures(batch.column(1), samples, size)
            if held is None and ids:
                yield _batch({"doc_id": ids[:1], "fingerprint": prints[:1], "range": [number], "edge": [FIRST], "text": texts[:1]})
            elif ids:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            if ids:
                held = (ids.pop(), texts.pop(), prints.pop())
                if ids:
                    rows = _edits(ids, texts, prints, [*texts[1:], held[1]], [*prints[1:], held[2]], samples, size)
                    yield _batch(rows | {"range": [number] * len(ids), "edge": [WHOLE] * len(ids)})
        if held is not None:
            yield _batch({"doc_id": [held[0]], "fingerprint": [held[2]], "range": [number], "edge": [LAST], "text": [held[1]]})
        tidy()

    found = stored(dealt.mapInArrow(run, SCHEMA), "fingerprints")
    last = found.where(F.col("edge") == LAST).select("range", "doc_id", "text", "fingerprint")
    first = found.where(F.col("edge") == FIRST).select(F.col("range").alias("next_range"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    numbers = sorted(r["range"] for r in last.select("range").collect())  # one number a range, MOST_RANGES at most
    pairs = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "range int, next_range int")
    met = last.join(pairs.hint("merge"), "range").join(first.hint("merge"), "next_range").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(_edits(*(c.to_pylist() for c in batch.columns), samples, size))

    columns = [as_digits(name) if kind == pa.binary() else F.col(name) for name, kind in FIELDS[:7]]
    return found.where(F.col("edge") == WHOLE).select(columns).unionByName(met.mapInArrow(meet, SCHEMA).select(columns))

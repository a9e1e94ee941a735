"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of its MINIMISER-word grams. Consecutive windows
with the same minimiser form a super-k-mer and travel as one packed string of words to the minimiser's bucket, so equal
windows always meet in one bucket. There their words are numbered exactly, windows are sorted, and every window that is
not the first of its kind (least document, then position) is reported as a span of removed words.

A minimiser that many windows share would make one bucket long, so the most frequent ones, found in a bounded draw of the
texts, rank behind all others: windows that have another gram go by that, and those that have none are much alike. Equal
windows still have equal minimisers, whatever the draw finds.

Before the shuffle each task keeps one copy of equal super-k-mers: of the others every window starts earlier in the
first one, so their spans are known at once. A passage that a third of all documents hold so reaches its bucket as one
string a task. Strings of one bucket and task are packed together, compressed. Spans that are already known travel
spread over all buckets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, stored
from touchline.llm.text import grams, mix, white_space_words, words

WINDOW, MINIMISER = 20, 5
#: Buckets by shuffle partition, and bytes of text after which a task hands over what it has packed.
BUCKETS_BY_PARTITION, FLUSH_BYTES = 4, 24 << 20
#: Bytes of text that are drawn to find frequent minimisers, how often one must occur there, and how many are set back at most.
DRAWN_BYTES, FREQUENT, MOST_FREQUENT = 16 << 20, 64, 2000
_WORD = white_space_words()
SPANS = "doc_id bigint, first int, last int"


def _sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every k consecutive entries."""
    width, out = 1, x
    while width < k:
        step = min(width, k - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def super_kmers(h: np.ndarray, row: np.ndarray, window: int, minimiser: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, and minimiser of each super-k-mer, over word hashes h of rows. frequent: hashes, ascending,
    of grams that rank behind all others."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    ranked = grams(h, minimiser) >> np.uint64(1)
    if frequent is not None and len(frequent):
        at = np.searchsorted(frequent, ranked)
        ranked |= (frequent[np.minimum(at, len(frequent) - 1)] == ranked).astype(np.uint64) << np.uint64(63)
    least = _sliding_least(ranked, window - minimiser + 1)
    whole = row[:n] == row[window - 1 :]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])))
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    # windows that reach into the next document are at the end of a row's run; they form no super-k-mer
    first = np.flatnonzero(whole & (new | ~np.concatenate(([False], whole[:-1]))))
    end = np.flatnonzero(whole & np.concatenate((new[1:] | ~whole[1:], [True]))) + 1
    return first, end, least[first]


class _Packer:
    """Packed strings of one task by bucket, and spans known at once."""

    def __init__(self, buckets: int, window: int, spread: int) -> None:
        self.buckets, self.window, self.turn = buckets, window, spread
        self.clear()

    def clear(self) -> None:
        self.strings: dict[int, list[bytes]] = {}
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.at: dict[bytes, tuple[int, int]] = {}
        self.known: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, doc: int, begin: int, windows: int, bucket: int, string: bytes) -> None:
        where = self.at.get(string)
        if where is None:
            mine = self.strings.setdefault(bucket, [])
            self.at[string] = (bucket, len(mine))
            mine.append(string)
            self.places.setdefault(bucket, []).append((doc, begin))
            self.size += len(string)
            return
        places = self.places[where[0]]
        if (doc, begin) < places[where[1]]:
            (doc, begin), places[where[1]] = places[where[1]], (doc, begin)
        self.known.append((doc, begin, begin + windows + self.window - 1))
        self.size += 24

    def rows(self) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        out = []
        for bucket, strings in self.strings.items():
            places = np.array(self.places[bucket], np.int64)
            out.append((bucket, 0, press.compress(pickle.dumps((strings, places[:, 0].tobytes(), places[:, 1].tobytes())))))
        for at in range(0, len(self.known), 50_000):
            self.turn += 1
            out.append((self.turn % self.buckets, 1, press.compress(np.array(self.known[at : at + 50_000], np.int64).tobytes())))
        self.clear()
        for at in range(0, len(out), 256):
            part = out[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "kind", "packed"])


def frequent_minimisers(docs: DataFrame, window: int, minimiser: int) -> np.ndarray:
    """Minimisers, ascending, that many super-k-mers of a bounded draw of the texts have. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4 << 20):
            w = words(batch.column(1), _WORD, lower=False)
            key, n = np.unique(super_kmers(w.hash, w.row, window, minimiser)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["key", "n"])

    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    drawn = docs.sample(min(1.0, DRAWN_BYTES / max(total, 1)), seed=5).mapInArrow(run, "key bigint, n bigint")
    found = drawn.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT)
    return np.sort(np.array([r["key"] for r in found.collect()], np.int64).astype(np.uint64))


def pack(docs: DataFrame, buckets: int, window: int, minimiser: int, frequent: np.ndarray | None = None) -> DataFrame:
    """bucket, kind (0: strings with their places, 1: spans that are known), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, window, TaskContext.get().partitionId() * 7919)
        for batch in slices(batches):
            w = words(batch.column(1), _WORD, lower=False)
            begin, end, least = super_kmers(w.hash, w.row, window, minimiser, frequent)
            bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
            docs_, rows, data = batch.column(0).to_pylist(), w.row, w.data.tobytes()
            # single spaces between words: only then is a string a plain piece of the text
            plain = np.concatenate((w.start[1:] - w.end[:-1] == 1, [True])) if len(w.start) else np.empty(0, bool)
            plain[:-1] &= (w.data[w.end[:-1]] == 0x20) | (rows[1:] != rows[:-1])
            odd = np.concatenate(([0], np.cumsum(~plain)))
            starts, ends = w.start, w.end
            last = end + window - 2
            pos = begin - w.first[rows[begin]]
            easy = odd[last] == odd[begin]
            for b, n, k, r, p, lo, hi, e in zip(begin.tolist(), (end - begin).tolist(), bucket.tolist(), rows[begin].tolist(), pos.tolist(), starts[begin].tolist(), ends[last].tolist(), easy.tolist(), strict=True):
                string = data[lo:hi]
                packer.add(docs_[r], p, n, k, string if e else b" ".join(string.split()))
            if packer.size > FLUSH_BYTES:
                yield from packer.rows()
        yield from packer.rows()

    return docs.mapInArrow(run, "bucket int, kind int, packed binary")


def later_windows(strings: list[bytes], doc: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """Spans (doc, first, last word + 1) of the windows of packed strings that aren't the first of their kind."""
    number: dict[bytes, int] = {}
    lists = [s.split(b" ") for s in strings]
    sizes = np.array([len(x) for x in lists])
    ids = np.fromiter((number.setdefault(w, len(number)) for x in lists for w in x), np.int64, int(sizes.sum()))
    offset = np.concatenate(([0], sizes.cumsum()))
    count = sizes - window + 1
    owner = np.repeat(np.arange(len(lists)), count)
    inner = np.arange(count.sum()) - np.repeat(np.concatenate(([0], count.cumsum()[:-1])), count)
    at = offset[owner] + inner
    d, p = doc[owner], begin[owner] + inner
    h = grams(mix(ids.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.lexsort((p, d, h))
    hs = h[order]
    same = np.concatenate(([False], hs[1:] == hs[:-1]))
    # exactly: word by word against the first of the run; a run of equal hashes that differs is sorted by its words
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    check = np.flatnonzero(same)
    a, b = at[order[check]], at[order[group[check]]]
    equal = np.ones(len(check), bool)
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    later = np.zeros(len(order), bool)
    later[order[check]] = True
    for g in np.unique(group[check[~equal]]).tolist():
        seen: set[tuple] = set()
        for i in order[group == g].tolist():
            key = tuple(ids[at[i] : at[i] + window].tolist())
            later[i] = key in seen
            seen.add(key)
    i = np.flatnonzero(later)
    i = i[np.lexsort((p[i], d[i]))]
    return merged(d[i], p[i], p[i] + window)


def merged(d: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Union of spans of equal length that are sorted by document and start."""
    if not len(d):
        return np.empty((0, 3), np.int64)
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (first[1:] > last[:-1])))
    at = np.flatnonzero(new)
    return np.stack((d[at], first[at], last[np.append(at[1:], len(d)) - 1]), 1)


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, last: words [first, last) are covered by windows whose word sequence also starts earlier.

    Spans of a document may overlap. Null and empty texts and those of fewer than window words have none. Rows without
    an id are left out; of rows that repeat an id, equal starts count as one place, so give each row its own id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    buckets = BUCKETS_BY_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(table: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        strings, doc, begin, known = [], [], [], []
        kinds, packed = table.column("kind").to_pylist(), table.column("packed")
        for kind, blob in zip(kinds, packed, strict=True):
            raw = press.decompress(blob.as_py())
            if kind:
                known.append(np.frombuffer(raw, np.int64).reshape(-1, 3))
            else:
                s, d, b = pickle.loads(raw)
                strings += s
                doc.append(np.frombuffer(d, np.int64))
                begin.append(np.frombuffer(b, np.int64))
        if strings:
            known.append(later_windows(strings, np.concatenate(doc), np.concatenate(begin), window))
        out = np.concatenate(known)
        return pa.table({"doc_id": out[:, 0], "first": out[:, 1].astype(np.int32), "last": out[:, 2].astype(np.int32)})

    frequent = frequent_minimisers(rows, window, minimiser)
    return pack(rows, buckets, window, minimiser, frequent).groupBy("bucket").applyInArrow(run, SPANS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space).

    A document of null or empty text has no words and an empty kept_text. See repeated_spans() for ties and repeats.
    """
    spans = stored(repeated_spans(docs, window, minimiser, id_col, text_col), "repeated-spans")
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(gone.hint("merge"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, mine in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                w = text.as_buffer().to_pybytes().split()
                cover = np.zeros(len(w) + 1, np.int32)
                for s in mine or ():
                    cover[s["first"]] += 1
                    cover[s["last"]] -= 1
                stay = (np.cumsum(cover)[:-1] == 0) if mine else np.ones(len(w), bool)
                n_words.append(len(w))
                n_removed.append(len(w) - int(stay.sum()))
                kept.append(b" ".join([x for x, s in zip(w, stay.tolist(), strict=True) if s] if mine else w).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")

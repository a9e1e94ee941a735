"""Lexical retrieval packing: sequences of related documents.

Documents are encoded once; terms are their token ids, so document frequencies of the whole corpus are exact and as many
as the vocabulary. The index is sharded by term: a document belongs with those that share its two foremost terms (by BM25
weight, of terms that several documents hold), and documents in order of these terms make up shards. A shard has an
inverted index with BM25 weights. A seed document opens a window; unused neighbours in order of their score fill it, the
last one is cut, and its rest stays unused. Full windows of one document need no neighbours. What is left of a shard is
laid out in sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bpe import SLICE, encoder, forget, without_collection
from touchline.llm.common import discard, slices, stored, tidy

WINDOW, END = 1024, 0
K1, B = 1.2, 0.75
#: Documents of a shard, and ids (one longer document may exceed them).
SHARD_DOCS, SHARD_IDS = 1024, 1 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
ENCODED = "doc_id bigint, ids binary"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with the end id, in the encoder's dtype) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_collection():
            code = encoder(path)
            for batch in slices(batches, size=SLICE):
                end = np.array([END], code.dtype).tobytes()
                ids = [x.tobytes() + end for x in code.encode_many(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        tidy()

    return docs.mapInArrow(run, ENCODED)


def terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs in order, their counts, and ids by row."""
    size = np.array([len(x) for x in ids], np.int64)
    key = np.repeat(np.arange(len(ids), dtype=np.int64), size) << 32 | np.concatenate(ids).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key))), size


def _arrays(column: pa.Array, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def statistics(docs: DataFrame, vocabulary: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, float]:
    """Documents by term, inverse document frequency, and mean ids of a document, over all encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            if batch.num_rows:
                _, term, _, size = terms(_arrays(batch.column(0), dtype))
                df += np.bincount(term, minlength=vocabulary)
                n, total = n + batch.num_rows, total + int(size.sum())
        at = np.flatnonzero(df)
        # terms -1 and -2 hold the number of documents and of ids
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], at))), pa.array(np.concatenate(([n, total], df[at])))], names=["term", "n"])
        forget()
        tidy()

    rows = docs.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows["term"].tolist(), rows["n"].tolist(), strict=True))
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(vocabulary)
    df[list(found)] = list(found.values())
    return df, np.log1p((n - df + 0.5) / (df + 0.5)), total / max(n, 1)


def weights(row: np.ndarray, term: np.ndarray, count: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    return idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[row] / max(mean, 1e-9)))


def foremost(ids: list[np.ndarray], df: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """The two terms of greatest weight of each document that other documents hold too; -1 where there is none."""
    row, term, count, size = terms(ids)
    shared = df[term] > 1
    row, term, count = row[shared], term[shared], count[shared]
    order = np.lexsort((term, -weights(row, term, count, size, idf, mean), row))
    row, term = row[order], term[order]
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    out = np.full((len(ids), 2), -1, np.int64)
    for k in range(2):
        has = np.diff(first) > k
        out[has, k] = term[first[:-1][has] + k]
    return out


class Index:
    """Inverted index of a shard: postings by term with their BM25 weights."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        row, term, count, size = terms(ids)
        weight = weights(row, term, count, size, idf, mean)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = row[order], weight[order]
        slots, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.own = np.searchsorted(slots, term)  # term numbers by document
        self.span = np.searchsorted(row, np.arange(len(size) + 1))
        self.n = len(size)

    def neighbours(self, seed: int, left: np.ndarray) -> np.ndarray:
        """Documents with something left that share a term with the seed, by falling score; then all others, by position."""
        t = self.own[self.span[seed] : self.span[seed + 1]]
        begin, size = self.first[t], self.first[t + 1] - self.first[t]
        at = np.repeat(begin - np.concatenate(([0], size.cumsum()[:-1])), size) + np.arange(size.sum()) if len(t) else np.empty(0, np.int64)
        score = np.bincount(self.docs[at], self.weights[at], self.n)
        free = np.flatnonzero(left > 0)
        return free[np.argsort(-score[free], kind="stable")]


def pack_shard(lengths: list[int], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length). All ids are used once."""
    out = []
    used = [0] * len(lengths)
    for d, n in enumerate(lengths):
        while n - used[d] >= window:
            out.append([(d, used[d], window)])
            used[d] += window
    left = np.array([n - u for n, u in zip(lengths, used, strict=True)])
    for seed in range(len(lengths)):
        while left[seed] > 0:
            pieces, room = [(seed, used[seed], int(left[seed]))], window - int(left[seed])
            used[seed] += int(left[seed])
            left[seed] = 0
            if room and left.any():
                order = index.neighbours(seed, left)
                # as many whole neighbours as fit, then a cut one
                fit = int(np.searchsorted(left[order].cumsum(), room, side="right"))
                for d in order[: fit + 1].tolist():
                    take = min(room, int(left[d]))
                    if take:
                        pieces.append((d, used[d], take))
                        used[d] += take
                        left[d] -= take
                        room -= take
            if not room:
                out.append(pieces)
                continue
            for bit in range(window.bit_length() - 1, -1, -1):
                size, filled = 1 << bit, []
                if not (window - room) & size:
                    continue
                while size:
                    d, start, n = pieces.pop(0)
                    take = min(n, size)
                    filled.append((d, start, take))
                    size -= take
                    if take < n:
                        pieces.insert(0, (d, start + take, n - take))
                out.append(filled)
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces (SCHEMA): each id of each document, with an end id, lies in one piece of one sequence.

    A null or empty text is its end id alone. Rows that repeat an id, or have none, are packed each (pieces are told
    apart by their sequences). Very long texts fill windows of their own. Ties go by document order in a shard. Other
    columns aren't used, whatever their names; an empty table gives no pieces. window must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = stored(encoded(rows, path), "encoded")
    vocabulary, dtype = encoder(path).vocabulary, encoder(path).dtype
    df, idf, mean = statistics(whole, vocabulary, dtype)
    shared = docs.sparkSession.sparkContext.broadcast((df, idf))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                two = foremost(_arrays(batch.column(1), dtype), *shared.value, mean)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(two[:, 0]), pa.array(two[:, 1])], names=["doc_id", "ids", "t1", "t2"])
        forget()
        tidy()

    # the document's hash parts documents that have both terms in common, however many
    placed = stored(whole.mapInArrow(keyed, f"{ENCODED}, t1 bigint, t2 bigint").withColumn("h", F.xxhash64("doc_id", "ids")), "keyed")
    discard(whole)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(n, "t1", "t2", "h").sortWithinPartitions("t1", "t2", "h").select("doc_id", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        doc_ids, ids, size = [], [], 0
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), _arrays(batch.column(1), dtype), strict=True):
                if ids and (len(ids) == shard_docs or size + len(x) > SHARD_IDS):
                    yield doc_ids, ids
                    doc_ids, ids, size = [], [], 0
                doc_ids.append(doc)
                ids.append(x)
                size += len(x)
        if ids:
            yield doc_ids, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        for doc_ids, ids in shards(batches):
            out = []
            for pieces in pack_shard([len(x) for x in ids], Index(ids, shared.value[1], mean), window):
                offset = 0
                for d, start, n in pieces:
                    out.append((doc_ids[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4")), len(ids[d]), sequence, offset))
                    offset += n
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
        forget()
        tidy()

    return dealt.mapInArrow(run, SCHEMA)

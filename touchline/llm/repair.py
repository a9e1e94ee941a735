"""Token-ID files with Re-Pair grammar compression.

Documents are encoded in ascending order of their ids, an end id after each. A shard's id string is compressed by
rounds: frequent pairs become nonterminals (never across an end id), every round counts the pairs of the shortened string
again, until no pair occurs LEAST times. A shard stores its rules, the expansion length of each rule and the compressed
string with the place of every document, so a range of a document's ids is decoded from its own symbols: the lengths
tell which symbols cover the range.

File format, one row per shard in Parquet files: part and shard (order), n_tokens, doc_ids (int64), doc_tokens
(uint32, with the end id), doc_symbols (uint32), rules (pairs of uint32), rule_lengths (uint32), symbols (uint16 while
ids and nonterminals fit in 16 bits, else uint32); all little-endian. Symbols from `base` on are nonterminals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.bpe import SLICE, encoder, forget, without_collection
from touchline.llm.common import slices, tidy

END = 0
#: Ids of a shard (one longer document has a shard of its own).
SHARD_TOKENS = 1 << 20
#: How often a pair must occur to be replaced: a rule takes 12 bytes and saves 2 bytes an occurrence, so 7 is the first number that pays.
LEAST = 7
SCHEMA = "part int, shard int, base int, n_tokens bigint, doc_ids binary, doc_tokens binary, doc_symbols binary, rules binary, rule_lengths binary, symbols binary"


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n x 2) and expansion lengths of an id string in which END closes each document.

    A round replaces every occurrence of its frequent pairs, or the symbol they share with one replaced before them. So
    the other pairs of older symbols only become rarer, and the next round counts those with a symbol of this one.
    """
    s = ids.astype(np.uint32)
    rules = np.empty((0, 2), np.uint32)
    lengths = np.empty(0, np.uint32)
    fresh = 0
    while len(s) > 1:
        narrow = base + len(rules) <= 1 << 16
        inner = (s[:-1] != END) & (s[1:] != END)
        if fresh:
            new = s >= fresh
            inner &= new[:-1] | new[1:]
        where = np.flatnonzero(inner)
        keys = (s[where] << np.uint32(16) | s[where + 1]) if narrow else s[where].astype(np.uint64) << np.uint64(32) | s[where + 1]
        ordered = np.sort(keys)
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        chosen = ordered[first[counts >= least]]
        if not len(chosen):
            break
        # a small table of hashes first, then the exact look-up
        sieve = np.zeros(1 << 16, bool)
        slot = lambda k: (k * k.dtype.type(0x9E3779B1) >> k.dtype.type(16)).astype(np.uint16) if k.dtype == np.uint32 else ((k ^ k >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
        with np.errstate(over="ignore"):
            sieve[slot(chosen)] = True
            maybe = np.flatnonzero(sieve[slot(keys)])
        place = np.searchsorted(chosen, keys[maybe])
        place[place == len(chosen)] = 0
        hit = chosen[place] == keys[maybe]
        at, place = where[maybe[hit]], place[hit]
        # of overlapping pairs every second one is replaced, from the left
        start = np.concatenate(([True], np.diff(at) != 1))
        run = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
        keep = (at - run) % 2 == 0
        at, place = at[keep], place[keep]
        left, right = s[at], s[at + 1]
        used = np.unique(place)
        number = np.zeros(len(chosen), np.uint32)
        number[used] = np.arange(len(used), dtype=np.uint32) + np.uint32(base + len(rules))
        pair = np.zeros((len(chosen), 2), np.uint32)
        pair[place, 0], pair[place, 1] = left, right
        all_lengths = np.concatenate((np.ones(base, np.uint32), lengths))
        fresh = base + len(rules)
        rules, lengths = np.concatenate((rules, pair[used])), np.concatenate((lengths, all_lengths[pair[used, 0]] + all_lengths[pair[used, 1]]))
        s[at] = number[place]
        s = np.delete(s, at + 1)
    return s, rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    s = symbols.astype(np.uint32)
    while len(s) and (inner := s >= base).any():
        out = np.repeat(s, np.where(inner, 2, 1))
        at = (np.cumsum(np.where(inner, 2, 1)) - 2)[inner]
        pair = rules[s[inner] - base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def _shard(part: int, shard: int, base: int, doc_ids: list, ids: list[np.ndarray]) -> list:
    tokens = np.array([len(x) for x in ids], np.uint32)
    symbols, rules, lengths = compress(np.concatenate(ids), base)
    ends = np.flatnonzero(symbols == END)
    doc_symbols = np.diff(np.concatenate(([-1], _document_ends(symbols, ends, tokens, lengths, base)))).astype("<u4")
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    ids_out = np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8")
    return [part, shard, base, int(tokens.sum()), ids_out.tobytes(), tokens.astype("<u4").tobytes(), doc_symbols.tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes()]


def _document_ends(symbols: np.ndarray, ends: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Places of the end ids that close documents: an id 0 of a text itself is no end."""
    if len(ends) == len(tokens):
        return ends
    size = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))[symbols].cumsum()
    return np.searchsorted(size, tokens.astype(np.int64).cumsum())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards (SCHEMA) of all documents in ascending order of id: write them as Parquet, they are the file format.

    A null text is empty and so one end id; null ids come first; rows that repeat an id all stay, side by side. Other
    columns aren't used; an empty table gives no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_collection():
            yield from shards(batches)
        tidy()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0
        end = np.array([END], code.dtype)

        def close() -> pa.RecordBatch:
            row = _shard(part, shard, code.vocabulary, doc_ids, ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches, size=SLICE):
            for doc, found in zip(batch.column(0).to_pylist(), code.encode_many(batch.column(1)), strict=True):
                x = np.concatenate((found, end))
                if size and size + len(x) > shard_tokens:
                    yield close()
                    shard, doc_ids, ids, size = shard + 1, [], [], 0
                doc_ids.append(doc)
                ids.append(x)
                size += len(x)
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """part, shard, start: the ids before each shard. Sums of parts (tasks) are few; only they are ordered in one task."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return shards.select("part", "shard", "n_tokens", within.alias("within")).join(before.hint("merge"), "part").select("part", "shard", (F.col("before") + F.col("within")).alias("start"))


def documents(shards: DataFrame, ids: bool = False) -> DataFrame:
    """Decode: doc_id, start (ids before it), n_tokens, ids_crc32, and the ids themselves where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                kind = "<u2" if row["base"] + len(rules) <= 1 << 16 else "<u4"
                tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                whole = expand(np.frombuffer(row["symbols"], kind), rules, row["base"]).astype("<u4")
                last = tokens.cumsum()
                parts = [whole[b - n : b] for b, n in zip(last.tolist(), tokens.tolist(), strict=True)]
                found = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found, mask=found == -(1 << 63)), pa.array(row["start"] + last - tokens), pa.array(tokens),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if ids else [None] * len(parts), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )
        forget()
        tidy()

    placed = shards.join(starts(shards).hint("merge"), ["part", "shard"]).select("base", "doc_ids", "doc_tokens", "rules", "symbols", "start")
    out = placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>")
    return out if ids else out.drop("ids")


def decode_range(row: dict, number: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Random access: ids [first, last) of the number-th document of one shard row; only symbols that cover them are expanded."""
    rules, lengths = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)
    kind = "<u2" if row["base"] + len(rules) <= 1 << 16 else "<u4"
    of_docs = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
    end = int(of_docs[: number + 1].sum())
    symbols = np.frombuffer(row["symbols"], kind)[end - int(of_docs[number]) : end].astype(np.int64)
    inner = symbols >= row["base"]
    size = np.ones(len(symbols), np.int64)
    size[inner] = lengths[symbols[inner] - row["base"]]
    ends = size.cumsum()
    last = int(ends[-1]) if last is None else min(last, int(ends[-1]))
    if first >= last:
        return np.empty(0, np.uint32)
    a, b = int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, last)) + 1
    begin = int(ends[a] - size[a])
    return expand(symbols[a:b], rules, row["base"])[first - begin : last - begin]

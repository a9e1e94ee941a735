"""Exact dedup by an extendible-hash index on shared files (native: DataFrame functions only).

Every text has a 64-bit key hash. A directory of hash prefixes starts with one bucket and doubles while a bucket holds more
distinct keys than its capacity; only overfull buckets split, so a bucket is a range of keys. Rows are entered into the bucket
that the directory names for their key: equal bytes of a bucket are one entry, counted by task before the shuffle, so a
text that a third of all rows hold reaches its place as one row per task. Owner tasks, each of a range of buckets, chain the
entries that share a key and write the buckets' files. A document is looked up in its bucket by its key: the chain there
is a single entry, which is then its own, or has several, and their bytes are compared with its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import by_rows, discard, stored, text_key, without_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of one bucket before it splits; the directory's slots that the driver holds and broadcasts at most (16 MB).
#: A corpus that fills 2**MOST_DEPTH buckets gets a proportionally larger capacity, not deeper prefixes.
CAPACITY, MOST_DEPTH = 8192, 20


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def prefix_bits(key: Column, depth: int) -> Column:
    """The first depth bits of a 64-bit hash as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def depth_for(entries: int, capacity: int) -> int:
    """Bits of prefix by which entries are counted: three more than even buckets would need."""
    return min(MOST_DEPTH, max(1, math.ceil(math.log2(max(entries / capacity, 1))) + 3))


def directory(counts: Mapping[int, int], capacity: int, depth: int) -> list[tuple[int, int]]:
    """Buckets (depth, prefix) after splitting every overfull one; counts: entries by prefix of depth bits."""
    sums: list[dict[int, int]] = [dict(counts)]
    for _ in range(depth):
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    sums.reverse()
    done, todo = [], [(0, 0)]
    while todo:
        d, p = todo.pop()
        if d < depth and sums[d].get(p, 0) > capacity:
            todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        else:
            done.append((d, p))
    return sorted(done, key=lambda b: b[1] << (depth - b[0]))


def slots_of(spark: SparkSession, buckets: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """The directory as a table (slot, bucket) of 2**depth rows, and its depth: several slots may name one bucket."""
    depth = max(d for d, _ in buckets)
    rows = [i for i, (d, _) in enumerate(buckets) for _ in range(1 << (depth - d))]
    # from Arrow: a list would go through Python workers, which stay in every executor behind this step
    return spark.createDataFrame(pa.table({"slot": pa.array(range(len(rows)), pa.int64()), "bucket": pa.array(rows, pa.int32())})), depth


def in_bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows (with key) and the bucket that the directory names; the directory's size is checked (MOST_DEPTH)."""
    return rows.withColumn("slot", prefix_bits(F.col("key"), depth)).join(F.broadcast(slots), "slot").drop("slot")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("norm"))


def build_index(rows: DataFrame, capacity: int = CAPACITY, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The index (bucket, key, chain, links, text_sha256, keep_id, keep_key, group_size) and its directory.

    rows: doc_id, text_key, norm; keys: their keys, where they are at hand. links: entries of the key's chain.
    """
    keys = keyed(rows).select("key") if keys is None else keys
    depth = depth_for(rows.count(), capacity)
    counts = {r["p"]: r["n"] for r in keys.distinct().groupBy(prefix_bits(F.col("key"), depth).alias("p")).agg(F.count("*").alias("n")).collect()}
    slots, depth = slots_of(rows.sparkSession, directory(counts, max(capacity, math.ceil(sum(counts.values()) / (1 << MOST_DEPTH))), depth))
    found = stored(entries(in_bucket(keyed(rows), slots, depth)).drop("norm"), "entries")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chain = Window.partitionBy("bucket", "key")
    owned = found.repartitionByRange(n, "bucket")
    chained = owned.withColumns({"chain": F.row_number().over(chain.orderBy("text_sha256")), "links": F.count("*").over(chain)})
    index = stored(chained.sortWithinPartitions("bucket", "key"), "exact-index")
    discard(found)
    return index, slots, depth


def entries(rows: DataFrame) -> DataFrame:
    """Of rows in their buckets, one entry for all of equal bytes: bucket, key, norm, text_sha256, keep_id, keep_key, group_size."""
    made = rows.groupBy("bucket", "key", "norm").agg(F.max(F.struct("doc_id", "text_key")).alias("keep"), F.count("*").alias("group_size"))
    return made.select("bucket", "key", "norm", F.sha2("norm", 256).alias("text_sha256"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_key").alias("keep_key"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_key: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id of its group), group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty, so nulls and empty texts form one
    group. Every row counts, also one that repeats an id. Of rows with the largest id, the one with the greatest
    text_key (a hash of the text as it is) is kept; a null id is less than any other, so a group of null ids keeps one
    text too. Rows equal in id and text are all marked kept. Other columns of docs are not used, whatever their names.
    Very long texts are taken whole. An empty table gives an empty result. with_key adds text_key.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), normalised(F.col(text_col)).alias("norm"))
    members = stored(keyed(rows).drop("norm"), "exact-rows")
    index, slots, depth = build_index(rows, capacity, members.select("key"))
    held = index.drop("chain")
    found = in_bucket(members, slots, depth).join(held.where("links = 1").hint("merge"), ["bucket", "key"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *(["text_key"] if with_key else [])]
    chains = index.where("links > 1").select("key").distinct()
    if chains.isEmpty():
        return found.select(columns)
    # different texts of one 64-bit key, a rarity: these rows are read again, and their bytes decide
    again = in_bucket(keyed(rows).join(chains.hint("merge"), "key", "left_semi"), slots, depth)
    same = again.join(entries(again).hint("merge"), ["bucket", "key", "norm"])
    return found.select(columns).unionByName(same.select(columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of exact_groups(); all columns stay.

    Decisions are on rows, not on ids: an id that one group drops may stay in another. Of rows equal in id and text one
    stays, whichever.
    """
    found = stored(exact_groups(docs, id_col, text_col, with_key=True), "exact-groups")
    left = without_rows(docs, found.where(~F.col("kept")).select("doc_id", "text_key"), id_col, text_col)
    twice = found.where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    twice = stored(twice, "repeated-rows")
    if twice.isEmpty():
        return left
    again = by_rows(left, twice, id_col, text_col, "left_semi").dropDuplicates([id_col, text_col])
    return by_rows(left, twice, id_col, text_col, "left_anti").unionByName(again)

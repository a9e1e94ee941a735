"""Filter interaction audit with wide packed counters.

A row fails some of the filters: a mask. What each filter of each order does to a row depends on its mask and its two
labels alone, so every (mask, labels) is mapped to one big integer, whose fields of FIELD_BITS bits hold the outcomes of
all steps of all orders (120 orders of five filters: 600 steps, six counters each). Rows are counted by part and mask in
Spark, combined in the tasks before the shuffle; per part the integers, times these counts, are summed. A field holds a
number of rows, which stays below 2**63, so fields never run into each other; the sum is unpacked once per part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_BITS = 64
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most filters: 7 give 35,280 steps and integers of 1.7 MB for each of 512 masks and labels.
MOST_FILTERS = 6


def orders(filters: str) -> list[str]:
    """All orders of the filters' letters, in alphabetical order."""
    return ["".join(p) for p in itertools.permutations(sorted(filters))]


def outcomes(filters: str, mask: int, good: bool, toxic: bool) -> np.ndarray:
    """0 or 1 by order, step and counter for one row that fails the filters of mask (bit i: the i-th letter)."""
    letters = sorted(filters)
    fails = {x: bool(mask >> i & 1) for i, x in enumerate(letters)}
    out = np.zeros((len(orders(filters)), len(letters), len(COUNTERS)), np.uint64)
    alone = sum(fails.values()) == 1
    for i, order in enumerate(orders(filters)):
        gone = False
        for k, x in enumerate(order):
            here = fails[x] and not gone
            redundant = fails[x] and gone
            gone = gone or here
            out[i, k] = (not gone, here, redundant, fails[x] and alone, here and good, here and toxic)
    return out


def packed(fields: np.ndarray) -> int:
    """Fields as one integer, the first in its lowest bits."""
    return int.from_bytes(np.ascontiguousarray(fields, "<u8").tobytes(), "little")


def unpacked(total: int, n: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(n * FIELD_BITS // 8, "little"), "<u8").astype(np.int64)


def text_failures(text: Column) -> dict[str, Column]:
    """The filters A to D on a text (no null): few words, few distinct words, many capitals, odd characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 50, "B": 100 * distinct.cast("long") < 65 * n.cast("long"), "C": 100 * capitals.cast("long") > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of docs: part, fails_A to fails_E, good, toxic.

    E fails where a row of a smaller id has the same text (texts are told apart by SHA-256 and length). Null texts are empty, a
    null part is the empty string. A row without an id doesn't fail E and makes no other row fail; rows that repeat the least id
    of a text all pass E. A row is good or toxic if any row of labels with its id says 1. Other columns aren't used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = {"id": F.col(id_col), "digest": F.unhex(F.sha2(text, 256)), "size": F.octet_length(text)}
    rows = docs.select(*(c.alias(k) for k, c in ids.items()), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), *(c.alias(f"fails_{k}") for k, c in text_failures(text).items()))
    # the least id of a text: only ids and digests are shuffled, combined by task; a row then meets it under its own id
    least = docs.select(*(c.alias(k) for k, c in ids.items())).groupBy("digest", "size").agg(F.min("id").alias("id"), F.lit(True).alias("least"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    joined = rows.join(marks.hint("merge"), "id", "left").join(least.hint("merge"), ["id", "digest", "size"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select("part", *(f"fails_{x}" for x in "ABCD"), (F.col("id").isNotNull() & F.col("least").isNull()).alias("fails_E"), yes(F.col("quality")).alias("good"), yes(F.col("toxic")).alias("toxic"))


def audit(rows: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """What each filter does at each step of each order, by part: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (what its filter removes, summed over all orders).

    rows: part, good, toxic and one boolean column per filter, true where the row fails it; filters: letter -> column, at most
    MOST_FILTERS. A null failure passes. Every part has a row for every step, zeros included; an empty table has none.
    """
    letters = "".join(sorted(filters))
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    mask = sum((F.coalesce(F.col(filters[x]), F.lit(False)).cast("int") * (1 << i) for i, x in enumerate(letters)), F.lit(0))
    counts = rows.groupBy("part", mask.alias("mask"), "good", "toxic").agg(F.count("*").alias("n"))
    names = orders(letters)
    steps = len(names) * len(letters)
    fields = steps * len(COUNTERS)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in (*COUNTERS, "shapley"))])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("mask", "good", "toxic", "n"))
            for m, good, toxic, n in zip(*columns, strict=True):
                number += n * _integer(letters, m, bool(good), bool(toxic))
        counters = unpacked(number, fields).reshape(len(names), len(letters), len(COUNTERS))
        removed = dict.fromkeys(letters, 0)
        for i, order in enumerate(names):
            for k, x in enumerate(order):
                removed[x] += int(counters[i, k, COUNTERS.index("removed")])
        flat = counters.reshape(steps, len(COUNTERS))
        out = [pa.array([key[0].as_py()] * steps, pa.string()), pa.array([o for o in names for _ in letters]), pa.array(list(range(1, len(letters) + 1)) * len(names), pa.int32())]
        out += [pa.array(flat[:, c]) for c in range(len(COUNTERS))]
        yield pa.RecordBatch.from_arrays([*out, pa.array([removed[x] for o in names for x in o], pa.int64())], schema=schema)

    longs = ", ".join(f"{c} bigint" for c in (*COUNTERS, "shapley"))
    return counts.groupBy("part").applyInArrow(total, f"part string, filter_order string, step int, {longs}")


_integers: dict[tuple[str, int, bool, bool], int] = {}


def _integer(letters: str, mask: int, good: bool, toxic: bool) -> int:
    key = (letters, mask, good, toxic)
    if key not in _integers:
        _integers[key] = packed(outcomes(*key))
    return _integers[key]

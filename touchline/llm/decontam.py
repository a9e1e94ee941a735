"""Benchmark decontamination (native: DataFrame functions only).

The window texts of the benchmark form a hash set that is broadcast behind a size check. A document is first probed in
blocks: every occurrence of a window of w words covers a whole block of q = (w + 1) // 2 words that starts at a
multiple of q, so only every q-th q-gram is looked up. Documents with a match build all their windows, which join the set
on their whole text, so every hit is verified.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored, text_key, without_rows
from touchline.llm.exact import normalised

WINDOW = 13
#: All that isn't a digit, a letter of the (lower-cased) Latin alphabet or above ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that may be broadcast (about 100 bytes each), and block hashes that may stand in the plan; more are joined.
BROADCAST_WINDOWS, BLOCK_SET = 200_000, 100_000


def word_array(text: Column) -> Column:
    """Words of a text; null and texts without words give an empty array."""
    return F.filter(F.split(normalised(text), SEPARATORS), lambda w: w != "")


def windows_of(words: Column, width: Column | int) -> Column:
    """Structs (pos, gram) of all windows of width words; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, width), " ").alias("gram"))),
    ).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def block_hashes(words: Column, q: int, step: int) -> Column:
    """Hashes of the q-grams that start at multiples of step."""
    return F.when(
        F.size(words) >= q, F.transform(F.sequence(F.lit(0), F.size(words) - q, F.lit(step)), lambda i: F.xxhash64(F.slice(words, i + 1, q)))
    ).otherwise(F.array().cast("array<bigint>"))


def _in(values: list[int]) -> Callable[[Column], Column]:
    return lambda h: h.isin(values)


def _with_width(width: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(width).alias("width"), x["pos"].alias("pos"), x["gram"].alias("gram"))


def probed(rows: DataFrame, items: DataFrame, widths: list[int], block_set: int) -> DataFrame:
    """rows (doc_id, text_key, words) with maybe: whether a block of the document equals a q-gram of an item.

    Up to block_set hashes stand in the plan as a set. More are a table: blocks of documents are joined with it, and only
    rows with a match are marked.
    """
    blocks = None
    for q in sorted({(w + 1) // 2 for w in widths}):
        at = items.where(F.floor((F.col("width") + 1) / 2) == q).select(F.lit(q).alias("q"), F.explode(block_hashes(F.col("words"), q, 1)).alias("h")).distinct()
        blocks = at if blocks is None else blocks.unionByName(at)
    if blocks is None:
        return rows.withColumn("maybe", F.lit(False))
    blocks = stored(blocks, "benchmark-blocks")
    sizes = {r["q"]: r["n"] for r in blocks.groupBy("q").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= block_set:
        values: dict[int, list[int]] = {}
        for r in blocks.collect():
            values.setdefault(r["q"], []).append(r["h"])
        probe = F.lit(False)
        for q, found in sorted(values.items()):
            probe |= F.exists(block_hashes(F.col("words"), q, q), _in(found))
        return rows.withColumn("maybe", probe)
    own = [rows.select("doc_id", "text_key", F.lit(q).alias("q"), F.explode(block_hashes(F.col("words"), q, q)).alias("h")) for q in sizes]
    hit = functools.reduce(DataFrame.unionByName, own).join(blocks.hint("merge"), ["q", "h"], "left_semi").select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return rows.join(hit.hint("merge"), same, "left").withColumn("maybe", F.col("hit_key").isNotNull()).drop("hit_id", "hit_key")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", broadcast_limit: int = BROADCAST_WINDOWS, block_set: int = BLOCK_SET,
) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, hits array of (pos, width, items) for each window that occurs.

    A benchmark item of fewer than window words, but not none, is one window of its own width; items that repeat an id
    are all used. Null or empty texts and items have no words, no windows and no hits. Rows that repeat a doc_id, of
    equal text or not, have a row each; a null doc_id is kept. Very long texts are taken whole. An empty benchmark gives
    documents without hits, an empty table no rows. Other columns are not used, so their names may clash. text_key is a
    hash of the text: with doc_id it names a row.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(item_text)).alias("words")).where("size(words) > 0")
    items = items.withColumn("width", F.least(F.size("words"), F.lit(window)))
    grams = (
        items.select("item", "width", "words", F.explode(windows_of(F.col("words"), F.col("width"))).alias("w"))
        .groupBy("width", F.col("w.gram").alias("gram"))
        .agg(F.collect_set("item").alias("items"))
    )
    widths = [r["width"] for r in items.select("width").distinct().collect()]
    n_grams = grams.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), word_array(F.col(text_col)).alias("words"))
    rows = probed(rows, items, widths, block_set).withColumn("row", F.monotonically_increasing_id())
    found = F.array().cast("array<struct<width:int,pos:int,gram:string>>")
    for w in widths:
        found = F.concat(found, F.transform(windows_of(F.col("words"), w), _with_width(w)))
    found = F.when(F.col("maybe"), found)
    own = ["row", "doc_id", "text_key", "n_words"]
    scanned = rows.select("row", "doc_id", "text_key", F.size("words").alias("n_words"), F.explode_outer(found).alias("f")).select(*own, "f.*")
    grams = F.broadcast(grams) if n_grams <= broadcast_limit else grams.hint("merge")
    hits = scanned.join(grams, ["width", "gram"], "left")
    return hits.groupBy(*own).agg(F.collect_list(F.when(F.col("items").isNotNull(), F.struct("pos", "width", "items"))).alias("hits")).drop("row")


def summary(hits: DataFrame) -> DataFrame:
    """contamination() with n_hit (words inside hits), items (sorted ids) and contaminated (at least 5 % of the words)."""
    spans = F.transform(F.col("hits"), lambda h: F.sequence(h["pos"], h["pos"] + h["width"] - 1))
    return (
        hits.withColumn("n_hit", F.size(F.array_distinct(F.flatten(spans))).cast("long"))
        .withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform(F.col("hits"), lambda h: h["items"])))))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without contaminated rows, told apart by id and text; all columns stay. See contamination() for nulls and repeats."""
    found = summary(contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how))
    return without_rows(docs, found.where("contaminated").select("doc_id", "text_key"), id_col, text_col)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id and clean_text, its normalised words outside of hits joined by spaces."""
    hit = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).where(F.size("hits") > 0)
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "hits").dropDuplicates(["hit_id", "hit_key"])
    gone = F.flatten(F.transform(F.col("hits"), lambda h: F.sequence(h["pos"], h["pos"] + h["width"] - 1)))
    words = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), word_array(F.col(text_col)).alias("words"))
    kept = F.transform(
        F.filter(F.transform(F.col("words"), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: ~F.array_contains(F.col("gone"), x["i"])), lambda x: x["w"]
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    joined = words.join(hit.withColumn("gone", gone).drop("hits").hint("merge"), same, "left")
    return joined.select("doc_id", F.array_join(F.when(F.size("gone") > 0, kept).otherwise(F.col("words")), " ").alias("clean_text"))

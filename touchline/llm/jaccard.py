"""N-gram Jaccard join in metric space.

Two sets link when 100 |x & y| >= t |x | y|, that is when their symmetric difference is at most
D = (100 - t) (|x| + |y|) / (100 + t). The size of the symmetric difference is a metric, and so is the Hamming distance of parity
sketches (bit i: parity of the shingles that fall into slot i), which never exceeds it. Distances to pivots are taken on
the sketches; links are decided on the shingles of the texts themselves.

1. Equal shingle sets are one class (128-bit digests); only one document of a class goes on.
2. Unrelated documents all lie equally far apart, so pivots part nothing among them. In the order of shingle hashes take
   the first floor((100 - t + e) n / 100) + 1 shingles of each document (n: its shingles). A link shares at least
   floor(e n / 100) + 1 of them, from either side, so a document with fewer that any other document has leaves.
3. The documents that stay meet in root regions, one for a shingle: of the shared ones, a document goes to the regions
   of its rarest, as many as a link can't avoid. The empty set is the first pivot of each region: its distances are sizes,
   which cut rings that overlap by what a link allows. Regions of equal members are one.
4. Regions are parted by pivots: a document lies in the Voronoi cell of its nearest pivot and is replicated to each cell
   whose pivot is at most 2 D further off (triangle inequality); cells are parted in turn. Regions of more than
   TASK_MEMBERS are parted by Spark, smaller ones within a task. Where pivots part nothing, a region is compared
   block by block, in a task of its own for every two blocks.
5. Pairs of different components whose sketches allow a link are compared on their texts. A region with many such pairs
   first sends each member with its nearest neighbours and the foremost one (that shares most with others), and goes on, with
   more pairs, only while it holds several components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import discard, only_ids, slices, stored, text_key, tidy, without_rows
from touchline.llm.graph import components
from touchline.llm.text import grams, mix, white_space_words, words

#: Threshold in hundredths, words of a shingle.
THRESHOLD, SHINGLE = 85, 4
#: Hundredths of a document's shingles that are looked at besides the prefix a link can't avoid.
EXTRA = 10
#: Members of a cell that are compared directly, pivots drawn from a larger one.
LEAF, PIVOTS = 8, 8
#: Distance, in reaches, from which on a member lies in no pivot's cell but in the outer one.
OUTER = 3
#: Members of a region that a task takes as a whole (a sketch is some 100 bytes to 8 kB); larger ones are parted first.
TASK_MEMBERS = 4096
#: Cells are taken if they hold at most this many times the members of their region.
SPREAD = 2.0
#: Pairs by member that a region may send as a whole in the first round, else nearest neighbours of each member; from
#: round to round four times as many.
PAIRS, PAIRS_GROWTH = 2, 4
#: Pairs of one document that are compared in one place.
SALT = 256
#: Bytes of text whose shingles a task makes at once: some 16 MB of numbers.
SLICE = 1 << 18
REGION = ["key", "ring", "path"]
_WORD = white_space_words()
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_keys(texts: pa.LargeStringArray, k: int = SHINGLE) -> list[np.ndarray]:
    """By text, its distinct shingles as sorted 62-bit numbers. Fewer than k words: the whole sequence is one."""
    w = words(texts, _WORD, lower=True)
    all_grams = grams(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            g = all_grams[a : b - k + 1]
        else:
            g = grams(w.hash[a:b], b - a) if b > a else all_grams[:0]
        out.append(np.unique((g >> np.uint64(2)).astype(np.int64)))
    return out


def ring_of(n: int) -> int:
    """A document of n shingles has a sketch of 2**ring bits: two bits a shingle or more."""
    return max(6, (2 * n - 1).bit_length()) if n else 6


def sketch(keys: np.ndarray) -> bytes:
    bits = 1 << ring_of(len(keys))
    odd = np.bincount(keys & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(raw: bytes, ring: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to 2**ring bits: parities of slots that fall together add up."""
    s = np.frombuffer(raw, np.uint64)
    while len(s) > 1 << (ring - 6):
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def digests(keys: np.ndarray) -> tuple[int, int]:
    u = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        a = mix(u).sum(dtype=np.uint64).astype(np.int64)
        b = mix(mix(u ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64).astype(np.int64)
    return int(a), int(b)


def profiles(docs: DataFrame, k: int, threshold: int, extra: int = EXTRA) -> DataFrame:
    """doc_id, text_key, n (shingles), a and b (128-bit digest of the set), sketch, root (first shingles by hash), row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            sets = shingle_keys(batch.column(1), k)
            two = [digests(s) for s in sets]
            root = [s[: (100 - threshold + extra) * len(s) // 100 + 1] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in two], pa.int64()), pa.array([x for _, x in two], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.binary()), pa.array(root, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n", "a", "b", "sketch", "root"],
            )
        tidy()

    read = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    found = read.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, a bigint, b bigint, sketch binary, root array<bigint>")
    return found.withColumn("row", F.monotonically_increasing_id())


def close_pairs(root: DataFrame, sizes: DataFrame, extra: int) -> DataFrame:
    """key, x: root regions of the documents that may have a link. root: x, key; sizes: x, n."""
    need = F.floor(F.lit(extra) * F.col("n") / 100) + 1
    # one exchange serves both sides: the largest and least document of a region tell whether it has several
    dealt = root.repartition("key")
    several = dealt.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("key")
    shared = stored(dealt.join(several.hint("shuffle_hash"), "key", "left_semi"), "shared-shingles")
    may = shared.groupBy("x").agg(F.count("*").alias("c")).join(sizes.hint("merge"), "x").where(F.col("c") >= need).select("x", "n")
    left = shared.join(may.hint("merge"), "x")
    several = left.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    left = left.join(several.hint("merge"), "key").groupBy("x").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    # those that a document has alone are its rarest; a link may lack all but need - 1 of the others
    left = left.where(F.size("own") >= need).withColumn("own", F.slice("own", F.lit(1), (F.size("own") - need + 1).cast("int")))
    out = stored(left.select("x", "n", F.explode("own.key").alias("key")), "root-regions")
    discard(shared)
    return out


def rings(members: DataFrame, threshold: int) -> DataFrame:
    """members (key, x, n) by size: the ring of a document's own sketch, and the one below where a link can reach into it."""
    own = F.greatest(F.lit(6), F.ceil(F.log2(F.col("n") * 2.0))).cast("int")
    own = F.when(F.pow(F.lit(2.0), own) >= 2 * F.col("n"), own).otherwise(own + 1)
    reaches = (own > 6) & (threshold * F.col("n") <= 100 * F.pow(F.lit(2.0), own - 2))
    both = F.when(reaches, F.array(own, own - 1)).otherwise(F.array(own))
    return members.select("key", "x", F.explode(both).alias("ring"), F.lit("").alias("path"))


def distinct_regions(members: DataFrame) -> DataFrame:
    """members of regions that hold several documents; of regions with equal members one stays."""
    marks = [F.bit_xor(F.xxhash64("x", F.lit(i))).alias(f"h{i}") for i in range(2)]
    found = members.groupBy(*REGION).agg(F.count("*").alias("size"), *marks).where("size > 1")
    kept = found.groupBy("ring", "size", "h0", "h1").agg(F.min(F.struct("key", "path")).alias("r")).select("r.key", "ring", "r.path", "size")
    return members.join(kept.hint("merge"), REGION)


def gaps(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches (rows of 64-bit words) to one."""
    return np.bitwise_count(sketches ^ one).sum(1, dtype=np.int64)


def within(away: np.ndarray, reach: int) -> np.ndarray:
    """Which cells (rows) a member (column) belongs to, by its distances to the pivots; the last row is the outer cell.

    A constant changes no faster than a distance does, so the outer cell is one more Voronoi cell, of those that lie OUTER *
    reach or more from every pivot; the window of 2 * reach holds for it too.
    """
    away = np.concatenate((away, np.full((1, away.shape[1]), OUTER * reach)))
    return away <= away.min(0) + 2 * reach


def cells(sketches: np.ndarray, reach: int, leaf: int = LEAF, pivots: int = PIVOTS) -> list[np.ndarray]:
    """Members (row numbers, ascending) of the cells that pivots make, recursively; two at most reach apart share a cell."""
    out, todo = [], [np.arange(len(sketches))]
    while todo:
        mine = todo.pop()
        if len(mine) <= leaf:
            out.append(mine)
            continue
        # pivots: the foremost member, then the one farthest from all pivots so far
        held = sketches[mine]
        away = [gaps(held, held[0])]
        nearest = away[0]
        while len(away) < pivots and nearest.max() > 2 * reach:
            away.append(gaps(held, held[int(nearest.argmax())]))
            nearest = np.minimum(nearest, away[-1])
        inside = within(np.stack(away), reach)
        sizes = inside.sum(1)
        if len(away) == 1 or sizes.max() == len(mine) or sizes.sum() > SPREAD * len(mine):
            out.append(mine)
        else:
            todo += [mine[row] for row in inside]
    return out


def meets_here(own: np.ndarray, i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
    """Whether key is the least region that members i and j have in common; own: region keys by member, padded by distinct fillers."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 21) // own.shape[1] ** 2)
    for at in range(0, len(i), step):
        a, b = own[i[at : at + step]], own[j[at : at + step]]
        common = (a[:, :, None] == b[:, None, :]).any(2)
        out[at : at + step] = np.where(common, a, np.iinfo(np.int64).max).min(1) == key
    return out


def candidates(sketches: np.ndarray, n: np.ndarray, comp: np.ndarray, native: np.ndarray, own: np.ndarray, key: int, threshold: int, budget: int, leaf: int, pivots: int) -> tuple[np.ndarray, bool]:
    """Pairs (member, foremore member) whose sketches allow a link, and whether they are all.

    Members come in order of rank. Beyond budget pairs by member, each is paired with its budget nearest neighbours and
    its foremost one only. A pair that has several regions in common is met in the least of them.
    """
    m = len(n)
    reach = (100 - threshold) * 2 * int(n.max()) // (100 + threshold)
    found, chosen, count = [], [np.empty((0, 2), np.int64)], 0
    for cell in cells(sketches, reach, leaf, pivots):
        step = max(1, (1 << 21) // max(1, len(cell) * sketches.shape[1]))
        for at in range(0, len(cell), step):
            rows = cell[at : at + step]
            apart = np.bitwise_count(sketches[rows][:, None, :] ^ sketches[cell][None, :, :]).sum(2, dtype=np.int64)
            a, b = n[rows][:, None], n[cell][None, :]
            near = ((100 + threshold) * apart <= (100 - threshold) * (a + b)) & (100 * np.minimum(a, b) >= threshold * np.maximum(a, b))
            near &= (comp[rows][:, None] != comp[cell][None, :]) & (native[rows][:, None] | native[cell][None, :])
            i, j = np.nonzero(near)
            here = meets_here(own, rows[i], cell[j], key)
            near[i[~here], j[~here]] = False
            i, j = i[here], j[here]
            count += len(i)
            if not len(i):
                continue
            if count <= 2 * budget * m:
                found.append(np.stack((rows[i], cell[j]), 1))
            far = np.where(near, apart / (a + b), np.inf)
            nearest = np.argpartition(far, min(budget, len(cell)) - 1, axis=1)[:, :budget]
            picked = np.zeros_like(near)
            np.put_along_axis(picked, nearest, True, 1)
            picked[np.arange(len(rows)), near.argmax(1)] = True
            i, j = np.nonzero(picked & near)
            chosen.append(np.stack((rows[i], cell[j]), 1))
    # every pair has been seen from both sides
    done = count <= 2 * budget * m
    pairs = np.concatenate(found) if done and found else np.concatenate(chosen)
    return np.unique(np.stack((pairs.max(1), pairs.min(1)), 1), axis=0), done


def region_pairs(members: DataFrame, threshold: int, budget: int, leaf: int, pivots: int) -> DataFrame:
    """REGION, x, y, done: pairs to compare; regions that have not sent all have done false. members: with x, n, comp, score, sketch, own."""

    def work(rows: list[tuple]) -> Iterator[tuple]:
        ring = rows[0][1]
        rows.sort(key=lambda r: (-r[6], r[3]))
        n = np.array([r[4] for r in rows])
        native = np.array([ring_of(r[4]) == ring for r in rows])
        comp = np.array([r[5] for r in rows])
        own = np.arange(-1, -1 - len(rows) * max(len(r[8]) for r in rows), -1).reshape(len(rows), -1)  # fillers are no keys
        for i, r in enumerate(rows):
            own[i, : len(r[8])] = r[8]
        pairs, done = candidates(np.stack([folded(r[7], ring) for r in rows]), n, comp, native, own, rows[0][0], threshold, budget, leaf, pivots)
        for i, j in pairs.tolist():
            yield *rows[0][:3], rows[i][3], rows[j][3], done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*REGION, "x", "y", "done"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += work(held)
                    held = []
                    if len(out) > 50_000:
                        yield flush()
                held.append(row)
        if held:
            out += work(held)
        if out:
            yield flush()
        tidy()

    sent = members.select(*REGION, "x", "n", "comp", "score", "sketch", "own").repartition(*REGION).sortWithinPartitions(*REGION)
    return sent.mapInArrow(run, "key bigint, ring int, path string, x bigint, y bigint, done boolean")


def parted(members: DataFrame, threshold: int, most: int, pivots: int) -> DataFrame:
    """members (REGION, x, n, score, sketch) in regions that a task can take: larger ones become cells, or blocks by twos."""
    done = None
    while True:
        sizes = stored(members.groupBy(*REGION).agg(F.count("*").alias("size"), F.max("n").alias("most_n")).where(F.col("size") > most), "large-regions")
        if sizes.isEmpty():
            return members if done is None else members.unionByName(done)
        small = members.join(sizes.select(*REGION).hint("merge"), REGION, "left_anti")
        large = members.join(sizes.hint("merge"), REGION)
        slot = F.pmod(F.xxhash64("x"), F.lit(pivots))
        foremost = F.struct((-F.col("score")).alias("s"), "x", "sketch")
        drawn = large.groupBy(*REGION).agg(*(F.min(F.when(slot == i, foremost)).alias(f"p{i}") for i in range(pivots)))
        drawn = drawn.select(*REGION, F.filter(F.array(*(F.col(f"p{i}.sketch") for i in range(pivots))), lambda s: s.isNotNull()).alias("pivots"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = {c: batch.column(c).to_pylist() for c in ("ring", "sketch", "pivots", "most_n")}
                inside = []
                for ring, own, heads, n in zip(col["ring"], col["sketch"], col["pivots"], col["most_n"], strict=True):
                    away = gaps(np.stack([folded(p, ring) for p in heads]), folded(own, ring))
                    reach = (100 - threshold) * 2 * n // (100 + threshold)
                    inside.append(np.flatnonzero(within(away[:, None], reach)[:, 0]).tolist())
                kept = batch.drop_columns(["pivots", "most_n"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(inside, pa.list_(pa.int32()))], names=[*kept.schema.names, "cells"])

        near = large.join(drawn.hint("merge"), REGION)
        kept = near.drop("pivots", "most_n")
        near = stored(near.mapInArrow(run, kept.select("*", F.array().cast("array<int>").alias("cells")).schema), "cells-of-members")
        # a cell that holds the whole region parts nothing
        of_cell = near.select(*REGION, "size", F.explode("cells").alias("cell")).groupBy(*REGION, "size", "cell").agg(F.count("*").alias("m"))
        spread = of_cell.groupBy(*REGION, "size").agg(F.sum("m").alias("all"), F.max("m").alias("largest"))
        whole = spread.select(*REGION, ((F.col("largest") == F.col("size")) | (F.col("all") > SPREAD * F.col("size"))).alias("whole"))
        near = near.join(whole.hint("merge"), REGION)
        same = [c for c in members.columns if c != "path"]
        in_cells = near.where(~F.col("whole")).withColumn("cell", F.explode("cells")).select(*same, F.concat("path", F.lit("/"), F.col("cell").cast("string")).alias("path"))
        blocks = F.ceil(F.col("size") * 2.5 / most).cast("int")
        mine = F.pmod(F.xxhash64("x", F.lit(7)), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        by_two = near.where("whole").withColumn("mine", mine).withColumn("other", other)
        by_two = by_two.select(*same, F.concat_ws("-", F.concat("path", F.lit("/b")), F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string")).alias("path"))
        done = stored(by_two if done is None else done.unionByName(by_two), "blocks")
        members = stored(small.unionByName(in_cells.select(*small.columns)), "regions")
        done = done.select(*members.columns)


def compared(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """a, b: the pairs (x, y) whose texts link, by the shingles of the texts themselves. texts: x, text.

    Pairs are grouped by y, whose text is sent once for every SALT of its pairs.
    """

    def shingles(text: str) -> set[tuple]:
        w = text.encode().translate(_LOWER).split()
        return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, set()
        for batch in batches:
            a, b = [], []
            for y, salt, x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if x is None:
                    head, own = (y, salt), shingles(text.as_py())
                    continue
                if head != (y, salt):
                    raise RuntimeError("a pair came without its text")
                theirs = shingles(text.as_py())
                both = len(own & theirs)
                if both and 100 * both >= threshold * (len(own) + len(theirs) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        own.clear()
        tidy()

    many = pairs.groupBy("y").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    dealt = stored(pairs.join(many.hint("merge"), "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt")), "pairs")
    rows = dealt.join(texts.hint("merge"), "x").select("y", "salt", "x", "text")
    heads = dealt.select("y", "salt").distinct().join(texts.withColumnRenamed("x", "y").hint("merge"), "y").select("y", "salt", F.lit(None).cast("long").alias("x"), "text")
    sent = rows.unionByName(heads).repartition("y", "salt").sortWithinPartitions("y", "salt", F.col("x").asc_nulls_first())
    return sent.mapInArrow(run, "a bigint, b bigint")


def texts_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """x, text of the classes wanted (x, rep, a, b). Rows that repeat an id are told apart by the digest of their set."""
    ids = stored(wanted.select(F.col("rep").alias("doc_id")).distinct(), "compared-ids")
    found = only_ids(docs.select("doc_id", "text"), ids, "doc_id", ids.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            two = [digests(s) for s in shingle_keys(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in two], pa.int64()), pa.array([x for _, x in two], pa.int64()), batch.column(1).cast(pa.string())], names=["rep", "a", "b", "text"])

    found = found.mapInArrow(run, "rep bigint, a bigint, b bigint, text string")
    return stored(found.join(wanted.hint("merge"), ["rep", "a", "b"]).groupBy("x").agg(F.first("text").alias("text")), "compared-texts")


def join_classes(
    docs: DataFrame, classes: DataFrame, profile: DataFrame, k: int, threshold: int, extra: int = EXTRA, leaf: int = LEAF, pivots: int = PIVOTS, task_members: int = TASK_MEMBERS, first_pairs: int = PAIRS
) -> DataFrame:
    """Links (a, b) between classes (x, rep, n, a, b): every link is real, and the components are those of all links."""
    root = profile.join(classes.select(F.col("x").alias("row")).hint("merge"), "row", "left_semi").select(F.col("row").alias("x"), F.explode("root").alias("key"))
    regions = close_pairs(root, classes.select("x", "n"), extra)
    found = stored(distinct_regions(rings(regions, threshold)), "distinct-regions")
    score = found.groupBy("x").agg(F.sum("size").alias("score"))
    sketches = profile.select(F.col("row").alias("x"), "n", "sketch")
    info = stored(sketches.join(score.hint("merge"), "x"), "sketches")
    texts = texts_of(docs, classes.join(score.select("x").hint("merge"), "x", "left_semi").select("x", "rep", "a", "b"), k)
    own = found.groupBy("x", "ring").agg(F.sort_array(F.collect_list("key")).alias("own"))
    members = found.select(*REGION, "x").join(own.hint("merge"), ["x", "ring"]).join(info.hint("merge"), "x")
    members = parted(members, threshold, task_members, pivots)
    members = stored(members.withColumn("comp", F.col("x")), "members")
    discard(regions, found)
    links, budget = docs.sparkSession.createDataFrame(pa.table({k: pa.array([], pa.int64()) for k in "ab"})), first_pairs
    while True:
        sent = stored(region_pairs(members, threshold, budget, leaf, pivots), "candidates")
        if sent.isEmpty():
            return links
        links = stored(links.unionByName(compared(sent.select("x", "y").distinct(), texts, k, threshold)), "links-so-far")
        open_regions = sent.where(~F.col("done")).select(*REGION).distinct()
        if open_regions.isEmpty():
            return links
        comp = components(links).withColumnRenamed("node", "x")
        rest = members.drop("comp").join(open_regions.hint("merge"), REGION, "left_semi").join(comp.hint("merge"), "x", "left").withColumn("comp", F.coalesce("component", "x")).drop("component")
        mixed = rest.groupBy(*REGION).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(*REGION)
        before, members = members, stored(rest.join(mixed.hint("merge"), REGION, "left_semi"), "members")
        discard(before, sent)
        budget *= PAIRS_GROWTH


def similar_groups(docs: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id that links lead to, itself included).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds distinct k-word shingles; fewer words are one
    shingle. A null or empty text has none and links with nothing. A row without an id keeps a null component. Rows that
    repeat an id are documents of their own, of equal text or not. Very long texts are taken whole. Other columns aren't
    used, whatever their names; an empty table gives an empty result. with_key adds text_key, which with doc_id names a row.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = stored(profiles(docs, k, threshold, how.get("extra", EXTRA)), "profiles")
    classes = profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min(F.struct("doc_id", "row")).alias("r"), F.first("n").alias("n"))
    classes = stored(classes.select(F.col("r.row").alias("x"), F.col("r.doc_id").alias("rep"), "n", "a", "b"), "classes")
    comp = components(join_classes(docs, classes, profile, k, threshold, **how)).withColumnRenamed("node", "x")
    named = classes.select("x", "rep", "a", "b").join(comp.hint("merge"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(least.hint("merge"), "component").select("a", "b", "component_id"), "components")
    out = profile.select("doc_id", "text_key", "n", "a", "b").join(named.hint("merge"), ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *(["text_key"] if with_key else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose id isn't the least of their component; all columns stay.

    Rows are told apart by id and text. Rows with the least id of a component all stay, also where they repeat it; rows
    without an id stay.
    """
    found = similar_groups(docs, id_col=id_col, text_col=text_col, with_key=True, **how)
    return without_rows(docs, found.where("doc_id <> component_id").select("doc_id", "text_key"), id_col, text_col)

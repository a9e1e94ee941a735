"""WARC fixity audit with Merkle trees.

Records of an archive are leaves in slots of their file; a node hashes the digests of up to FANOUT consecutive children
and the ranges of offsets that they cover, counted from its own first offset. So a lost record changes the nodes above it
and none beside them, and padding shows in the node whose children it moves apart. Two replicas are compared root by
root, and only below nodes that differ are children compared, level by level, down to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import stored

#: Slots of an archive file and children of a node; the file's tree has LEVELS levels above the records.
FILE_SLOTS, FANOUT, LEVELS = 4096, 16, 3


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC 1.0 response record. Null columns count as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, id_col: str = "page_id", record_col: str = "record", file_slots: int = FILE_SLOTS, offset_col: str | None = None) -> DataFrame:
    """Leaves: file, slot, offset, length and digest (sha256) of each record, in order of id within a file.

    offset_col holds the offsets where the archive has them; else records lie end to end.

    Ids are dealt to files by range, so a file has file_slots slots, and a lost record leaves its slot empty. Rows
    without an id have no slot and are left out; of rows with one id the least record stands for all. Null records are
    empty.
    """
    record = F.coalesce(F.col(record_col), F.lit(""))
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"), (F.col(offset_col) if offset_col else F.lit(None)).cast("long").alias("given"))
    rows = rows.groupBy("id").agg(F.min(F.struct("digest", "length", "given")).alias("r")).select("id", "r.*")
    placed = rows.select(F.floor(F.col("id") / file_slots).alias("file"), F.pmod(F.col("id"), F.lit(file_slots)).alias("slot"), "length", "digest", "given")
    if offset_col:
        return placed.select("file", "slot", F.coalesce("given", F.lit(0)).alias("offset"), "length", "digest")
    before = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select("file", "slot", before.alias("offset"), "length", "digest")


def tree(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes by level, leaves first: file, node, first (offset), last (end offset), digest of the ordered children and ranges.

    Levels above the leaves are stored, so a comparison reads them and computes nothing again.
    """
    out = [leaves.select("file", F.col("slot").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), "digest")]
    for _ in range(levels):
        up = out[-1].withColumn("up", F.floor(F.col("node") / fanout)).groupBy("file", F.col("up").alias("node"))
        up = up.agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("n"), F.col("first").alias("a"), F.col("last").alias("z"), "digest"))).alias("children"), F.min("first").alias("first"), F.max("last").alias("last"))
        child = lambda c: F.concat_ws(":", c["n"], c["a"] - F.col("first"), c["z"] - F.col("first"), c["digest"])
        out.append(stored(up.select("file", "node", "first", "last", F.sha2(F.array_join(F.transform("children", child), ","), 256).alias("digest")), "tree-level"))
    return out


def damaged(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """file, level (0: records), node, status: found by descending below nodes that differ.

    Records are corrupt, missing or extra in theirs. A node or record is shifted if it is intact and lies elsewhere than
    in ours, counted from the start of the node above (a root: from the start of the file).
    """
    wrong = shifted = None
    for level in range(len(ours) - 1, -1, -1):
        a, b = (x.select("file", "node", F.col("digest").alias(n), F.col("first").alias(f"{n}_first")) for x, n in ((ours[level], "a"), (theirs[level], "b")))
        if wrong is None:
            a, b = a.withColumn("a_at", F.col("a_first")), b.withColumn("b_at", F.col("b_first"))
        else:
            above = wrong.select("file", F.col("node").alias("parent"), F.col("a_first").alias("a_start"), F.col("b_first").alias("b_start"))
            a, b = (
                x.withColumn("parent", F.floor(F.col("node") / fanout)).join(above.select("file", "parent", f"{n}_start").hint("merge"), ["file", "parent"])
                .withColumn(f"{n}_at", F.col(f"{n}_first") - F.col(f"{n}_start")).drop("parent", f"{n}_start")
                for x, n in ((a, "a"), (b, "b"))
            )
        both = a.join(b.hint("merge"), ["file", "node"], "full")
        found = stored(both.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("a_at") != F.col("b_at"))), "differing-nodes")
        wrong = found.where(~F.col("a").eqNullSafe(F.col("b")))
        moved = found.where("a = b").select("file", F.lit(level).alias("level"), "node", F.lit("shifted").alias("status"))
        shifted = moved if shifted is None else shifted.unionByName(moved)
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return wrong.select("file", F.lit(0).alias("level"), "node", status.alias("status")).unionByName(shifted)


def audit(records: DataFrame, replica: DataFrame, id_col: str = "page_id", record_col: str = "record", file_slots: int = FILE_SLOTS, fanout: int = FANOUT) -> DataFrame:
    """One row per record of either replica: id, file, offset, length, digest, status (ok, corrupt, missing or extra).

    Offset, length and digest are those of records, null for extra ones. An intact record that others have moved is ok;
    damaged() tells what is shifted. Two empty tables give an empty result.
    """
    levels = 1
    while fanout**levels < file_slots:
        levels += 1
    ours, theirs = (stored(manifest(r, id_col, record_col, file_slots), "manifest") for r in (records, replica))
    wrong = damaged(tree(ours, fanout, levels), tree(theirs, fanout, levels), fanout)
    wrong = wrong.where("status <> 'shifted'").select("file", F.col("node").alias("slot"), "status")
    out = ours.join(wrong.hint("merge"), ["file", "slot"], "full")
    return out.select((F.col("file") * file_slots + F.col("slot")).alias("id"), "file", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))

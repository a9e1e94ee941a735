"""Writers: tables and documents by match, run summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of a run, in order, by mode.
ARTIFACTS = {
    "normal": ("ffprobe_meta.json", "detections.jsonl", "tracks.json", "camera_path.json", "foi_meta.json"),
    "no_detect": ("camera_path.json",),
}


def write_detections(df: DataFrame, path: str, form: str = "json") -> None:
    """A directory per match; rows in order of frame."""
    df.repartition("match_id").sortWithinPartitions("match_id", "frame").write.partitionBy("match_id").format(form).save(path)


def write_documents(df: DataFrame, path: str, value: str = "document") -> None:
    """One JSON document per match."""
    df.select("match_id", value).write.partitionBy("match_id").text(path)


def documents_of(df: DataFrame, key: str = "match_id", order: str = "frame") -> DataFrame:
    """match_id, document: the rows of a match as a JSON array in order."""
    fields = [order, *(c for c in df.columns if c not in (key, order))]
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("document"))


def write_arrays(df: DataFrame, path: str, key: str = "match_id", order: str = "frame", per_file: int = 100_000) -> None:
    """path/match_id=.../block=.../: the rows of a match, one for each value of order, as a JSON array, an element a line.

    A file holds per_file values of order at most and is written by one task, so a long match takes several; its files one
    after another are the array. readers.read_arrays() reads the lines, each on its own.
    """
    ends = df.groupBy(key).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    element = F.to_json(F.struct(order, *(c for c in df.columns if c not in (key, order))))
    line = F.concat(F.when(F.col(order) == F.col("__lo"), "[").otherwise(""), element, F.when(F.col(order) == F.col("__hi"), "]").otherwise(","))
    block = F.format_string("%09d", F.floor(F.col(order) / per_file))
    rows = df.join(ends.hint("merge"), key).select(key, block.alias("block"), order, line.alias("value"))
    rows.repartition(key, "block").sortWithinPartitions(key, "block", order).drop(order).write.partitionBy(key, "block").text(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """path/match_id=.../part-*.json: one document a match (match_id and the document's fields); readers.read_manifests() reads them."""
    manifests.write.partitionBy("match_id").json(path)


def artifact_plan(matches: DataFrame, files: Mapping[str, tuple[str, ...]] = ARTIFACTS) -> DataFrame:
    """match_id, mode, seq, file that a run in this mode leaves; unknown modes leave none."""
    lists = F.create_map(*(x for mode, names in files.items() for x in (F.lit(mode), F.array(*map(F.lit, names)))))
    return matches.select("match_id", "mode", F.posexplode(F.try_element_at(lists, F.col("mode"))).alias("seq", "file"))


def run_summary(matches: DataFrame, artifacts: DataFrame, config_json: str = "{}") -> DataFrame:
    """One row per match for the runs table: number and list of artifacts, configuration."""
    held = artifacts.groupBy("match_id").agg(F.count("*").alias("n_artifacts"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "file"))), lambda a: a["file"]).alias("artifacts"))
    return matches.join(held.hint("merge"), "match_id", "left").withColumn("config_json", F.lit(config_json)).withColumn("n_artifacts", F.coalesce("n_artifacts", F.lit(0)))


def overwrite_matches(df: DataFrame, path: str) -> None:
    """path/match_id=.../: the matches that df holds are replaced, others stay. Writing the same again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)


def write_runs(summary: DataFrame, path: str) -> None:
    """The runs table, a folder by match: a match that is run again has the later row alone."""
    overwrite_matches(summary, path)

"""File names, fingerprints and job ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_file(frame: Column) -> Column:
    return F.format_string("frame_%06d.jpg", frame)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def all_suffixes(name: Column) -> Column:
    """Every suffix of a file name: '.tar.gz' of 'a.tar.gz'; none for '.x' and for a name that ends in a dot."""
    return F.when(name.endswith("."), F.lit("")).otherwise(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"^[^.]*(\..*)?$", 1))


def stem(name: Column) -> Column:
    """The name without all its suffixes."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(all_suffixes(name)))


def last_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def job_id(at: Column, name: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), stem(name))


def normalize_fingerprint(size: Column, mtime_ns: Column, ctime_ns: Column, ino: Column, dev: Column) -> Column:
    """Struct of the five; null where size or mtime is missing or negative; other parts only if above 0."""
    some = lambda c: F.when(c > 0, c)
    parts = F.struct(size.alias("size"), mtime_ns.alias("mtime_ns"), some(ctime_ns).alias("ctime_ns"), some(ino).alias("ino"), some(dev).alias("dev"))
    return F.when((size >= 0) & (mtime_ns >= 0), parts)


def fingerprint_key(fp: Column) -> Column:
    """Text of size, mtime, inode and device without what is missing; the change time is no part of it."""
    return F.concat_ws(",", *(F.concat(F.lit(f"{k}="), fp[k].cast("string")) for k in ("size", "mtime_ns", "ino", "dev")))

"""File sources: whole files with their paths and modification times, filtered before they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .code import LANGUAGES
from .ignore import ignored
from .parsers import FORMATS

# Folders that a walk never enters.
SKIPPED = ("node_modules", "dist", "build", "target", "__pycache__", "vendor")


def walk(path: Column, extensions: list[str]) -> Column:
    """Whether a walk takes a file: a known extension, no dot folder, no skipped folder above it."""
    skipped = "|".join(SKIPPED)
    return path.rlike(rf"(?i)\.({'|'.join(extensions)})$") & ~path.rlike(rf"(^|/)(\.[^/]+|{skipped})/") & ~path.rlike(r"(^|/)\.[^/]+$")


def read_files(spark: SparkSession, root: str, extensions: list[str], rules: list[str] | None = None, since: str | None = None, max_bytes: int | None = None, limit: int | None = None) -> DataFrame:
    """(path, content, modified, size) below a folder, with paths relative to it.

    Paths, sizes and times are filtered on the file listing, before contents are read.  ``since`` is
    a high-water mark: files not modified more than a second after it are skipped.  ``max_bytes``
    skips longer files and ``limit`` caps the walk; both are off by default.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(root)
    base = root.rstrip("/").split("://")[-1].split("/", 1)[-1] if "://" in root else root.rstrip("/")
    relative = F.regexp_replace("path", rf"^.*?\Q{base}\E/", "")
    files = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    chosen = files.withColumn("relative", relative).filter(walk(F.col("relative"), extensions))
    if rules:
        chosen = chosen.filter(~ignored(F.col("relative"), rules))
    if since is not None:
        chosen = chosen.filter(F.col("modificationTime") > F.lit(since).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1)))
    out = chosen.select(F.col("relative").alias("path"), F.decode("content", "utf-8").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return out if limit is None else out.limit(limit)


def read_code(spark: SparkSession, root: str, **options) -> DataFrame:
    return read_files(spark, root, list(LANGUAGES), **options)


def read_docs(spark: SparkSession, root: str, **options) -> DataFrame:
    return read_files(spark, root, list(FORMATS), **options)


def needs_fallback(symbols: DataFrame, files: DataFrame, builtin: bool) -> bool:
    """An external index that found nothing although there are sources gives way to the built-in rules."""
    return not builtin and symbols.isEmpty() and not files.isEmpty()

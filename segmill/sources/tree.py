"""Directory trees: walks in a fixed order, file contents, plain listings."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES = 20_000
INVENTORY = "walk_idx long, path string, size long, extension string, is_link boolean"


def walk(root: str | Path, most: int = MOST_FILES) -> tuple[list[tuple], list[str]]:
    """``(inventory rows, warnings)`` of a tree: a directory's files before its subdirectories, by folded name.

    Links to directories aren't followed, files whose facts can't be read are left out, both with a
    warning; so is everything beyond ``most`` files.
    """
    if most < 1:
        raise ValueError("scan bounds must be positive")
    base = Path(root).resolve(strict=True)
    rows: list[tuple] = []
    warnings: list[str] = []
    open_ = [base]
    while open_:
        here = open_.pop()
        entries = sorted(os.scandir(here), key=lambda e: e.name.casefold())
        below = []
        for e in entries:
            rel = Path(e.path).relative_to(base).as_posix()
            if e.is_dir(follow_symlinks=True):
                if e.is_symlink():
                    warnings.append(f"directory link not followed: {rel}")
                else:
                    below.append(Path(e.path))
                continue
            if len(rows) >= most:
                return rows, [*warnings, f"stopped at {most} files"]
            try:
                size = e.stat(follow_symlinks=False).st_size
            except OSError as error:
                warnings.append(f"unreadable: {rel}: {type(error).__name__}")
                continue
            rows.append((len(rows), rel, size, Path(e.name).suffix.casefold(), e.is_symlink()))
        open_ += reversed(below)
    return rows, warnings


def inventory(spark: SparkSession, root: str | Path, most: int = MOST_FILES) -> tuple[DataFrame, list[str]]:
    """The walk as a table, and its warnings."""
    rows, warnings = walk(root, most)
    return spark.createDataFrame(rows, INVENTORY), warnings


def contents(spark: SparkSession, root: str | Path, pattern: str | None = None) -> DataFrame:
    """``(path, content, length)`` of all files below a root, paths relative to it.

    Read by the distributed binary reader: what isn't selected isn't read, and predicates on ``length``
    reach the scan. A file as root is relative to its folder.
    """
    base = Path(root).resolve(strict=True)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    top = (base if base.is_dir() else base.parent).as_posix()
    raw = reader.load(base.as_posix())
    rel = F.regexp_replace(F.url_decode(F.replace(raw["path"], F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    return raw.select(F.substring(rel, len(top) + 2, 1 << 20).alias("path"), "content", "length")


def heads(files: DataFrame, root: str | Path, size: int) -> DataFrame:
    """``files`` with ``content``, the first ``size`` bytes of each file below a root; nothing more of a file is read."""
    base = Path(root).resolve(strict=True)

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        def one(path: str) -> bytes:
            with open(base / path, "rb") as file:
                return file.read(size)

        return paths.map(one)

    return files.withColumn("content", read("path"))


def files_with_inventory(spark: SparkSession, root: str | Path, most: int = MOST_FILES) -> DataFrame:
    """``(path, content, length, extension, is_link, walk_idx)``."""
    facts, _ = inventory(spark, root, most)
    return contents(spark, root).join(F.broadcast(facts.select("path", "extension", "is_link", "walk_idx")), "path")  # at most `most` rows


def relative_files(files: DataFrame) -> DataFrame:
    """``(path)`` in code-point order."""
    return files.select("path").orderBy("path")

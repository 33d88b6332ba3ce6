"""Source files of a repository as a table: a directory that driver and executors see, or rows of a table.

A directory is read by the data source of sources.datasource (Spark's own readers drop names that begin with '_' or '.').
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .datasource import read_tree
from .tables import materialize

# Directories and suffixes that are not indexed.
EXCLUDED_DIRS = ".git __pycache__ .mypy_cache .pytest_cache .tox .nox .venv venv env ENV .env dist build node_modules site-packages .eggs".split()
EXCLUDED_DIR_SUFFIX = ".egg-info"
EXCLUDED_SUFFIXES = (".pyc", ".pyo", ".pyd")


def is_excluded_dir(name: str) -> bool:
    return name in EXCLUDED_DIRS or name.endswith(EXCLUDED_DIR_SUFFIX)


def indexable(file: Column) -> Column:
    """Whether a relative path would be indexed."""
    parts = F.split(file, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(dirs, lambda d: d.isin(EXCLUDED_DIRS) | d.endswith(EXCLUDED_DIR_SUFFIX))
    return file.endswith(".py") & ~bad


def discover(root: str | os.PathLike) -> list[str]:
    """Relative paths of the files to index, in the order of their components."""
    root, found = Path(root), []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not is_excluded_dir(d)]
        found += [Path(folder, n).relative_to(root) for n in names if n.endswith(".py") and not n.endswith(EXCLUDED_SUFFIXES)]
    return [p.as_posix() for p in sorted(found)]


def scan_repository(spark: SparkSession, repository_id: str, root: str | os.PathLike, encoding: str = "utf-8") -> DataFrame:
    """(repository_id, file, file_ord, source, read_error) of a directory; a file that can't be read has a read_error."""
    root = Path(root).resolve()
    if not root.is_dir():
        raise ValueError(f"Not a directory: {root}")
    rows = read_tree(spark, root, encoding=encoding).select(F.lit(repository_id).alias("repository_id"), "file", "source", "read_error")
    return number_files(materialize(rows, "files"))


def number_files(rows: DataFrame) -> DataFrame:
    """rows: repository_id, file, source, read_error. With file_ord, the place among the files of the repository by the components of
    their paths. Only names are sorted; texts meet their numbers in one shuffle."""
    order = Window.partitionBy("repository_id").orderBy(F.split("file", "/"))
    numbers = rows.select("repository_id", "file").distinct().select("repository_id", "file", (F.row_number().over(order) - 1).alias("file_ord"))
    return rows.join(numbers, ["repository_id", "file"]).select("repository_id", "file", "file_ord", "source", "read_error")


def files_from_table(rows: DataFrame, repository_col: str = "repository_id", file_col: str = "file", source_col: str = "source") -> DataFrame:
    """The same relation from a table of files: the way in for corpora that are no directory."""
    out = rows.select(F.col(repository_col).alias("repository_id"), F.col(file_col).alias("file"), F.col(source_col).alias("source")).where(indexable(F.col("file")))
    return number_files(out.withColumn("read_error", F.lit(None).cast("string")))

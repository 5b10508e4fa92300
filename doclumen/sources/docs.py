"""The two documentation corpora: one row per file, never joined into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_README = ["README.md", "README.rst", "README.txt", "readme.md"]


def is_coverage_doc(path: Column) -> Column:
    """README, ``docs/**`` text files, and package sources outside tests.

    The first condition says less than the second, in a form file formats prune by.
    """
    candidate = (
        path.isin(_README)
        | F.startswith(path, F.lit("docs/"))
        | F.endswith(path, F.lit("__init__.py"))
    )
    text = path.rlike(
        r"^(?:README\.(?:md|rst|txt)|readme\.md|docs/(?:.*/)?[^/]+\.(?:md|rst|txt))$"
    )
    package = (
        path.rlike(r"(?:^|/)__init__\.py$")
        & ~F.contains(path, F.lit(".venv"))
        & ~F.contains(F.lower(path), F.lit("test"))
    )
    return candidate & (text | package)


def is_explain_doc(path: Column) -> Column:
    """``README.md`` and Markdown below the documentation directories."""
    candidate = F.startswith(path, F.lit("doc")) | (path == "README.md")
    text = path.rlike(r"^(?:README\.md|(?:docs|doc|documentation)/(?:.*/)?[^/]*\.md)$")
    archived = F.contains(path, F.lit("_archive")) | F.contains(path, F.lit("node_modules"))
    return candidate & text & ~archived


def coverage_docs(files: DataFrame) -> DataFrame:
    """``project, path, text`` with lower-case text; the path filter reaches the scan."""
    return files.where(is_coverage_doc(F.col("path"))).select(
        "project", "path", F.lower("content").alias("text")
    )


def explain_docs(files: DataFrame) -> DataFrame:
    return files.where(is_explain_doc(F.col("path"))).select("project", "path", "content")

"""Sections of a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sections(content: Column) -> Column:
    """``array<struct<header, body, has_body>>`` of the parts that start with ``#``.

    The text is cut before every line that starts with ``#``; what precedes the
    first is no section, nor is a header without a line of its own below it.
    """
    # With a newline added at the end, every piece ends its last line, so the last
    # one needs no case of its own.
    pieces = F.split(F.concat(content, F.lit("\n")), r"(?md)(?=^#)", -1)

    def section(piece: Column) -> Column:
        header = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(header) + 2)
        return F.struct(
            header.alias("header"),
            F.substr(body, F.lit(1), F.length(body) - 1).alias("body"),
            (body != "").alias("has_body"),
        )

    found = F.transform(F.filter(pieces, lambda p: F.startswith(p, F.lit("#"))), section)
    return F.filter(found, lambda s: s["has_body"])

"""Names, labels and the forms under which a term may be mentioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kebab(name: Column) -> Column:
    return F.translate(name, "_", "-")


def term_forms(term: Column) -> Column:
    """Distinct lower-case spellings, any of which counts as a mention."""
    low = F.lower(term)
    return F.array_distinct(
        F.array(
            low,
            F.translate(low, "-_", "  "),
            F.translate(low, "-", "_"),
            F.translate(low, "_", "-"),
        )
    )


def endpoint_label(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, path)

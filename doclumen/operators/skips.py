"""Which paths each extractor leaves out.

Paths are relative to the project.  ``root_prefix`` puts an absolute prefix back
in front, for results equal to a scan that tested absolute paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclumen import fixed_values as fv


def _contains_any(path: Column, fragments: list[str]) -> Column:
    return path.rlike("|".join(re.escape(fragment) for fragment in fragments))


def _full(path: Column, root_prefix: str) -> Column:
    return F.concat(F.lit(root_prefix), path) if root_prefix else path


def skips_cli(path: Column, root_prefix: str = "") -> Column:
    return _contains_any(_full(path, root_prefix), fv.CLI_SKIP_FRAGMENTS)


def skips_api(path: Column, root_prefix: str = "") -> Column:
    return _contains_any(_full(path, root_prefix), fv.API_SKIP_FRAGMENTS)


def skips_config(path: Column, root_prefix: str = "") -> Column:
    return _contains_any(_full(path, root_prefix), fv.CONFIG_SKIP_FRAGMENTS)


def skips_symbols(path: Column, root_prefix: str = "") -> Column:
    parts = F.split(_full(path, root_prefix), "/")
    name = F.element_at(parts, -1)
    return (
        F.arrays_overlap(parts, F.array(*[F.lit(p) for p in fv.SYMBOL_SKIP_PARTS]))
        | F.startswith(name, F.lit("test_"))
        | F.endswith(name, F.lit("_test.py"))
        | F.startswith(name, F.lit("conftest"))
    )


def is_python(path: Column) -> Column:
    return F.endswith(path, F.lit(".py"))

"""Classes and module-level functions, read from the syntax tree.

Spark has no Python parser, so this is the one extraction that runs in Python:
an Arrow pass over the files of the package, whose output no longer carries
their content.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclumen import fixed_values as fv
from doclumen.functions.matching import pattern
from doclumen.operators import skips
from doclumen.runtime import broadcast_if_small, materialize
from doclumen.sources.packages import package_dirs

#: Symbols in an Arrow batch, more by those of one file at most.
BATCH = 1_000

_PARSED = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("is_public", T.BooleanType()),
        T.StructField("pos", T.IntegerType()),
    ]
)
_PARSED_ARROW = pa.schema(
    [
        ("project", pa.string()),
        ("name", pa.string()),
        ("type", pa.string()),
        ("path", pa.string()),
        ("line", pa.int32()),
        ("docstring", pa.string()),
        ("is_public", pa.bool_()),
        ("pos", pa.int32()),
    ]
)


def _symbols_of(content: str) -> Iterator[tuple[str, str, int, str, int]]:
    """``name, type, line, docstring, position`` in breadth-first order."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for pos, node in enumerate(ast.walk(tree)):
        match node:
            case ast.ClassDef():
                kind = "class"
            case ast.FunctionDef(col_offset=0):
                kind = "function"
            case _:
                continue
        if node.name[0] != "_":
            yield node.name, kind, node.lineno, ast.get_docstring(node) or "", pos


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols of ``project, path, content, exports``, of which one file at a time is a Python string."""
    for batch in batches:
        found = []
        for project, path, content, exported in zip(*batch.columns):
            exports = exported.as_py()
            for name, kind, line, docstring, pos in _symbols_of(content.as_py()):
                found.append(
                    {
                        "project": project.as_py(),
                        "name": name,
                        "type": kind,
                        "path": path.as_py(),
                        "line": line,
                        "docstring": docstring,
                        "is_public": not exports or name in exports,
                        "pos": pos,
                    }
                )
            if len(found) >= BATCH:
                yield pa.RecordBatch.from_pylist(found, schema=_PARSED_ARROW)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_PARSED_ARROW)


def symbols(
    files: DataFrame, root_prefix: str = "", packages: DataFrame | None = None
) -> DataFrame:
    """Symbols of each project's package, with docstring and visibility.

    The package directories are one small row per project.  If they measure small they
    are broadcast, else both sides are shuffled by project (adaptive execution splits a large
    one): moving a file costs far less than parsing it, so at any number of projects
    nothing outside the packages is parsed.  Give ``packages`` where ``files`` are not all of
    the projects' files.
    """
    in_package = F.startswith("path", F.concat("package_dir", F.lit("/")))
    exports = F.regexp_extract_all(
        F.regexp_extract("content", pattern(fv.EXPORT_LIST), 1),
        F.lit(pattern(fv.QUOTED_WORD)),
        F.lit(1),
    )
    candidates = files.where(
        skips.is_python(F.col("path")) & ~skips.skips_symbols(F.col("path"), root_prefix)
    )
    if packages is None:
        packages = materialize(package_dirs(files).select("project", "package_dir"))
    inside = candidates.join(broadcast_if_small(packages), "project").where(in_package)
    return inside.select("project", "path", "content", exports.alias("exports")).mapInArrow(_parse, _PARSED)


def public_symbols(found: DataFrame, kind: str | None = None) -> DataFrame:
    found = found.where("is_public")
    return found if kind is None else found.where(F.col("type") == kind)


def key_classes(found: DataFrame, limit: int = fv.KEY_CLASSES) -> DataFrame:
    """The classes most worth documenting: with a docstring first, longest names first.

    ``row_number() <= limit`` becomes a group limit before the shuffle, so a
    project's classes are cut to ``limit`` rows in every task already.
    """
    order = Window.partitionBy("project").orderBy(
        F.desc(F.col("docstring") != ""), F.desc(F.length("name")), "path", "pos"
    )
    return (
        public_symbols(found, "class")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )

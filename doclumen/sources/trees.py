"""Project trees on a shared file system as a data source: ``project, path, content``.

``spark.read.format("project_files").option("roots", json)`` reads every text file below
the given roots, contents as bytes.  Spark's own file sources hide names that start with ``_`` or
``.``, which would lose ``__init__.py``.

The driver plans partitions and opens no file: small roots are dealt to partitions
as they are, large ones are opened up, the largest first, until their directories are as
many as their share of the partitions; the files of a directory with very many are
parted by a hash of their names.  Filters on project and path are taken over from the query, so
files that it does not want are never opened.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

#: File name endings that any operator reads.
SUFFIXES = (".py", ".md", ".rst", ".txt", ".toml")
#: Entries of a root, or files of a directory, from which it is more than one unit of work.
LARGE = 20_000
#: Bytes and files that are sent to Spark together.
BATCH_BYTES = 8 << 20
BATCH_FILES = 1024

_ARROW = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.binary())])


@dataclass(frozen=True)
class Unit:
    """A directory below a root: all of it, or of its own files the share ``slice`` of ``slices``."""

    project: str
    root: str
    path: str = ""
    whole: bool = True
    slice: int = 0
    slices: int = 1


@dataclass
class Units(InputPartition):
    units: list[Unit] = field(default_factory=list)


def entries(folder: str) -> Iterator[os.DirEntry]:
    """A directory's entries; what cannot be listed is empty."""
    try:
        with os.scandir(folder) as listing:
            yield from listing
    except OSError:
        return


def is_folder(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir(follow_symlinks=False)
    except OSError:
        return False


def count_entries(root: str) -> int:
    """Entries below a root, counted no further than ``LARGE``."""
    seen, todo = 0, deque([root])
    while todo and seen < LARGE:
        for entry in entries(todo.popleft()):
            seen += 1
            if is_folder(entry):
                todo.append(entry.path)
            if seen >= LARGE:
                break
    return seen


def opened_up(unit: Unit, wanted: int) -> list[Unit]:
    """A large directory as some ``wanted`` units or more: broadest level first."""
    todo, flat = deque([unit]), []
    while todo and len(todo) + len(flat) < wanted:
        now = todo.popleft()
        files = 0
        for entry in entries(os.path.join(now.root, now.path)):
            if is_folder(entry):
                todo.append(Unit(now.project, now.root, os.path.join(now.path, entry.name)))
            else:
                files += 1
        slices = -(-files // LARGE)
        flat += [Unit(now.project, now.root, now.path, False, i, slices) for i in range(slices)]
    return [*flat, *todo]


class ProjectFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots: list[list] = json.loads(options.get("roots", "[]"))
        self.wanted = int(options.get("partitions", "64"))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what it can test on project and path alone."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains))
            if known and f.attribute in (("project",), ("path",)):
                self.tests.append(f)
            else:
                yield f

    def _wants(self, **given: str) -> bool:
        """Whether the filters on the given columns let a file pass."""
        for f in self.tests:
            value = given.get(f.attribute[0])
            if value is None:
                continue
            match f:
                case EqualTo():
                    ok = value == f.value
                case In():
                    ok = value in f.value
                case StringStartsWith():
                    ok = value.startswith(f.value)
                case StringEndsWith():
                    ok = value.endswith(f.value)
                case _:
                    ok = f.value in value
            if not ok:
                return False
        return True

    def partitions(self) -> list[Units]:
        roots = [(p, r, n) for p, r, n in self.roots if self._wants(project=p)]
        parts = [Units() for _ in range(max(1, min(self.wanted, len(roots))))]
        large = [r for r in roots if r[2] >= LARGE]
        for i, (project, root, _) in enumerate(r for r in roots if r[2] < LARGE):
            parts[i % len(parts)].units.append(Unit(project, root))
        for project, root, _ in large:
            share = max(2, self.wanted // len(large))
            parts += [Units([u]) for u in opened_up(Unit(project, root), share)]
        return [p for p in parts if p.units] or [Units()]

    def _files(self, unit: Unit) -> Iterator[str]:
        todo = deque([unit.path])
        while todo:
            path = todo.popleft()
            for entry in entries(os.path.join(unit.root, path)):
                inside = os.path.join(path, entry.name)
                if is_folder(entry):
                    if unit.whole:
                        todo.append(inside)
                elif entry.name.endswith(SUFFIXES) and zlib.crc32(os.fsencode(entry.name)) % unit.slices == unit.slice:
                    if self._wants(project=unit.project, path=inside):
                        yield inside

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for unit in partition.units:
            for path in self._files(unit):
                # A dangling link, or a file removed meanwhile, costs only itself.
                try:
                    with open(os.path.join(unit.root, path), "rb") as handle:
                        content = handle.read()
                except OSError:
                    continue
                rows.append({"project": unit.project, "path": path, "content": content})
                size += len(content)
                if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class ProjectFiles(DataSource):
    """Options: ``roots``, a JSON list of ``[project, root, entries]``, and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return "project string, path string, content binary"

    def reader(self, schema) -> ProjectFilesReader:
        return ProjectFilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters be handed to Python sources."""
    spark.dataSource.register(ProjectFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

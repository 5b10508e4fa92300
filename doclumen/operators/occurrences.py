"""Which of a project's patterns occur in its documents.

Substring containment has no equi-join key finer than the project, and testing
every (pattern, document) pair costs the product of the two.  Each document is
therefore read once against all patterns of its project together, with a
multi-pattern automaton inside an Arrow pass; only the occurrences come out.

Three plans give the same rows:

* the patterns' count and bytes are checked first; if they are small they are
  broadcast and the documents stay where they were scanned, without a shuffle;
* beyond that, mentions are looked up by windows of the texts that a filter lets pass and that are joined
  to the patterns (:mod:`doclumen.operators.windows`), and scores by sending the patterns that such windows find in a
  part of the documents to that part, landed in buckets (:mod:`doclumen.operators.colocated`), which stay there for
  further searches;
* mentions alone can be looked up by the documents' signatures
  (:mod:`doclumen.operators.signatures`), so that most documents are not read at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclumen import fixed_values as fv
from doclumen.operators import colocated, windows
from doclumen.operators.colocated import ColocatedDocs
from doclumen.runtime import materialize

#: Largest pattern table that is broadcast.
BROADCAST_PATTERNS = 200_000
BROADCAST_CHARS = 16_000_000
#: Most patterns one automaton holds where patterns are not broadcast (about 200 MB).
PATTERNS_PER_CHUNK = 1_000_000
#: Patterns of one or two characters that are looked up one by one; a text's pairs of
#: characters are listed for more.
FEW_SHORT = 16

_MENTION = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("pattern", T.StringType()),
    ]
)
_MENTION_ARROW = pa.schema([("project", pa.string()), ("pattern", pa.string())])
_SCORED = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField(
            "hits",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("pattern", T.StringType()),
                        T.StructField("tenths", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)
_SCORED_ARROW = pa.schema(
    [
        ("project", pa.string()),
        ("path", pa.string()),
        ("hits", pa.list_(pa.struct([("pattern", pa.string()), ("tenths", pa.int32())]))),
    ]
)

_FOUND = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ]
)
_FOUND_ARROW = pa.schema([("project", pa.string()), ("path", pa.string()), ("patterns", pa.list_(pa.string()))])


def _finder(patterns: list[str]) -> Callable[[str], set[str]]:
    """A function giving the patterns that occur in a text.

    Patterns of one or two characters would match at almost every position of the
    automaton, so they are looked up apart from it.
    """
    import ahocorasick

    short = {p for p in patterns if len(p) < 3}
    automaton = ahocorasick.Automaton()
    for p in patterns:
        if len(p) >= 3:
            automaton.add_word(p, p)
    automaton.make_automaton()

    def find(text: str) -> set[str]:
        found = {p for _, p in automaton.iter(text)} if len(automaton) else set()
        if len(short) <= FEW_SHORT:
            found.update(p for p in short if p in text)
        else:
            found |= short & {"", *text, *map("".join, zip(text, text[1:]))}
        return found

    return find


def _found(project: str, path: str, text: str, find, seen: set) -> list[dict]:
    hits = sorted(find(text))
    return [{"project": project, "path": path, "patterns": hits}] if hits else []


def _new_mentions(project: str, path: str, text: str, find, seen: set) -> list[dict]:
    new = [p for p in find(text) if (project, p) not in seen]
    seen.update((project, p) for p in new)
    return [{"project": project, "pattern": p} for p in new]


def _scores(project: str, path: str, text: str, find, seen: set) -> list[dict]:
    hits = []
    for p in sorted(find(text)):
        tenths = min(text.count(p), fv.COUNT_CAP)
        if f"# {p}" in text:
            tenths += fv.HEADING_TENTHS
        hits.append({"pattern": p, "tenths": tenths})
    return [{"project": project, "path": path, "hits": hits}] if hits else []


def _by_broadcast(patterns: DataFrame, docs: DataFrame, emit, arrow, schema) -> DataFrame:
    by_project: dict[str, list[str]] = {}
    for row in patterns.collect():  # size checked by the caller
        by_project.setdefault(row["project"], []).append(row["pattern"])
    shared = docs.sparkSession.sparkContext.broadcast(by_project)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict[str, Callable] = {}
        seen: set = set()
        for batch in batches:
            rows: list[dict] = []
            for named, path, text in zip(*batch.columns):  # one text at a time as a Python string
                project = named.as_py()
                if project not in shared.value:
                    continue
                if project not in finders:
                    finders[project] = _finder(shared.value[project])
                rows += emit(project, path.as_py(), text.as_py(), finders[project], seen)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select("project", "path", "text").mapInArrow(scan, schema)


def _by_buckets(patterns: DataFrame, landed: ColocatedDocs, emit, arrow, schema) -> DataFrame:
    chunk = PATTERNS_PER_CHUNK

    def scan(project: str, wanted: list[str], docs: pa.Table) -> list[dict]:
        rows: list[dict] = []
        seen: set = set()
        for first in range(0, len(wanted), chunk):
            find = _finder(wanted[first : first + chunk])
            for path, text in zip(docs.column("path"), docs.column("text")):
                rows += emit(project, path.as_py(), text.as_py(), find, seen)
        return rows

    return colocated.search(windows.occurring(patterns, landed), landed, scan, arrow, schema)


def are_small(patterns: DataFrame) -> bool:
    """Whether ``patterns(project, pattern)`` may be broadcast."""
    count, chars = patterns.agg(
        F.count("*"), F.sum(F.length("pattern") + F.length("project"))
    ).first()
    return count <= BROADCAST_PATTERNS and (chars or 0) <= BROADCAST_CHARS


def _occurrences(
    patterns: DataFrame,
    docs: DataFrame | ColocatedDocs,
    emit,
    arrow,
    schema,
    join_chunks=lambda df: df,
) -> DataFrame:
    patterns = materialize(patterns.select("project", "pattern").distinct())
    there = docs.docs if isinstance(docs, ColocatedDocs) else docs
    if are_small(patterns):
        return _by_broadcast(patterns, there, emit, arrow, schema)
    landed = docs if isinstance(docs, ColocatedDocs) else colocated.colocate(docs)
    return join_chunks(_by_buckets(patterns, landed, emit, arrow, schema))


def mentioned_patterns(patterns: DataFrame, docs: DataFrame | ColocatedDocs) -> DataFrame:
    """Distinct ``project, pattern`` with the pattern in any document of the project.

    Land documents that are searched more than once with :func:`colocated.colocate`.
    """
    patterns = materialize(patterns.select("project", "pattern").distinct())
    if not are_small(patterns):
        return windows.mentions(patterns.withColumn("name", F.col("pattern")), docs).withColumnRenamed("name", "pattern")
    there = docs.docs if isinstance(docs, ColocatedDocs) else docs
    return _by_broadcast(patterns, there, _new_mentions, _MENTION_ARROW, _MENTION).distinct()


def mentioned_names(forms: DataFrame, docs: DataFrame | ColocatedDocs) -> DataFrame:
    """Distinct ``project, name`` of ``forms(project, name, pattern)`` with a pattern in any document of the project."""
    if not are_small(forms):
        return windows.mentions(forms, docs)
    hits = mentioned_patterns(forms, docs)
    return forms.join(hits, ["project", "pattern"], "left_semi").select("project", "name").distinct()


def scored_documents(patterns: DataFrame, docs: DataFrame | ColocatedDocs) -> DataFrame:
    """``project, path, hits`` of the documents that hold a pattern of their project.

    ``hits`` lists ``pattern, tenths`` in order of the pattern.
    """

    def join_chunks(found: DataFrame) -> DataFrame:
        # A document has a row per chunk of its project's patterns.
        return found.groupBy("project", "path").agg(
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")
        )

    return _occurrences(patterns, docs, _scores, _SCORED_ARROW, _SCORED, join_chunks)


def found_documents(patterns: DataFrame, docs: DataFrame | ColocatedDocs) -> DataFrame:
    """``project, path, patterns`` of the documents that hold a pattern of their project, unscored.

    A document has a row for each chunk of its project's patterns, or one where they are broadcast.
    """
    return _occurrences(patterns, docs, _found, _FOUND_ARROW, _FOUND)

"""Which documents may hold a pattern, told without reading them.

A document's signature is a Bloom filter of the byte sequences of length three in its
lower-cased text (and of single bytes and pairs, for patterns that short).  A pattern can
only occur where all of its sequences are in the signature.  Signatures are landed once
and are a small part of the texts; every search after that reads them instead.

One mention in any document is enough, so a search opens documents in two waves: first,
for each pattern, the document that may hold the most patterns besides it; then, for
patterns that were not found there, whatever else may hold them.  A pattern that no
signature admits costs no reading at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.operators import occurrences
from doclumen.runtime import broadcast_if_small, materialize

#: Bits for each distinct sequence, rounded up to one of four sizes for each power of two; a
#: sequence sets one of them, so one that is absent seems present in at most a fifth of all cases,
#: and a pattern of n characters in the (n - 2)th power of that.
BITS_PER_SEQUENCE = 4
LEAST_BITS = 256

INDEX = "project string, path string, signature binary"
_PAIRS, _SINGLES = 1 << 24, 1 << 25


def _threes(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    return d[:-2] << 16 | d[1:-1] << 8 | d[2:]


def text_sequences(text: str) -> np.ndarray:
    """Distinct sequences of one, two and three bytes of a text, as numbers."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    d = data.astype(np.uint32)
    parts = [np.unique(data).astype(np.uint32) | _SINGLES]
    if len(data) > 1:
        parts.append(np.unique(d[:-1] << 8 | d[1:]) | _PAIRS)
    if len(data) > 2:
        parts.append(np.unique(_threes(data)))
    return np.concatenate(parts)


def pattern_sequences(pattern: str) -> np.ndarray:
    """Sequences that a text with the pattern must have; none for the empty pattern."""
    data = np.frombuffer(pattern.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) > 2:
        return np.unique(_threes(data))
    return text_sequences(pattern)[-1:] if len(data) else np.empty(0, np.uint32)


def places(sequences: np.ndarray, bits: int) -> np.ndarray:
    mixed = sequences.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def signature(text: str) -> bytes:
    found = text_sequences(text)
    bits = max(LEAST_BITS, BITS_PER_SEQUENCE * len(found))
    step = 1 << (bits.bit_length() - 3)
    bits = -(-bits // step) * step
    held = np.zeros(bits, bool)
    held[places(found, bits)] = True
    return np.packbits(held).tobytes()


def signature_index(docs: DataFrame) -> DataFrame:
    """Land the signatures of ``docs(project, path, text)``: one pass over the texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = pa.array([signature(t.as_py() or "") for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], names=["project", "path", "signature"])

    return materialize(docs.select("project", "path", "text").mapInArrow(sign, INDEX))


class _Patterns:
    """Patterns of a project and where their sequences are in a signature of any size."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        found = [pattern_sequences(p) for p in patterns]
        sizes = np.array([len(f) for f in found])
        # One more at the end, so that every pattern has an end and may be empty.
        self.sequences = np.concatenate([*found, np.zeros(1, np.uint32)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.free = sizes == 0  # the empty pattern is in every text
        self.by_bits: dict[int, np.ndarray] = {}

    def admitted(self, signed: bytes) -> np.ndarray:
        """Which patterns a document with this signature may hold."""
        bits = 8 * len(signed)
        if bits not in self.by_bits:
            self.by_bits[bits] = places(self.sequences, bits)
        held = np.unpackbits(np.frombuffer(signed, np.uint8))
        return np.minimum.reduceat(held[self.by_bits[bits]], self.starts)[:-1].astype(bool) | self.free


def _pass(patterns: DataFrame, index: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``emit(project, patterns, path, signature)`` over the index; patterns are few enough to be broadcast."""
    by_project: dict[str, list[str]] = {}
    for row in patterns.collect():  # size checked by the caller
        by_project.setdefault(row["project"], []).append(row["pattern"])
    shared = index.sparkSession.sparkContext.broadcast(by_project)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Patterns] = {}
        state: dict = {}
        for batch in batches:
            for project, path, signed in zip(*(batch.column(i) for i in range(3))):
                name = project.as_py()
                if name not in shared.value:
                    continue
                if name not in known:
                    known[name] = _Patterns(shared.value[name])
                yield from emit(state, name, known[name], path.as_py(), signed.as_py())
        yield from emit(state, None, None, None, None)

    return index.select("project", "path", "signature").mapInArrow(scan, schema)


def _best_documents(state: dict, project, patterns, path, signed) -> Iterator[pa.RecordBatch]:
    """At the end of a task: for each pattern the document that may hold it and the most others."""
    if project is not None:
        counts, paths = state.setdefault(project, (patterns, np.zeros(len(patterns.patterns), np.int64), {}))[1:]
        ok = patterns.admitted(signed)
        better = np.flatnonzero(ok & (int(ok.sum()) > counts))
        counts[better] = int(ok.sum())
        paths.update(dict.fromkeys(better.tolist(), path))
        return
    for name, (asked, counts, paths) in state.items():
        rows = [{"project": name, "pattern": asked.patterns[i], "many": int(counts[i]), "path": p} for i, p in sorted(paths.items())]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("project", pa.string()), ("pattern", pa.string()), ("many", pa.int64()), ("path", pa.string())]))


def _admitting_documents(state: dict, project, patterns, path, signed) -> Iterator[pa.RecordBatch]:
    if project is not None and patterns.admitted(signed).any():
        yield pa.RecordBatch.from_pylist([{"project": project, "path": path}], schema=pa.schema([("project", pa.string()), ("path", pa.string())]))


def candidate_documents(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """``project, path`` of the documents that may hold at least one pattern of their project."""
    return _pass(patterns, index, _admitting_documents, "project string, path string")


def mentioned_patterns(
    patterns: DataFrame, docs: DataFrame, index: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Distinct ``project, pattern`` that occur, and ``project, path`` of the documents read for it.

    The same rows as :func:`occurrences.mentioned_patterns` gives.  ``index`` comes from
    :func:`signature_index` over the same documents; paths are unique within a project.
    """
    patterns = materialize(patterns.select("project", "pattern").where(F.col("project").isNotNull()).distinct())
    if not occurrences.are_small(patterns):
        # So many are admitted by almost every document.
        opened = index.select("project", "path").join(patterns.select("project").distinct(), "project", "left_semi")
        return materialize(occurrences.mentioned_patterns(patterns, docs)), opened
    best = _pass(patterns, index, _best_documents, "project string, pattern string, many long, path string")
    chosen = materialize(
        best.groupBy("project", "pattern").agg(F.max_by("path", F.struct("many", "path")).alias("path"))
    )
    first = materialize(chosen.select("project", "path").distinct())

    def read(wanted: DataFrame, opened: DataFrame) -> DataFrame:
        texts = docs.join(broadcast_if_small(opened), ["project", "path"], "left_semi")
        return materialize(occurrences.mentioned_patterns(wanted, texts))

    found = read(chosen.select("project", "pattern"), first)
    rest = materialize(chosen.select("project", "pattern").join(found, ["project", "pattern"], "left_anti"))
    if rest.isEmpty():
        return found, first
    more = materialize(candidate_documents(rest, index).join(first, ["project", "path"], "left_anti"))
    return found.unionByName(read(rest, more)), first.unionByName(more)

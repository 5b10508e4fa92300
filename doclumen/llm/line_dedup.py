"""Removing repeated multi-line chunks with content-defined boundaries (operator 4).

A rolling hash over the hashes of ``WINDOW`` lines decides where a boundary may be, so that
the same lines are cut alike wherever they stand.  From every boundary a chunk runs to
the next one that gives it ``MIN_LINES`` lines with content: chunks overlap, and a short
passage between other lines has a chunk of its own.  Chunks are counted by a 128-bit
hash; what is removed has first been compared with the first chunk's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import id_order, land, plain

WINDOW = 2
#: A line ends at a boundary unless its hash is divisible by this.
DIVISOR = 32
#: Lines with content that a chunk has at least.
MIN_LINES = 2
COUNTS = ("n_removed_lines", "n_removed_chunks")


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """First line and number of lines of each chunk.

    A chunk starts at a line with content behind a boundary (the text's start is one, its
    end another), so that no line is in more than two chunks.
    """
    from xxhash import xxh64_intdigest as digest

    ends, full, before = [], [0], [0] * (WINDOW - 1)
    for i, line in enumerate(lines):
        now = digest(line)
        rolled = now
        for h in before:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & (2**64 - 1)
        before = [now, *before][: WINDOW - 1]
        full.append(full[-1] + bool(line.strip()))
        if ((rolled ^ (rolled >> 33)) * 0xC2B2AE3D27D4EB4F >> 32) % DIVISOR or i + 1 == len(lines):
            ends.append(i + 1)
    out, e = [], 0
    for start in [0, *ends[:-1]]:
        while e < len(ends) and full[ends[e]] - full[start] < MIN_LINES:
            e += 1
        if e == len(ends):
            break
        if full[start + 1] > full[start]:
            out.append((start, ends[e] - start))
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest as digest

    for batch in batches:
        out: list[tuple] = []
        for order, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            lines = (text.as_py() or b"").split(b"\n")
            for at, n in chunks(lines):
                out.append((order, th, at, n, digest(b"\n".join(lines[at : at + n]))))
        columns = list(zip(*out)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["ord", "th", "at", "n", "h"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks ``spans`` of each text."""
    for batch in batches:
        hashes, parts = [], []
        for text, spans in zip(batch.column(0), batch.column(1).to_pylist()):
            lines = (text.as_py() or b"").split(b"\n")
            for span in spans:
                hashes.append(span["h"])
                parts.append(b"\n".join(lines[span["at"] : span["at"] + span["n"]]))
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(parts, pa.binary())], names=["h", "chunk"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``kept``: the text without the chunks that equal, byte for byte, the one they
    repeat, or null if nothing goes."""
    for batch in batches:
        kept, gone_lines, gone_chunks = [], [], []
        for text, spans in zip(batch.column("body"), batch.column("spans").to_pylist()):
            value, n_lines, n_chunks = None, 0, 0
            if spans:
                lines = text.as_py().split(b"\n")
                keep = [True] * len(lines)
                for span in spans:
                    at, n = span["at"], span["n"]
                    if b"\n".join(lines[at : at + n]) == span["chunk"]:
                        keep[at : at + n] = [False] * n
                        n_chunks += 1
                n_lines = keep.count(False)
                value = b"\n".join(line for line, k in zip(lines, keep) if k) if n_chunks else None
            kept.append(value)
            gone_lines.append(n_lines)
            gone_chunks.append(n_chunks)
        others = [c for c in batch.schema.names if c.startswith("_col_")]
        arrays = [*(batch.column(c) for c in others), pa.array(kept, pa.binary()), pa.array(gone_lines, pa.int64()), pa.array(gone_chunks, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*others, "kept", *COUNTS])


def _repeats(texts: DataFrame) -> DataFrame:
    """For ``texts(ord, th, body)`` that repeat chunks: ``spans``, each with the bytes of the first such chunk.

    Joins with texts are merges at any size: what is joined grows with the texts.
    """
    found = land(texts.mapInArrow(_hashed, "ord long, th long, at int, n int, h binary"))
    place = F.struct("ord", "th", "at")
    firsts = found.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    occurrences = land(found.join(land(firsts.select("h", "first")), "h"))
    of_first = occurrences.filter(place == F.col("first")).dropDuplicates(["h"])
    of_first = land(of_first.groupBy("ord", "th").agg(F.collect_list(F.struct("at", "n", "h")).alias("spans")))
    parts = texts.join(of_first.hint("merge"), ["ord", "th"]).select("body", "spans").mapInArrow(_cut_out, "h binary, chunk binary")
    parts = land(parts.dropDuplicates(["h"]), release=True)
    repeats = occurrences.filter(place != F.col("first")).select("ord", "th", "at", "n", "h").distinct()
    repeats = land(repeats.join(parts, "h").select("ord", "th", F.struct("at", "n", "chunk").alias("span")))
    return land(repeats.groupBy("ord", "th").agg(F.collect_list("span").alias("spans")), release=True)


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, ``text`` without repeated chunks, and two counts:
    ``n_removed_lines, n_removed_chunks`` (columns of these names in ``docs`` are replaced).

    Of equal chunks the first stays: that of the smallest ``doc_id`` (missing ids last, then
    by a hash of the text), and there the earliest; chunks are judged on the input, not on
    what is left, and a removed line always stands in an earlier place; rows alike in id
    and text are treated alike.  A null text stays null, an empty one empty; a text that only repeats others
    becomes empty and its row stays.  Lines end at line feeds only.  ``n_chars`` is set
    again where ``docs`` has it.
    """
    columns = [c for c in docs.columns if c not in COUNTS]
    place = {c: f"_col_{i}" for i, c in enumerate(columns)}
    body = F.col("text").cast("binary")
    keys = [id_order(F.col("doc_id").cast("long")).alias("ord"), F.xxhash64(body).alias("th"), body.alias("body")]
    spans = _repeats(docs.select(*keys))
    every = docs.select(*keys, *(plain(c).alias(p) for c, p in place.items())).join(spans.hint("merge"), ["ord", "th"], "left")
    schema = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in place.items())
    out = every.mapInArrow(_removed, f"{schema}, kept binary, n_removed_lines long, n_removed_chunks long")
    changed = F.col("kept").isNotNull()
    text = F.when(changed, F.col("kept").cast("string")).otherwise(F.col(place["text"]))
    new = {"text": text, "n_chars": F.when(changed, F.length(text)).otherwise(F.col(place["n_chars"]) if "n_chars" in place else None)}
    return out.select(*(new.get(c, F.col(p)).cast(docs.schema[c].dataType).alias(c) for c, p in place.items()), *COUNTS)

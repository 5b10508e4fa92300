"""Mentions of any number of patterns: the places of a text that may hold one, told by a filter, meet the patterns by key.

A rolling hash gives, at once for all places of a text, the hash of the window of any length
there.  Patterns set bits of a Bloom filter by their hash, and by the hashes of their beginnings of a
few lengths; a place whose shortest beginning is not in the filter is left at once, and only what is there
in every length asked for is cut out.  What was cut out is joined to the patterns as it is, so the
filter decides on the work and never on the result.  No text is shuffled and no task holds the
patterns: it holds the filter, which has a greatest size.

Many patterns are searched for in groups of projects, so that a filter never gets too full to tell
anything: each project's texts are read for its own patterns only.  What was cut out makes a second filter,
and only patterns that pass it are sent to the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclumen.operators.colocated import ColocatedDocs
from doclumen.runtime import materialize, release

#: Bits of the filter for each pattern, at least, and most patterns that it grows for (64 MB); more pass more windows.
BITS_PER_PATTERN = 16
GROUP_PATTERNS = 1 << 25
#: Patterns, spellings with other separators not counted, that are searched for at once; a project with more is read several times.
SEARCH_PATTERNS = 1 << 25
#: Patterns beyond which those found by no window are left out before the join.
JOINED_PATTERNS = 1_000_000
#: Lengths in bytes of the beginnings that are in the filter.
BEGINNINGS = (4, 6, 8, 12, 16, 32, 64)
#: Distinct windows that a task remembers so as not to write them twice, more by those of one block at most.
SEEN_WINDOWS = 400_000
#: Windows of each length up to eight bytes that a task knows again without cutting them out.
WRITTEN_SHORT = 1 << 16
#: Windows in an Arrow batch.
BATCH = 20_000
#: Bytes of text that are hashed together; longer texts are cut into blocks that overlap.
BLOCK_BYTES = 1 << 18
#: Bytes of text that a task holds besides its Arrow batch.
HELD_BYTES = 1 << 23
#: Bytes of the filter that one group of its building makes.
PAGE_BYTES = 1 << 18
#: Projects are told apart by so many numbers where the lengths of their patterns are kept.
LENGTH_KEYS = 4096

_BETWEEN = b"\xff"  # in no text and no pattern, as it is not in UTF-8
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_PROBES = [np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_BEGIN_PROBES = _PROBES[:2]
_BEGINS = np.uint64(0x589965CC75374CC3)
_WINDOWS = "project string, piece binary"
_WINDOWS_ARROW = pa.schema([("project", pa.string()), ("piece", pa.binary())])


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ numbers >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ numbers >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return numbers ^ numbers >> np.uint64(31)


_EXACT = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: Spellings of a name that differ in their separators set the same bits.
_SEPARATORS = "-_ "
_BYTES = _EXACT.copy()
_BYTES[[ord(c) for c in _SEPARATORS]] = _EXACT[ord(" ")]


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _UNBASE):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return tuple(both)


class _Hashes:
    """Hashes of the windows of some bytes, equal for equal windows wherever they stand."""

    def __init__(self, data: bytes, numbers: np.ndarray = _BYTES):
        codes = np.frombuffer(data, np.uint8)
        self.size = len(codes)
        powers, self.unpowers = _powers(max(2 * BLOCK_BYTES, 1 << self.size.bit_length()))
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(numbers[codes] * powers[: self.size], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[: self.size + 1 - length]) * self.unpowers[: self.size + 1 - length]

    def at(self, places: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[places + lengths] - self.sums[places]) * self.unpowers[places]


@lru_cache(maxsize=100_000)
def _seed(project: str) -> int:
    return int.from_bytes(blake2b(project.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _bits(hashes: np.ndarray, probe: np.uint64, shift: int) -> np.ndarray:
    bits = hashes >> np.uint64(32)
    bits ^= hashes
    bits *= probe
    bits >>= np.uint64(shift)
    return bits.view(np.int64)


class _Pieces:
    """The hashes of the strings of a column, without a Python object for each."""

    def __init__(self, projects: pa.Array, pieces: pa.Array, numbers: np.ndarray):
        pieces = pieces.cast(pa.large_binary())
        _, offsets, data = pieces.buffers()
        ends = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        self.sizes = np.diff(ends)
        self.starts = ends[:-1] - ends[0]
        self.hashes = _Hashes(memoryview(data or b"")[ends[0] : ends[-1]], numbers)
        named = projects.dictionary_encode()
        seeds = np.array([_seed(p) for p in named.dictionary.to_pylist()], np.uint64)
        self.seeds = seeds[named.indices.to_numpy()]

    def whole(self) -> np.ndarray:
        return self.hashes.at(self.starts, self.sizes) ^ self.seeds


def _set(filled: np.ndarray, places: np.ndarray) -> None:
    inside = places & 7
    for bit in range(8):
        filled[places[inside == bit] >> 3] |= np.uint8(1 << bit)


def _pages(shift: int, beginnings: tuple[int, ...] = BEGINNINGS, numbers: np.ndarray = _BYTES):
    """The bits that all patterns of a task set, by page of the filter: the page itself, or the places in it where they are few."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(max((1 << 64 - shift) // 8, PAGE_BYTES), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = _Pieces(batch.column(0), batch.column(1), numbers)
            hashes = pieces.whole()
            new = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))  # a name's spellings stand together
            for probe in _PROBES:
                _set(filled, _bits(hashes[new], probe, shift))
            for length in beginnings:
                long = new[pieces.sizes[new] >= length]
                begin = pieces.hashes.at(pieces.starts[long], length) ^ pieces.seeds[long] ^ _BEGINS
                for probe in _BEGIN_PROBES:
                    _set(filled, _bits(begin, probe, shift))
        for page, bits in enumerate(filled.reshape(-1, PAGE_BYTES)):
            if not bits.any():
                continue
            places = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint32)
            part = places.tobytes() if places.nbytes < PAGE_BYTES else bits.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([part], pa.binary())], names=["page", "places"])

    return scan


def _page(table: pa.Table) -> pa.Table:
    bits = np.zeros(PAGE_BYTES, np.uint8)
    for part in table.column("places"):
        held = part.as_py()
        if len(held) == PAGE_BYTES:
            bits |= np.frombuffer(held, np.uint8)
        else:
            _set(bits, np.frombuffer(held, np.uint32))
    return pa.table({"page": table.column("page")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def _filter(
    patterns: DataFrame, count: int, beginnings: tuple[int, ...] = BEGINNINGS, numbers: np.ndarray = _BYTES
) -> tuple[np.ndarray, int]:
    """The filter of ``patterns(project, piece)`` and by how many bits a hash is shifted for a place in it."""
    exponent = max(3, (BITS_PER_PATTERN * min(count, GROUP_PATTERNS) - 1).bit_length())
    shift = 64 - exponent
    # As many tasks as cores: each brings a filter of its own, which together are what is shuffled.
    few = patterns.coalesce(patterns.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(_pages(shift, beginnings, numbers), "page int, places binary").groupBy("page").applyInArrow(_page, "page int, bits binary")
    filled = np.zeros(max((1 << exponent) // 8, PAGE_BYTES), np.uint8)
    for row in found.toLocalIterator():  # no more than the filter's greatest size
        filled[row["page"] * PAGE_BYTES : (row["page"] + 1) * PAGE_BYTES] = np.frombuffer(row["bits"], np.uint8)
    return filled, shift


def _passed(hashes: np.ndarray, places: np.ndarray | None, probes: list[np.uint64], filled: np.ndarray, shift: int) -> np.ndarray:
    """The places, all where none are given, whose hashes are in the filter."""
    for probe in probes:
        bits = _bits(hashes, probe, shift)
        held = filled.take(bits >> 3)
        held >>= (bits & 7).astype(np.uint8)
        held &= 1
        kept = np.flatnonzero(held.view(bool))
        places = kept if places is None else places[kept]
        hashes = hashes[kept]
    return places


class _Written:
    """Short windows that a task has cut out before, the latest of those that fall on one slot.

    A window of up to eight bytes is told by its bytes as a number, so none is taken for another.
    """

    def __init__(self):
        self.numbers = np.zeros((9, WRITTEN_SHORT), np.uint64)
        self.owners = np.full((9, WRITTEN_SHORT), -1, np.int64)
        self.shift = np.uint64(65 - WRITTEN_SHORT.bit_length())

    def new(self, block: bytes, places: np.ndarray, length: int, owner: int) -> np.ndarray:
        codes = np.frombuffer(block, np.uint8)
        numbers = np.zeros(len(places), np.uint64)
        for i in range(length):
            numbers <<= np.uint64(8)
            numbers |= codes[places + i]
        slots = (numbers * np.uint64(_BASE) >> self.shift).view(np.int64)
        new = np.flatnonzero((self.numbers[length, slots] != numbers) | (self.owners[length, slots] != owner))
        self.numbers[length, slots[new]] = numbers[new]
        self.owners[length, slots[new]] = owner
        return places[new]


def windows(
    block: bytes, seed: int, lengths: list[int], filled: np.ndarray, shift: int, written: _Written | None = None, owner: int = 0
) -> list[bytes]:
    """The windows of a block that may be patterns: all that are, and few others.  ``lengths`` ascend.

    With ``written``, most of those that it knows as the owner's are left out.
    """
    hashes = _Hashes(block)
    mark = np.uint64(seed)
    places: np.ndarray | None = None
    found: list[bytes] = []
    steps = sorted([*((b, 0) for b in BEGINNINGS if b <= lengths[-1]), *((n, 1) for n in lengths if n)])
    for length, whole in steps:
        if length > hashes.size:
            break
        tag, probes = (mark, _PROBES) if whole else (mark ^ _BEGINS, _BEGIN_PROBES)
        if places is None:
            passed = _passed(hashes.all(length) ^ tag, None, probes, filled, shift)
        else:
            fit = places[: np.searchsorted(places, hashes.size - length, "right")]
            passed = _passed(hashes.at(fit, length) ^ tag, fit, probes, filled, shift)
        if not whole:
            places = passed
            continue
        if written and length <= 8:
            passed = written.new(block, passed, length, owner)
        found += [block[i : i + length] for i in passed.tolist()]
    return found


def _blocks(texts: list[bytes], longest: int) -> Iterator[bytes]:
    """Texts joined, or cut with so much overlap that a window is whole in one of the cuts."""
    size = max(BLOCK_BYTES, 2 * longest)
    held, held_bytes = [], 0
    for text in texts:
        for start in range(0, max(len(text) - longest + 1, 1), size - longest + 1):
            part = text[start : start + size]
            held.append(part)
            held_bytes += len(part)
            if held_bytes >= BLOCK_BYTES:
                yield _BETWEEN.join(held)
                held, held_bytes = [], 0
    if held:
        yield _BETWEEN.join(held)


def _by_project(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by project, some bytes at a time."""
    texts: dict[str, list[bytes]] = {}
    held = 0
    for batch in batches:
        for project, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            if project.is_valid and text.is_valid:
                own = text.as_py()
                texts.setdefault(project.as_py(), []).append(own)
                held += len(own)
                if held >= HELD_BYTES:
                    yield texts
                    texts, held = {}, 0
    yield texts


def _new_windows(
    batches: Iterator[pa.RecordBatch], lengths: dict[int, list[int]], filled: np.ndarray, shift: int
) -> Iterator[pa.RecordBatch]:
    """The windows of ``project, text``; those that were written before are told by a bounded memory, emptied between blocks."""
    seen: dict[str, set[bytes]] = {}
    held = 0
    written = _Written()
    owners: dict[str, int] = {}
    for texts in _by_project(batches):
        for project, own in texts.items():
            wanted = lengths.get(zlib.crc32(project.encode("utf-8", "surrogatepass")) % LENGTH_KEYS)
            if not wanted:
                continue
            owner = owners.setdefault(project, len(owners))
            new = set() if wanted[0] else {b""}
            for block in _blocks(own, wanted[-1]):
                known = seen.setdefault(project, set())
                new.update(windows(block, _seed(project), wanted, filled, shift, written, owner))
                new -= known
                known |= new
                held += len(new)
                pieces = [p for p in new if _BETWEEN not in p]
                new = set()
                for first in range(0, len(pieces), BATCH):
                    part = pieces[first : first + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([project] * len(part), pa.string()), pa.array(part, pa.binary())], schema=_WINDOWS_ARROW)
                if held > SEEN_WINDOWS:
                    seen, held = {}, 0


def cut(docs: DataFrame | ColocatedDocs, lengths: dict[int, list[int]], filled: np.ndarray, shift: int, parts: bool = False) -> DataFrame:
    """``project, piece``: the windows of all documents that may be patterns, most of them once for a task.

    With ``parts``, for documents that are landed: ``project, part, piece``.
    """
    there = docs.docs if isinstance(docs, ColocatedDocs) else docs
    shared = there.sparkSession.sparkContext.broadcast((lengths, filled))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _new_windows(batches, *shared.value, shift)

    def scan_part(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in scan(batch.select(["project", "text"]) for batch in batches):
            if parts:
                part = pa.array(np.full(len(found), key[1].as_py(), np.int32))
                found = pa.RecordBatch.from_arrays([found.column(0), part, found.column(1)], names=["project", "part", "piece"])
            yield found

    if isinstance(docs, ColocatedDocs):  # a part stays in its bucket, where its texts give a window once
        schema = "project string, part int, piece binary" if parts else _WINDOWS
        return there.select("project", "part", "text").groupBy("project", "part").applyInArrow(scan_part, schema)
    return there.select("project", "text").mapInArrow(scan, _WINDOWS)


def _passing(forms: DataFrame, filled: np.ndarray, shift: int) -> DataFrame:
    """``forms(project, name, piece)`` whose pieces are in a filter of whole pieces."""
    shared = forms.sparkSession.sparkContext.broadcast(filled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = _Pieces(batch.column(0), batch.column(2), _EXACT).whole()
                yield batch.take(pa.array(_passed(hashes, None, _PROBES, shared.value, shift)))

    return forms.mapInArrow(scan, forms.schema)


def _groups(counts: dict[int, int]) -> list[tuple[list[int], int]]:
    """Keys of projects that are searched together, and into how many shares their patterns are cut."""
    groups: list[tuple[list[int], int]] = []
    held = 0
    for key, count in sorted(counts.items()):
        if count > SEARCH_PATTERNS:
            groups.append(([key], -(-count // SEARCH_PATTERNS)))
            held = SEARCH_PATTERNS
        elif groups and held + count <= SEARCH_PATTERNS:
            groups[-1][0].append(key)
            held += count
        else:
            groups.append(([key], 1))
            held = count
    return groups


def _key() -> Column:
    return F.pmod(F.crc32(F.col("project").cast("binary")), F.lit(LENGTH_KEYS)).cast("int")


def mentions(forms: DataFrame, docs: DataFrame | ColocatedDocs) -> DataFrame:
    """Distinct ``project, name`` of ``forms(project, name, pattern)`` with a pattern that occurs in any
    document of the project.  ``forms`` is read several times: give it landed, or cheap to make of what is."""
    return _met(forms, docs, False)


def occurring(patterns: DataFrame, landed: ColocatedDocs) -> DataFrame:
    """Distinct ``project, part, pattern`` of ``patterns(project, pattern)`` that occur in any document of the part."""
    return _met(patterns.withColumn("name", F.col("pattern")), landed, True).withColumnRenamed("name", "pattern")


def _joined(asked: DataFrame, pieces: DataFrame) -> DataFrame:
    if "part" in pieces.columns:
        return asked.join(pieces, ["project", "piece"]).select("project", "part", "name").distinct()
    return asked.join(pieces, ["project", "piece"], "left_semi").select("project", "name").distinct()


def _met(forms: DataFrame, docs: DataFrame | ColocatedDocs, parts: bool) -> DataFrame:
    also = (True,) if parts else ()
    known = forms.where(F.col("project").isNotNull() & F.col("pattern").isNotNull())
    asked = known.select("project", "name", F.col("pattern").cast("binary").alias("piece"))
    other = F.contains("pattern", F.lit("-")) | F.contains("pattern", F.lit("_"))
    sizes = known.groupBy(_key().alias("key"), F.octet_length("pattern").alias("length")).agg(
        F.count("*").alias("n"), F.count_if(other).alias("other")
    )
    lengths: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    total = 0
    for row in sizes.orderBy("length").collect():  # at most a row for each key and length
        lengths.setdefault(row["key"], []).append(row["length"])
        counts[row["key"]] = counts.get(row["key"], 0) + max(row["n"] - row["other"], -(-row["other"] // 2))
        total += row["n"]

    groups = _groups(counts)
    if total <= JOINED_PATTERNS and len(groups) <= 1 and all(shares == 1 for _, shares in groups):
        filled, shift = _filter(asked.select("project", "piece"), max(sum(counts.values()), 1))
        return _joined(asked, cut(docs, lengths, filled, shift, *also))

    found: list[DataFrame] = []
    for keys, shares in groups:
        for share in range(shares):
            here, texts = asked, docs
            if len(groups) > 1:
                mine = _key().isin(keys)
                here = here.where(mine)
                texts = replace(docs, docs=docs.docs.where(mine)) if isinstance(docs, ColocatedDocs) else docs.where(mine)
            if shares > 1:
                spelling = F.translate(F.col("piece").cast("string"), _SEPARATORS, " " * len(_SEPARATORS))
                here = here.where(F.pmod(F.xxhash64(spelling), F.lit(shares)) == share)
            filled, shift = _filter(here.select("project", "piece"), max(sum(counts[k] for k in keys) // shares, 1))
            pieces = materialize(cut(texts, lengths, filled, shift, *also))
            few = pieces.count()
            if few < total:
                here = _passing(here, *_filter(pieces.select("project", "piece"), max(few, 1), (), _EXACT))
            found.append(materialize(_joined(here, pieces)))
            release(asked.sparkSession)
    both = found[0]
    for more in found[1:]:
        both = both.union(more)
    return both.distinct() if any(shares > 1 for _, shares in groups) else both

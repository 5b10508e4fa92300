"""How the sources of a language differ in their words (operator 13).

Terms are counted in Arrow passes that never build a string for each word: the bytes of a
slice of texts are classed by a table, terms of up to eight bytes become one 64-bit word
and of up to sixteen two, which a radix sort by 16-bit digits puts in order; longer terms
are sorted byte by byte in a bucket for each length.  Runs of equal keys are the counts.
Spark adds them up, keeps the terms that enough documents have, and compares the sources'
smoothed shares, in whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclumen.llm.common import land

#: Documents of a language that a kept term occurs in at least; terms reported for each group.
MIN_DOCS = 30
TOP_TERMS = 50
#: Added to every count; shares are in parts of this.
SMOOTH = 5
SCALE = 1_000_000_000
#: Bytes of text that are counted together.
SLICE_BYTES = 1 << 22
#: Sources of a language in a block on average: shares are compared for two blocks at a time.
BLOCK_SOURCES = 128
#: Shares that wait in a task until they are compared together.
WAITING = 4096

#: Letters, and all bytes of characters beyond ASCII.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

COUNTED = "lang string, source string, term string, n long, docs long"


def radix_order(*words: np.ndarray) -> np.ndarray:
    """A stable order by 64-bit words, the first the most significant: by one 16-bit digit
    after the other from the last, digits that are all alike left out."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one word, the first byte the highest; zeros behind the end."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        has = lengths > k
        if not has.any():
            break
        out[has] |= data[starts[has] + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out



def _counted(keys: list[np.ndarray], doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For terms in order (equal ones side by side, by document within): the first of each run of
    one term and group, the run's length, and how many documents are in it."""
    other = np.zeros(len(doc) - 1, bool)
    for key in keys:
        other |= key[1:] != key[:-1]
    first = np.concatenate([[True], other | (group[1:] != group[:-1])])
    new_doc = first.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(doc))), np.add.reduceat(new_doc.astype(np.int64), at)


def term_counts(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of some texts with their group, occurrences and documents; ``groups`` rises."""
    ends = np.cumsum([len(t) + 1 for t in texts])  # a zero byte parts the texts
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    inside = np.concatenate([[False], _IN_TERM[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(ends, starts, side="right")
    for low, high in ((0, 8), (8, 16)):
        mine = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(mine):
            continue
        s, n = starts[mine], lengths[mine]
        keys = [_packed(data, s, n)]
        if high == 16:
            keys.append(_packed(data, s + 8, n - 8))
        order = radix_order(*keys)
        keys, of = [k[order] for k in keys], doc[mine][order]
        at, count, docs = _counted(keys, of, groups[of])
        shown = np.stack([k[at] for k in keys], axis=1).astype(">u8").view(f"S{high}").ravel()
        yield pa.array(shown.tolist(), pa.binary()), groups[of[at]], count, docs
    long = lengths > 16
    for size in np.unique(lengths[long]).tolist():
        mine = np.flatnonzero(lengths == size)
        bucket = data[starts[mine][:, None] + np.arange(size)].view(f"S{size}").ravel()
        order = np.argsort(bucket, kind="stable")
        bucket, of = bucket[order], doc[mine][order]
        at, count, docs = _counted([bucket], of, groups[of])
        yield pa.array(bucket[at].tolist(), pa.binary()), groups[of[at]], count, docs


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(sizes):
        last, size = first + 1, sizes[first]
        while last < len(sizes) and size + sizes[last] <= SLICE_BYTES:
            size += sizes[last]
            last += 1
        yield first, last
        first = last


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.sort_by([("lang", "ascending"), ("source", "ascending")])
        langs, sources, texts = (batch.column(c).to_pylist() for c in range(3))
        new = [i == 0 or (langs[i], sources[i]) != (langs[i - 1], sources[i - 1]) for i in range(len(langs))]
        groups = np.cumsum(new) - 1
        of = np.flatnonzero(new)
        for first, last in _slices([len(t) for t in texts]):
            for terms, group, n, docs in term_counts(texts[first:last], groups[first:last]):
                at = pa.array(of[group])
                arrays = [batch.column(0).take(at), batch.column(1).take(at), terms.cast(pa.string()), pa.array(n), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def share(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a count in parts of ``SCALE``, from 1 on; exact at any count."""
    wide = "decimal(38,0)"
    return F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + SMOOTH).cast("decimal(21,0)"), (total + SMOOTH * terms).cast(wide)
    ).cast("long") + 1


class _Tile:
    """Two blocks of sources, and distances of their pairs over the terms given so far.

    ``sums`` holds how far the pairs' distance over these terms is from that of two
    sources without any of them."""

    def __init__(self, lang: str, tile: str, chunk: int):
        one, _, two = tile.partition(",")
        self.lang, self.with_itself, self.first_chunk = lang, one == two, chunk == 0
        self.names: tuple[list[str], list[str]] = ([], [])
        self.bases: tuple[list[int], list[int]] = ([], [])
        self.terms = 0
        self.sums: np.ndarray | None = None
        self.waiting: list[tuple[int, str, str, int]] = []

    def add_source(self, side: int, source: str, base: int, terms: int) -> None:
        self.names[side].append(source)
        self.bases[side].append(base)
        self.terms = terms

    def add_share(self, side: int, source: str, term: str, p: int) -> None:
        # A term's rows stay together: work is done between two terms only.
        if len(self.waiting) >= WAITING and self.waiting[-1][2] != term:
            self.work()
        self.waiting.append((side, source, term, p))

    def work(self) -> None:
        if self.sums is None:
            self.sums = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)
            self.place = [{name: i for i, name in enumerate(names)} for names in self.names]
            self.base = [np.array(base, np.int64) for base in self.bases]
        rows: dict[str, int] = {}
        for _, _, term, _ in self.waiting:
            rows.setdefault(term, len(rows))
        shares = [np.tile(base, (len(rows), 1)) for base in self.base]
        for side, source, term, p in self.waiting:
            shares[side][rows[term], self.place[side][source]] = p
        for i, base in enumerate(self.base[0]):
            self.sums[i] += np.abs(shares[0][:, i : i + 1] - shares[1]).sum(axis=0) - len(rows) * np.abs(base - self.base[1])
        self.waiting.clear()

    def result(self) -> Iterator[pa.RecordBatch]:
        """Each pair of different sources once; the first chunk also gives what all terms have in common."""
        if not self.waiting and self.sums is None and not self.first_chunk:
            return
        self.work()
        others = np.array(self.names[1], dtype=object)
        for i, name in enumerate(self.names[0]):
            part = self.sums[i] + (self.terms * np.abs(self.base[0][i] - self.base[1]) if self.first_chunk else 0)
            pick = np.flatnonzero(others > name) if self.with_itself else np.arange(len(others))
            columns = ([self.lang] * len(pick), [name] * len(pick), others[pick].tolist(), part[pick])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_TYPES)], names=["lang", "source", "other", "part"])


_PART_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64())


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each tile and chunk of terms, one tile after the other; its sources come before its terms."""
    key, tile = None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "tile", "chunk", "term", "side", "source", "p", "terms"))
        for lang, place, chunk, term, side, source, p, terms in zip(*columns):
            if (lang, place, chunk) != key:
                if tile is not None:
                    yield from tile.result()
                key, tile = (lang, place, chunk), _Tile(lang, place, chunk)
            if term is None:
                tile.add_source(side, source, p, terms)
            else:
                tile.add_share(side, source, term, p)
    if tile is not None:
        yield from tile.result()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language of ``docs``.

    Part ``pair``: the distance to each other source of the language, all of them.  Part
    ``term``: the ``top`` terms that the source has above its language's share.  Null text,
    language and source are read as empty; repeated rows are documents of their own; ties
    rank by item; a group without kept terms still has its pairs; an empty table gives an
    empty result.  Other columns of ``docs`` are not read.
    """
    text = {c: F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")}
    read = docs.select(text["lang"].alias("lang"), text["source"].alias("source"), text["text"].cast("binary").alias("text"))
    counted = read.mapInArrow(_count_terms, COUNTED).groupBy("lang", "term", "source")
    counts = land(counted.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), release=True)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = land(kept.drop("docs"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    found = land(counts.drop("docs").join(kept, ["lang", "term"]))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text["lang"].alias("lang"), text["source"].alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    groups = land(groups.withColumn("base", base))
    shared = found.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shared = land(shared.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = (
        shared.filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )
    pairs = _distances(groups, shared).withColumn("rank", F.row_number().over(order))
    return typical.unionByName(pairs)


def _distances(groups: DataFrame, shared: DataFrame) -> DataFrame:
    """The distance of each two sources of a language, both ways round.

    Sources are dealt to blocks of bounded size and terms to chunks; a pair of blocks and a
    chunk is one unit of work, which holds two blocks' shares for some terms at a time.
    Its result has a row for each pair, as the whole result must.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.greatest(F.lit(1), F.floor(F.lit(2 * tasks) / (F.col("blocks") * (F.col("blocks") + 1)))).cast("int")
    blocks = land(blocks.withColumn("chunks", chunks))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    # A source is on the first side of tiles with its own and later blocks, and on the second with its own and earlier.
    first = F.transform(F.sequence("block", F.col("blocks") - 1), lambda b: F.struct(F.lit(0).alias("side"), F.concat_ws(",", "block", b).alias("tile")))
    second = F.transform(F.sequence(F.lit(0), F.col("block")), lambda b: F.struct(F.lit(1).alias("side"), F.concat_ws(",", b, "block").alias("tile")))
    tiles = F.inline(F.concat(first, second))
    heads = groups.join(blocks, "lang").withColumn("block", block)
    heads = heads.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    heads = heads.select("lang", "source", "chunk", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "terms", tiles)
    shares = shared.select("lang", "source", "term", "p").join(blocks, "lang").withColumn("block", block)
    shares = shares.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    shares = shares.select("lang", "source", "chunk", "term", "p", F.lit(None).cast("long").alias("terms"), tiles)
    dealt = heads.unionByName(shares).repartition("lang", "tile", "chunk")
    dealt = dealt.sortWithinPartitions("lang", "tile", "chunk", F.col("term").asc_nulls_first(), "side", "source")
    parts = dealt.mapInArrow(_tile_sums, "lang string, source string, other string, part long")
    sums = land(parts.groupBy("lang", "source", "other").agg(F.sum("part").alias("value")))
    turned = sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    each = sums.unionByName(turned)
    return each.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

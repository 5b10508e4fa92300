"""Mixing sources to target weights by blocks of words (operator 8).

A source's documents, in a fixed pseudorandom order, are one stream of words cut into
blocks of fixed length.  Each source gets a quota of block slots, the last one cut so that
the words meet its target.  The counts of a source's slots in the output shards are
drawn from a multinomial, which makes a shard's source counts multinomial while the quotas
hold exactly.  A slot's block is found by a pseudorandom permutation of the source's blocks,
one permutation for each cycle through them, and joined by its index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from doclumen.llm.common import id_order, land, partitions_for, plain, words

#: Weights of the sources by code point, repeating; no source goes beyond so many times its size.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
#: Slots of a shard on average, parts that one draw deals to, and tasks that expand shards at most.
SHARD_BLOCKS = 16_384
FAN = 4096
EXPANDING_TASKS = 20_000
#: Documents of a group whose words are summed in one task.
GROUP_DOCS = 4096
#: Sources that one task ranks.
RANKED_SOURCES = 100_000


def _ranked(sizes: DataFrame) -> DataFrame:
    """``rank`` added to distinct sources by code point, null last: ranges are numbered apart and moved on by those before."""
    parts = partitions_for(sizes.count(), RANKED_SOURCES)
    ranged = land(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before = [(part, sum(counts.get(k, 0) for k in range(part))) for part in sorted(counts)]
    first = sizes.sparkSession.createDataFrame(before, "_part int, _first long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    out = ranged.withColumn("rank", place.cast("long")).join(F.broadcast(first), "_part")
    return out.withColumn("rank", F.col("rank") + F.col("_first")).drop("_part", "_first")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size`` to ``rank, target`` added: shares of all words by weight.

    Sources that reach ``repeats`` times their size stop there and the excess is shared
    again by weight among the others, until none is above.  Only two sums reach the
    driver in each round.  ``sizes`` has one row for each source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    df = land(
        _ranked(sizes)
        .withColumn("weight", weight.cast("double"))
        .withColumn("limit", (repeats * F.col("source_size")).cast("double"))
    )
    total = float(df.agg(F.sum("source_size")).first()[0] or 0)
    share, full = 0.0, F.lit(False)
    while True:
        open_weight, stopped = df.agg(
            F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0))
        ).first()
        if not open_weight:
            break
        share = (total - stopped) / open_weight
        now_full = full | (F.col("weight") * share > F.col("limit"))
        grown = df.filter(now_full & ~full).limit(1).count()
        full = F.col("weight") * share > F.col("limit") if grown else full
        if not grown:
            break
    target = F.when(full, F.col("limit")).otherwise(F.col("weight") * share)
    return df.withColumn("target", target).drop("weight", "limit")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 for each key: a Feistel network that walks
    on until it is back inside the range; with ``back`` its inverse."""
    index, size = index.astype(np.uint64), size.astype(np.uint64)
    half = np.uint64(1)
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2), 1).astype(np.uint64)
    mask = (half << bits) - half
    key = key.astype(np.int64).view(np.uint64)
    out, todo = index.copy(), np.ones(len(index), bool)
    while todo.any():
        value, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        left, right = value >> b, value & m
        if back:
            left, right = right, left
        for turn in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            mixed = (right + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & m)
        if back:
            left, right = right, left
        out[todo] = (left << b) | right
        todo[todo] = out[todo] >= size[todo]
    return out.astype(np.int64)


@pandas_udf(LongType())
def _permute(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


@pandas_udf(LongType())
def _place(block: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(block.to_numpy(), size.to_numpy(), key.to_numpy(), back=True))


def quotas(sources: DataFrame, seed: int = 42) -> DataFrame:
    """``blocks, last_words, quota, cut`` added to ``rank, source_size, target``.

    ``quota`` slots have the target's words, rounded to whole words, once ``cut`` words are left off the
    last slot.  Whole cycles take every block; the last cycle's slots are counted with
    regard to where its permutation puts the source's last block, which may be short.
    """
    size, take = F.col("source_size"), F.round("target").cast("long")
    df = sources.withColumn("blocks", F.greatest(F.ceil(size / BLOCK_WORDS), F.lit(1)).cast("long"))
    df = df.withColumn("last_words", size - (F.col("blocks") - 1) * BLOCK_WORDS)
    df = df.withColumn("_cycles", F.when(size > 0, F.floor(take / size)).otherwise(0).cast("long"))
    df = df.withColumn("_rest", F.when(size > 0, take - F.col("_cycles") * size).otherwise(0).cast("long"))
    df = df.withColumn("_short_at", _place(F.col("blocks") - 1, "blocks", F.xxhash64(F.lit(seed + 1), "rank", "_cycles")))
    plain = F.ceil(F.col("_rest") / BLOCK_WORDS).cast("long")
    longer = F.greatest(F.col("_short_at"), F.ceil((F.col("_rest") - F.col("last_words")) / BLOCK_WORDS).cast("long")) + 1
    with_short = F.col("_short_at") < plain
    df = df.withColumn("_more", F.when(with_short, longer).otherwise(plain))
    have = F.col("_more") * BLOCK_WORDS - F.when(with_short, BLOCK_WORDS - F.col("last_words")).otherwise(0)
    df = df.withColumn("quota", F.col("_cycles") * F.col("blocks") + F.col("_more")).withColumn("cut", have - F.col("_rest"))
    return df.drop("_cycles", "_rest", "_short_at", "_more")


def shard_counts(sources: DataFrame, seed: int = 42) -> DataFrame:
    """``rank, shard, first, n``: how many slots of each source every output shard has, none left out.

    A source's quota is dealt to the shards by a multinomial of equal chances, through ranges of
    ``FAN`` parts where shards are many; ``first`` is its first slot there.  Draws are seeded
    by source and range, so that lost tasks draw the same again.
    """
    count = sources.agg(F.sum("quota")).first()[0] or 0
    span = shards = partitions_for(count, SHARD_BLOCKS)
    rows = sources.filter("quota > 0").select(
        F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("end"),
        F.lit(0).cast("long").alias("first"), F.col("quota").alias("n"),
    )
    while span > 1:
        step = -(-span // FAN)

        def dealt(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rank, low, high, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                    starts = np.arange(low, high, step)
                    ends = np.minimum(starts + step, high)
                    drawn = np.random.default_rng([seed, rank, low, high]).multinomial(n, (ends - starts) / (high - low))
                    firsts = first + np.cumsum(drawn) - drawn
                    some = np.flatnonzero(drawn)
                    arrays = [np.full(len(some), rank), starts[some], ends[some], firsts[some], drawn[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=batch.schema.names)

        rows = land(rows.mapInArrow(dealt, "rank long, shard long, end long, first long, n long"))
        span = step
    return rows.drop("end")


def slots(sources: DataFrame, seed: int = 42) -> DataFrame:
    """``shard, source_rank, slot, block, cycle, words``: one row for each block that the mix takes, ``words`` of it.

    ``sources`` is what ``quotas`` gives.
    """
    counts = shard_counts(sources, seed)
    shards = (counts.agg(F.max("shard")).first()[0] or 0) + 1
    known = sources.select(F.col("rank").cast("long").alias("rank"), "blocks", "last_words", "quota", "cut")
    drawn = counts.join(known, "rank").repartition(min(shards, EXPANDING_TASKS), "shard")
    each = drawn.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    each = each.withColumn("cycle", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    index = F.col("slot") - F.col("cycle") * F.col("blocks")
    each = each.withColumn("block", _permute(index, "blocks", F.xxhash64(F.lit(seed + 1), "rank", "cycle")))
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_words")).otherwise(BLOCK_WORDS)
    left_off = F.when(F.col("slot") == F.col("quota") - 1, F.col("cut")).otherwise(0)
    return each.select("shard", F.col("rank").alias("source_rank"), "slot", "block", "cycle", (whole - left_off).alias("words"))


def _sources(base: DataFrame, seed: int) -> DataFrame:
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    return land(quotas(targets(sizes), seed))


def _streams(base: DataFrame, sources: DataFrame) -> DataFrame:
    """``base`` with ``_rank, source_size, target`` and the place ``_start, _end`` of its words in its source's stream.

    Groups of documents by hash follow each other; a group that rows alike make large is parted by row.
    """
    groups = partitions_for(base.count(), GROUP_DOCS)
    known = sources.select(F.col("source").alias("_of"), F.col("rank").cast("long").alias("_rank"), "source_size", "target")
    docs = base.join(known, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    docs = docs.withColumn("_group", F.pmod("_hash", F.lit(groups))).withColumn("_part", F.lit(0).cast("long"))
    crowded = land(docs.groupBy("_rank", "_group").agg(F.count("*").alias("_n")).filter(F.col("_n") > 4 * GROUP_DOCS))
    if not crowded.isEmpty():
        docs = docs.join(crowded, ["_rank", "_group"], "left")
        parts = F.coalesce(F.ceil(F.col("_n") / GROUP_DOCS), F.lit(1))
        docs = docs.withColumn("_part", F.pmod(F.xxhash64("_uid"), parts)).drop("_n")
    keys = ["_rank", "_group", "_part"]
    sums = docs.groupBy(*keys).agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_rank").orderBy("_group", "_part")) - F.col("_sum")
    starts = sums.select(*keys, before.alias("_start"))
    order = Window.partitionBy(*keys).orderBy("_hash", id_order("_id"), "_uid")
    docs = docs.withColumn("_upto", F.sum("_size").over(order)).join(starts, keys)
    docs = docs.withColumn("_end", F.col("_start") + F.col("_upto")).withColumn("_start", F.col("_end") - F.col("_size"))
    return docs.drop("_upto", "_group", "_part")


def _pieces(base: DataFrame, seed: int) -> DataFrame:
    """``base`` (``_uid, _id, _source, _hash, _size``) with its blocks and the times each is taken: one row for each
    document and block, ``_from, _to`` within the document, the last ``_less`` words of it once less than ``_times``."""
    sources = _sources(base, seed)
    # Landed so that its size is known: a plan would take it for as small as the sources it grows from.
    taken = land(slots(sources, seed).groupBy("source_rank", "block").agg(F.count("*").alias("_times"), F.min("words").alias("_least")))
    docs = _streams(base, sources)
    first, last = F.floor(F.col("_start") / BLOCK_WORDS), F.floor((F.col("_end") - 1) / BLOCK_WORDS)
    each = docs.withColumn("_block", F.explode_outer(F.when(F.col("_size") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("_block") * BLOCK_WORDS, F.col("_start"))
    high = F.least((F.col("_block") + 1) * BLOCK_WORDS, F.col("_end"))
    each = each.withColumn("_low", low).withColumn("_high", high)
    joined = each.join(taken, (F.col("_rank") == F.col("source_rank")) & (F.col("_block") == F.col("block")), "left")
    least = F.coalesce("_least", F.lit(BLOCK_WORDS))
    less = F.greatest(F.col("_high") - F.greatest(F.col("_low"), F.col("_block") * BLOCK_WORDS + least), F.lit(0))
    return joined.select(
        "_uid", "_id", "_size", "source_size", "target",
        (F.col("_low") - F.col("_start")).alias("_from"), (F.col("_high") - F.col("_start")).alias("_to"),
        F.coalesce("_times", F.lit(0)).alias("_times"), F.coalesce(less, F.lit(0)).alias("_less"),
    )


def _base(docs: DataFrame, *more: Column | str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("_uid"),
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        F.xxhash64("doc_id", "text").alias("_hash"),
        F.size(words(F.col("text"))).cast("long").alias("_size"),
        *more,
    )


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Null and empty texts have size 0 and are never taken; documents without a source are
    a source of their own, the last; repeated rows count each; an empty table gives an
    empty result.  Other columns of ``docs`` are not read.
    """
    pieces = _pieces(land(_base(docs)), seed)
    taken = F.coalesce(F.sum((F.col("_to") - F.col("_from")) * F.col("_times") - F.col("_less")), F.lit(0)).cast("long")
    out = pieces.groupBy("_uid", "_id", "_size", "source_size", "target").agg(taken.alias("taken"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")


#: White space between words, as ``words`` splits.
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the beginnings and ends of the words of a text."""
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(text, np.uint8)], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


@pandas_udf(ArrayType(StringType()))
def _passes_of(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """For each text its passes: the words of spans (from, to, times) taken that often, white space between
    neighbours as it was and a space over gaps.  Null for null."""
    out = []
    for text, taken in zip(texts, spans):
        if text is None:
            out.append(None)
            continue
        raw = text.encode()
        begins, ends = _word_places(raw)
        passes = []
        for turn in range(1, max(s["t"] for s in taken) + 1):
            runs: list[list[int]] = []
            for s in taken:
                if s["t"] < turn:
                    continue
                if runs and runs[-1][1] == s["f"]:
                    runs[-1][1] = s["u"]
                else:
                    runs.append([s["f"], s["u"]])
            whole = runs == [[0, len(begins)]]
            passes.append(text if whole else b" ".join(raw[begins[f] : ends[u - 1]] for f, u in runs).decode())
        out.append(passes)
    return pd.Series(out)


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document comes once for each pass over it: its first pass has the words of blocks
    taken at least once, its second of those taken twice, and so on; words that are not
    taken are left out.  ``text`` is kept as it is where all its words are taken; else white space
    between words that stay neighbours is kept, and a space stands for what is left out.
    ``n_chars`` is set again where ``docs`` has it.  Null and empty texts are never taken; a missing id or
    source and repeated rows are as in ``mix``; an empty table gives an empty result.
    """
    names = docs.columns
    kept = [plain(c).alias(f"_col_{i}") for i, c in enumerate(names)]
    text = F.col(f"_col_{names.index('text')}")
    base = land(_base(docs, *kept), release=True)
    pieces = _pieces(base.select("_uid", "_id", "_source", "_hash", "_size"), seed).filter("_times > 0")
    span = lambda f, u, t: F.struct(f.alias("f"), u.alias("u"), t.cast("long").alias("t"))
    low, high, times = F.col("_from"), F.col("_to"), F.col("_times")
    middle = high - F.col("_less")
    parts = F.when(F.col("_less") > 0, F.array(span(low, middle, times), span(middle, high, times - 1))).otherwise(F.array(span(low, high, times)))
    pieces = pieces.select("_uid", F.explode(parts).alias("_span")).filter("_span.f < _span.u and _span.t > 0")
    spans = pieces.groupBy(F.col("_uid").alias("_of")).agg(
        F.array_sort(F.collect_list("_span")).alias("_spans"),
        F.max("_span.t").alias("_passes"),
        F.sum((F.col("_span.u") - F.col("_span.f")) * F.col("_span.t")).alias("_taken"),
    )
    each = base.join(spans, F.col("_uid") == F.col("_of"))
    cut = F.col("_taken") < F.col("_size") * F.col("_passes")
    each = each.withColumn("_texts", _passes_of(F.when(cut, text), F.when(cut, F.col("_spans"))))
    each = each.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), "_passes")))
    each = each.withColumn("_text", F.coalesce(F.element_at("_texts", F.col("_pass").cast("int")), text))
    out = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return each.select(*(out.get(c, F.col(f"_col_{i}")).cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(names)))


@pandas_udf(ArrayType(StructType([StructField("block", LongType()), StructField("at", LongType()), StructField("text", StringType())])))
def _block_texts(texts: pd.Series, starts: pd.Series) -> pd.Series:
    """The parts of each text in its source's blocks, ``starts`` being its place in the stream."""
    out = []
    for text, start in zip(texts, starts):
        raw = text.encode()
        begins, ends = _word_places(raw)
        inner = np.arange(start // BLOCK_WORDS * BLOCK_WORDS + BLOCK_WORDS, start + len(begins), BLOCK_WORDS) - start
        cuts = [0, *inner.tolist(), len(begins)]
        out.append([((start + f) // BLOCK_WORDS, start + f, raw[begins[f] : ends[u - 1]].decode()) for f, u in zip(cuts, cuts[1:])])
    return pd.Series(out)


def mixed_shards(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix as output shards: ``shard, place, source, text``, a row for each block that a shard takes.

    Blocks meet the slots by their index; ``place`` counts a shard's blocks from 0 in pseudorandom order.
    A block runs over the ends of documents; a space stands between them.  Rows without words are in
    no block, rows without a source are the last source, repeated rows count each; an empty table gives none.
    """
    base = land(_base(docs, F.col("text").alias("_text")), release=True)
    sources = _sources(base, seed)
    docs = _streams(base.filter("_size > 0"), sources)
    parts = docs.select("_rank", F.explode(_block_texts("_text", "_start")).alias("_of")).select("_rank", "_of.*")
    held = F.array_sort(F.collect_list(F.struct("at", "text")))
    blocks = land(parts.groupBy("_rank", "block").agg(F.array_join(F.transform(held, lambda p: p.getField("text")), " ").alias("_whole")))
    taken = slots(sources, seed).withColumnRenamed("source_rank", "_rank")
    named = sources.select(F.col("rank").cast("long").alias("_rank"), "source", "blocks", "last_words")
    joined = taken.join(blocks, ["_rank", "block"]).join(named, "_rank")
    full = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_words")).otherwise(BLOCK_WORDS)
    first_words = F.array_join(F.slice(words(F.col("_whole")), 1, F.col("words").cast("int")), " ")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "_rank", "slot"), "_rank", "slot")
    return joined.select(
        "shard", (F.row_number().over(order) - 1).cast("long").alias("place"), "source",
        F.when(F.col("words") < full, first_words).otherwise(F.col("_whole")).alias("text"),
    )

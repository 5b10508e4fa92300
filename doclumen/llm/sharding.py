"""K-d tree sharding by metadata, balanced in bytes (operator 1).

Native: DataFrame functions only.  Every level splits all open nodes at once; a node's
weighted median is found by histograms of its rows' keys, 16 bits finer each round, so
what is aggregated is bounded by the number of nodes and bins and never by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclumen.llm.common import drop, land

#: Bits of a key that one histogram resolves, and bits of a key in all.
STEP_BITS = 16
KEY_BITS = 64
#: Rows are numbered within groups of so many, so that no task sorts a whole shard.
SLOT_GROUP_BITS = 16


def text_dimension(column: Column | str) -> Column:
    """A number that orders texts as their first six bytes do; missing ones come first."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def document_dimensions() -> dict[str, Column]:
    """Metadata of ``documents``: source, language, id and the text's length on a log scale."""
    return {
        "source": text_dimension("source"),
        "lang": text_dimension("lang"),
        "doc_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)),
        "length": F.log2(F.col("_size").cast("double")),
    }


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none if it is missing) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _split(level: DataFrame, names: list[str]) -> DataFrame:
    """One level of the tree: nodes of more than one shard are cut in two.

    ``level`` has ``_uid, _size, _first, _shards`` and dimensions in 0 to 1.  A node's
    shards are numbered from ``_first``; the left child gets half of them, rounded down,
    and that share of the bytes.
    """
    nodes = level.groupBy("_first", "_shards").agg(
        F.sum("_size").alias("_bytes"),
        *(F.min(n).alias(f"{n}_lo") for n in names),
        *(F.max(n).alias(f"{n}_hi") for n in names),
    )
    widths = [F.col(f"{n}_hi") - F.col(f"{n}_lo") for n in names]
    widest = F.array_position(F.array(*widths), F.array_max(F.array(*widths)))
    left = F.floor(F.col("_shards") / 2)
    nodes = nodes.select(
        "_first",
        widest.alias("_widest"),
        F.element_at(F.array(*(F.col(f"{n}_lo") for n in names)), widest.cast("int")).alias("_lo"),
        F.array_max(F.array(*widths)).alias("_width"),
        left.alias("_left"),
        (F.col("_bytes") * left / F.col("_shards")).alias("_rest"),
        F.lit(0).cast("long").alias("_bin"),
    ).filter("_left > 0")
    state = land(nodes)
    value = F.element_at(F.array(*(F.col(n) for n in names)), F.col("_widest").cast("int"))
    scaled = F.when(F.col("_width") > 0, (value - F.col("_lo")) / F.col("_width")).otherwise(0.0)
    # 31 bits of the dimension, 32 bits that part rows equal in it: a positive long.
    place = F.floor(scaled * F.lit(2.0**31 - 1)).cast("long")
    tie = F.xxhash64("_uid").bitwiseAND(F.lit(2**32 - 1))
    key = F.shiftleft(place, 32).bitwiseOR(tie)

    for shift in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        keyed = level.join(state, "_first").withColumn("_key", key)
        if shift < KEY_BITS - STEP_BITS:
            keyed = keyed.filter(F.shiftright("_key", shift + STEP_BITS) == F.col("_bin"))
        bins = keyed.groupBy("_first", F.shiftright("_key", shift).alias("_next")).agg(
            F.sum("_size").alias("_weight"), F.count("*").alias("_rows")
        )
        upto = F.sum("_weight").over(Window.partitionBy("_first").orderBy("_next"))
        # A node has at most 2 ** STEP_BITS bins here, whatever its rows.
        bins = bins.withColumn("_upto", upto).join(state.drop("_weight", "_rows"), "_first")
        crossed = bins.filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_weight") < F.col("_rest")))
        finer = land(
            crossed.select(
                "_first", "_widest", "_lo", "_width", "_left",
                (F.col("_rest") - F.col("_upto") + F.col("_weight")).alias("_rest"),
                F.col("_next").alias("_bin"), "_weight", "_rows",
            )
        )
        drop(state)
        state = finer
        if (state.agg(F.max("_rows")).first()[0] or 1) == 1:
            break

    at = F.shiftright(key, shift)
    goes_left = (at < F.col("_bin")) | ((at == F.col("_bin")) & (2 * F.col("_rest") >= F.col("_weight")))
    goes_right = F.col("_left").isNotNull() & ~goes_left
    out = level.join(state, "_first", "left").select(
        "_uid", "_size", *names, *(c for c in level.columns if c.startswith("_keep_")),
        F.when(goes_right, F.col("_first") + F.col("_left")).otherwise(F.col("_first")).cast("long").alias("_first"),
        F.when(F.col("_left").isNull(), F.col("_shards"))
        .when(goes_left, F.col("_left"))
        .otherwise(F.col("_shards") - F.col("_left")).cast("long").alias("_shards"),
    )
    result = land(out)
    drop(state)
    return result


def kd_shards(
    docs: DataFrame,
    dimensions: dict[str, Column] | None = None,
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Give ``shards``, or ``target_bytes`` for as many shards as leave none much above it.
    A node is cut along the dimension that is widest in it (as a share of that
    dimension's width over all rows), where the bytes of its rows reach the share of the
    shards on the left; rows equal in it are parted by a hash, so that a source with a
    third of all rows, or a text that does, is cut like any other.

    Missing texts count as empty and missing metadata as smallest; repeated rows are
    placed one by one; an empty table gives an empty result; with fewer rows than shards
    some shards stay empty.  Only ``doc_id``, ``text`` and what ``dimensions`` name are
    read, so other columns may have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_size", text_size(F.col("text")))
    names = list(dims := dimensions or document_dimensions())
    base = land(
        df.select(
            F.monotonically_increasing_id().alias("_uid"),
            "_size",
            F.col("doc_id").alias("_keep_id"),
            F.crc32(text.cast("binary")).alias("_keep_crc"),
            F.lit(0).cast("long").alias("_first"),
            *(c.cast("double").alias(f"_dim_{n}") for n, c in dims.items()),
        )
    )
    names = [f"_dim_{n}" for n in names]
    bounds = base.agg(F.sum("_size").alias("bytes"), *(f(n).alias(f"{n}{k}") for n in names for f, k in ((F.min, 0), (F.max, 1)))).first()
    if shards is None:
        shards = max(1, -(-(bounds["bytes"] or 0) // (target_bytes or 1 << 30)))

    def scaled(n: str) -> Column:
        lo, hi = bounds[f"{n}0"], bounds[f"{n}1"]
        return ((F.col(n) - lo) / (hi - lo) if hi is not None and hi > lo else F.lit(0.0)).alias(n)

    level = base.select(
        "_uid", "_size", "_keep_id", "_keep_crc", *(scaled(n) for n in names),
        "_first", F.lit(shards).cast("long").alias("_shards"),
    )
    previous = base
    for _ in range((shards - 1).bit_length()):
        level = _split(level, names)
        drop(previous)
        previous = level
    group = F.shiftright("_uid", SLOT_GROUP_BITS)
    placed = level.withColumn("_group", group)
    counts = placed.groupBy("_first", "_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_first").orderBy("_group")) - F.col("_n")
    starts = counts.select(F.col("_first").alias("_f"), F.col("_group").alias("_g"), before.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_first", "_group").orderBy("_uid")) - 1
    numbered = placed.withColumn("_within", within)
    return numbered.join(starts, (F.col("_first") == F.col("_f")) & (F.col("_group") == F.col("_g"))).select(
        F.col("_keep_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_keep_crc").alias("text_crc32"),
        F.col("_first").cast("int").alias("shard"),
        (F.col("_start") + F.col("_within")).alias("slot"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` below ``path``, one folder for each shard; ids must be unique."""
    shard = placed.select(F.col("doc_id").alias("_of"), F.col("shard").alias("_shard"))
    docs.join(shard, F.col("doc_id").eqNullSafe(F.col("_of"))).drop("_of").write.partitionBy("_shard").parquet(path)

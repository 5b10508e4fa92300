"""The best documents of keyword sets, without scoring what cannot be among them.

A posting is one keyword's score in one document.  The best postings of each keyword
give every keyword set some documents, and the score of the last place they reach is a
floor.  From the best score of each keyword it follows which keywords cannot carry a
document over the floor by themselves, all of them together: documents that have only
these are never met.  A posting of another keyword is met if its document could still reach
the floor with the best of all the others.  What is left is exact: a document at or
above the floor keeps all of its postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclumen.runtime import broadcast_if_small, materialize


def land_postings(hits: DataFrame) -> DataFrame:
    """Land ``project, path, hits`` as postings, the highest of a file first, so that a scan for high
    ones can pass over the rest."""
    postings = hits.select("project", "path", F.inline("hits"))
    return materialize(postings.sortWithinPartitions(F.desc("tenths"), "project", "pattern"))


def keyword_bounds(words: DataFrame, postings: DataFrame, top: int, least_score: int) -> DataFrame:
    """``words(project, keywords, pattern)`` that occur, with what bounds their postings.

    ``floor`` is a score that ``top`` documents reach, or ``least_score``; ``least`` is the
    lowest tenths that matter for the pattern; ``essential`` tells the patterns one of which a
    document needs, ``slack`` what all the others of the set can add.
    """
    by_impact = Window.partitionBy("project", "pattern").orderBy(F.desc("tenths"), F.desc("path"))
    seeds = materialize(
        postings.withColumn("_place", F.row_number().over(by_impact)).where(F.col("_place") <= top)
    )
    best = seeds.where("_place = 1").select("project", "pattern", F.col("tenths").alias("most"))
    known = words.join(broadcast_if_small(materialize(best)), ["project", "pattern"])
    in_set = Window.partitionBy("project", "keywords")
    known = known.withColumn("ceiling", F.sum("most").over(in_set)).withColumn(
        "upto", F.sum("most").over(in_set.orderBy("most", "pattern"))
    )
    reached = (
        words.join(broadcast_if_small(seeds.drop("_place")), ["project", "pattern"])
        .groupBy("project", "keywords", "path")
        .agg(F.sum("tenths").alias("reached"))
        .withColumn("_place", F.row_number().over(in_set.orderBy(F.desc("reached"))))
        .where(F.col("_place") == top)
        .select("project", "keywords", "reached")
    )
    floor = F.greatest(F.coalesce("reached", F.lit(0)), F.lit(least_score)).cast("long")
    bounded = known.join(reached, ["project", "keywords"], "left").withColumn("floor", floor)
    essential = F.col("upto") >= F.col("floor")
    return materialize(
        bounded.select(
            "project",
            "keywords",
            "pattern",
            "floor",
            (F.col("floor") - F.col("ceiling") + F.col("most")).alias("least"),
            essential.alias("essential"),
            F.sum(F.when(essential, 0).otherwise(F.col("most"))).over(in_set).alias("slack"),
        )
    )


def needed_postings(bounds: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of essential patterns from their lowest score that matters to any set on."""
    wanted = materialize(
        bounds.where("essential").groupBy("project", "pattern").agg(F.min("least").alias("_from"))
    )
    lowest = wanted.agg(F.min("_from")).first()[0]
    high = postings.where(F.col("tenths") >= (lowest or 0))  # reaches the scan
    return (
        high.join(broadcast_if_small(wanted), ["project", "pattern"])
        .where(F.col("tenths") >= F.col("_from"))
        .drop("_from")
    )


def top_documents(words: DataFrame, postings: DataFrame, top: int, least_score: int) -> DataFrame:
    """``project, keywords, path, tenths, doc_rank``: the ``top`` documents of each keyword set with
    at least ``least_score``, by score and path, both falling.

    ``words`` and ``postings`` are read several times: pass materialised tables.
    """
    # Keyword sets and patterns are long and few: numbers stand for them where documents are met.
    numbered = materialize(words.select("project", "keywords").distinct().withColumn("_set", F.monotonically_increasing_id()))
    short = words.join(broadcast_if_small(numbered), ["project", "keywords"])
    bounds = keyword_bounds(
        materialize(short.select("project", F.col("_set").alias("keywords"), "pattern")), postings, top, least_score
    )
    key = ["keywords", "path"]
    met = needed_postings(bounds, postings).join(
        broadcast_if_small(materialize(bounds.where("essential"))), ["project", "pattern"]
    )
    candidates = (
        met.where(F.col("tenths") >= F.col("least"))
        .groupBy(*key)
        .agg(F.sum("tenths").alias("tenths"), F.max("floor").alias("floor"), F.max("slack").alias("slack"))
        .where(F.col("tenths") + F.col("slack") >= F.col("floor"))
    )
    candidates = materialize(candidates.select(*key, "tenths"))
    # The other patterns are looked up for candidates only.
    others = bounds.where(~F.col("essential")).select("project", "keywords", "pattern")
    named = materialize(others.select("project", "pattern").distinct().withColumn("_word", F.monotonically_increasing_id()))
    named = broadcast_if_small(named)
    others = materialize(others.join(named, ["project", "pattern"]).select("keywords", "_word"))
    asked = candidates.select(*key).join(broadcast_if_small(others), "keywords")
    looked = postings.join(named, ["project", "pattern"]).select("_word", "path", "tenths")
    more = asked.join(looked, ["_word", "path"]).groupBy(*key).agg(F.sum("tenths").alias("_more"))
    total = F.col("tenths") + F.coalesce("_more", F.lit(0))
    order = Window.partitionBy("keywords").orderBy(F.desc("tenths"), F.desc("path"))
    best = (
        candidates.join(more, key, "left")
        .select(*key, total.cast("int").alias("tenths"))
        .where(F.col("tenths") >= least_score)
        .withColumn("doc_rank", F.row_number().over(order))
        .where(F.col("doc_rank") <= top)
    )
    return best.withColumnRenamed("keywords", "_set").join(broadcast_if_small(numbered), "_set").select(
        "project", "keywords", "path", "tenths", "doc_rank"
    )

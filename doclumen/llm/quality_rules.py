"""Quality rules on documents, and on hosts by shrunken failure rates (operator 10).

Native: DataFrame functions only.  A document's measures come from one pass over its
text; everything that is aggregated or joined afterwards is a narrow landed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclumen.llm.common import land, words

#: A window of so many words that occurs twice in a text counts as repeated.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A host is turned down if its shrunken failure rate is above this.
MAX_HOST_RATE = 0.5
#: Everything but the counted symbols.
NOT_SYMBOLS = "[^#*$%&|<>]+"


def _pairwise(values: Column, step: int) -> Column:
    """A hash of each element with the one ``step`` later; shorter by ``step``."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    A missing text counts as empty.  Columns of ``docs`` with these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumns({"_words": words(F.col(text)), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, NOT_SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    for step in (1, 2, 4):
        df = df.withColumn("_h", _pairwise(F.col("_h"), step))
    twice = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _sorted_places())
    df = df.withColumn("_at", twice).drop("_h")
    gaps = F.zip_with(
        F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))),
        F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))),
        lambda later, earlier: F.least(later - earlier, F.lit(WINDOW)),
    )
    total = F.aggregate(gaps, F.lit(WINDOW), lambda acc, gap: acc + gap)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_at") > 0, total), F.lit(0)).cast("long")).drop("_at")


def _sorted_places() -> Column:
    """Ascending places of the windows whose hash occurs again in the text."""
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.transform(F.array(placed), _twice)
    return F.array_sort(F.element_at(marked, 1))


def _twice(placed: Column) -> Column:
    """Places of elements that equal a neighbour; bound once so that the sort runs once."""
    def same(k: Column, h: Column) -> Column:
        return F.coalesce(F.get(placed, k).getField("h") == h, F.lit(False))

    kept = F.filter(placed, lambda x, k: same(k - 1, x.getField("h")) | same(k + 1, x.getField("h")))
    return F.transform(kept, lambda x: x.getField("i"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def host_rates(docs: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, failures, rate``: failure rates shrunken by an empirical beta prior.

    The prior's mean and strength are those of the hosts' raw rates by the method of
    moments, with the variance that sampling alone would give taken off.  Hosts that do
    not differ beyond it share one rate.  A missing host is a host of its own.
    """
    hosts = docs.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")
    )
    hosts = hosts.withColumn("_raw", F.col("failures") / F.col("n"))
    k, mean, rate_var, within = hosts.agg(
        F.count("*"),
        F.sum("failures") / F.sum("n"),
        F.coalesce(F.var_samp("_raw"), F.lit(0.0)),
        F.avg(1.0 / F.col("n")),
    ).first()
    if not k:
        return hosts.select("host", "n", "failures", F.col("_raw").alias("rate"))
    spread = mean * (1 - mean)
    between = rate_var - spread * within
    strength = spread / between - 1 if between > 0 else float("inf")
    if strength == float("inf"):
        rate = F.lit(float(mean))
    else:
        strength = max(strength, 1e-6)
        rate = (F.col("failures") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "failures", rate.alias("rate"))


def quality_rules(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id``, measures, ``base_failed``, ``host_rate``, ``kept`` for every row of ``docs``.

    A document is kept if it passes the base rules and its host's shrunken rate is at
    most ``max_host_rate``.  Null and empty texts have no words and so fail; repeated
    rows are judged one by one; an empty table gives an empty result; other columns of
    ``docs`` are not looked at, whatever their names.
    """
    df = measures(docs.select("doc_id", F.col(host).alias("_host"), "text"))
    df = land(df.drop("text").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))))
    verdicts = host_rates(df, "_host", "base_failed").select(F.col("host").alias("_of"), F.col("rate").alias("host_rate"))
    # Hosts are as many as the data has; adaptive execution broadcasts them if they are few.
    joined = df.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).drop("_of", "_host")

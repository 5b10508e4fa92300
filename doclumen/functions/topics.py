"""Keywords of a topic or question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.functions.matching import with_spaces


def _alias_table() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.array(*[F.lit(k) for k in keywords]).alias("keywords"),
            )
            for key, keywords in fv.TOPIC_ALIASES.items()
        ]
    )


def meaningful_words(text: Column) -> Column:
    words = F.transform(
        F.split(F.lower(text), with_spaces(r"(?U)\s+")),
        lambda w: F.btrim(w, F.lit(fv.WORD_PUNCTUATION)),
    )
    return F.filter(
        words,
        lambda w: (F.length(w) > fv.SHORT_WORD) & ~w.isin(fv.STOP_WORDS),
    )


def _touches(word: Column, alias: Column) -> Column:
    """Does a keyword reach an alias: containment with its key, a prefix of a synonym."""
    key = alias["key"]
    return (
        F.contains(key, word)
        | F.contains(word, key)
        | F.exists(
            alias["keywords"],
            lambda k: F.startswith(k, word) | F.startswith(word, k),
        )
    )


def topic_keywords(text: Column) -> Column:
    """Distinct keywords, widened by the aliases one after the other.

    The keywords an alias adds are seen by the aliases after it, so the table is
    folded in order.  A text without a meaningful word is its own only keyword.
    """
    words = F.array_distinct(meaningful_words(text))
    widened = F.aggregate(
        _alias_table(),
        words,
        lambda found, alias: F.when(
            F.exists(found, lambda w: _touches(w, alias)),
            F.array_union(found, alias["keywords"]),
        ).otherwise(found),
    )
    return F.when(F.size(words) > 0, widened).otherwise(F.array(F.lower(text)))


def alias_keys() -> Column:
    return F.array(*[F.lit(key) for key in fv.TOPIC_ALIASES])


def related_topics(text: Column) -> Column:
    low = F.lower(text)
    return F.slice(
        F.filter(alias_keys(), lambda key: ~F.contains(low, key)),
        1,
        fv.RELATED_TOPICS,
    )


def relevance_tenths(low_text: Column, keyword: Column) -> Column:
    """Score of one keyword in a lower-case text, as integer tenths."""
    occurrences = (
        F.length(low_text) - F.length(F.replace(low_text, keyword, F.lit("")))
    ) / F.length(keyword)
    heading = F.contains(low_text, F.concat(F.lit("# "), keyword))
    return F.least(occurrences.cast("int"), F.lit(fv.COUNT_CAP)) + F.when(
        heading, F.lit(fv.HEADING_TENTHS)
    ).otherwise(F.lit(0))

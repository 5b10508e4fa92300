"""Answers to a batch of topics and questions from the projects' documents.

Queries of a project that ask for the same keywords share one ranking.  Keywords
are looked up in each document once for the whole batch; only documents that hold
a keyword are scored, and only winning documents are split into sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.functions.matching import strip_whitespace
from doclumen.functions.sections import sections
from doclumen.functions.topics import (
    alias_keys,
    related_topics,
    relevance_tenths,
    topic_keywords,
)
from doclumen.operators.occurrences import scored_documents
from doclumen.operators.ranking import land_postings, top_documents
from doclumen.runtime import broadcast_if_small, materialize
from doclumen.sources.docs import explain_docs


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def query_keywords(queries: DataFrame) -> DataFrame:
    """``queries(query_id, project, topic, question)`` with search text and keywords.

    A query needs a topic or a question; one with neither has no search text.
    """
    text = F.coalesce(_given(F.col("topic")), _given(F.col("question")))
    return queries.select(
        "query_id", "project", "topic", "question", text.alias("query")
    ).withColumn("keywords", F.array_sort(topic_keywords(F.col("query"))))


def keyword_sets(asked: DataFrame) -> DataFrame:
    return asked.where(F.col("query").isNotNull()).select("project", "keywords").distinct()


def rank_documents(wanted: DataFrame, docs: DataFrame, top: int = fv.TOP_DOCS) -> DataFrame:
    """Best documents per keyword set: ``project, keywords, path, tenths, doc_rank``.

    Scores are integer tenths.  Documents of a project with the same hits, copies above
    all, score the same for every query, so only the ``top`` of them by path can appear
    in a ranking; the others go before any query meets them.  Of the rest, a query meets
    those that can reach its last place (:mod:`doclumen.operators.ranking`).
    """
    words = materialize(
        wanted.select("project", "keywords", F.explode("keywords").alias("pattern"))
    )
    low = docs.select("project", "path", F.lower("content").alias("text"))
    alike = Window.partitionBy("project", "hits").orderBy(F.desc("path"))
    hits = (
        scored_documents(words.select("project", "pattern"), low)
        .withColumn("_copy", F.row_number().over(alike))
        .where(F.col("_copy") <= top)
    )
    return top_documents(words, land_postings(hits), top, fv.DOC_MIN_TENTHS)


def rank_sections(
    ranked: DataFrame,
    docs: DataFrame,
    per_doc: int = fv.TOP_SECTIONS_PER_DOC,
) -> DataFrame:
    """Best sections of the ranked documents.

    A document that several keyword sets rank is split once, and its sections are put into
    lower case once; then every set that ranks it meets them.  The ranked rows are few
    per keyword set; if they measure small they are broadcast, so that neither documents
    nor sections are shuffled.
    """
    winners = broadcast_if_small(materialize(ranked.select("project", "path").distinct()))
    # The outer form, as for the plain one the optimizer infers a filter on the
    # array's size, which would split every document a second time.
    split = (
        docs.join(winners, ["project", "path"])
        .select("project", "path", F.inline_outer(sections(F.col("content"))))
        .where(F.col("header").isNotNull())
        .select(
            "project",
            "path",
            "header",
            F.substring("body", 1, fv.SECTION_BODY_CHARS).alias("body"),
            F.lower(F.concat("header", F.lit("\n"), "body")).alias("_low"),
        )
    )
    score = F.aggregate(
        "keywords", F.lit(0), lambda sum_, word: sum_ + relevance_tenths(F.col("_low"), word)
    )
    order = Window.partitionBy("project", "keywords", "path").orderBy(
        F.desc("tenths"), F.desc("header"), F.desc("body")
    )
    return (
        split.join(broadcast_if_small(ranked), ["project", "path"])
        # Exploded, as the filter on a plain column would compute the score once more.
        .select("project", "keywords", "path", "doc_rank", "header", "body", F.explode(F.array(score)).alias("tenths"))
        .where(F.col("tenths") >= fv.SECTION_MIN_TENTHS)
        .withColumn("section_rank", F.row_number().over(order))
        .where(F.col("section_rank") <= per_doc)
    )


def _section_text() -> Column:
    return F.concat(
        F.lit("**"), "path", F.lit("** "), "header", F.lit("\n"), strip_whitespace(F.col("body"))
    )


def explain(files: DataFrame, queries: DataFrame) -> DataFrame:
    """One answer row per query, over the documents among ``files``."""
    docs = explain_docs(files)
    asked = materialize(query_keywords(queries))
    ranked = materialize(rank_documents(keyword_sets(asked), docs))
    sources = ranked.groupBy("project", "keywords").agg(
        F.array_sort(F.collect_list(F.struct("doc_rank", "path", "tenths"))).alias("_docs")
    )
    bodies = (
        rank_sections(ranked, docs)
        .groupBy("project", "keywords")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("doc_rank", "section_rank", _section_text().alias("text")))
            ).alias("_sections")
        )
    )
    has_docs = docs.select("project").distinct().withColumn("_has_docs", F.lit(True))
    answered = (
        asked.join(has_docs, "project", "left")
        .join(sources, ["project", "keywords"], "left")
        .join(bodies, ["project", "keywords"], "left")
    )
    return answered.select("query_id", "project", *_answer_columns())


def _answer_columns() -> list[Column]:
    query = F.col("query")
    valid = F.col("_has_docs").isNotNull() & query.isNotNull()
    found = valid & F.col("_docs").isNotNull()
    missed = valid & F.col("_docs").isNull()
    heading = F.when(
        _given(F.col("question")).isNotNull(),
        F.concat(F.lit(fv.ANSWER_HEADER), "question"),
    ).otherwise(F.concat(F.lit(fv.TOPIC_HEADER), "topic"))
    shown = F.slice(
        F.coalesce("_sections.text", F.array().cast("array<string>")), 1, fv.TOP_SECTIONS
    )
    explanation = F.concat(
        heading, F.lit("\n\n"), F.array_join(shown, fv.SECTION_SEPARATOR)
    )
    sources = F.transform(
        "_docs",
        lambda d: F.struct(
            d["path"].alias("path"), F.round(d["tenths"] / 10, 2).alias("relevance")
        ),
    )
    no_sources = F.array().cast("array<struct<path:string,relevance:double>>")
    return [
        valid.alias("ok"),
        F.when(valid, query).alias("query"),
        F.when(found, explanation)
        .when(
            missed,
            F.concat(F.lit("No documentation found for '"), query, F.lit("'")),
        )
        .alias("explanation"),
        F.when(found, sources).when(missed, no_sources).alias("sources"),
        F.when(found, related_topics(query)).alias("related_topics"),
        F.when(missed, alias_keys()).alias("suggestions"),
        F.when(query.isNull(), F.lit(fv.NO_QUERY_ERROR))
        .when(~valid, F.lit(fv.NO_DOCS_ERROR))
        .alias("error"),
        F.when(~valid & query.isNotNull(), F.lit(fv.NO_DOCS_HINT)).alias("hint"),
    ]

"""Registered queries: each runs an operator over the whole derived corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclumen.operators import coverage as cov
from doclumen.operators import colocated, extract, signatures, skips, symbols
from doclumen.plans import assess as plan
from doclumen.plans import explain as answers
from doclumen.plans import incremental, sinks
from doclumen.runtime import materialize, release
from doclumen.sources import docs, files, packages
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.spark_files(spark, sf_dir, inputs.CODE_FILES)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus, landed once: several operators of a job read it."""
    return materialize(inputs.spark_files(spark, sf_dir))


# -- sources and filters --


def coverage_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.coverage_docs(inputs.spark_files(spark, sf_dir))
    return found.select("project", "path", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def explain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.explain_docs(inputs.spark_files(spark, sf_dir))
    return found.select(
        "project", "path", F.length("content").alias("chars"), F.md5("content").alias("digest")
    )


def clean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.clean(inputs.spark_sql(spark, sf_dir, inputs.BINARY_FILES))
    return found.select("project", "path", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def package_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.package_dirs(_code(spark, sf_dir))


def skip_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _code(spark, sf_dir).select(
        "project",
        "path",
        skips.skips_cli(path).alias("skip_cli"),
        skips.skips_api(path).alias("skip_api"),
        skips.skips_config(path).alias("skip_config"),
        skips.skips_symbols(path).alias("skip_symbols"),
    )


# -- extraction --


def _cli(*only: extract.Extractor) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = extract.raw_features(_code(spark, sf_dir), ("cli",), only)
        return extract.cli_commands(raw)

    return run


def _api(*only: extract.Extractor) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = extract.raw_features(_code(spark, sf_dir), ("api",), only)
        return extract.api_endpoints(raw)

    return run


def _config(*only: extract.Extractor) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = extract.raw_features(_code(spark, sf_dir), ("config",), only)
        return extract.config_matches(raw)

    return run


def config_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = extract.raw_features(_code(spark, sf_dir), ("config",))
    return extract.config_matches(extract.dedup_raw(raw))


def all_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols(materialize(_code(spark, sf_dir))).drop("pos")


def public_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.public_symbols(symbols.symbols(materialize(_code(spark, sf_dir))))
    return found.groupBy("project", "type").agg(
        F.count("*").alias("symbols"), F.count_if(F.col("docstring") != "").alias("with_docstring")
    )


def key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = symbols.key_classes(symbols.symbols(materialize(_code(spark, sf_dir))))
    return best.select("project", "rank", "name", "path", "line", "docstring")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan.discover(materialize(_code(spark, sf_dir)))
    return found.select(
        "project", "category", "label", "path", "line", F.array_join("terms", "|").alias("terms")
    )


# -- coverage and scores --


def mention_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    found = materialize(plan.discover(files))
    terms = found.select("project", F.explode("terms").alias("term"))
    described = docs.coverage_docs(files)
    return cov.mentioned_terms(terms, described, signatures.signature_index(described))


def word_pair_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of another project's pairs of words a project's documents hold.

    There are far more forms than may be broadcast, so they go to the documents' buckets.  Terms and
    hits are distinct, so their rows are counted before they are joined.
    """
    texts = inputs.spark_sql(spark, sf_dir, inputs.PLAIN_TEXTS)
    landed = colocated.colocate(texts.select("project", "path", F.lower("text").alias("text")))
    terms = materialize(inputs.spark_sql(spark, sf_dir, inputs.WORD_PAIRS))
    release(spark)
    hits = cov.mentioned_terms(terms, landed, distinct=True)
    counted = hits.groupBy("project").agg(F.count("*").alias("mentioned"))
    return terms.groupBy("project").agg(F.count("*").alias("terms")).join(counted, "project", "left").select(
        "project", "terms", F.coalesce("mentioned", F.lit(0).cast("long")).alias("mentioned")
    )


def _coverage(strict: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cov.category_coverage(plan.measure(_files(spark, sf_dir), strict))
        return rows.select(
            "project", "category", "total", "documented", "coverage", "moon",
            F.array_join("undocumented", "|").alias("undocumented"),
        )

    return run


def core_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols as one category, strict and permissive side by side."""
    files = _files(spark, sf_dir)
    public = symbols.public_symbols(symbols.symbols(files))
    found = materialize(cov.features_from_symbols(public, "Core Modules"))
    strict = cov.feature_status(found, docs.coverage_docs(files), strict=True)
    permissive = cov.feature_status(found, docs.coverage_docs(files))
    both = strict.withColumn("mode", F.lit("strict")).unionByName(
        permissive.withColumn("mode", F.lit("permissive"))
    )
    return both.groupBy("project", "category", "mode").agg(
        F.count("*").alias("total"), F.count_if("documented").alias("documented")
    )


def undocumented_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of all three depths: one ranking cut at the deepest."""
    deepest = cov.undocumented_preview(plan.measure(_files(spark, sf_dir)), plan.preview_limit(3))
    return deepest.select(
        "project", "category", "rank", "label", "path", "line",
        (F.col("rank") <= plan.preview_limit(1)).alias("depth_1"),
        (F.col("rank") <= plan.preview_limit(2)).alias("depth_2"),
    )


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return plan.project_assessment(cov.category_coverage(plan.measure(files)), files)


_ASSESSMENT = (
    "project", "know", "uncertainty", "overall_coverage", "total_features",
    "documented_features", "assessment", "moon",
)


def project_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select(*_ASSESSMENT)


def incremental_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it was before some files came, went and changed, then brought up to date."""
    now = _files(spark, sf_dir)
    kind = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(100))
    old = F.when(kind == 1, F.concat(F.lit('os.getenv("OLD_KEY")\n'), F.substring("content", 1, 200)))
    was = now.where(kind != 0).withColumn("content", old.otherwise(F.col("content")))
    gone = now.where(kind == 2).withColumn("path", F.concat(F.lit("docs/gone-"), "path"))
    before, _ = incremental.update(materialize(was.unionByName(gone)))
    state, _ = incremental.update(now, before)
    return plan.project_assessment(incremental.categories(state), state.files).select(*_ASSESSMENT)


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select(
        "project", F.posexplode("recommendations").alias("position", "recommendation")
    )


def discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select(
        "project", "cli_commands", "classes", "public_functions", "api_endpoints", "config_options"
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = plan.report(_assessed(spark, sf_dir))
    day = F.to_date(F.lit("2026-01-01"))
    return sinks.findings(reports, day).select("run_date", "project", "impact", "finding")


def unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = plan.report(_assessed(spark, sf_dir))
    return sinks.unknowns(reports, F.to_date(F.lit("2026-01-01")))


def assess_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_json(plan.assess(_files(spark, sf_dir)))


# -- explain --


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.spark_sql(spark, sf_dir, inputs.QUERIES)


def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = answers.query_keywords(_queries(spark, sf_dir))
    return asked.select("query_id", "query", F.array_join("keywords", "|").alias("keywords"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = docs.explain_docs(_files(spark, sf_dir))
    asked = materialize(answers.query_keywords(_queries(spark, sf_dir)))
    ranked = materialize(answers.rank_documents(answers.keyword_sets(asked), found))
    return found, asked, ranked


def doc_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, asked, ranked = _ranked(spark, sf_dir)
    return asked.join(ranked, ["project", "keywords"]).select(
        "query_id", "project", "doc_rank", "path", "tenths"
    )


def section_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, asked, ranked = _ranked(spark, sf_dir)
    return asked.join(answers.rank_sections(ranked, found), ["project", "keywords"]).select(
        "query_id", "project", "path", "section_rank", "header", "body", "tenths"
    )


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = answers.explain(_files(spark, sf_dir), _queries(spark, sf_dir))
    return answered.select(
        "query_id",
        "project",
        "ok",
        "query",
        "explanation",
        F.array_join(F.transform("sources", lambda s: s["path"]), "|").alias("source_paths"),
        F.aggregate(
            "sources", F.lit(0).cast("int"), lambda n, s: n + F.round(s["relevance"] * 10).cast("int")
        ).alias("relevance_tenths"),
        F.array_join("related_topics", "|").alias("related_topics"),
        F.array_join("suggestions", "|").alias("suggestions"),
        "error",
        "hint",
    )


QUERIES: dict[str, Query] = {
    "clean_files": clean_files,
    "coverage_docs": coverage_docs,
    "explain_docs": explain_docs,
    "package_dirs": package_dirs,
    "skip_filters": skip_filters,
    "argparse_commands": _cli(extract.argparse_subcommands, extract.argparse_progs),
    "click_commands": _cli(extract.click_commands, extract.click_groups),
    "typer_commands": _cli(extract.typer_commands),
    "fire_commands": _cli(extract.fire_commands),
    "fastapi_endpoints": _api(extract.fastapi_endpoints),
    "flask_endpoints": _api(extract.flask_endpoints),
    "django_routes": _api(extract.django_routes),
    "env_vars": _config(extract.getenv_options, extract.environ_options),
    "pydantic_settings": _config(
        extract.settings_field_options, extract.settings_bare_options
    ),
    "django_settings": _config(extract.django_settings),
    "config_dedup": config_dedup,
    "symbols": all_symbols,
    "public_symbols": public_symbols,
    "key_classes": key_classes,
    "features": features,
    "mention_hits": mention_hits,
    "word_pair_mentions": word_pair_mentions,
    "category_coverage": _coverage(strict=False),
    "category_coverage_strict": _coverage(strict=True),
    "core_modules": core_modules,
    "undocumented_preview": undocumented_preview,
    "project_assessment": project_assessment,
    "incremental_assessment": incremental_assessment,
    "recommendations": recommendations,
    "discovery_counts": discovery_counts,
    "findings": findings,
    "unknowns": unknowns,
    "assess_report_json": assess_report_json,
    "topic_keywords": topic_keywords,
    "doc_ranking": doc_ranking,
    "section_ranking": section_ranking,
    "explanations": explanations,
}

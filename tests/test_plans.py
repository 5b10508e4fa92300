"""Physical plans: what must not be shuffled, repeated or collected."""

import pytest
from pyspark.sql import functions as F

from doclumen.operators import coverage as cov
from doclumen.operators import extract, occurrences, symbols
from doclumen.plans import explain as answers
from doclumen.runtime import materialize
from doclumen.sources import docs


@pytest.fixture
def landed(spark, make_files, tmp_path):
    files = make_files(
        {
            "pkg/__init__.py": "",
            "pkg/m.py": "class A:\n    pass\nadd_parser('x')\n",
            "docs/a.md": "# A\nx\n",
        }
    )
    files.write.parquet(str(tmp_path / "files"))
    return spark.read.parquet(str(tmp_path / "files"))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_is_one_scan_without_a_shuffle(landed):
    plan = physical(extract.raw_features(landed))
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan


def test_extraction_runs_once_per_file(landed):
    plan = physical(extract.raw_features(landed))
    assert plan.count("Generate inline") == 1
    filters = [line for line in plan.splitlines() if " Filter " in line]
    assert not any("regexp_replace" in line for line in filters)


def test_small_pattern_sets_leave_the_documents_in_place(spark, landed):
    patterns = spark.createDataFrame([("p", "x")], "project string, pattern string")
    plan = physical(occurrences.scored_documents(patterns, docs.coverage_docs(landed)))
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_rankings_limit_their_groups_before_the_shuffle(spark, landed):
    found = symbols.symbols(landed)
    assert "row_number(), 20, Partial" in physical(symbols.key_classes(found))
    status = cov.features_from_symbols(found).withColumn("documented", F.lit(False))
    assert "row_number(), 50, Partial" in physical(cov.undocumented_preview(status, 50))


def test_symbols_do_not_carry_or_shuffle_contents(landed):
    plan = physical(symbols.symbols(landed))
    scan = plan[plan.index("MapInArrow") :]
    assert "BroadcastHashJoin" in scan and "hashpartitioning" not in scan


def test_materialised_tables_are_scanned_with_pruned_columns_and_filters(landed):
    again = materialize(landed)
    names = physical(again.select("project").distinct())
    assert "FileScan parquet" in names and "content" not in names
    wanted = physical(docs.coverage_docs(again).select("path"))
    assert "StringStartsWith(path,docs/)" in wanted and "content" not in wanted


def test_categories_are_one_scan_and_one_aggregate(spark, landed):
    found = cov.features_from_symbols(symbols.symbols(landed)).withColumn("documented", F.lit(False))
    status = materialize(found)
    plan = physical(cov.category_coverage(status))
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Window" not in plan
    assert plan.count("Exchange") == 1


def test_files_outside_the_package_are_not_parsed_at_any_number_of_projects(spark, landed, monkeypatch):
    monkeypatch.setattr(symbols, "broadcast_if_small", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(symbols.symbols(landed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.index("MapInArrow") < plan.index("SortMergeJoin") and "StartsWith(path" in plan[plan.index("MapInArrow") :]


def test_documents_are_split_once_for_all_keyword_sets(spark, landed):
    ranked = spark.createDataFrame([("p", ["a"], "docs/a.md", 1), ("p", ["b"], "docs/a.md", 1)], "project string, keywords array<string>, path string, doc_rank int")
    plan = physical(answers.rank_sections(ranked, docs.explain_docs(landed)))
    assert plan.count("split(") == 1 and plan.count("aggregate(keywords") == 1
    assert plan.count("FileScan parquet") == 2  # the documents, and the winners' names

"""Tables and JSON written from reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.functions import scores


_ROWS = {"findings": "finding string, impact double", "unknowns": "`unknown` string"}


def findings(reports: DataFrame, run_date: Column) -> DataFrame:
    """One finding per report: its text and its impact."""
    e = F.col("epistemic")
    return reports.select(
        run_date.alias("run_date"),
        "project",
        scores.finding_text(
            e["overall_coverage"], e["know"], e["uncertainty"]
        ).alias("finding"),
        scores.impact(e["overall_coverage"]).alias("impact"),
    )


def unknowns(reports: DataFrame, run_date: Column) -> DataFrame:
    """The first recommendations of each report, one per row."""
    first = F.slice("epistemic.recommendations", 1, fv.FINDING_UNKNOWNS)
    return reports.select(run_date.alias("run_date"), "project", F.explode(first).alias("unknown"))


def append_findings(reports: DataFrame, run_date: Column, path: str, run_id: str = "daily") -> None:
    """Write one run to ``<path>/findings`` and ``<path>/unknowns``, and commit it to ``<path>/runs``.

    Each try writes its rows under a name of its own; the run's row among ``runs``, written
    last, says which try counts.  A run that is repeated for the same day and ``run_id``
    replaces what it wrote before, and one that ends between the tables leaves nothing
    that :func:`read_findings` sees.
    """
    tried = F.lit(uuid.uuid4().hex)
    place = ("run_date", "run_id", "attempt")
    for name, rows_of in (("findings", findings), ("unknowns", unknowns)):
        table = rows_of(reports, run_date).withColumn("run_id", F.lit(run_id)).withColumn("attempt", tried)
        table.write.mode("append").partitionBy(*place).parquet(f"{path}/{name}")
    runs = reports.select(run_date.alias("run_date")).distinct()
    (
        runs.select("run_date", F.lit(run_id).alias("run_id"), tried.alias("attempt"))
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date", "run_id")
        .parquet(f"{path}/runs")
    )


def read_findings(spark: SparkSession, path: str, name: str = "findings") -> DataFrame:
    """Committed rows of ``findings`` or ``unknowns``; other tries are not even listed in the scan.

    The runs are one row for each day and ``run_id``, and so broadcast at any time.
    """
    # Declared, as the types of the folders' values would be guessed from their looks.
    place = "run_date date, run_id string, attempt string"
    runs = spark.read.schema("attempt string, run_date date, run_id string").parquet(f"{path}/runs")
    rows = spark.read.schema(f"project string, {_ROWS[name]}, {place}").parquet(f"{path}/{name}")
    counted = rows.join(F.broadcast(runs), ["run_date", "run_id", "attempt"], "left_semi")
    return counted.drop("attempt")


def remove_uncommitted(spark: SparkSession, path: str) -> None:
    """Delete what tries that no run counts have left.  Not while a run is being written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    runs = spark.read.schema("attempt string, run_date date, run_id string").parquet(f"{path}/runs")
    committed = {r["attempt"] for r in runs.select("attempt").collect()}
    for name in ("findings", "unknowns"):
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/run_date=*/run_id=*/attempt=*")
        files = pattern.getFileSystem(hadoop)
        for status in files.globStatus(pattern) or ():
            if status.getPath().getName().removeprefix("attempt=") not in committed:
                files.delete(status.getPath(), True)


def as_json(reports: DataFrame) -> DataFrame:
    """``project, json``: the report as one JSON text.

    Fields without a value are left out of explanations, as each of their variants
    has fields of its own.
    """
    fields = [c for c in reports.columns if c not in ("query_id",)]
    return reports.select(
        *[c for c in ("query_id", "project") if c in reports.columns],
        F.to_json(F.struct(*fields)).alias("json"),
    )


def write_json(reports: DataFrame, path: str) -> None:
    as_json(reports).select(F.col("json").alias("value")).write.mode("overwrite").text(path)

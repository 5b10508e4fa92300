"""The package directory of each project, by order of preference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.functions.matching import first_group


def package_dirs(files: DataFrame) -> DataFrame:
    """``project, package_dir, preference``: one directory per project that has any.

    1. a package directly below ``src/``; 2. the package named like the project in
    ``pyproject.toml``; 3. any other package at the root.  Ties go to the first
    name.  Only ``pyproject.toml`` is opened; the rest is read off the paths.  Both
    steps are aggregates, so a project of any size combines before its shuffle.
    """
    path, package = F.col("path"), F.col("package_dir")
    # The first condition is one that file formats can prune by.
    inits = files.where(
        F.endswith(path, F.lit("/__init__.py")) & path.rlike(r"^(?:src/)?[^/]+/__init__\.py$")
    ).select(
        "project",
        F.regexp_replace(path, r"/__init__\.py$", "").alias("package_dir"),
        F.lit(False).alias("named"),
    )
    named = files.where(path == "pyproject.toml").select(
        "project",
        F.translate(first_group(F.col("content"), fv.PROJECT_NAME), "-", "_").alias("package_dir"),
        F.lit(True).alias("named"),
    )
    preference = (
        F.when(F.startswith(package, F.lit("src/")) , 1)
        .when(F.col("named"), 2)
        .when(~package.isin(fv.NON_PACKAGE_DIRS), 3)
    )
    return (
        inits.unionByName(named)
        .groupBy("project", "package_dir")
        .agg(F.bool_or("named").alias("named"), F.bool_or(~F.col("named")).alias("exists"))
        .where("exists")
        .select("project", "package_dir", preference.alias("preference"))
        .where(F.col("preference").isNotNull())
        .groupBy("project")
        .agg(F.min(F.struct("preference", "package_dir")).alias("best"))
        .select("project", "best.package_dir", "best.preference")
    )

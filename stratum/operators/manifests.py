"""Validation of cohort manifests and release databases, and cohort databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import COMMIT, DIGEST
from ..storage import numbered

MANIFEST = "idx int, name string, version string, revision string, source_url string, archive_sha256 string, path string, path_exists boolean, path_is_dir boolean"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def manifest_errors(projects: DataFrame) -> DataFrame:
    """(idx, error) of each project, null for none: its first failed rule, in the rules' order.

    A repeated (name, version) is an error of all but the first project with it.
    """
    exists = F.coalesce(F.col("path").isNotNull() & F.col("path_exists"), F.lit(False))
    address = F.size(F.filter(F.split(F.regexp_replace("source_url", "^https://github.com/", ""), "/"), lambda x: x != "")) == 2
    repository = F.col("source_url").startswith("https://github.com/") & address
    first = projects.groupBy("name", "version").agg(F.min("idx").alias("_first"))
    rules = [
        ("empty name", _blank(F.col("name"))),
        ("empty version", _blank(F.col("version"))),
        ("empty source_url", _blank(F.col("source_url"))),
        ("empty revision", F.col("revision").isNotNull() & _blank(F.col("revision"))),
        ("invalid archive_sha256", F.col("archive_sha256").isNotNull() & ~F.col("archive_sha256").rlike(DIGEST)),
        ("input not found", F.col("path").isNotNull() & ~exists & ~repository),
        ("path not a directory", exists & ~F.coalesce("path_is_dir", F.lit(False))),
        ("revision required", ~exists & ~F.coalesce(F.col("revision").rlike(COMMIT), F.lit(False))),
        ("archive digest required", ~exists & F.col("archive_sha256").isNull()),
        ("duplicate project", F.col("_first") < F.col("idx")),
    ]
    error = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        error = F.when(failed, F.lit(name)).otherwise(error)
    both = projects.join(first, ["name", "version"], "left")
    return both.select("idx", error.alias("error"))


def first_error(errors: DataFrame) -> DataFrame:
    """One row: the error of the first project with one, or null."""
    return errors.where("error is not null").agg(F.min_by("error", "idx").alias("error"), F.min("idx").alias("idx"))


def duplicate_identities(projects: DataFrame) -> DataFrame:
    """(name, version, n) that occur more than once."""
    return projects.groupBy("name", "version").agg(F.count("*").alias("n")).where("n > 1")


def sorted_projects(projects: DataFrame) -> DataFrame:
    """Projects numbered by (name, version), without local paths."""
    return numbered(projects, ["name", "version"], "position", 1).select("position", "name", "version", "revision", "source_url", "archive_sha256")

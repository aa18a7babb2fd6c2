"""Queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def all_queries():
    from cardmill.plans import conversion, corpora, intake, validation  # noqa: F401
    from cardmill.plans.catalog import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from cardmill.plans.catalog import ORACLES

    all_queries()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["violation_summary"](spark, sf_dir)

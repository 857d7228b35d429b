"""Registered queries: one per operator of the inventory, each with the DuckDB SQL
that must give the same rows. Queries read the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def with_ctes(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


QUERY_MODULES = ["q_corpus", "q_sequences", "q_datasets", "q_metrics", "q_train"]


def load_all() -> tuple[dict, dict]:
    """Import every query module (each registers its queries) and return the tables."""
    import importlib

    for m in QUERY_MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return QUERIES, ORACLES

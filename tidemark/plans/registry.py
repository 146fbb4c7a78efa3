"""All queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.catalog import PORTABLE
from tidemark.plans.model import Model, duck
from tidemark.plans.queries import BUILT
from tidemark.streaming import queries as streams


def _portable(text: str, through: int | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Model(spark, sf_dir, through).sql(text)


def _built(f: Callable[[Model], DataFrame], through: int | None, per_segment: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Model(spark, sf_dir, through, per_segment))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _portable(*x) for name, x in PORTABLE.items()}
    out |= {name: _built(f, through, per) for name, (f, through, _, per) in BUILT.items()}
    return dict(sorted((out | streams.QUERIES).items()))


def oracle_sql() -> dict[str, str]:
    out = {name: duck(*x) for name, x in PORTABLE.items()}
    out |= {name: duck(sql, through, per) for name, (_, through, sql, per) in BUILT.items() if sql is not None}
    return dict(sorted((out | streams.SQL).items()))

"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (or marts Spark derives from them) in
full; parameters are the fixed ones in ``params``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordersight.sources.marts import Marts

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: Callable[[Marts], DataFrame]) -> Callable[[Marts], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Marts(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_REGISTRY)


def _load_all() -> None:
    # Importing the modules registers their queries.
    from ordersight.plans import q_quality, q_rules, q_service, q_sql, q_supply, q_text, q_trace  # noqa: F401


__all__ = ["register", "queries"]

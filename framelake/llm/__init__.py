"""Training-data operators: tokens, duplicates, search, leaks, secrets, shards, chats and quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The registered query of every operator here."""
    from framelake.llm import workload

    return dict(workload.QUERIES)


def oracles() -> dict[str, str]:
    """DuckDB SQL for the queries SQL can express."""
    from framelake.llm import workload

    return dict(workload.ORACLES)

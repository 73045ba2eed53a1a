"""The library's registered queries, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from . import backtest_queries, file_queries, market_queries, memory_queries, parser_queries, run_queries, stream_queries, text_queries


MODULES = (market_queries, text_queries, file_queries, backtest_queries, parser_queries, stream_queries, memory_queries, run_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}

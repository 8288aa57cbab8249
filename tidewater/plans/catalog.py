"""Every query of the library by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from tidewater.plans import base, checks, forecasts, mixed, models, series, sources, streams, tables  # noqa: F401  importing registers

FLAGSHIP = "monthly_orders_changes"


def queries() -> dict[str, base.Query]:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.SQL

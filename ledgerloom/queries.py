"""The query catalog on the driver's tables, with DuckDB SQL beside each query."""

from __future__ import annotations

from .plans import catalog, filings, pages
from .plans.dialect import DUCK, SPARK
from .plans.relational import PLANS

QUERIES: dict = {p.__name__: (lambda s, d, p=p: SPARK.spark_sql(s, d, p(SPARK))) for p in PLANS} | filings.QUERIES | pages.QUERIES | catalog.QUERIES
ORACLES: dict[str, str] = {p.__name__: p(DUCK) for p in PLANS} | filings.ORACLES | pages.ORACLES | catalog.ORACLES

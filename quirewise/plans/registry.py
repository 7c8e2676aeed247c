"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .model import CTES, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Model by its name; sql may use the model's tables, see CTES."""

    def add(f: Callable[[Model], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Model(configure(spark), sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_ctes(sql)
        return f

    return add


def with_ctes(sql: str) -> str:
    used = [n for n in CTES if _uses(sql, n)]
    grown = True
    while grown:  # a model table may read others
        more = [n for n in CTES if n not in used and any(_uses(CTES[u], n) for u in used)]
        used += more
        grown = bool(more)
    heads = [f"{n} AS ({CTES[n]})" for n in CTES if n in used]
    recursive, body = "", sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = " RECURSIVE", "," + body[len("WITH RECURSIVE") :]
    elif body.upper().startswith("WITH"):
        body = "," + body[len("WITH") :]
    return f"WITH{recursive} " + ", ".join(heads) + "\n" + body if heads else sql


def _uses(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", sql) is not None

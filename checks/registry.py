"""Registration of checked queries and composition of their reference SQL."""

import re
from functools import wraps

QUERIES = {}
ORACLES = {}
CTES = {}

_CACHE = {}


def cte(name: str, sql: str) -> None:
    """Define a named subquery for the reference SQL; later ones may use earlier ones."""
    CTES[name] = sql.strip()


def compose(sql: str) -> str:
    """Put the named subqueries a statement needs, directly or not, in front of it."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


def check(name: str, sql: str | None = None):
    """Register a query; with ``sql`` its result is compared with DuckDB's."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register


def shared(fn):
    """Build an intermediate table once per Spark application and data folder."""

    @wraps(fn)
    def cached(spark, sf_dir):
        key = (fn.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _CACHE:
            _CACHE[key] = fn(spark, sf_dir)
        return _CACHE[key]

    return cached

"""Named inputs, registered queries and their oracle SQL.

An input is a table of the data folder or a named derivation of such tables.  Derivations given as SQL
run unchanged in Spark and in DuckDB; ``{name}`` stands for an input.  A query is a function of
``Tables`` that binds an operator to inputs; its oracle is independent SQL over the same inputs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_NAME = re.compile(r"\{([a-z][a-z_0-9]*)\}")
TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

_inputs: dict[str, str] = {}
_built: dict[str, Callable[[Tables], DataFrame]] = {}
_queries: dict[str, Callable[[Tables], DataFrame]] = {}
_oracles: dict[str, str] = {}


class Tables:
    """Inputs of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        _load()
        self.spark, self.sf_dir = spark, sf_dir
        self._tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in _built:
                self._made[name] = _built[name](self)
            else:
                self._made[name] = self.sql(_inputs[name])
        return self._made[name]

    def give(self, name: str, df: DataFrame) -> None:
        """Use ``df`` as the input of that name, where a query already has its rows."""
        self._made[name] = df

    def sql(self, text: str) -> DataFrame:
        """Spark SQL in which ``{name}`` stands for an input."""

        def view(match: re.Match) -> str:
            name = f"in_{self._tag}_{match[1]}"
            self(match[1]).createOrReplaceTempView(name)
            return name

        return self.spark.sql(_NAME.sub(view, text))


def source(name: str, sql: str) -> None:
    """Name a derivation that runs in both engines."""
    _inputs[name] = sql


def derived(name: str, sql: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Name an input that an operator makes in Spark, and that ``sql`` makes in DuckDB."""

    def keep(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _inputs[name], _built[name] = sql, make
        return make

    return keep


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query under its function's name."""

    def keep(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _queries[make.__name__] = make
        if oracle is not None:
            _oracles[make.__name__] = oracle
        return make

    return keep


def _load() -> None:
    from . import conversations, evaluation, identity, ledger, maintenance, memory, operations, ranking, safety, streams, text  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {name: (lambda spark, sf_dir, make=make: make(Tables(spark, sf_dir))) for name, make in _queries.items()}


def _with(sql: str) -> str:
    """The SQL with all inputs that it needs as common table expressions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name not in TABLES and name not in order:
                need(_inputs[name])
                order.append(name)

    need(sql)
    body = _NAME.sub(r"\1", sql).strip()
    parts = [f"{name} AS ({_NAME.sub(r'\1', _inputs[name])})" for name in order]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if not parts:
        return body
    rest = f", {body[head.end() :]}" if head else f" {body}"
    return "WITH RECURSIVE " + ", ".join(parts) + rest


def oracles() -> dict[str, str]:
    _load()
    return {name: _with(sql) for name, sql in _oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense retrieval, relevance gate, confidence band and context selection in one plan."""
    from .ranking import retrieval_plan

    return retrieval_plan(Tables(spark, sf_dir))

"""Registry of named queries: a Spark callable and, where SQL can state it, an oracle for DuckDB.

Input shapes the given tables do not hold directly (snapshots, commits, marks) are derived from them by
the fragments in ``derive``. A fragment written in SQL both engines take is run by both; ``{t}`` names a
table of the data set.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diffloom.session import cut, release

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

FRAGMENTS: dict[str, str] = {}  # portable SQL, run by Spark and DuckDB
ORACLE_FRAGMENTS: dict[str, str] = {}  # DuckDB only: the stated semantics of an operator
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Functions whose names differ: placeholder -> (Spark, DuckDB).
_DIALECT = {
    "MICROS": ("unix_micros(cast({0} as timestamp))", "epoch_us({0})"),
    "SECONDS": ("unix_seconds(cast({0} as timestamp))", "cast(floor(epoch({0})) as bigint)"),
}


def _dialect(sql: str, spark: bool) -> str:
    for name, forms in _DIALECT.items():
        pattern = re.compile(rf"@{name}\(([^()]*)\)")
        sql = pattern.sub(lambda m: forms[0 if spark else 1].format(m.group(1)), sql)
    return sql


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql


def oracle_fragment(name: str, sql: str) -> None:
    ORACLE_FRAGMENTS[name] = sql


def _needed(sql: str, known: dict[str, str]) -> list[str]:
    out: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(known[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def oracle(sql: str) -> str:
    """``sql`` with the fragments it names prepended as CTEs, in DuckDB's dialect."""
    known = {**FRAGMENTS, **ORACLE_FRAGMENTS}
    ctes = [f"{n} as ({known[n].strip()})" for n in _needed(sql, known)]
    body = sql.strip()
    if body.startswith("with recursive "):
        ctes, body = [*ctes, body[len("with recursive "):]], ""
    elif body.startswith("with "):
        ctes, body = [*ctes, body[len("with "):]], ""
    text = ("with recursive " + ",\n".join(ctes) + "\n" + body) if ctes else body
    return _dialect(re.sub(r"\{(%s)\}" % "|".join(TABLES), r"\1", text), spark=False)


_SHARED: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Drops the tables shared between queries, so that a timing starts from the given tables."""
    _SHARED.clear()


class Data:
    """The tables of one data set directory, and the derived inputs, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._derived: dict[str, DataFrame] = {}

    def shared(self, name: str, build: Callable[[Data], DataFrame]) -> DataFrame:
        """A table many queries read (the changes, the aligned lines): checkpointed once per data set, as a
        user of the library would write it to a table once."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _SHARED:
            _SHARED[key] = cut(build(self))
            release(self.spark)
        return _SHARED[key]

    def has(self, name: str) -> bool:
        """Whether another query of the session has already written the shared table ``name``."""
        return (self.spark.sparkContext.applicationId, self.folder, name) in _SHARED

    def written(self, *names: str) -> Data:
        """Fragments that others read several times, each written once, in the order given; what is derived later reads
        the written tables."""
        for name in names:
            self._derived[name] = self.shared(name, lambda d, name=name: getattr(d, name))
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in FRAGMENTS:
            if name not in self._derived:
                self._derived[name] = self.sql(FRAGMENTS[name])
            return self._derived[name]
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        names = _needed(text, FRAGMENTS)
        tables = {t: self.table(t) for t in TABLES if re.search(r"\{%s\}" % t, text)}
        parts = {n: getattr(self, n) for n in names}
        # Braces of the text itself (JSON) are doubled, then table and fragment names become parameters.
        text = re.sub(r"\{(%s)\}" % "|".join(TABLES), "\x01\\1\x02", text)
        pieces = re.split(r"('(?:[^']|'')*')", text)  # literals keep their words
        for n in names:
            pieces[::2] = [re.sub(rf"\b{n}\b", f"\x01{n}\x02", p) for p in pieces[::2]]
        text = "".join(pieces)
        text = text.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")
        return self.spark.sql(_dialect(text, spark=True), **tables, **parts)


def query(name: str, sql: str | None = None):
    """Registers ``fn(data) -> DataFrame`` under ``name``; ``sql`` is its oracle."""

    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLES.items()}

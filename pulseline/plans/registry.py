"""Registry of runnable queries and the plain SQL that states what each one means."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseline.plans.domain import Domain
from pulseline.session import prepare


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Domain], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}
CTES: dict[str, str] = {}
RECURSIVE = "WITH RECURSIVE"


def query(name: str, sql: str | None = None):
    """Register a builder under a name, with its SQL statement where SQL can express it."""

    def keep(fn: Callable[[Domain], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, fn, sql)
        return fn

    return keep


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def full_sql(body: str) -> str:
    """Prefix a statement with the common table expressions it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bc_\w+", text)):
            if word in CTES and word not in needed:
                visit(CTES[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body
    tables = ",\n".join(f"{n} AS (\n{CTES[n].strip()}\n)" for n in needed)
    own = body.strip()
    if own.startswith(RECURSIVE):  # a body with tables of its own
        return f"{RECURSIVE} {tables},\n{own.removeprefix(RECURSIVE)}"
    return f"WITH {tables}\n{own}"


def plain_types(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so any client compares them the same way."""
    cols = [
        F.col(f"`{name}`").cast("string").alias(name) if kind in ("date", "timestamp", "timestamp_ntz")
        else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    return df.select(*cols)


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain_types(entry.build(Domain(prepare(spark), folder)))

    run.__name__ = entry.name
    return run


# --- small SQL text helpers -------------------------------------------------------------------

def r(expr: str, digits: int = 2) -> str:
    """The same half-up rounding formula as functions.columns.rnd."""
    return f"floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits}"


def pct(top: str, bottom: str, digits: int = 2) -> str:
    return r(f"1e2 * CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0e0)", digits)


def div(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0e0))"


def gavg(expr: str, digits: int) -> str:
    """Mean of grid values by an exact integer sum, as functions.columns.grid_avg."""
    return (
        f"(CAST(sum(CAST(round(({expr}) * 1e{digits}) AS BIGINT)) AS DOUBLE)"
        f" / nullif(1e{digits} * CAST(count({expr}) AS DOUBLE), 0e0))"
    )


def txt(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"

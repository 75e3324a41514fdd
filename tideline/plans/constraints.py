"""What each table must fulfil, declared once: keys, references and checks, and the faults of a set of tables in one pass each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans import audit


@dataclass(frozen=True)
class Reference:
    """Columns that must be those of some row of another table."""

    columns: tuple[str, ...]
    table: str
    to: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    checks: Callable[[], dict[str, Column]]
    key: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()


RECORD = ("source_file", "record_id")
TABLES = (
    Table("observations", audit.observation_rules, RECORD),
    Table("intervals", audit.interval_rules, RECORD),
    Table("clinical_facts", audit.fact_rules, RECORD),
    Table("quarantine", audit.quarantine_rules),
    Table("ingest_manifest", audit.manifest_rules, ("run_id", *RECORD[:1], "target_table")),
    Table("signals", audit.signal_rules, ("signal_id",)),
    Table("evidence", audit.evidence_rules, references=(Reference(("signal_id",), "signals", ("signal_id",)),)),
)


def _own(df: DataFrame, table: Table) -> DataFrame:
    """(rule, n) of the checks and the key: the rows of a key are counted on the exchange that its checks are summed on."""
    names, checks = zip(*[(name, F.count_if(~F.coalesce(ok, F.lit(False)))) for name, ok in table.checks().items()], strict=True)
    key = [c for c in table.key if c in df.columns]  # a table that names no source has its record numbers alone
    if key:
        by_key = df.groupBy(*key).agg(F.count("*").alias("_n"), *[c.alias(f"_{i}") for i, c in enumerate(checks)])
        names, checks = (*names, "key"), [*[F.coalesce(F.sum(f"_{i}"), F.lit(0)) for i in range(len(checks))], F.count_if(F.col("_n") > 1)]
        df = by_key
    counted = df.agg(*[c.cast("long").alias(f"_{i}") for i, c in enumerate(checks)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("n")) for i, name in enumerate(names)])))


def faults(tables: dict[str, DataFrame], declared: tuple[Table, ...] = TABLES) -> DataFrame:
    """(table, rule, n) of what the ``tables`` break: rows that fail a check, keys that are given more than once (``key``), and rows that refer to nothing.

    References to a table that is not among them are not looked at; a reference with a null in it refers to nothing.
    """
    parts = []
    for table in (t for t in declared if t.name in tables):
        df, named = tables[table.name], F.lit(table.name).alias("table")
        parts.append(_own(df, table).select(named, "rule", "n"))
        for ref in (r for r in table.references if r.table in tables):
            there = tables[ref.table].select(*[F.col(c).alias(f"_{c}") for c in ref.to]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_{b}") for a, b in zip(ref.columns, ref.to, strict=True)])
            lost = df.select(*ref.columns).groupBy(*ref.columns).agg(F.count("*").alias("n")).join(there, same, "left_anti")
            parts.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(named, F.lit(f"{','.join(ref.columns)} of {ref.table}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def require(tables: dict[str, DataFrame], declared: tuple[Table, ...] = TABLES) -> None:
    """Raise where the tables break anything; there are as many rows as rules at most."""
    if found := sorted((r.table, r.rule, r.n) for r in faults(tables, declared).collect()):
        raise audit.ViolationError(f"constraints are broken: {found}")

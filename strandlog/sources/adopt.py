"""Adoption of an older table as a log: a plan with its problems, then the rows under their new names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.errors import UsageError
from strandlog.sources.canonical import Log, extracted

#: Names that a column may have had.
OLD_NAMES = {"sequence": ("sequence_number", "id", "seq"), "event_type": ("eventtype", "type"), "payload": ("data", "body"), "recorded_at": ("created_at", "occurred_at", "ts"), "transaction_id": ("xid",), "metadata": ("meta",)}


@dataclass
class Plan:
    renames: dict[str, str] = field(default_factory=dict)
    added: list[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def plan_adoption(df: DataFrame) -> Plan:
    plan, have = Plan(), {c.lower(): c for c in df.columns}
    for name, olds in OLD_NAMES.items():
        found = [have[c] for c in (name, *olds) if c in have]
        if len(found) > 1:
            plan.notes.append(f"{name} is taken from {found[0]}; {', '.join(found[1:])} stay unused")
        if found:
            if found[0] != name:
                plan.renames[found[0]] = name
        elif name in ("transaction_id", "metadata", "recorded_at"):
            plan.added.append(name)
        else:
            plan.problems.append(f"no column for {name}")
    if not plan.problems:
        kinds = dict(df.dtypes)
        where = {new: old for old, new in plan.renames.items()}
        if kinds[where.get("sequence", "sequence")] not in ("int", "bigint"):
            plan.problems.append("the sequence is not an integer column")
    return plan


def adopt(df: DataFrame, scope_keys: tuple[str, ...] = (), plan: Plan | None = None) -> Log:
    """The log of a table. The caller's plan must still fit; counts and the last sequence are checked by check_adopted."""
    fresh = plan_adoption(df)
    if plan is not None and plan != fresh:
        raise UsageError("the table changed since it was planned")
    if fresh.problems:
        raise UsageError("; ".join(fresh.problems))
    for old, new in fresh.renames.items():
        df = df.withColumnRenamed(old, new)
    constants = {"transaction_id": F.lit(1).cast("long"), "metadata": F.lit(None).cast("string"), "recorded_at": F.lit(None).cast("timestamp")}
    for name in fresh.added:
        df = df.withColumn(name, constants[name])
    base = df.select(F.col("sequence").cast("long").alias("sequence"), F.col("transaction_id").cast("long").alias("transaction_id"), "event_type", F.col("payload").cast("string").alias("payload"), "metadata", "recorded_at")
    return Log(extracted(base, scope_keys), scope_keys)


def check_adopted(before: DataFrame, sequence: str, log: Log) -> None:
    a = before.agg(F.count("*").alias("n"), F.max(sequence).alias("m")).first()
    b = log.df.agg(F.count("*").alias("n"), F.max("sequence").alias("m")).first()
    if tuple(a) != tuple(b):
        raise UsageError(f"adoption changed the rows: {tuple(a)} before, {tuple(b)} after")

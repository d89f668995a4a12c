"""Sinks: JSON lines with sorted keys, JSON, CSV, Markdown tables, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import write_text


def sorted_json_value(columns: list[str]) -> Column:
    """A row's columns as a JSON object with sorted keys."""
    return F.to_json(F.parse_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def sorted_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object with sorted keys."""
    return df.select(sorted_json_value(df.columns).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: str | None = "_ord", single: bool = False) -> None:
    """One object for each line. ``single`` writes one file, for small results."""
    if order and order in df.columns:
        df = df.orderBy(order).drop(order)
    out = sorted_json(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_shards(df: DataFrame, path: str, shard: str = "shard_id") -> None:
    """One folder for each shard."""
    df.repartition(shard).write.mode("overwrite").partitionBy(shard).json(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """A one-row report as an indented JSON file, on whatever file system."""
    import json

    row = json.loads(sorted_json(df).first().value)
    write_text(df.sparkSession, path, json.dumps(row, indent=2, sort_keys=True) + "\n")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table: floats with four digits, null as unavailable.

    ``limit`` rows are shown, and a last line says so if there are more.
    """
    rows = df.limit(limit + 1).collect()
    if not rows:
        return "_No rows._"
    show = lambda v: "unavailable" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    tail = [f"\n_Only the first {limit} rows are shown._"] if len(rows) > limit else []
    return "\n".join(head + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows[:limit]] + tail)


def report(title: str, **sections: DataFrame) -> str:
    """A Markdown report with one table for each section."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        parts += [f"## {name.replace('_', ' ').capitalize()}", markdown_table(df)]
    return "\n\n".join(parts) + "\n"

"""Sinks: Parquet, append-only histories, CSV, JSON maps and Markdown reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from tesela.runtime import require_columns


def write_table(df: DataFrame, path: str, contract: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table, after checking the columns of its contract."""
    require_columns(df, contract or [], path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append rows to a history without rewriting it."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV folder with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_map(df: DataFrame, key: str, value: str, path: str, most: int = 10_000) -> None:
    """A two-column frame of at most ``most`` rows as one JSON object."""
    rows = df.select(key, value).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keys")
    Path(path).write_text(json.dumps({r[0]: r[1] for r in rows}, ensure_ascii=False, indent=1, default=str), encoding="utf-8")


def markdown_table(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A small result as a Markdown section; says so if rows beyond ``most`` are left out."""
    rows = df.limit(most + 1).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *(["", f"The first {most} rows."] if len(rows) > most else []), ""])


def make_layout(root: str, folders: tuple[str, ...] = ("raw", "processed", "cache", "reports")) -> dict[str, str]:
    """Make the folders of a workspace that are missing and return their paths by name."""
    paths = {f: Path(root) / f for f in folders}
    for p in paths.values():
        p.mkdir(parents=True, exist_ok=True)
    return {f: str(p) for f, p in paths.items()}


def write_report(path: str, title: str, parts: list[tuple[str, DataFrame]]) -> None:
    """A Markdown report of small results, a section each."""
    Path(path).write_text("\n".join([f"# {title}", "", *[markdown_table(df, name) for name, df in parts]]), encoding="utf-8")

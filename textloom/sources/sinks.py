"""Sinks: files that appear whole or not at all, and tables that keep the last row of a key."""

from __future__ import annotations

import csv
import json
import os
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.evaluation import upsert_latest


def _replace(path: str, write) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    tmp = target.with_name(target.name + ".tmp")
    try:
        with tmp.open("w", encoding="utf-8", newline="") as f:
            write(f)
        os.replace(tmp, target)
    finally:
        tmp.unlink(missing_ok=True)
    return target


def write_json(path: str, payload, indent: int | None = 2) -> Path:
    return _replace(path, lambda f: json.dump(payload, f, ensure_ascii=False, indent=indent))


def write_jsonl(path: str, records: Iterable[dict]) -> Path:
    return _replace(path, lambda f: f.writelines(json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n" for r in records))


def write_csv(path: str, rows: Iterable[dict], columns: list[str]) -> Path:
    def write(f):
        w = csv.DictWriter(f, columns, extrasaction="ignore")
        w.writeheader()
        w.writerows(rows)

    return _replace(path, write)


def write_small_table(df: DataFrame, path: str, order: list[str], most: int = 1_000_000) -> Path:
    """A report table as one CSV file, in order; larger ones raise, for they belong in df.write."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the DataFrame instead")
    return write_csv(path, (r.asDict() for r in rows), df.columns)


def save_chat(df: DataFrame, path: str, order: str = "ordinal") -> None:
    """Chat records as compact JSON Lines in order, nothing but their contents; Spark's commit protocol makes them appear whole."""
    df.sort(order).select(F.to_json(F.struct("contents")).alias("value")).write.mode("overwrite").text(path)


def save_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_table(df: DataFrame, path: str, key: str = "id", order: str = "ordinal") -> None:
    """A table with the last row of each key, as INSERT OR REPLACE would leave it."""
    upsert_latest(df, key, order).write.mode("overwrite").parquet(path)


def copy_report(path: str, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return shutil.copy2(path, folder)


def object_uri(bucket: str, *parts: str, scheme: str = "gs") -> str:
    """scheme://bucket/part/part with single slashes; write to it with df.write, given the store's connector."""
    bucket = bucket.removeprefix(f"{scheme}://").strip("/")
    return f"{scheme}://" + "/".join([bucket, *(p.strip("/") for p in parts if p.strip("/"))])

"""Rows of a table in a plain-text database dump (COPY format)."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.cleaning import drop_blank_pairs

TERMINATOR = r"\."


def export_dump(dump: str, out: str, table: str, tool: str = "pg_restore") -> str:
    """Decompress one table of a custom-format dump to a text file with the database's own tool; its failure raises.

    Such dumps are no splittable source, so this runs once, outside of Spark.
    """
    with open(out, "wb") as f:
        done = subprocess.run([tool, "--data-only", f"--table={table}", "--file=-", dump], stdout=f, stderr=subprocess.PIPE)
    if done.returncode:
        Path(out).unlink(missing_ok=True)
        raise RuntimeError(f"{tool} failed with {done.returncode}: {done.stderr.decode(errors='replace')[:500]}")
    return out


def read_lines(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """(ordinal, value): lines of text with their place in order of file name, the same on every read.

    A place is the lines of the blocks before plus the place in its block; blocks
    are counted, and one row for each is all that is ordered. Lines end in \\n
    alone, as a carriage return can be data. ``skip_blank`` numbers the rest only.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    if skip_blank:
        lines = lines.filter(F.trim("value") != "")
    numbered = lines.withColumn("id", F.monotonically_increasing_id())  # runs on without gaps in a block
    blocks = numbered.groupBy("path", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return numbered.join(blocks, ["path", "start"]).select((F.col("before") + F.col("id") - F.col("first")).alias("ordinal"), "value")


def copy_columns(header: str, table: str) -> list[str] | None:
    """Column names of a COPY header of ``table`` in the public schema; None for other lines."""
    start = f"COPY public.{table} ("
    if not header.startswith(start) or ")" not in header:
        return None
    return [c.strip() for c in header[len(start) : header.index(")", len(start))].split(",")]


def copy_block(lines: DataFrame, table: str) -> tuple[list[str], DataFrame]:
    """(columns, rows): the lines between the table's first header and the terminator after it."""
    head = lines.filter(F.col("value").startswith(f"COPY public.{table} (")).orderBy("ordinal").first()
    columns = copy_columns(head["value"], table) if head else None
    if columns is None:
        raise ValueError(f"no COPY header of {table}")
    end = lines.filter((F.col("value") == TERMINATOR) & (F.col("ordinal") > head["ordinal"])).agg(F.min("ordinal")).first()[0]
    inside = F.col("ordinal") > head["ordinal"]
    return columns, lines.filter(inside if end is None else inside & (F.col("ordinal") < end))


def unescape(c):
    """\\N is null; then literal \\n and \\r become line ends; other escapes stay."""
    return F.when(c == r"\N", None).otherwise(F.replace(F.replace(c, F.lit(r"\n"), F.lit("\n")), F.lit(r"\r"), F.lit("\r")))


def extract_records(lines: DataFrame, table: str, fields: dict[str, str], texts: tuple[str, ...] = ("source", "target")) -> tuple[DataFrame, dict]:
    """(records, stats) of a dump's lines (ordinal, value).

    ``fields`` names the output columns and the dump's columns they come from; only
    ``texts`` are unescaped. Rows with a wrong number of values, and rows of which
    a text is null or blank, are dropped and counted together.
    """
    columns, rows = copy_block(lines, table)
    values = F.split("value", "\t", -1)
    cut = rows.select("ordinal", values.alias("v"))
    good = cut.filter(F.size("v") == len(columns)).select(
        "ordinal", *((unescape(F.col("v")[columns.index(src)]) if out in texts else F.col("v")[columns.index(src)]).alias(out) for out, src in fields.items())
    )
    records = drop_blank_pairs(good, *texts)
    total, exported = rows.count(), records.count()
    return records, {"total_lidos": total, "descartados_nulos": total - exported, "exportados": exported, "aproveitamento_pct": round(100.0 * exported / total, 1) if total else 0.0}

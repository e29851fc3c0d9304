"""Work that resumes: pending rows in batches with a manifest, and streams over growing tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textloom.operators.contracts import check_runner
from textloom.operators.evaluation import pending, upsert_latest
from textloom.operators.order import with_position
from textloom.sources.sinks import write_json


def with_retry(call: Callable[[], str], retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """Result of ``call``; after failure k it waits backoff * 2^(k - 1), and the last failure raises."""
    check_runner(max_retries=retries, backoff=backoff)
    for k in range(1, retries + 1):
        try:
            return call()
        except Exception:
            if k == retries:
                raise
            sleep(backoff * 2 ** (k - 1))


def generate(df: DataFrame, make_client: Callable[[], Callable[[dict], str]], out: str = "candidate", retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """``df`` with the text a model makes of each row; a client is built once for each partition that has rows."""

    def run(batches):
        client = None
        for pdf in batches:
            if len(pdf):
                client = client or make_client()
                pdf[out] = [with_retry(lambda r=r: client(r), retries, backoff) for r in pdf.to_dict("records")]
            else:
                pdf[out] = None
            yield pdf

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def score_batches(df: DataFrame, a: str, b: str, scorer: Callable[[list[str], list[str]], list[float]], out: str = "bertscore_f1", batch: int = 32) -> DataFrame:
    """``df`` with a model-backed similarity of two texts, scored ``batch`` rows at a time."""

    def run(batches):
        for pdf in batches:
            scores: list[float] = []
            for at in range(0, len(pdf), batch):
                scores += list(scorer(pdf[a].iloc[at : at + batch].tolist(), pdf[b].iloc[at : at + batch].tolist()))
            yield pdf.assign(**{out: scores})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def resume(
    spark: SparkSession, cases: DataFrame, out: str, manifest: str, keys: list[str], order: list[str], process: Callable[[DataFrame], DataFrame],
    flush_every: int = 100, limit: int | None = None, details: dict | None = None,
) -> dict:
    """Process the cases that ``out`` doesn't hold yet, appending ``flush_every`` rows at a time.

    A manifest says running, then completed or failed, with counts; what was
    appended before a failure counts as done the next time. Nothing is built or
    processed if nothing is pending. Batches are ranges of a written order, so each
    reads its own rows only.
    """
    check_runner(flush_every, limit)
    base = {**(details or {}), "started": datetime.now(UTC).isoformat(), "status": "running"}
    write_json(manifest, base)
    done_rows = 0
    try:
        try:
            done = spark.read.parquet(out)
            todo = pending(cases, done, *keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            todo = cases
        if limit is not None:
            todo = todo.orderBy(*order).limit(limit)
        plan = with_position(todo, [F.col(c) for c in order], "tmp_place").withColumn("tmp_place", F.col("tmp_place") - 1).persist()
        total = plan.count()
        for at in range(0, total, flush_every):
            part = plan.filter(F.col("tmp_place").between(at, at + flush_every - 1)).drop("tmp_place")
            process(part).write.mode("append").parquet(out)
            done_rows = min(total, at + flush_every)
        plan.unpersist()
    except Exception as e:
        write_json(manifest, {**base, "status": "failed", "processed": done_rows, "error": str(e)[:500]})
        raise
    final = {**base, "status": "completed", "processed": done_rows, "finished": datetime.now(UTC).isoformat()}
    write_json(manifest, final)
    return final


# Streams -----------------------------------------------------------------------------


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; its schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time_col: str, by: list[str], width: str = "1 day", late: str = "2 days", value: Column | None = None) -> DataFrame:
    """Counts (and sums of ``value``) in event-time windows; rows later than ``late`` are left out, which bounds the state."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value is not None else [])
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks need an instant
    return timed.withWatermark(time_col, late).groupBy(F.window(time_col, width), *by).agg(*aggs).select(F.col("window.start").alias("start"), *by, *[a for a in ("n", "total") if a == "n" or value is not None])


def upsert_stream(stream: DataFrame, out: str, key: str, order: str, checkpoint: str):
    """Keep the last row of each key under ``out``: every batch merges into a new version folder, and the last two are kept.

    The one before the last is what a replayed batch merges with.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if batch_id:
            try:
                merged = spark.read.parquet(f"{out}/v{batch_id - 1}").unionByName(batch)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        upsert_latest(merged, key, order).write.mode("overwrite").parquet(f"{out}/v{batch_id}")  # a replayed batch writes the same version
        if batch_id > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v{batch_id - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, append to Parquet, and stop; a restart goes on after it."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()



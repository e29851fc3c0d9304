"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or the named columns of it; small ones are dealt over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A temporary one is set only where the session has none and runs in one process,
    as in tests; on a cluster executors wouldn't see each other's files, so this raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read and no recomputation,
    and a later stage sees the same rows however often it is retried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "written_path", None)
    if path is not None:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, noted to read ``tables`` (or what they are noted to read) until it is written."""
    known = getattr(df, "reads", [])
    df.reads = known + [t for x in tables for t in ([x] if hasattr(x, "written_path") else getattr(x, "reads", []))]
    return df


def settle(df: DataFrame) -> DataFrame:
    """materialise(), after which the tables that ``df`` is noted to read are deleted."""
    out = materialise(df)
    release(df)
    return out


def release(df: DataFrame) -> None:
    """Delete the tables that ``df`` is noted to read, once its rows are no longer needed."""
    for t in getattr(df, "reads", []):
        discard(t)


def let(name: str, value: str, body: str) -> str:
    """SQL that works ``value`` out once; a column named inside a lambda may be worked out at every call."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", ways: int = 32, least: int = 2000, share: int = 4096) -> DataFrame:
    """``big`` joined to ``small`` (one row for each key); rows of a frequent key are dealt over ``ways`` tasks by a hash of the row.

    A key is frequent if over ``least`` rows and over one in ``share`` of ``big``
    have it. So there are fewer than ``share`` such keys, whatever ``big`` holds; they
    are counted with partial sums, and only their rows in ``small`` are repeated.
    ``big`` is read twice more, so it should be a written table.
    """
    n = big.count()
    hot = []
    if n > least:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(least, n // share))
        hot = counts.select(*keys).dropna().collect()
    if not hot:
        return big.join(small, keys, how)
    named = F.broadcast(big.sparkSession.createDataFrame(hot, StructType([big.schema[k] for k in keys])).withColumn("tmp_hot", F.lit(True)))
    salt = F.when(F.col("tmp_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(ways)).cast("int")).otherwise(0)
    left = big.join(named, keys, "left").withColumn("tmp_salt", salt).drop("tmp_hot")
    salts = F.when(F.col("tmp_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(named, keys, "left").withColumn("tmp_salt", F.explode(salts)).drop("tmp_hot")
    return left.join(right, [*keys, "tmp_salt"], how).drop("tmp_salt")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` begins with it (whatever the case)."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """Schema of ``df`` with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from every fit."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(5))


def sampled_labels(labels: DataFrame, value: str, bound: int, seed: int = 17) -> list[tuple[int, int]]:
    """At most ``bound`` labelled (doc_id, value) rows outside fold 0, by a hash of the id.

    The bound is what makes it right to hold them on the driver.
    """
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(value).isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max(value).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(bound).collect()
    )
    return [(r["doc_id"], r["y"]) for r in rows]

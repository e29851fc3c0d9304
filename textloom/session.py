"""Session factory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "textloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; a cluster's own settings win over them.

    Time zone UTC keeps wall clocks as written; AQE sizes shuffle partitions and
    splits skewed joins.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer partitions than those.

    Small files with one row group would keep a single core busy. Inputs of any
    size have more partitions than cores and pass without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Paired inference: intervals, p-values, adjustments and summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import constants as K
from textloom.operators.contracts import missing_keys, require_empty


def bootstrap_interval(deltas: np.ndarray, iterations: int = K.ITERATIONS, seed: int = K.SEED) -> tuple[float, float]:
    """95 % interval of the mean over resamples drawn one after the other from one generator.

    Draws of k resamples at once equal k draws, so blocks of them give the same numbers.
    """
    if deltas.ndim != 1 or not len(deltas) or iterations <= 0:
        raise ValueError("a vector with values and a positive number of iterations are needed")
    rng, n = np.random.default_rng(seed), len(deltas)
    means = np.empty(iterations)
    block = max(1, (1 << 22) // n)
    for at in range(0, iterations, block):
        k = min(block, iterations - at)
        means[at : at + k] = deltas[rng.integers(0, n, size=(k, n))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def permutation_p(ft: np.ndarray, zs: np.ndarray, iterations: int = K.ITERATIONS, seed: int = K.SEED) -> float:
    """Two-sided p-value of the mean difference under random signs: (hits + 1) / (iterations + 1)."""
    if ft.shape != zs.shape or ft.ndim != 1 or not len(ft) or iterations <= 0:
        raise ValueError("two vectors of one length and a positive number of iterations are needed")
    d = ft - zs
    seen, rng, n, hits = abs(float(d.mean())), np.random.default_rng(seed), len(d), 0
    block = max(1, (1 << 22) // n)
    for at in range(0, iterations, block):
        signs = rng.choice(np.array([-1.0, 1.0]), size=(min(block, iterations - at), n))
        hits += int((np.abs((signs * d).mean(axis=1)) >= seen).sum())
    return (hits + 1) / (iterations + 1)


def compare(pairs: DataFrame, iterations: int = K.ITERATIONS, seed: int = K.SEED, hooks: tuple[Callable, Callable] = (bootstrap_interval, permutation_p)) -> DataFrame:
    """(family, metric, n, mean_ft, mean_zs, delta, ci_low, ci_high, p): one comparison for each family and metric.

    ``pairs`` has family, metric, case_id, ft, zs. Vectors are in order of case_id,
    and the generator starts anew for every comparison, so results don't depend on
    how groups are dealt. A group is the cases of one evaluation set.
    """
    interval, p_value = hooks

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("case_id")
        ft, zs = pdf["ft"].to_numpy(float), pdf["zs"].to_numpy(float)
        low, high = interval(ft - zs, iterations, seed)
        return pd.DataFrame([{
            "family": pdf["family"].iloc[0], "metric": pdf["metric"].iloc[0], "n": len(pdf), "mean_ft": ft.mean(), "mean_zs": zs.mean(),
            "delta": (ft - zs).mean(), "ci_low": low, "ci_high": high, "p": p_value(ft, zs, iterations, seed),
        }])

    return pairs.groupBy("family", "metric").applyInPandas(run, "family string, metric string, n long, mean_ft double, mean_zs double, delta double, ci_low double, ci_high double, p double")


def paired_means(pairs: DataFrame) -> DataFrame:
    """(family, metric, n, mean_ft, mean_zs, delta) of the pairs that have both scores."""
    return pairs.filter("ft is not null and zs is not null").groupBy("family", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ft").alias("mean_ft"), F.avg("zs").alias("mean_zs"), F.avg("delta").alias("delta")
    )


def holm(df: DataFrame, p: str, by: list[str], tie: str, out: str = "adjusted") -> DataFrame:
    """Holm-Bonferroni within groups: running maximum of min(1, p (m - k)) in ascending order, ties by ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.col(p), F.col(tie))
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return df.withColumn("tmp_step", step).withColumn(out, F.max("tmp_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("tmp_step")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], tie: str, out: str = "adjusted") -> DataFrame:
    """Benjamini-Hochberg within groups: running minimum of p m / rank from the largest p down, at most 1."""
    order = Window.partitionBy(*by).orderBy(F.col(p), F.col(tie))
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    df = df.withColumn("tmp_step", F.col(p) * m / F.row_number().over(order))
    return df.withColumn(out, F.least(F.lit(1.0), F.min("tmp_step").over(down))).drop("tmp_step")


def adjust(comparisons: DataFrame, primary: list[str], alpha: float = K.ALPHA) -> DataFrame:
    """Comparisons with scope, method, adjusted and significant: Holm for primary metrics, Benjamini-Hochberg for the rest, by family."""
    scoped = comparisons.withColumn("scope", F.when(F.col("metric").isin(*primary), "primary").otherwise("secondary"))
    first = holm(scoped.filter("scope = 'primary'"), "p", ["family"], "metric").withColumn("method", F.lit("holm_bonferroni"))
    rest = benjamini_hochberg(scoped.filter("scope = 'secondary'"), "p", ["family"], "metric").withColumn("method", F.lit("benjamini_hochberg"))
    return first.unionByName(rest).withColumn("significant", F.col("adjusted") < alpha)


def require_primary(comparisons: DataFrame, primary: list[str]) -> None:
    """Every family has to have all primary metrics."""
    dim = comparisons.sparkSession.createDataFrame([(m,) for m in primary], "metric string")
    grid = comparisons.select("family").distinct().crossJoin(F.broadcast(dim))  # families by metrics: a few rows
    require_empty(missing_keys(grid, comparisons, "family", "metric"), "missing primary metrics")


def success_by_family(adjusted: DataFrame) -> DataFrame:
    """(family, success): all primary metrics better and significant."""
    return adjusted.filter("scope = 'primary'").groupBy("family").agg(F.bool_and((F.col("delta") > 0) & F.col("significant")).alias("success"))


def direction_consistency(comparisons: DataFrame) -> DataFrame:
    """(metric, families, consistent): whether the families' differences don't point both ways."""
    return comparisons.groupBy("metric").agg(F.count_distinct("family").alias("families"), (~(F.bool_or(F.col("delta") > 0) & F.bool_or(F.col("delta") < 0))).alias("consistent"))

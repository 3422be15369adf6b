"""Tables behind plots: histogram bins, box statistics, curve and scatter points; grids are in raster.py."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """bin, low, high and count of equal bins between the least and the largest value; the last bin is closed."""
    x = F.col(column).cast("double")
    ends = rows.filter(x.isNotNull() & ~F.isnan(x)).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    met = rows.filter(x.isNotNull() & ~F.isnan(x)).join(F.broadcast(ends))  # one row
    step = (F.col("b") - F.col("a")) / bins
    at = F.least(F.coalesce(F.floor((x - F.col("a")) / F.nullif(step, F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("long")
    counts = met.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("count"), F.first("a").alias("a"), F.first(step).alias("step"))
    return counts.select(*by, "bin", (F.col("a") + F.col("bin") * F.col("step")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("step")).alias("high"), "count")


def box_stats(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (the outermost values within 1.5 times the interquartile range) of each group."""
    x = F.col(column).cast("double")
    quartiles = rows.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    reach = 1.5 * (F.col("p")[2] - F.col("p")[0])
    met = rows.join(quartiles, list(by))
    inside = F.when((x >= F.col("p")[0] - reach) & (x <= F.col("p")[2] + reach), x)
    return met.groupBy(*by).agg(
        F.first(F.col("p")[0]).alias("q1"), F.first(F.col("p")[1]).alias("median"), F.first(F.col("p")[2]).alias("q3"),
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.count(F.when(inside.isNull(), x)).alias("n_outside"),
    )

"""Expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def spread(values: Column) -> Column:
    """Population standard deviation of a vector's entries, in two passes."""
    centre = mean(values)
    return F.sqrt(F.transform(F.array(centre), lambda m: mean(F.transform(values, lambda x: (x - m) * (x - m))))[0])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def normalize_probabilities(values: Column) -> Column:
    """Non-finite entries become 0, negative ones 0; the rest is scaled to sum 1, uniform if there is nothing; the last entry takes the rounding error."""
    clean = F.transform(values, lambda x: F.when(finite(x), F.greatest(x, F.lit(0.0))).otherwise(0.0))
    scaled = lambda c: F.transform(
        F.array(total(c)), lambda s: F.transform(c, lambda x: F.when(s <= 1e-15, 1.0 / F.size(c)).otherwise(x / F.when(s <= 1e-15, 1.0).otherwise(s)))
    )[0]
    first = lambda p: F.slice(p, 1, F.size(p) - 1)
    closed = lambda p: F.when(F.size(p) < 2, p).otherwise(F.concat(first(p), F.array(F.greatest(F.lit(0.0), 1.0 - total(first(p))))))
    return F.transform(F.transform(F.array(clean), scaled), closed)[0]


def row_features(temperature: Column, rain: Column) -> dict[str, Column]:
    """Climate summaries of a row: mean, minimum, maximum and range of each group, and the rain total."""
    return {
        "temp_mean": mean(temperature),
        "temp_min": F.array_min(temperature),
        "temp_max": F.array_max(temperature),
        "temp_range": F.array_max(temperature) - F.array_min(temperature),
        "precip_mean": mean(rain),
        "precip_min": F.array_min(rain),
        "precip_max": F.array_max(rain),
        "precip_total": total(rain),
        "precip_range": F.array_max(rain) - F.array_min(rain),
    }


def more_row_features(temperature: Column, rain: Column) -> dict[str, Column]:
    """Optional summaries: population deviations and the dryness index."""
    return {
        "temp_std": spread(temperature),
        "precip_std": spread(rain),
        "dryness_index": total(rain) / (mean(temperature) + 10.0 + 1e-12),
    }

"""Land-cover expressions: groups, components, class labels, colours, null-safe arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code ranges of the sequential and of the original coding, and the groups of each component.
NODATA_CODES = (0, 999)
CODE_RANGES = [
    (1, 11, "Artificial"),
    (12, 22, "Agriculture"),
    (23, 23, "Broadleaf_forest"),
    (24, 24, "Coniferous_forest"),
    (25, 25, "Mixed_forest"),
    (26, 29, "Shrubland"),
    (30, 34, "Grassland_Bare"),
    (35, 39, "Wetlands"),
    (40, 44, "Water"),
    (111, 142, "Artificial"),
    (211, 244, "Agriculture"),
    (311, 311, "Broadleaf_forest"),
    (312, 312, "Coniferous_forest"),
    (313, 313, "Mixed_forest"),
    (321, 324, "Shrubland"),
    (331, 335, "Grassland_Bare"),
    (411, 423, "Wetlands"),
    (511, 523, "Water"),
]
NATURAL_GROUPS = ["Broadleaf_forest", "Coniferous_forest", "Mixed_forest", "Shrubland", "Grassland_Bare", "Wetlands", "Water"]


def clc_group(code: Column) -> Column:
    """Broad group of a land-cover code; null and unlisted codes are Unknown."""
    out = F.when(code.isin(*NODATA_CODES), "NODATA")
    for low, high, name in CODE_RANGES:
        out = out.when(code.between(low, high), name)
    return out.otherwise("Unknown")


def land_use_component(group: Column) -> Column:
    return (
        F.when(group == "Agriculture", "agriculture").when(group.isin(*NATURAL_GROUPS), "natural").when(group == "Artificial", "artificial").otherwise("excluded")
    )


def agriculture_class(component: Column, name: Column, code: Column) -> Column:
    """Detailed class inside the agriculture component: the legend's name, or the code where it has none."""
    return F.when(component == "agriculture", F.coalesce(name, F.concat(F.lit("CLC_"), code.cast("int").cast("string"))))


def natural_class(component: Column, group: Column) -> Column:
    return F.when(component == "natural", group)


def hex_color(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02x%02x%02x", red, green, blue)


def keep_unless_in(column: Column, values: Iterable) -> Column:
    """NOT IN that keeps nulls."""
    return ~F.coalesce(column.isin(*values), F.lit(False))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is zero or null."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def null_if_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def is_finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def to_number(column: Column) -> Column:
    """Numeric value of a text, null where it is none."""
    return column.try_cast("double")


def direction(metric: Column) -> Column:
    """Whether a metric is better low or high, by its name; null if the name does not say."""
    name = F.lower(metric)
    return F.when(name.contains("fitness"), "lower").when(name.contains("eco"), "higher")


def slug(name: Column) -> Column:
    """File name of a solution: lower case, without umlaut, separators as underscores."""
    return F.translate(F.lower(name), " ö-+", "_o__")

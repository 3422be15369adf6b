"""Golden cases of expressions and statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapart.functions import landcover as lf
from terrapart.functions import stats
from terrapart.functions import vectors


def values(spark, column, rows, kind):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(column(F.col("x"))).collect()]


def test_groups(spark):
    codes = [1, 12, 23, 24, 25, 26, 30, 35, 44, 45, 111, 143, 244, 311, 324, 335, 423, 523, 0, 999, None]
    names = ["Artificial", "Agriculture", "Broadleaf_forest", "Coniferous_forest", "Mixed_forest", "Shrubland", "Grassland_Bare", "Wetlands", "Water", "Unknown", "Artificial", "Unknown", "Agriculture", "Broadleaf_forest", "Shrubland", "Grassland_Bare", "Wetlands", "Water", "NODATA", "NODATA", "Unknown"]
    assert values(spark, lf.clc_group, codes, "int") == names


def test_small_expressions(spark):
    assert values(spark, lambda x: lf.keep_unless_in(x, [0, 999]), [0, 1, None], "int") == [False, True, True]
    assert values(spark, lf.to_number, ["1.5", "x", None], "string") == [1.5, None, None]
    assert values(spark, lf.is_finite, [1.0, float("nan"), float("inf"), None], "double") == [True, False, False, False]
    assert values(spark, lf.direction, ["best_fitness", "eco", "other"], "string") == ["lower", "higher", None]
    assert values(spark, lambda x: lf.safe_ratio(x, x - 1), [1.0, 2.0], "double") == [None, 2.0]
    assert values(spark, lambda x: lf.hex_color(x, x, F.lit(255)), [9], "int") == ["#0909ff"]
    assert values(spark, lf.slug, ["Köppen-Geiger + A"], "string") == ["koppen_geiger___a"]


@pytest.mark.parametrize(("raw", "want"), [([1.0, float("nan"), -1.0, 3.0], [0.25, 0, 0, 0.75]), ([0.0, 0.0], [0.5, 0.5])])
def test_probabilities(spark, raw, want):
    assert values(spark, vectors.normalize_probabilities, [raw], "array<double>")[0] == pytest.approx(want)


def test_row_features(spark):
    rows = spark.createDataFrame([([1.0, 3.0], [10.0, 20.0, 30.0])], "t array<double>, p array<double>")
    all_ = vectors.row_features(F.col("t"), F.col("p")) | vectors.more_row_features(F.col("t"), F.col("p"))
    got = rows.select(*[c.alias(n) for n, c in all_.items()]).first()
    assert list(got) == pytest.approx([2, 1, 3, 2, 20, 10, 30, 60, 20, 1, 8.164966, 5], abs=1e-6)


def test_paired_tests():
    got = stats.paired_pvalues(np.array([1, 2, 3, 4, 5.0]))
    assert got["paired_t_p"] == pytest.approx(0.013236, abs=1e-6) and (got["wilcoxon_stat"], got["wilcoxon_p"]) == (0.0, 0.0625)
    assert stats.paired_pvalues(np.array([1.0])) == {"paired_t_p": None, "wilcoxon_stat": None, "wilcoxon_p": None}
    assert stats.paired_pvalues(np.zeros(4)) == {"paired_t_p": None, "wilcoxon_stat": 0.0, "wilcoxon_p": 1.0}
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    assert list(stats.average_ranks(np.array([3.0, 1.0, 3.0]))) == [2.5, 1.0, 2.5]

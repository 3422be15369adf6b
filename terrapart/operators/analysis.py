"""Analysis of run tables: keys, resume, summaries, rankings, curves, correlations, paired differences.

Summaries are single aggregations; top-N curves are expanding windows over one ranking; paired differences
join runs on the seed with the smaller configuration on the left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapart.functions.landcover import safe_ratio

CONFIG = ["fitness_name", "algorithm", "pheromone_update", "alpha", "beta", "evaporation"]


def config_id(columns: Sequence[str] = CONFIG) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def config_grid(spark, axes: dict[str, Sequence]) -> DataFrame:
    """All combinations of the axes' values with run_id from 1 in the order of the axes; axes are literals."""
    out = spark.range(1).select()
    for place, (name, values) in enumerate(axes.items()):
        options = F.array(*[F.struct(F.lit(i).alias(f"__o{place}"), F.lit(v).alias(name)) for i, v in enumerate(values)])
        out = out.select("*", F.explode(options).alias("__x")).select(*out.columns, "__x.*")
    order = Window.orderBy(*[f"__o{p}" for p in range(len(axes))])
    return out.withColumn("run_id", F.row_number().over(order).cast("long")).drop(*[f"__o{p}" for p in range(len(axes))])


def with_seeds(configs: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return configs.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))


def remaining(configs: DataFrame, done: DataFrame, key: Sequence[str], most: int | None = None) -> DataFrame:
    """Configurations whose key is not in the run table, at most the first ``most`` by run_id."""
    left = configs.join(done.select(*key).distinct(), list(key), "left_anti")
    return left.orderBy("run_id").limit(most) if most is not None else left


def keep_one(runs: DataFrame, key: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return runs.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("__rn = 1").drop("__rn")


def sweep_summary(runs: DataFrame, key: Sequence[str], metrics: Sequence[str], fitness: str = "best_fitness", eco: str = "eco") -> DataFrame:
    """Runs, mean and sample deviation of the metrics that exist, best fitness and ecology, for each configuration."""
    out = [F.count("*").alias("n_runs")]
    for m in metrics:
        if m in runs.columns:
            out += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    if fitness in runs.columns:
        out.append(F.min(fitness).alias(f"best_{fitness}"))
    if eco in runs.columns:
        out.append(F.max(eco).alias(f"best_{eco}"))
    return runs.groupBy(*key).agg(*out)


def checkpoint_by(runs: DataFrame, by: str, value: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return runs.groupBy(by).agg(F.count("*").alias("n"), r(F.avg(value)).alias("mean"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"))


def parameter_means(runs: DataFrame, parameters: Sequence[str], fitness: str = "best_fitness", eco: str = "eco") -> DataFrame:
    """Means by each value of each parameter, in one pass over grouping sets."""
    text = runs.select(*[F.col(p).cast("string").alias(p) for p in parameters], F.col(fitness).alias("__f"), F.col(eco).alias("__e"))
    sets = text.groupingSets([[p] for p in parameters], *parameters).agg(
        F.count("*").alias("n"), F.avg("__f").alias("mean_fitness"), F.stddev_samp("__f").alias("std_fitness"), F.avg("__e").alias("mean_eco"), F.stddev_samp("__e").alias("std_eco"),
        F.min("__f").alias("best_fitness"), F.max("__e").alias("best_eco"), *[F.grouping(p).alias(f"__g_{p}") for p in parameters],
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in parameters:
        here = F.col(f"__g_{p}") == 0
        name, value = F.when(here, p).otherwise(name), F.when(here, F.col(p)).otherwise(value)
    return sets.select(name.alias("parameter"), value.alias("value"), "n", "mean_fitness", "std_fitness", "mean_eco", "std_eco", "best_fitness", "best_eco")


def with_quantiles(found: DataFrame, long: DataFrame, by: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """found (by, n) with linearly interpolated quantiles of long's x; exact, by sorted counts of distinct values, which spill."""
    counts = long.filter("x IS NOT NULL").groupBy(*by, "x").agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("__e", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    at = lambda place: F.max(F.when((F.col("__e") > place) & (F.col("__e") - F.col("__c") <= place), F.col("x")))
    picks = []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("__n") - 1)
        picks += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}")]
    values = ends.groupBy(*by).agg(*picks).withColumnsRenamed({c: f"__k_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    out = found.join(values, same, "left")
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("n") - 1)
        out = out.withColumn(name, F.col(f"__lo_{name}") + (place - F.floor(place)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")))
    return out


def distribution(rows: DataFrame, metrics: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """For each metric (name to lower or higher): count, moments, quartiles, worst, best and range."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"), F.lit(d).alias("d")) for m, d in metrics.items()])).alias("s")).select(*by, "s.*")
    found = long.groupBy(*by, "metric", "d").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    found = with_quantiles(found, long, [*by, "metric"], {"p25": 0.25, "median": 0.5, "p75": 0.75})
    lower = F.col("d") == "lower"
    return found.select(
        *by, "metric", "n", "mean", "std", "p25", "median", "p75",
        F.when(lower, F.col("max")).otherwise(F.col("min")).alias("worst"), F.when(lower, F.col("min")).otherwise(F.col("max")).alias("best"), "min", "max", (F.col("max") - F.col("min")).alias("range"),
    )


def metric_ranges(rows: DataFrame, metrics: Sequence[str], group: str = "fitness_name") -> DataFrame:
    """Range and sample deviation of every metric for each group and over all, in one pass over grouping sets."""
    long = rows.select(group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("s")).select(group, "s.*")
    found = long.groupingSets([[group, "metric"], ["metric"]], group, "metric").agg(
        F.min("x").alias("min"), F.max("x").alias("max"), (F.max("x") - F.min("x")).alias("range"), F.stddev_samp("x").alias("std"), F.grouping(group).alias("__g")
    )
    return found.select(F.when(F.col("__g") == 1, "global").otherwise("fitness").alias("scope"), group, "metric", "min", "max", "range", "std")


def normalised_columns(rows: DataFrame, metrics: Sequence[str], group: str = "fitness_name") -> DataFrame:
    """Min-max values of every metric within its group and over all; 0 where a metric is constant."""
    ends = lambda scope: [f(m).alias(f"__{side}_{m}_{scope}") for m in metrics for side, f in (("low", F.min), ("high", F.max))]
    each = rows.groupBy(F.col(group).alias("__g")).agg(*ends(group))
    out = rows.join(each, F.col(group).eqNullSafe(F.col("__g")), "left").join(F.broadcast(rows.agg(*ends("global"))))  # one row
    scaled = lambda m, low, high: F.coalesce(safe_ratio(F.col(m) - low, high - low), F.col(m).cast("double") * 0.0)
    return out.select(*rows.columns, *[scaled(m, F.col(f"__low_{m}_{s}"), F.col(f"__high_{m}_{s}")).alias(f"{m}_norm_{s}") for s in (group, "global") for m in metrics])


def best_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= n)


def selected_configs(summary: DataFrame, key: Sequence[str], fitness: str, eco: str, group: str = "fitness_name") -> DataFrame:
    """Best configuration by fitness of each group, and the best by ecology if it is not one of them."""
    tie = [F.asc_nulls_last(c) for c in key]
    best = best_rows(summary, [group], [F.asc(fitness), *tie]).drop("rank").withColumn("selection", F.concat(F.lit("best_"), group))
    green = summary.orderBy(F.desc(eco), *tie).limit(1).withColumn("selection", F.lit("best_ecology"))
    return best.unionByName(green.join(best.select(*key), list(key), "left_anti").select(*best.columns))


def candidates(summary: DataFrame, key: Sequence[str], fitness: str, top_n: int, top_n_per_algorithm: int, threshold: float | None = None, group: str = "fitness_name") -> DataFrame:
    """The top configurations of each group and of each group and algorithm below threshold, each once."""
    rows = summary if threshold is None else summary.filter(F.col(fitness) < threshold)
    order = [F.asc(fitness), *[F.asc_nulls_last(c) for c in key]]
    whole = rows.drop("rank") if top_n < 0 else best_rows(rows, [group], order, top_n).drop("rank")
    each = best_rows(rows, [group, "algorithm"], order, top_n_per_algorithm).drop("rank")
    return whole.unionByName(each).dropDuplicates(list(key))


def top_overlap(rows: DataFrame, key: Sequence[str], fitness: str, eco: str, n: int = 50, group: str = "fitness_name") -> DataFrame:
    """How many rows are among the first n by fitness and by ecology, for each group."""
    tie = [F.asc_nulls_last(c) for c in key]
    w = Window.partitionBy(group)
    ranked = rows.withColumn("a", F.row_number().over(w.orderBy(F.asc(fitness), *tie))).withColumn("b", F.row_number().over(w.orderBy(F.desc(eco), *tie)))
    return ranked.groupBy(group).agg(F.count_if((F.col("a") <= n) & (F.col("b") <= n)).alias("overlap"))


def top_n_std(rows: DataFrame, rank_by: str, metrics: Sequence[str], key: Sequence[str], group: str | None = "fitness_name", least: int = 10, ascending: bool = True, parts: int = 64) -> DataFrame:
    """Sample deviation of each metric over the first n rows of a ranking, for every n from least on; over all rows if group is None.

    No task holds a whole ranking: rows are dealt into ranges of rank_by, which are summed up on their own (sums of
    differences from the metric's mean, so that they stay small) and get the totals of the ranges before them. Rows
    without a rank_by come first when ascending, else last; ties go by key, and equal values share a range.
    """
    by = [group] if group else []
    sign = 1.0 if ascending else -1.0
    value = sign * F.col(rank_by).cast("double")
    ends = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("cuts"), *[F.avg(m).alias(m) for m in metrics]).first()
    cuts = F.array(*[F.lit(v) for v in sorted(set(ends["cuts"] or []))]).cast("array<double>")
    range_of = F.when(F.col(rank_by).isNull(), -1 if ascending else parts + 1).otherwise(F.size(F.filter(cuts, lambda c: c < value)))
    off = {m: F.col(m).cast("double") - F.lit(ends[m]).cast("double") for m in metrics}
    terms = {"__n": F.lit(1)} | {f"__{p}_{m}": e for m in metrics for p, e in (("c", F.col(m).isNotNull().cast("long")), ("s", F.coalesce(off[m], F.lit(0.0))), ("q", F.coalesce(off[m] * off[m], F.lit(0.0))))}
    dealt = rows.select(*by, rank_by, *key, range_of.alias("__part"), *[e.alias(n) for n, e in terms.items()])
    order = Window.partitionBy(*by, "__part").orderBy(F.asc(rank_by) if ascending else F.desc(rank_by), *[F.asc_nulls_last(c) for c in key])
    inside = dealt.select(*by, "__part", *[F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in terms])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = dealt.groupBy(*by, "__part").agg(*[F.sum(n).alias(n) for n in terms])
    starts = sums.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__part").alias("__k"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__b{n}") for n in terms])
    met = inside.join(starts, [F.col("__part") == F.col("__k"), *[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]])
    so_far = lambda n: F.col(n) + F.col(f"__b{n}")
    std = lambda m: F.when(so_far(f"__c_{m}") > 1, F.sqrt(F.greatest(F.lit(0.0), so_far(f"__q_{m}") - so_far(f"__s_{m}") * so_far(f"__s_{m}") / so_far(f"__c_{m}")) / (so_far(f"__c_{m}") - 1)))
    out = met.select(*by, so_far("__n").cast("long").alias("n"), *[std(m).alias(m) for m in metrics]).filter(F.col("n") >= least)
    return out.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("std")) for m in metrics])).alias("s")).select(*by, "n", "s.*")


def pearson(x: str, y: str, window=None) -> Column:
    """Correlation of two columns, over a window if given; null where one of them is constant."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(there, F.col(x)), F.when(there, F.col(y))
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    top, one, two = [p.over(window) for p in parts] if window is not None else parts
    return top / F.nullif(one * two, F.lit(0.0))


def top_n_pearson(rows: DataFrame, x: str, y: str, key: Sequence[str], group: str = "fitness_name", least: int = 20) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.asc(x), *[F.asc_nulls_last(c) for c in key])
    so_far = pearson(x, y, order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(group, F.row_number().over(order).cast("long").alias("n"), so_far.alias("pearson")).filter(F.col("n") >= least)


def global_ranks(rows: DataFrame, columns: Sequence[str], parts: int = 64) -> DataFrame:
    """The columns' average ranks over all rows (null stays null); no task holds more than a range of values.

    Distinct values are counted and dealt into ranges by approximate quantiles; a value's rank is the number of
    rows in the ranges before, one row for each range, and of those before it in its own.
    """
    out = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    shares = [i / parts for i in range(1, parts)]
    bounds = out.agg(*[F.percentile_approx(c, shares).alias(c) for c in columns]).first()
    for c in columns:
        cuts = F.array(*[F.lit(v) for v in sorted(set(bounds[c] or []))]).cast("array<double>")
        counts = out.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count("*").alias("__c"))
        counts = counts.withColumn("__part", F.size(F.filter(cuts, lambda b: b < F.col("__v"))))  # noqa: B023
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.groupBy("__part").agg(F.sum("__c").alias("__s")).select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))  # at most parts rows
        inside = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        ranks = counts.withColumn("__e", F.sum("__c").over(inside)).join(F.broadcast(starts), "__part")
        ranks = ranks.select("__v", (F.col("__s") + F.col("__e") - (F.col("__c") - 1) / 2.0).alias("__r"))
        out = out.join(ranks, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__r")).drop("__v", "__r")
    return out


def top_n_spearman(rows: DataFrame, x: str, y: str, key: Sequence[str], group: str = "fitness_name", least: int = 20, chunk: int = 64) -> DataFrame:
    """Rank correlation over the first n rows by x, for every n; ranks change with n, so each prefix is ranked.

    A task ranks chunk prefixes of one group with numpy; a group's rows go to every task with a longer prefix.
    """
    from terrapart.functions.stats import average_ranks

    order = Window.partitionBy(group).orderBy(F.asc(x), *[F.asc_nulls_last(c) for c in key])
    ranked = rows.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.row_number().over(order).cast("long").alias("r"))
    whole = ranked.withColumn("last", F.max("r").over(Window.partitionBy(group)))
    dealt = whole.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("r") - 1) / chunk), F.floor((F.col("last") - 1) / chunk))))

    def correlate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        a, b, first = part.x.to_numpy(), part.y.to_numpy(), int(part.chunk.iloc[0]) * chunk
        found = []
        for n in range(max(least, first + 1), min(first + chunk, len(a)) + 1):
            there = ~(np.isnan(a[:n]) | np.isnan(b[:n]))
            u, v = average_ranks(a[:n][there]), average_ranks(b[:n][there])
            spread = u.std() * v.std() if len(u) else 0.0
            found.append((part[group].iloc[0], n, float(((u - u.mean()) * (v - v.mean())).mean() / spread) if spread > 0 else None))
        return pd.DataFrame(found, columns=[group, "n", "spearman"])

    kind = rows.schema[group].dataType.simpleString()
    return dealt.groupBy(group, "chunk").applyInPandas(correlate, f"{group} {kind}, n long, spearman double")


def correlations(rows: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, r for every pair of columns."""
    if method == "spearman":
        rows = global_ranks(rows, columns)
    pairs = [(a, b) for a in columns for b in columns]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("r")) for a, b in pairs])
    return rows.agg(cells.alias("m")).select(F.explode("m").alias("m")).select("m.*")


def objective_correlations(rows: DataFrame, key: Sequence[str], value: str, objectives: Sequence[str], objective: str = "fitness_name") -> DataFrame:
    """Correlation of the objectives' values over configurations that all of them have."""
    wide = rows.groupBy(*key).pivot(objective, list(objectives)).agg(F.first(value)).na.drop(subset=list(objectives))
    return correlations(wide, objectives)


def paired(runs: DataFrame, key: Sequence[str], metrics: Sequence[str], seed: str = "seed") -> DataFrame:
    """cfg_a, cfg_b, metric, seed, d: differences of every pair of configurations (a < b) on common seeds."""
    named = runs.select(config_id(key).alias("cfg"), seed, *[F.col(m).cast("double").alias(m) for m in metrics])
    a, b = named.select(F.col("cfg").alias("cfg_a"), seed, F.struct(*metrics).alias("x")), named.select(F.col("cfg").alias("cfg_b"), seed, F.struct(*metrics).alias("y"))
    met = a.join(b, seed).filter("cfg_a < cfg_b")
    return met.select("cfg_a", "cfg_b", seed, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"x.{m}") - F.col(f"y.{m}")).alias("d")) for m in metrics])).alias("s")).select("cfg_a", "cfg_b", seed, "s.*")


def paired_differences(pairs: DataFrame) -> DataFrame:
    """n, mean, median, sample deviation, Cohen's dz and t of each pair; all but n null with fewer than two."""
    found = pairs.filter(F.col("d").isNotNull()).groupBy("cfg_a", "cfg_b", "metric").agg(F.count("*").alias("n_pairs"), F.avg("d").alias("m"), F.median("d").alias("md"), F.stddev_samp("d").alias("sd"))  # as many values as seeds
    some = lambda c: F.when(F.col("n_pairs") >= 2, c)
    dz = safe_ratio(F.col("m"), F.col("sd"))
    return found.select(
        "cfg_a", "cfg_b", "metric", "n_pairs", some(F.col("m")).alias("mean_diff"), some(F.col("md")).alias("median_diff"), some(F.col("sd")).alias("std_diff"),
        some(dz).alias("cohen_dz"), some(dz * F.sqrt(F.col("n_pairs").cast("double"))).alias("paired_t_stat"),
    )


def t_two_sided(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite series of sines and cosines."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom.cast("double")))
    even = freedom % 2 == 0
    square = F.pow(F.cos(angle), F.lit(2.0))
    terms = F.floor((freedom - F.when(even, 2).otherwise(3)) / 2)  # after the first
    step = lambda at, j: F.struct((at["term"] * square * F.when(even, (2 * j - 1) / (2 * j)).otherwise((2 * j) / (2 * j + 1))).alias("term"), at["total"].alias("total"))
    grown = lambda at, j: F.struct(step(at, j)["term"].alias("term"), (at["total"] + step(at, j)["term"]).alias("total"))
    first = F.when(even, 1.0).otherwise(F.cos(angle))
    start = F.struct(first.alias("term"), first.alias("total"))
    places = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    series = F.sin(angle) * F.aggregate(places, start, grown, lambda at: at["total"])
    inside = F.when(even, series).when(freedom == 1, angle * (2 / math.pi)).otherwise((angle + series) * (2 / math.pi))
    return F.greatest(F.lit(0.0), 1 - inside)


def wilcoxon_table(spark, most: int = 50) -> DataFrame:
    """n, low, p: exact two-sided p-values of the smaller rank sum, for up to ``most`` pairs (22,000 rows for 50)."""
    rows = []
    for n in range(1, most + 1):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        below = np.minimum(1.0, 2 * np.cumsum(ways) / 2.0**n)
        rows += [(n, float(w), float(p)) for w, p in enumerate(below[: n * (n + 1) // 4 + 1])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["__n", "__low", "__p"]))


def paired_tests(pairs: DataFrame) -> DataFrame:
    """paired_t_p, wilcoxon_stat and wilcoxon_p of each pair of configurations; null with fewer than two finite differences.

    The signed-rank test is exact for up to 50 differences without zeros or ties, else by the normal curve. A
    pair has one difference for each seed, so its ranks are array expressions.
    """

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(x / math.sqrt(2)), na_action="ignore")

    finite = F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") != float("inf"))
    found = pairs.groupBy("cfg_a", "cfg_b", "metric").agg(F.avg(F.when(finite, F.col("d"))).alias("__m"), F.stddev_samp(F.when(finite, F.col("d"))).alias("__sd"), F.collect_list(F.when(finite, F.col("d"))).alias("__d"))
    found = found.withColumn("__k", F.size("__d")).withColumn("__z", F.filter("__d", lambda x: x != 0)).withColumn("__n", F.size("__z"))
    alike = lambda x: F.size(F.filter("__z", lambda y: F.abs(y) == F.abs(x)))
    rank = lambda x: F.size(F.filter("__z", lambda y: F.abs(y) < F.abs(x))) + (alike(x) + 1) / 2.0
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    side = lambda keep: total(F.transform(F.filter("__z", keep), lambda x: rank(x).cast("double")))
    found = found.withColumn("__low", F.least(side(lambda x: x > 0), side(lambda x: x < 0)))
    found = found.withColumn("__tied", total(F.transform("__z", lambda x: (alike(x) * alike(x) - 1).cast("double"))))
    met = found.join(F.broadcast(wilcoxon_table(pairs.sparkSession)), ["__n", "__low"], "left")
    n = F.col("__n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("__tied") / 48.0
    z = F.when(variance > 0, F.abs(F.col("__low") - n * (n + 1) / 4.0) / F.sqrt(variance)).otherwise(0.0)
    exact = (F.col("__n") <= 50) & (F.col("__n") == F.col("__k")) & (F.col("__tied") == 0)
    normal = tail(F.when(~exact & (F.col("__n") > 0), z))
    p = F.when(F.col("__n") == 0, 1.0).when(exact, F.col("__p")).otherwise(F.least(F.lit(1.0), normal))
    some = lambda c: F.when(F.col("__k") >= 2, c)
    t = F.col("__m") / (F.nullif("__sd", F.lit(0.0)) / F.sqrt(F.col("__k").cast("double")))
    return met.select("cfg_a", "cfg_b", "metric", some(t_two_sided(t, F.col("__k") - 1)).alias("paired_t_p"), some(F.col("__low")).alias("wilcoxon_stat"), some(p).alias("wilcoxon_p"))


def significance(runs: DataFrame, key: Sequence[str], metrics: Sequence[str], seed: str = "seed") -> DataFrame:
    """Differences and p-values of every pair of configurations in one table."""
    pairs = paired(runs, key, metrics, seed)
    return paired_differences(pairs).join(paired_tests(pairs), ["cfg_a", "cfg_b", "metric"])


def by_significance(table: DataFrame) -> DataFrame:
    """The table in the order of a report: by metric and p-values, nulls last."""
    return table.orderBy("metric", F.asc_nulls_last("wilcoxon_p"), F.asc_nulls_last("paired_t_p"), "cfg_a", "cfg_b")


def best_so_far(history: DataFrame, value: str = "fitness", by: Sequence[str] = (), order: str = "iteration") -> DataFrame:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_so_far", F.min(value).over(window))


def iteration_stats(ants: DataFrame, by: Sequence[str] = ("iteration",), pheromone: str | None = None) -> DataFrame:
    """Best, mean and deviation of the fitness of each iteration, and the pheromone's ends if its column is named."""
    ends = [F.min(pheromone).alias("pheromone_min"), F.max(pheromone).alias("pheromone_max")] if pheromone else []
    return ants.groupBy(*by).agg(F.min("fitness").alias("iteration_best"), F.avg("fitness").alias("mean"), F.stddev_pop("fitness").alias("std"), *ends)


def relabelled(runs: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return runs.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def union_migrate(old: DataFrame, rerun: DataFrame, legacy: str, column: str = "algorithm") -> DataFrame:
    """Old runs without the legacy algorithm, and its rerun; columns that one side lacks are null."""
    return old.filter(F.col(column) != legacy).unionByName(rerun, allowMissingColumns=True)


def quality_gate(runs: DataFrame, failures: DataFrame | None, metrics: Sequence[str], expected: int | None = None) -> DataFrame:
    """One row: rows, failures, rows with a non-finite metric, and whether the table is complete and clean."""
    from terrapart.functions.landcover import is_finite

    bad = F.lit(False)
    for m in metrics:
        bad = bad | ~is_finite(F.col(m).cast("double"))
    failed = failures.count() if failures is not None else 0
    out = runs.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad")).withColumn("n_failures", F.lit(failed).cast("long"))
    whole = F.lit(True) if expected is None else F.col("n_rows") >= expected
    return out.withColumn("passed", (F.col("n_bad") == 0) & (F.col("n_failures") == 0) & whole)

"""Pheromone tables (node_id, tau array<double>) and their updates as joins and aggregations.

Solutions are rows (ant, fitness, node_id, label). A deposit is aggregated by node and label before it meets
the table, so one row for each node and label is shuffled, however many ants there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapart.functions import vectors

#: Fixed values of the updates.
LOW, HIGH = 1e-6, 1e6
FIT_EPS, ROW_EPS = 1e-9, 1e-12


def initial(nodes: DataFrame, clusters: int, value: float = 1.0, normalize_rows: bool = True) -> DataFrame:
    each = 1.0 / clusters if normalize_rows else value
    return nodes.select("node_id", F.array_repeat(F.lit(each), clusters).alias("tau"))


def finished(tau: Column) -> Column:
    """Clipped entries, scaled to sum 1."""
    clipped = F.transform(tau, lambda x: F.least(F.greatest(x, F.lit(LOW)), F.lit(HIGH)))
    return F.transform(F.array(clipped), lambda c: F.transform(c, lambda x: x / (vectors.total(c) + ROW_EPS)))[0]


def deposited(table: DataFrame, deposits: DataFrame, evaporation: float) -> DataFrame:
    """tau after evaporation with the deposits (node_id, label, amount) on top."""
    rows = deposits.groupBy("node_id", "label").agg(F.sum("amount").alias("a")).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "a"))).alias("m"))
    met = table.join(rows, "node_id", "left")
    added = F.transform("tau", lambda x, i: x * (1.0 - evaporation) + F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return met.select("node_id", finished(added).alias("tau"))


def update_all_ants(table: DataFrame, solutions: DataFrame, evaporation: float, q: float) -> DataFrame:
    """Every ant deposits q / fitness at its labels."""
    return deposited(table, solutions.select("node_id", "label", (F.lit(q) / (F.col("fitness") + FIT_EPS)).alias("amount")), evaporation)


def update_best_ant(table: DataFrame, solutions: DataFrame, evaporation: float, q: float) -> DataFrame:
    """Only the best ant deposits, the first on ties."""
    best = solutions.agg(F.min(F.struct("fitness", "ant")).alias("b")).select(F.col("b.ant").alias("ant"))
    return update_all_ants(table, solutions.join(F.broadcast(best), "ant"), evaporation, q)  # one row


def update_quality_weighted(table: DataFrame, solutions: DataFrame, evaporation: float, q: float, clip_first: bool = False) -> DataFrame:
    """Ants deposit q times their squared, clipped quality against the mean.

    As published, quality is squared before it is clipped, so an ant worse than the mean deposits too;
    clip_first=True gives such ants nothing.
    """
    fits = solutions.select("ant", "fitness").distinct()
    stats = fits.agg(F.avg("fitness").alias("mean"), F.min("fitness").alias("best"))
    raw = (F.col("mean") - F.col("fitness")) / (F.col("mean") - F.col("best") + ROW_EPS) + ROW_EPS
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    quality = clip(raw) * clip(raw) if clip_first else clip(raw * raw)
    rated = solutions.join(F.broadcast(stats))  # one row
    return deposited(table, rated.select("node_id", "label", (q * quality).alias("amount")), evaporation)

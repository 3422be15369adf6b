"""From pixels to model data, from labelings to a comparison, and sweeps that resume."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapart.operators import analysis as an
from terrapart.operators import colony as co
from terrapart.operators import graph as gr
from terrapart.operators import landcover as lc
from terrapart.operators import raster as ra
from terrapart.sources import tables as st


@dataclass
class ModelData:
    """pixels (row, col, node_id), nodes (node_id, f, weight, r, c) and edges (src, rank, dst, dist)."""

    pixels: DataFrame
    nodes: DataFrame
    edges: DataFrame
    features: list[str]


def feature_table(pixels: DataFrame, mode: str = "raw", more: bool = False) -> tuple[DataFrame, list[str]]:
    """Pixels with the features of a mode: raw layers, climate summaries, or grouped components."""
    temperature, rain = ra.climate_columns(pixels.columns)
    if mode == "raw":
        return pixels, [*temperature, *rain]
    wide = pixels.withColumns({"__t": F.array(*[F.col(c).cast("double") for c in temperature]), "__p": F.array(*[F.col(c).cast("double") for c in rain])})
    if mode == "koppen":
        out = ra.climate_features(wide, "__t", "__p", more).drop("__t", "__p")
        return out, [c for c in out.columns if c not in pixels.columns]
    if mode == "pca":
        key = wide.withColumn("__key", F.concat_ws("_", "row", "col"))
        parts, _ = ra.grouped_pca(key, {"temp": ("__t", 2), "rain": ("__p", 2)}, "__key")
        names = [c for c in parts.columns if c != "__key"]
        return key.join(parts, "__key").drop("__key", "__t", "__p"), names
    raise ValueError(mode)


def prepare_model_data(pixels: DataFrame, mode: str = "superpixels", features: str = "raw", target_size: int = 150, neighbours: int = 16, scale: bool = True, superpixels: str = "tiles", seed: int = 0) -> ModelData:
    """Features, aggregation to nodes, scaling and the spatial graph.

    In pixel mode a node's id is its place in the lattice; superpixels are square tiles or k-means clusters of
    positions, of about target_size cells. Rows without all features are left out first.
    """
    table, names = feature_table(pixels, features)
    table = ra.complete_rows(table, names)
    if mode == "pixels":
        width = table.agg(F.max("col")).first()[0] + 1
        table = table.withColumn("node_id", (F.col("row").cast("long") * width + F.col("col")).cast("long"))
        nodes = ra.raw_features(table, names).select("node_id", "f", F.lit(1.0).alias("weight"), F.col("row").cast("double").alias("r"), F.col("col").cast("double").alias("c"))
        placed = table.select("row", "col", "node_id")
    elif mode == "superpixels":
        side = max(1, round(target_size**0.5))
        dealt = ra.tile_superpixels(table, side) if superpixels == "tiles" else ra.kmeans_superpixels(table, target_size, seed)
        nodes = ra.superpixel_means(ra.raw_features(dealt, names), "superpixel")
        placed = dealt.join(nodes.select("superpixel", "node_id"), "superpixel").select("row", "col", "node_id")
        nodes = nodes.select("node_id", "f", "weight", "r", "c")
    else:
        raise ValueError(mode)
    if scale:
        entries = nodes.select("*", *[F.col("f")[i].alias(f"__f{i}") for i in range(len(names))])
        columns = [f"__f{i}" for i in range(len(names))]
        nodes = ra.standard_scale(entries, columns).withColumn("f", F.array(*columns)).drop(*columns)
    return ModelData(placed, nodes, gr.knn_lattice(nodes, neighbours), names)


def compare_solutions(nodes: DataFrame, edges: DataFrame, snn: DataFrame, solutions: DataFrame, references: Sequence[str], pixels: DataFrame | None = None, cover: DataFrame | None = None, legend: DataFrame | None = None, sample: Sequence[int] | None = None) -> DataFrame:
    """A row for each solution: three fitness values, the Rand index against each reference, the land-use score.

    solutions: solution, node_id, label. There are few solutions; each is scored by plans over its nodes.
    """
    spark = nodes.sparkSession
    rows = []
    told = {s: solutions.filter(F.col("solution") == s).select("node_id", "label") for s in sorted(r[0] for r in solutions.select("solution").distinct().collect())}
    for name, labels in told.items():
        labelled = nodes.drop("label").join(labels, "node_id")
        rough = gr.disagreement(edges, labels)
        row = {"solution": name}
        terms = {"centroid": (gr.compactness(labelled), "compactness"), "silhouette": (gr.silhouette_mean(gr.silhouette(labelled, sample, fallback=sample is None)), "silhouette_term"), "snn": (gr.snn_cut(snn, labels), "cut")}
        for objective, (term, column) in terms.items():
            row[f"{objective}_fitness"] = gr.mixed_fitness(term, column, rough).first().fitness
        for reference in references:
            both = labels.join(told[reference].withColumnRenamed("label", "other"), "node_id")
            row[f"ari_vs_{reference}"] = gr.adjusted_rand(both, "label", "other").first().ari
        if pixels is not None and cover is not None:
            overall = lc.evaluate_labels(pixels, labels, cover, legend)[1].first()
            row["land_use_score"] = overall.weighted_combined_ecological_consistency if overall else None
        rows.append(row)
    kinds = ", ".join(f"{c} {'string' if c == 'solution' else 'double'}" for c in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], kinds)


#: The key of a run for resuming.
RUN_KEY = ["fitness_name", "algorithm", "pheromone_update", "alpha", "beta", "evaporation", "q", "seed", "feature_mode", "mode"]


def sweep_configs(spark: SparkSession, algorithms: Sequence[str], updates: Sequence[str], objectives: Sequence[str], alphas: Sequence[float], betas: Sequence[float], evaporations: Sequence[float], qs: Sequence[float], seeds: Sequence[int], feature_mode: str = "raw", mode: str = "superpixels") -> DataFrame:
    """The grid of a sweep with seeds, for one feature set and mode; names are checked."""
    unknown = (set(algorithms) - set(co.ALGORITHMS)) | (set(objectives) - set(co.OBJECTIVES))
    if unknown:
        raise ValueError(f"unknown: {sorted(unknown)}")
    axes = {"fitness_name": list(objectives), "algorithm": list(algorithms), "pheromone_update": list(updates), "alpha": list(alphas), "beta": list(betas), "evaporation": list(evaporations), "q": list(qs)}
    return an.with_seeds(an.config_grid(spark, axes), seeds).withColumns({"feature_mode": F.lit(feature_mode), "mode": F.lit(mode)})


def with_comparisons(runs: DataFrame, labels: DataFrame, baseline: DataFrame, pixels: DataFrame | None = None, cover: DataFrame | None = None, legend: DataFrame | None = None) -> DataFrame:
    """runs (run_id, seed, ...) with ari_vs_kmeans and, given a cover, the land-use scores of their labelings.

    labels: run_id, seed, node_id, label; baseline: node_id, label. All runs are scored in one aggregation.
    """
    key = ["run_id", "seed"]
    both = labels.join(baseline.select("node_id", F.col("label").alias("__base")), "node_id")
    out = runs.join(gr.adjusted_rands(both, key, "label", "__base").withColumnRenamed("ari", "ari_vs_kmeans"), key, "left")
    if pixels is None or cover is None:
        return out
    classes = lc.with_legend(pixels.select("row", "col", "node_id").join(cover.select("row", "col", "clc_class"), ["row", "col"]).filter(~F.col("clc_class").isin(0, 999)), legend)
    named = labels.select("node_id", F.struct(*key, "label").alias("cluster"))
    per = lc.consistency(classes.join(named, "node_id")).select("cluster.*", *lc.SCORED)
    return out.join(lc.overall_by(per, key), key, "left")


def run_sweep(configs: DataFrame, model: co.Model, path: str, most: int | None = None, **settings) -> DataFrame:
    """Run what the run table at path lacks, append it (failures too), and return the table."""
    spark = configs.sparkSession
    todo = configs
    if st.exists(spark, path):
        done = spark.read.parquet(path).filter("status = 'ok'")
        todo = an.remaining(configs, done, RUN_KEY)
    if most is not None:
        todo = todo.orderBy("run_id", "seed").limit(most)
    n = max(1, min(todo.count(), 4 * spark.sparkContext.defaultParallelism))
    st.append_runs(co.run_configs(todo.repartition(n, "run_id", "seed"), model, **settings), path, ["fitness_name"])
    return spark.read.parquet(path)

"""Command line: ``python -m terrapart.plans.cli sweep|topn ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def numbers(text: str) -> list[float]:
    """"0.1, 0.2" as a list; at least one number."""
    found = [float(p) for p in text.split(",") if p.strip()]
    if not found:
        raise argparse.ArgumentTypeError("no numbers")
    return found


def names(text: str, allowed: list[str]) -> list[str]:
    """Comma-separated names, or all of them."""
    found = allowed if text.strip() == "all" else [p.strip() for p in text.split(",") if p.strip()]
    unknown = sorted(set(found) - set(allowed))
    if unknown or not found:
        raise argparse.ArgumentTypeError(f"unknown: {unknown}")
    return found


def parser() -> argparse.ArgumentParser:
    from terrapart.operators.colony import ALGORITHMS, OBJECTIVES

    top = argparse.ArgumentParser(prog="terrapart")
    commands = top.add_subparsers(dest="command", required=True)
    sweep = commands.add_parser("sweep", help="run the grid that the run table lacks")
    sweep.add_argument("--pixels", required=True, help="Parquet with row, col and layers")
    sweep.add_argument("--out", required=True)
    sweep.add_argument("--features", choices=["raw", "koppen", "pca"], default="raw")
    sweep.add_argument("--mode", choices=["pixels", "superpixels"], default="superpixels")
    sweep.add_argument("--target-size", type=int, default=150)
    sweep.add_argument("--neighbours", type=int, default=16)
    sweep.add_argument("--algorithms", type=lambda t: names(t, list(ALGORITHMS)), default=list(ALGORITHMS))
    sweep.add_argument("--objectives", type=lambda t: names(t, list(OBJECTIVES)), default=list(OBJECTIVES))
    for name, default in (("alphas", "0.75,1,2"), ("betas", "1,3"), ("evaporations", "0.02,0.1"), ("qs", "0.05"), ("seeds", "0,1")):
        sweep.add_argument(f"--{name}", type=numbers, default=numbers(default))
    sweep.add_argument("--ants", type=int, default=15)
    sweep.add_argument("--iterations", type=int, default=20)
    sweep.add_argument("--max-runs", type=int)
    sweep.add_argument("--dry-run", action="store_true")
    topn = commands.add_parser("topn", help="top-N curves of a summary table")
    topn.add_argument("--summary", required=True)
    topn.add_argument("--out", required=True)
    topn.add_argument("--fitness", default="fit")
    topn.add_argument("--ecology", default="eco")
    topn.add_argument("--opposite-ranking", action="store_true")
    topn.add_argument("--std-only", action="store_true")
    return top


def main(arguments: list[str] | None = None) -> int:
    from terrapart.operators import analysis as an
    from terrapart.operators import colony as co
    from terrapart.operators import graph as gr
    from terrapart.plans import model as mo

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "sweep":
        updates = ["all_ants", "best_ant", "quality_weighted"]
        configs = mo.sweep_configs(spark, args.algorithms, updates, args.objectives, args.alphas, args.betas, args.evaporations, args.qs, [int(s) for s in args.seeds])
        logging.info("%d runs in the grid", configs.count())
        if args.dry_run:
            return 0
        data = mo.prepare_model_data(spark.read.parquet(args.pixels), args.mode, args.features, args.target_size, args.neighbours)
        near = gr.knn_features(data.nodes, 20)
        problem, _ = co.collect_model(data.nodes, data.edges, gr.snn_graph(near, gr.undirected(data.edges), 20))
        runs = mo.run_sweep(configs, problem, args.out, args.max_runs, n_ants=args.ants, n_iterations=args.iterations)
        logging.info("%d runs in the table, %d failed", runs.count(), runs.filter("status = 'failed'").count())
        return 0
    rows = spark.read.parquet(args.summary)
    key = [c for c in an.CONFIG if c in rows.columns]
    by = args.ecology if args.opposite_ranking else args.fitness
    an.top_n_std(rows, by, [args.fitness, args.ecology], key, ascending=not args.opposite_ranking).write.mode("overwrite").parquet(f"{args.out}/topn_std_curves")
    if not args.std_only:
        pearson = an.top_n_pearson(rows, args.fitness, args.ecology, key)
        pearson.join(an.top_n_spearman(rows, args.fitness, args.ecology, key), ["fitness_name", "n"]).write.mode("overwrite").parquet(f"{args.out}/topn_corr_curves")
    an.metric_ranges(rows.select("fitness_name", F.col(args.fitness), F.col(args.ecology)), [args.fitness, args.ecology]).write.mode("overwrite").parquet(f"{args.out}/metric_ranges")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

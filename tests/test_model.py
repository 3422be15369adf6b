import argparse

import pytest
from pyspark.sql import functions as F

from terrapart.operators import colony as co
from terrapart.operators import graph as gr
from terrapart.operators import plots
from terrapart.plans import cli
from terrapart.plans import model as mo


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(r, c, float(r), float(r + c), float(c), float(r * c) if (r, c) != (0, 0) else None) for r in range(12) for c in range(12)]
    return spark.createDataFrame(rows, "row int, col int, temp_1 double, temp_2 double, padavine_1 double, padavine_2 double")


@pytest.mark.parametrize("features", ["raw", "koppen", "pca"])
def test_prepare(pixels, features):
    data = mo.prepare_model_data(pixels.fillna(0.0), "superpixels", features, target_size=9, neighbours=4)
    assert data.nodes.count() == 16 and data.edges.count() == 64 and data.pixels.count() == 144
    assert data.nodes.agg(F.sum("weight")).first()[0] == 144.0
    means = data.nodes.select(F.avg(F.col("f")[0]), F.stddev_pop(F.col("f")[0])).first()
    assert means[0] == pytest.approx(0, abs=1e-9) and means[1] == pytest.approx(1)


def test_prepare_pixels_and_clusters(pixels):
    data = mo.prepare_model_data(pixels, "pixels", neighbours=4, scale=False)
    assert data.nodes.count() == 143 and data.features == ["temp_1", "temp_2", "padavine_1", "padavine_2"]
    assert mo.prepare_model_data(pixels, "superpixels", target_size=20, neighbours=2, superpixels="kmeans").nodes.count() == 7
    with pytest.raises(ValueError):
        mo.prepare_model_data(pixels, "nothing")


def test_sweep_resumes_and_compares(spark, pixels, tmp_path):
    data = mo.prepare_model_data(pixels.fillna(0.0), target_size=9, neighbours=4)
    snn = gr.snn_graph(data.edges, gr.undirected(data.edges), 4)
    problem, ids = co.collect_model(data.nodes, data.edges, snn)
    configs = mo.sweep_configs(spark, ["aco_centroid"], ["best_ant"], ["centroid", "snn"], [1.0], [1.0], [0.1], [0.05], [0, 1])
    settings = {"n_ants": 2, "n_iterations": 2, "clusters": 3}
    first = mo.run_sweep(configs, problem, str(tmp_path / "runs"), most=1, **settings)
    assert first.count() == 1
    runs = mo.run_sweep(configs, problem, str(tmp_path / "runs"), **settings)
    assert runs.count() == 4 and runs.filter("status <> 'ok'").count() == 0 and runs.select(*mo.RUN_KEY).distinct().count() == 4
    labels = co.labels_of(runs, ids).select(F.concat_ws("_", F.lit("run"), "run_id", "seed").alias("solution"), "node_id", "label")
    table = mo.compare_solutions(data.nodes, data.edges, snn, labels, ["run_1_0"]).collect()
    own = {f"run_{r.run_id}_{r.seed}": r for r in runs.collect()}
    assert len(table) == 4
    for r in table:
        assert r.snn_fitness == pytest.approx(own[r.solution].snn_fitness) and (r.solution != "run_1_0" or r.ari_vs_run_1_0 == pytest.approx(1.0))
    with pytest.raises(ValueError):
        mo.sweep_configs(spark, ["x"], ["best_ant"], ["snn"], [1.0], [1.0], [0.1], [0.05], [0])


def test_plot_tables(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in [0, 1, 2, 3, 4, 100]] + [("a", None)], "g string, x double")
    bins = {r.bin: (r.low, r.high, r["count"]) for r in plots.histogram(rows, "x", 10).collect()}
    assert bins == {0: (0.0, 10.0, 5), 9: (90.0, 100.0, 1)}
    box = plots.box_stats(rows, "x", ["g"]).first()
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high, box.n_outside) == (1.25, 2.5, 3.75, 0.0, 4.0, 1)


def test_command_line(spark, tmp_path):
    assert cli.numbers("0.1, 2") == [0.1, 2.0] and cli.names("all", ["a", "b"]) == ["a", "b"]
    for bad in (lambda: cli.numbers(","), lambda: cli.names("x", ["a"])):
        with pytest.raises(argparse.ArgumentTypeError):
            bad()
    assert cli.main(["sweep", "--pixels", "none", "--out", "none", "--objectives", "snn", "--dry-run"]) == 0
    rows = [("snn", f"a{i}", float(i % 7), float(i % 5)) for i in range(30)]
    spark.createDataFrame(rows, "fitness_name string, algorithm string, fit double, eco double").write.parquet(str(tmp_path / "s"))
    assert cli.main(["topn", "--summary", str(tmp_path / "s"), "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o" / "topn_std_curves")).count() == 42 and spark.read.parquet(str(tmp_path / "o" / "topn_corr_curves")).count() == 11

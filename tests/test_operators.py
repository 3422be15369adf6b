"""Golden mini-cases and properties of the relational operators."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapart.operators import analysis as an
from terrapart.operators import graph as gr
from terrapart.operators import landcover as lc
from terrapart.operators import pheromone as ph
from terrapart.operators import raster as ra
from terrapart.plans import catalog
from terrapart.plans import fixtures as fx
from terrapart.sources import tables as st
from terrapart.streaming import monitor


def cover(spark, codes):
    return lc.with_legend(spark.createDataFrame(codes, "cluster int, clc_class int"), spark.createDataFrame([(12, "x"), (13, None)], "clc_class int, clc_name string"))


def test_entropy(spark):
    rows = spark.createDataFrame([(0, "a")] * 3 + [(0, "b"), (1, "c"), (2, None)], "cluster int, k string")
    got = {r.cluster: r for r in lc.quality(rows, "cluster", "k").collect()}
    assert [got[0].shannon_entropy, got[0].normalized_entropy, got[0].simpson_diversity, got[0].dominant_class_share] == pytest.approx([0.562335, 0.811278, 0.375, 0.75], abs=1e-6)
    assert got[0].dominant_class == "a" and got[1].normalized_entropy == 0 and got[2].n_classes == 0


def test_consistency(spark):
    got = {r.cluster: r for r in lc.consistency(cover(spark, [(0, 12), (0, 12), (0, 13), (0, 23), (1, 1), (2, None)])).collect()}
    assert got[0].agriculture_homogeneity == pytest.approx(0.081704, abs=1e-6) and got[0].natural_homogeneity == 1
    assert got[0].combined_ecological_consistency == pytest.approx(0.311278, abs=1e-6) and got[0].agriculture_dominant_class == "x"
    assert got[1].combined_ecological_consistency is None and got[2].excluded == 1
    assert lc.overall_consistency(lc.consistency(cover(spark, [(1, 1)]))).count() == 0
    assert lc.overall_consistency(lc.consistency(cover(spark, [(0, 12), (1, 1)]))).first().mean_combined_ecological_consistency == 1


def test_join_keeps_null_classes(spark):
    pixels = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 1)], "row int, col int, cluster int")
    classes = spark.createDataFrame([(0, 0, None), (0, 1, 0), (0, 2, 5)], "row int, col int, clc_class int")
    assert sorted(r.col for r in lc.join_cover(pixels, classes).collect()) == [0, 2]


def nodes(spark, weights=(1.0, 1.0, 1.0, 1.0)):
    return spark.createDataFrame([(i, [x], w, lab) for i, (x, w, lab) in enumerate(zip([0.0, 2.0, 10.0, 12.0], weights, [0, 0, 1, 1], strict=True))], "node_id long, f array<double>, weight double, label long")


@pytest.mark.parametrize(("weights", "compact", "mean", "term"), [((1.0,) * 4, 0.038462, 0.797980, 0.101010), ((1.0, 2.0, 3.0, 4.0), 0.045009, 0.794071, 0.102965)])
@pytest.mark.parametrize("block", [2, 2048])
def test_compactness_and_silhouette(spark, weights, compact, mean, term, block):
    n = nodes(spark, weights)
    assert gr.compactness(n).first()[0] == pytest.approx(compact, abs=1e-6)
    got = gr.silhouette_mean(gr.silhouette(n, block=block)).first()
    assert (got.silhouette, got.silhouette_term) == pytest.approx((mean, term), abs=1e-6)


def test_disagreement_snn_ari(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src long, dst long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node_id long, label long")
    assert gr.disagreement(edges, labels).first()[0] == pytest.approx(2 / 3) and gr.disagreement(edges, labels, True).first()[0] == pytest.approx(0.5)
    near = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], "src long, dst long")
    snn = gr.snn_graph(near, gr.undirected(near), 2)
    assert [r.weight for r in snn.collect()] == [0.5] * 3 and gr.snn_cut(snn, labels).first().cut == pytest.approx(2 / 3)
    assert gr.snn_cut(snn.limit(0), labels).first().cut == 0
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)], "a int, b int, c int")
    assert [gr.adjusted_rand(rows, *p).first()[0] for p in (("a", "b"), ("a", "a"), ("a", "c"))] == pytest.approx([-0.5, 1.0, 1.0])


def test_support(spark):
    edges = spark.createDataFrame([(9, i) for i in range(5)], "src long, dst long")
    labels = spark.createDataFrame([(0, 2), (1, 2), (2, 2), (3, 3), (4, -1)], "node_id long, label long")
    assert {r.label: r.support for r in gr.neighbour_support(edges, labels).collect()} == {2: 0.75, 3: 0.25}


@pytest.mark.parametrize("size", [0.4, 1.0, 50.0])
def test_lattice_neighbours_are_exact(spark, size):
    rng = np.random.default_rng(2)
    at = [(int(i), float(r), float(c)) for i, (r, c) in enumerate(rng.integers(0, 12, (60, 2)))] + [(60, 90.0, 90.0), (61, 90.0, 90.0)]
    got = {}
    for r in gr.knn_lattice(spark.createDataFrame(at, "node_id long, r double, c double"), 5, size).collect():
        got.setdefault(r.src, {})[r.rank] = r.dst
    for i, r, c in at:
        order = sorted((math.hypot(r - r2, c - c2), j) for j, r2, c2 in at if j != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in order]


def test_feature_neighbours_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, f array<double>")
    got = {(r.src, r["rank"]): r.dst for r in gr.knn_features(table, 4, 16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all(got[i, k + 1] == j for i in range(50) for k, j in enumerate(np.argsort(d[i])[:4]))


def test_centroids_fill_empty_labels(spark):
    got = {r.label: r.f for r in gr.filled_centroids(nodes(spark), 3).collect()}
    assert got[0] == [1.0] and got[1] == [11.0] and got[2][0] in (0.0, 2.0, 10.0, 12.0)


def taus(table):
    return {r.node_id: r.tau for r in table.collect()}


def test_pheromone(spark):
    start = ph.initial(spark.createDataFrame([(0,)], "node_id long"), 2)
    one = spark.createDataFrame([(0, 0.5, 0, 0)], "ant int, fitness double, node_id long, label long")
    for update in (ph.update_all_ants, ph.update_best_ant):
        assert taus(update(start, one, 0.1, 0.05))[0] == pytest.approx([0.55, 0.45], abs=1e-6)
    two = spark.createDataFrame([(0, 0.2, 0, 0), (1, 0.4, 0, 1)], "ant int, fitness double, node_id long, label long")
    assert taus(ph.update_quality_weighted(start, two, 0.1, 0.05))[0] == pytest.approx([0.5, 0.5])
    assert taus(ph.update_quality_weighted(start, two, 0.1, 0.05, clip_first=True))[0] == pytest.approx([0.5 / 0.95, 0.45 / 0.95], abs=1e-6)


def test_scaling_and_grid(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 5.0), (0, 2, 2.0, 5.0), (1, 1, 6.0, 5.0)], "row long, col long, a double, b double")
    got = ra.standard_scale(rows, ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in got] == pytest.approx([-0.9258, -0.4629, 1.3887], abs=1e-4) and {r.b for r in got} == {0.0}
    assert [(r.a, r.b) for r in ra.minmax_scale(rows, ["a", "b"]).orderBy("a").collect()] == [(0.0, 0.0), (0.2, 0.0), (1.0, 0.0)]
    assert [list(r["values"]) for r in ra.raster_grid(rows, "a").orderBy("row").collect()] == [[1.0, None, 2.0], [None, 6.0, None]]
    assert ra.climate_columns(["Temp_1", "padavine_jan", "row"]) == (["Temp_1"], ["padavine_jan"])
    assert ra.feature_columns(rows.withColumn("cluster", F.lit(1))) == ["a", "b", "cluster"]
    with pytest.raises(ValueError):
        ra.climate_columns(["x"])
    cells = spark.createDataFrame([(0, 0, "t", 1.0), (0, 0, "p", float("nan"))], "row int, col int, layer string, value double")
    assert list(ra.layers_to_columns(cells, ["t", "p"]).first()) == [0, 0, 1.0, None]


def test_pca_is_centred_and_signed(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(8)], "id long, v array<double>")
    out, explained = ra.grouped_pca(rows, {"g": ("v", 1)}, "id")
    assert [r.g_pc1 for r in out.orderBy("id").collect()] == pytest.approx([i / 7 for i in range(8)]) and explained["g"][0] == pytest.approx(1.0)


def test_resume_and_dedupe(spark):
    grid = an.config_grid(spark, {"a": ["x", "y"], "b": [1.0, 2.0]})
    assert [(r.run_id, r.a, r.b) for r in grid.orderBy("run_id").collect()] == [(1, "x", 1.0), (2, "x", 2.0), (3, "y", 1.0), (4, "y", 2.0)]
    done = grid.filter("run_id = 2")
    assert [r.run_id for r in an.remaining(grid, done, ["a", "b"], 2).collect()] == [1, 3]
    runs = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 6.0)], "k string, t int, v double")
    assert an.keep_one(runs, ["k"], ["t"]).first().v == 6.0 and an.keep_one(runs, ["k"], ["t"], last=False).first().v == 5.0


def test_paired_null_cases(spark):
    pairs = spark.createDataFrame([("a", "b", "m", 0, 1.0), ("a", "c", "m", 0, 0.0), ("a", "c", "m", 1, 0.0)], "cfg_a string, cfg_b string, metric string, seed long, d double")
    got = {r.cfg_b: r for r in an.paired_differences(pairs).collect()}
    assert got["b"].n_pairs == 1 and got["b"].mean_diff is None and got["c"].mean_diff == 0 and got["c"].cohen_dz is None


def test_seeded_sample_is_of_all_ids(spark):
    table = spark.range(0, 2000).select((F.col("id") * 3).alias("node_id"))
    assert gr.seeded_sample(table, 100, 7) == (3 * np.sort(np.random.default_rng(7).choice(2000, size=100, replace=False))).tolist()
    assert gr.seeded_sample(table) is None and gr.seeded_sample(table, 2000) is None
    with pytest.raises(ValueError):
        gr.seeded_sample(table, 0)


def test_fitness_takes_all_nodes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist(), i % 2, 1.0, float(i // 25), float(i % 25)) for i in range(30)]
    monkeypatch.setattr(fx, "nodes", lambda s, d: spark.createDataFrame(rows, "node_id long, f array<double>, label long, weight double, r double, c double"))
    want = gr.silhouette_mean(gr.silhouette(fx.nodes(spark, ""))).first()
    assert want.n == 30 and catalog.queries()["fitness_silhouette"](spark, "").first().term == pytest.approx(want.silhouette_term, abs=1e-6)


def test_whole_grid_is_resampled(spark, monkeypatch):
    cells = {(r, c): float(r * r + 3 * c) for r in range(45) for c in range(43)}
    monkeypatch.setattr(fx, "pixels", lambda s, d: spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, value double"))
    got = {(r.row, r.col): r.value for r in catalog.queries()["resample_bilinear"](spark, "").collect()}
    want = {}
    for r, c in cells:
        y, x = r * 0.5 + 0.25, c * 0.5 + 0.25
        near = [((1 - abs(y - i)) * (1 - abs(x - j)), cells[i, j]) for i in (int(y), int(y) + 1) for j in (int(x), int(x) + 1) if (i, j) in cells]
        want[r, c] = sum(w * v for w, v in near) / sum(w for w, _ in near)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_all_configurations_are_paired(spark, monkeypatch):
    rows = [(f, "alg_0", "all_ants", 1.0, b, e, seed, k * 0.01 + seed * k * k * 0.001, k + seed * 0.5, 1) for k, (f, b, e) in enumerate([("snn", 1.0, 0.1), ("snn", 3.0, 0.1), ("centroid", 1.0, 0.02), ("silhouette", 3.0, 0.02)]) for seed in range(3)]
    names = [*an.CONFIG, "seed", "best_fitness", "eco", "logged"]
    monkeypatch.setattr(fx, "runs", lambda s, d: spark.createDataFrame(rows, names))
    by = {}
    for r in rows:
        by.setdefault("|".join(map(str, r[:6])), {})[r[6]] = r[7:9]
    want = {(a, b, m): np.mean([by[a][s][i] - by[b][s][i] for s in range(3)]) for a in by for b in by if a < b for i, m in enumerate(["best_fitness", "eco"])}
    got = {(r.cfg_a, r.cfg_b, r.metric): r.mean_diff for r in catalog.queries()["paired_differences"](spark, "").collect()}
    assert got.keys() == want.keys() and len(want) == 12 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert {(r.cfg_a, r.cfg_b, r.metric) for r in catalog.queries()["paired_pvalues"](spark, "").collect()} == want.keys()


def test_partitioning_does_not_matter(spark):
    rows = [(i % 3, (i * 7) % 45) for i in range(200)]
    frames = [spark.createDataFrame(rows, "cluster int, clc_class int").repartition(n) for n in (1, 8)]
    one, eight = (sorted(map(str, lc.consistency(lc.with_legend(f)).select("cluster", F.round("combined_ecological_consistency", 9)).collect())) for f in frames)
    assert one == eight


def test_sources(spark, tmp_path):
    runs = spark.createDataFrame([("aco", "f", "centroid", 0.5), ("old", "f", "centroid", None)], "algorithm string, feature_mode string, fitness_name string, best_fitness double")
    st.overwrite(runs, str(tmp_path / "a"), sep=";")
    assert st.read_csv(spark, str(tmp_path / "a")).count() == 2 and st.sniffed_separator(spark, str(tmp_path / "a")) == ";"
    assert st.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    folder = tmp_path / "raw" / "centroid"
    folder.mkdir(parents=True)
    (folder / "summary.csv").write_text("algorithm;fit\nx;1.5\n")
    got = st.read_summaries(spark, str(tmp_path), "summary.csv", ["algorithm", "fit"]).first()
    assert (got.feature_mode, got.fitness_name, got.fit) == ("raw", "centroid", 1.5)
    with pytest.raises(ValueError):
        st.read_summaries(spark, str(tmp_path), "summary.csv", ["nothing"])
    (tmp_path / "legend.txt").write_text("1,230,0,77,255,Urban\n")
    assert st.read_legend(spark, str(tmp_path / "legend.txt")).first().color == "#e6004d"
    st.append_runs(runs, str(tmp_path / "runs"))
    rerun = runs.filter("algorithm = 'aco'").withColumn("algorithm", F.lit("new")).withColumn("extra", F.lit(1))
    manifest = st.migrate_runs(spark, str(tmp_path / "runs"), rerun, "old", str(tmp_path / "archive")).first()
    assert (manifest.archived, manifest.dropped, manifest.added) == (2, 1, 1)
    assert {r.algorithm for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {"aco", "new"}
    assert not (tmp_path / "runs-new").exists() and not (tmp_path / "runs-old").exists()
    st.save_labels(spark.createDataFrame([("Köppen-A", 1, 2)], "name string, node_id long, label long"), str(tmp_path / "labels"))
    assert st.load_labels(spark, str(tmp_path / "labels"), "Köppen-A").first().solution == "koppen_a"
    assert runs.select(st.config_json(["fitness_name", "algorithm"])).first()[0] == '{"algorithm":"aco","fitness_name":"centroid"}'
    gate = an.quality_gate(runs, None, ["best_fitness"]).first()
    assert (gate.n_rows, gate.n_bad, gate.passed) == (2, 1, False)


def test_monitor(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", float("nan"))], "algorithm string, best_fitness double")
    runs.write.parquet(str(tmp_path / "runs"))
    monitor.watch(monitor.run_stream(spark, str(tmp_path / "runs"), runs.schema), "watched", str(tmp_path / "check")).awaitTermination()
    got = {r.algorithm: r for r in spark.table("watched").collect()}
    assert (got["a"].n, got["a"].mean, got["b"].n_bad) == (2, 2.0, 1)


def test_supervisor(spark):
    tables = {"one": [1.0, 2.0], "two": [1.0, float("nan")]}
    gate = lambda name: an.quality_gate(spark.createDataFrame([(v,) for v in tables[name]], "best_fitness double"), None, ["best_fitness"])
    ran = []
    assert monitor.supervise(spark, [("one", lambda: (ran.append(1), time.sleep(0.5)))], gate, 0.1, 2) == [("one", 2), ("one", 2)]
    with pytest.raises(RuntimeError, match="bad values"):
        monitor.supervise(spark, [("two", lambda: ran.append(2)), ("one", lambda: ran.append(3))], gate, 5.0)
    with pytest.raises(RuntimeError, match="failed"):
        monitor.supervise(spark, [("one", lambda: 1 / 0), ("one", lambda: ran.append(3))], gate, 5.0)
    assert ran == [1, 2]


@pytest.mark.parametrize("parts", [1, 3, 64])
@pytest.mark.parametrize("ascending", [True, False])
def test_curves_do_not_depend_on_ranges(spark, parts, ascending):
    rng = np.random.default_rng(3)
    data = [(["a", "b", None][i % 3], i, None if i % 11 == 0 else float(rng.integers(0, 9)), float(rng.normal(5)) if i % 7 else None) for i in range(120)]
    rows = spark.createDataFrame(data, "fitness_name string, id long, fit double, eco double")
    for group in ("fitness_name", None):
        got = {(r.fitness_name if group else 0, r.n): r.std for r in an.top_n_std(rows, "fit", ["eco"], ["id"], group, 10, ascending, parts).collect()}
        want = {}
        for g in {d[0] for d in data} if group else {0}:
            mine = sorted((d for d in data if not group or d[0] == g), key=lambda d: ((d[2] is not None) == ascending, (d[2] or 0.0) * (1 if ascending else -1), d[1]))
            want |= {(g, n): np.std([d[3] for d in mine[:n] if d[3] is not None], ddof=1) for n in range(10, len(mine) + 1)}
        assert got == pytest.approx(want)


def test_native_tests_equal_the_numpy_ones(spark):
    from terrapart.functions.stats import paired_pvalues

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for pair in range(60):
        n = int(rng.integers(0, 12)) if pair % 7 else 70
        d = rng.normal(size=n) if pair % 3 else rng.integers(-2, 3, n) / 4.0
        want[str(pair)] = paired_pvalues(np.array(d, float))
        rows += [("a", str(pair), "m", float(x)) for x in d] + [("a", str(pair), "m", None)]
    got = an.paired_tests(spark.createDataFrame(rows, "cfg_a string, cfg_b string, metric string, d double")).collect()
    assert len(got) == 60
    for r in got:
        for name, value in want[r.cfg_b].items():
            assert (r[name] is None) == (value is None) and (value is None or abs(r[name] - value) < 1e-9), (r, want[r.cfg_b])


def test_global_ranks_and_quantiles(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    x = pd.DataFrame({"a": rng.integers(0, 40, 500) / 4.0, "b": rng.normal(size=500)})
    x.loc[::50, "a"] = None
    rows = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x.itertuples(index=False)], "a double, b double")
    got = sorted(tuple(r) for r in an.global_ranks(rows.filter("a IS NOT NULL"), ["a", "b"], 7).collect())
    there = x.dropna()
    assert got == sorted(zip(there.a.rank(), there.b.rank(), strict=True))
    found = an.distribution(rows, {"a": "lower"}).first()
    assert [found.p25, found.median, found.p75] == there.a.quantile([0.25, 0.5, 0.75]).tolist()


def test_csv_append_keeps_one_table(spark, tmp_path):
    from terrapart.sources import tables as st

    path = str(tmp_path / "runs")
    st.append_csv(spark.createDataFrame([(1, "x")], "n long, s string"), path)
    st.append_csv(spark.createDataFrame([("y", 2)], "s string, n long"), path)
    assert sorted((r.n, r.s) for r in st.read_csv(spark, path, sep=";").collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="columns differ"):
        st.append_csv(spark.createDataFrame([(1,)], "n long"), path)


def test_lone_node_counts_without_fallback(spark):
    rows = [(0, [0.0], 1, 1.0), (1, [1.0], 1, 1.0), (9, [9.0], 2, 1.0), (10, [2.0], 3, 1.0), (11, [2.5], 3, 1.0)]
    nodes = spark.createDataFrame(rows, "node_id long, f array<double>, label long, weight double")
    got = {r.node_id: r.s for r in gr.silhouette(nodes, [0, 1, 9, 10], fallback=False).collect()}
    assert set(got) == {0, 1, 9} and got[9] == 0.0  # 10 has another in its cluster, but not in the sample


def test_nearest_rows_against_differences():
    """The product's bound keeps every neighbour: copies, far offsets that cancel, small and large blocks."""
    rng = np.random.default_rng(2)
    for n, offset in ((7, 0.0), (300, 1e6), (2000, 0.0), (2000, 100.0)):
        y = rng.normal(size=(n, 5)) + offset
        y[n // 2 :: 3] = y[0]
        x = y[rng.permutation(n)[:280]]
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        k = min(9, n)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        i, j, dist = gr.nearest_rows(x, y, 9)
        assert i.tolist() == np.repeat(np.arange(len(x)), k).tolist()
        assert (j.reshape(-1, k) == want).all() and (dist.reshape(-1, k) == np.take_along_axis(d, want, axis=1)).all()


def test_nearest_centres_against_all():
    rng = np.random.default_rng(3)
    lattice = np.stack(np.divmod(np.arange(4000.0), 100), axis=1)
    for points, centres in (
        (lattice, lattice[rng.choice(4000, 300, replace=False)]), (lattice * [1e-3, 1], lattice[::97] * [1e-3, 1]), (lattice, np.array([[1e4, -1e4], [5.0, 5.0]])),
        (rng.normal(size=(3000, 2)), rng.normal(size=(500, 2)) ** 3), (lattice, np.repeat(lattice[:1], 9, axis=0)), (lattice[:0], lattice[:3]),
    ):
        far = (points[:, None, 0] - centres[None, :, 0]) ** 2 + (points[:, None, 1] - centres[None, :, 1]) ** 2
        assert (ra.nearest_centres(points, centres) == far.argmin(axis=1)).all()


def test_superpixels_are_the_library_s_clusters(spark):
    """The rounds end where those of the library do, but for cells as near to two centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([(int(r), int(c), "x") for r, c in rng.integers(0, 400, size=(900, 2))], "row int, col int, name string").coalesce(1).cache()
    got = ra.kmeans_superpixels(cells, 30, seed=4).toPandas()
    assert list(got.columns) == ["row", "col", "name", "superpixel"] and len(got) == 900
    at = ra.standard_scale(cells.select(F.col("row").cast("double").alias("r"), F.col("col").cast("double").alias("c")), ["r", "c"])
    data = VectorAssembler(inputCols=["r", "c"], outputCol="v").transform(at)
    model = KMeans(k=30, seed=4, maxIter=10, initMode="random", featuresCol="v").fit(data)
    want = model.transform(data).toPandas().prediction.to_numpy()
    assert (got.superpixel.to_numpy() == want).mean() > 0.99

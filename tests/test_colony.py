"""Properties of the ant-colony optimiser."""

import numpy as np
import pytest

from terrapart.operators import colony as co
from terrapart.plans import catalog


def model(n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.2, size=(n // 3, 2)) for c in (0.0, 3.0, 6.0)])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, axis=1)[:, 1:7]
    a, b = np.repeat(np.arange(n), 6), near.ravel()
    return co.Model(x, np.ones(n), near, (a, b, np.ones(len(a))))


@pytest.mark.parametrize("algorithm", list(co.ALGORITHMS))
@pytest.mark.parametrize("objective", list(co.OBJECTIVES))
def test_fit(algorithm, objective):
    m = model()
    settings = dict(algorithm=algorithm, update="best_ant", objective=objective, clusters=3, n_ants=3, n_iterations=3, evaporation=0.1)
    found = co.Colony(**settings).fit(m)
    assert set(found.labels) <= {0, 1, 2} and found.tau.sum(axis=1) == pytest.approx(np.ones(60), abs=1e-6)
    best = [h["global_best"] for h in found.history]
    assert best == sorted(best, reverse=True) and best[-1] == found.fitness
    assert co.score(m, found.labels, found.centres, objective)[0] == pytest.approx(found.fitness)
    assert (co.Colony(**settings).fit(m).labels == found.labels).all()


def test_heuristics():
    m = co.Model(np.array([[0.0], [1.0], [2.0]]), np.ones(3), np.array([[1, 2], [0, 2], [0, 1]]))
    p = co.Partial(m, 2, np.array([-1, -1, -1]), np.array([[1.0], [2.0]]), np.random.default_rng(0))
    assert co.by_centre(p, 0, 1.0) == pytest.approx([0.8, 0.2], abs=1e-6)
    assert co.support(np.array([2, 2, 2, 3]), 5).tolist() == [0, 0, 0.75, 0.25, 0]
    assert co.by_space(p, 0, 1.0) == pytest.approx([0.5, 0.5]) and co.by_cohesion(p, 0, 1.0) == pytest.approx([0.5, 0.5])
    p.labels[:] = [-1, 0, 1]
    assert co.neighbour_closeness(p, 0, 0.1) == pytest.approx([1.0, 0.5], abs=1e-5)


def test_terms():
    m = co.Model(np.array([[0.0], [2.0], [10.0], [12.0]]), np.array([1.0, 2, 3, 4]), np.array([[1], [2], [1], [2]]), None)
    labels = np.array([0, 0, 1, 1])
    centres = co.centres_of(m, labels, 2, np.random.default_rng(0))
    assert co.scatter(m, labels, centres) == pytest.approx(0.045009, abs=1e-6)
    assert co.silhouette_term(m, labels) == pytest.approx(0.102965, abs=1e-6)
    assert co.cut_term(m, labels) == 0.0


def test_updates():
    fits = np.array([0.2, 0.4])
    assert co.amounts(fits, "quality_weighted", 1.0) == pytest.approx([1.0, 1.0]) and co.amounts(fits, "quality_weighted", 1.0, True) == pytest.approx([1.0, 0.0])
    assert co.updated(np.full((1, 2), 0.5), [(0.5, np.array([0]))], "all_ants", 0.1, 0.05)[0] == pytest.approx([0.55, 0.45], abs=1e-6)


@pytest.mark.parametrize("bad", [{"algorithm": "x"}, {"n_ants": 0}, {"evaporation": 1.0}, {"q": 0.0}, {"update": "x"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        co.Colony(**bad)


def test_runs_on_spark(spark):
    m = model()
    rows = [(1, 0, "aco_centroid", "all_ants", "centroid", 1.0, 3.0, 0.1, 0.05), (2, 0, "nonsense", "all_ants", "centroid", 1.0, 1.0, 0.1, 0.05)]
    configs = spark.createDataFrame(rows, "run_id long, seed long, algorithm string, pheromone_update string, fitness_name string, alpha double, beta double, evaporation double, q double")
    got = {r.run_id: r for r in co.run_configs(configs, m, n_ants=2, n_iterations=2, clusters=3).collect()}
    own = co.Colony("aco_centroid", clusters=3, beta=3.0, evaporation=0.1, n_ants=2, n_iterations=2).fit(m)
    assert got[1].status == "ok" and got[1].best_fitness == own.fitness == pytest.approx(got[1].recomputed_fitness) and got[1].labels == own.labels.tolist()
    assert got[2].status == "failed" and "unknown" in got[2].error and got[2].labels is None
    runs = co.run_configs(configs, m, n_ants=1, n_iterations=1, clusters=3)
    assert co.labels_of(runs, np.arange(100, 160)).count() == 60


def test_parallel_ants(spark):
    settings = co.Colony("aco_centroid", clusters=3, n_ants=3, n_iterations=2, evaporation=0.1)
    one, two = (co.fit_ants_parallel(spark, model(), settings) for _ in range(2))
    assert one.fitness == two.fitness and (one.labels == two.labels).all() and len(one.history) == 2


def test_registered_fit_takes_all_nodes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist(), i % 5) for i in range(520)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    real, met = co.run_configs, []

    def short(configs, model, **settings):
        met.append((model.x.shape, model.near.shape, settings))
        return real(configs, model, n_ants=1, n_iterations=1)

    monkeypatch.setattr(co, "run_configs", short)
    got = catalog.queries()["aco_centroid"](spark, str(tmp_path)).collect()
    assert met == [((520, 64), (520, 16), {})]
    assert {(r.status, r.n_labels) for r in got} == {("ok", 520)}


def test_ants_of_a_batch_are_told_apart():
    m, rng = model(), np.random.default_rng(3)
    labels, centres = rng.integers(-1, 3, size=(4, 60)), rng.normal(size=(4, 3, 2))
    i = rng.integers(60, size=4)
    for heuristic in (co.by_centre, co.by_neighbours, co.by_space):
        batch = heuristic(co.Partial(m, 3, labels, centres, rng), i, 2.0)
        for ant in range(4):
            assert batch[ant] == pytest.approx(heuristic(co.Partial(m, 3, labels[ant], centres[ant], rng), i[ant], 2.0))
    # Up to 40 members a label, cohesion takes all of them.
    odds = co.by_cohesion(co.Partial(m, 3, labels, centres, rng), i, 1.0)
    for ant in range(4):
        far = [np.linalg.norm(m.x[labels[ant] == k] - m.x[i[ant]], axis=1) for k in range(3)]
        raw = np.array([1.0 / (f.mean() + 1e-6) if len(f) > 15 else 1.0 / 3 for f in far])
        assert odds[ant] == pytest.approx(raw / raw.sum(), abs=1e-9)


def test_members_follow_moves_and_choices_are_uniform():
    rng = np.random.default_rng(5)
    labels = np.full((2, 30), -1)
    p = co.Partial(model(30), 2, labels, np.zeros((2, 2, 2)), rng, co.Members(labels, 2, rng))
    seen = np.zeros(30)
    for step in range(6000):
        i = rng.integers(30, size=2)
        p.put(i, rng.integers(2, size=2))
        nodes, counts = p.members.some(5)
        for ant in range(2):
            for label in range(2):
                mine = set(np.flatnonzero(labels[ant] == label))
                some = nodes[ant, label][counts[ant, label]]
                assert set(p.members.nodes[ant, label, : p.members.count[ant, label]]) == mine
                assert len(set(some)) == len(some) == min(5, len(mine)) and set(some) <= mine
                if step >= 1000 and len(mine) > 5:
                    seen[some] += 1
    assert seen.min() > 0.9 * seen.mean() and seen.max() < 1.1 * seen.mean()


@pytest.mark.parametrize("batch", [1, 2, None])
def test_every_ant_is_built_whatever_the_batch(batch):
    met = []
    found = co.Colony("aco_centroid", clusters=3, n_ants=5, n_iterations=2, evaporation=0.1, batch=batch, after=lambda labels, centres, m: met.append(1) or (labels, centres)).fit(model())
    assert len(met) == 10 and len(found.history) == 2


def test_cohesion_without_kept_distances(monkeypatch):
    m, labels, i = model(), np.random.default_rng(3).integers(-1, 3, size=(4, 60)), np.array([0, 7, 7, 59])
    odds = [co.by_cohesion(co.Partial(m, 3, labels, np.zeros((4, 3, 2)), np.random.default_rng(0)), i, 2.0)]
    monkeypatch.setattr(co, "KEPT_DISTANCES", 10)
    odds.append(co.by_cohesion(co.Partial(m, 3, labels, np.zeros((4, 3, 2)), np.random.default_rng(0)), i, 2.0))
    assert odds[0] == pytest.approx(odds[1])
    for algorithm in ("aco_cohesion", "aco_cohesion_refinement"):
        assert len(co.Colony(algorithm, objective="silhouette", clusters=3, n_ants=2, n_iterations=2).fit(m).labels) == 60


def test_silhouettes_of_a_batch_compute_distances_once(monkeypatch):
    """Above the kept number of nodes all ants of a batch share the distances, whatever the blocks; copies are at distance 0."""
    m, rng = model(90), np.random.default_rng(6)
    m.x[50:60] = m.x[3]
    m.weight[:] = rng.random(90) + 0.5
    labels = rng.integers(4, size=(5, 90))
    labels[1], labels[2, 7] = 0, 9
    chosen = np.sort(rng.choice(90, size=40, replace=False))
    want = [[co.silhouette_term(m, row, q) for row in labels] for q in (None, chosen)]
    monkeypatch.setattr(co, "KEPT_DISTANCES", 10)
    monkeypatch.setattr(co, "ROWS", 32)
    real, met = co.Model.products, []
    monkeypatch.setattr(co.Model, "products", lambda self, q: met.append(1) or real(self, q))
    for q, w in zip((None, chosen), want, strict=True):
        assert co.silhouette_terms(m, labels, q) == pytest.approx(w, abs=1e-9)
    assert len(met) == 2
    met.clear()
    co.Colony("aco_centroid", objective="silhouette", clusters=3, n_ants=4, n_iterations=2).fit(m)
    assert len(met) == 2


@pytest.mark.parametrize("heuristic", ["centroid", "graph", "spatial"])
def test_nodes_that_do_not_see_each_other_go_together(heuristic):
    """A pass with standing centres gives what a step for each node in turn gives, in fewer calls."""
    m, rng = model(300, 4), np.random.default_rng(8)
    for before in (-np.ones((4, 300), int), rng.integers(3, size=(4, 300))):
        p = co.Partial(m, 3, before.copy(), rng.normal(size=(4, 3, 2)) * 3, rng)
        order, pull = co.orders(rng, 4, 300), co.pulls(rng.random((300, 3)), 1.0)
        draws, forced = rng.random((300, 4)), np.where(rng.random((300, 4)) < 0.05, 2, -1)
        want = co.Partial(m, 3, before.copy(), p.centres, rng)
        for i, u, own in zip(order, draws, forced, strict=True):
            label = co.picked(rng, pull[i] * co.HEURISTICS[heuristic](want, i, 2.0), u)
            want.put(i, np.where(own >= 0, own, label))
        co.standing_pass(p, pull, order, draws, heuristic, 2.0, forced)
        assert (p.labels == want.labels).all() and len(list(co.layers(m, order, heuristic == "centroid"))) < 100


def test_cohesion_with_distances_in_single_precision(monkeypatch):
    m, labels, i = model(), np.random.default_rng(3).integers(-1, 3, size=(4, 60)), np.array([0, 7, 7, 59])
    monkeypatch.setattr(co, "KEPT_DISTANCES", 10)
    assert m.kept() == pytest.approx(np.linalg.norm(m.x[:, None] - m.x[None], axis=2), rel=1e-5, abs=1e-6)
    odds = [co.by_cohesion(co.Partial(m, 3, labels, np.zeros((4, 3, 2)), np.random.default_rng(0)), i, 2.0)]
    monkeypatch.setattr(co, "KEPT_BYTES", 0)
    odds.append(co.by_cohesion(co.Partial(m, 3, labels, np.zeros((4, 3, 2)), np.random.default_rng(0)), i, 2.0))
    assert m.kept() is None and odds[0] == pytest.approx(odds[1], rel=1e-5)


def test_silhouettes_of_ranges_of_nodes():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(900, 6)), np.repeat(rng.normal(size=(3, 6)), 100, axis=0)]) + 50.0
    model = co.Model(x, rng.random(len(x)) + 0.1, np.zeros((len(x), 2), int))
    labelings = np.stack([rng.integers(0, 4, len(x)), (x[:, 0] > 50).astype(int), np.repeat([0, 1], [len(x) - 1, 1]), np.zeros(len(x), int)])
    want = co.silhouette_terms(model, labelings)
    for single, most in ((False, 1e-9), (True, 1e-5)):
        above, below = sum(co.silhouette_shares(model, labelings, a, b, single) for a, b in ((0, 1), (1, 700), (700, 1200))).T
        assert abs((1 - above / below) / 2 - want).max() < most


@pytest.mark.parametrize("algorithm", ["aco_centroid", "aco_cohesion", "multi_cohesion_graph_spatial"])
def test_large_fit_is_spread_over_tasks(spark, monkeypatch, algorithm):
    monkeypatch.setattr(co, "KEPT_DISTANCES", 50)
    tasks = []
    plain = co.in_tasks
    monkeypatch.setattr(co, "in_tasks", lambda s, n, make: tasks.append(n) or plain(s, n, make))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4))
    model = co.Model(x, np.ones(120), rng.integers(0, 120, (120, 4)), (np.arange(119), np.arange(1, 120), np.ones(119)))
    configs = spark.createDataFrame([(1, 0, algorithm, "all_ants", "silhouette", 1.0, 1.0, 0.1, 0.05), (2, 0, "none", "all_ants", "snn", 1.0, 1.0, 0.1, 0.05)], "run_id long, seed long, algorithm string, pheromone_update string, fitness_name string, alpha double, beta double, evaporation double, q double")
    rows = {r.run_id: r for r in co.run_configs(configs, model, n_ants=5, n_iterations=2, clusters=3).collect()}
    assert rows[2].status == "failed" and "unknown algorithm" in rows[2].error
    found = rows[1]
    labels = np.array(found.labels)
    assert found.status == "ok" and max(tasks) > 1 and set(labels) <= {0, 1, 2}
    want = 0.7 * co.silhouette_term(model, labels) + 0.3 * co.rough_edges(model, labels)
    assert [found.best_fitness, found.recomputed_fitness] == pytest.approx([want, want], abs=1e-9)
    again = co.run_configs(configs, model, n_ants=5, n_iterations=2, clusters=3).filter("run_id = 1").first()
    assert again.labels == found.labels


def test_model_is_collected_without_rows_of_objects(spark, monkeypatch):
    nodes = spark.createDataFrame([(7, [1.0, 2.0], 1.0), (3, [0.0, 1.0], 2.0), (5, [4.0, 1.0], 3.0)], "node_id long, f array<double>, weight double")
    edges = spark.createDataFrame([(a, r, b) for a, near in ((3, (5, 7)), (5, (7, 3)), (7, (3, 5))) for r, b in enumerate(near, 1)], "src long, rank int, dst long")
    monkeypatch.setattr(type(nodes), "toPandas", None)
    model, ids = co.collect_model(nodes, edges.orderBy("rank", ascending=False), edges.selectExpr("src a", "dst b", "1.0d weight"))
    assert ids.tolist() == [3, 5, 7] and model.x.tolist() == [[0.0, 1.0], [4.0, 1.0], [1.0, 2.0]] and model.weight.tolist() == [2.0, 3.0, 1.0]
    assert model.near.tolist() == [[1, 2], [2, 0], [0, 1]] and sorted(zip(*model.snn, strict=True)) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 1, 1.0)]

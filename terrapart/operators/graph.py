"""Nearest-neighbour graphs, shared-neighbour graphs, and the metrics of labelings on them.

Lattice neighbours are found by a bucketed equality join that widens only where it must; feature neighbours
and silhouettes, which need all pairs by definition, compare blocks of rows with numpy, so that a task holds
two blocks and what leaves it is at most a few rows for each row of a block.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapart.functions.landcover import safe_ratio

EPS = 1e-12
BLOCK = 2048
#: Rows of a block for feature neighbours: each pair of blocks leaves k + 1 rows for each of its rows.
FEATURE_BLOCK = 16384


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each src by (dist, dst), with ranks from 1."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def settled(rows: DataFrame) -> DataFrame:
    """rows as a checkpoint in the shared folder, so that the next round does not compute this one again; rows as they are where none is named."""
    spark = rows.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows


def knn_lattice(nodes: DataFrame, k: int = 16, size: float | None = None) -> DataFrame:
    """Edges (src, rank, dst, dist) to the k nearest nodes by position (r, c), itself left out.

    Nodes fall into square buckets; a node meets the nodes of the nine buckets around it. Its neighbours are
    final if the k-th lies within one bucket's size; the other nodes go again with buckets twice as large,
    until the buckets cover everything.
    """
    stats = nodes.agg(F.count("*").alias("n"), (F.max("r") - F.min("r")).alias("h"), (F.max("c") - F.min("c")).alias("w")).first()
    if stats.n < 2:
        raise ValueError("a graph needs two nodes")
    extent = max(stats.h, stats.w, 1.0)
    k = min(k, stats.n - 1)
    size = size or max(1.0, (max(stats.h, 1.0) * max(stats.w, 1.0) * k / stats.n) ** 0.5)
    place = nodes.select("node_id", F.col("r").cast("double").alias("r"), F.col("c").cast("double").alias("c"))
    todo, done = place, None
    while True:
        bucket = lambda x: F.floor(F.col(x) / size)  # noqa: B023, E731
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        left = todo.select(F.col("node_id").alias("src"), F.col("r").alias("r1"), F.col("c").alias("c1"), bucket("r").alias("br"), bucket("c").alias("bc"), F.explode(around).alias("o"))
        left = left.select("src", "r1", "c1", (F.col("br") + F.col("o.i")).alias("br"), (F.col("bc") + F.col("o.j")).alias("bc"))
        right = place.select(F.col("node_id").alias("dst"), "r", "c", bucket("r").alias("br"), bucket("c").alias("bc"))
        dist = F.sqrt((F.col("r") - F.col("r1")) ** 2 + (F.col("c") - F.col("c1")) ** 2)
        met = nearest(left.join(right, ["br", "bc"]).filter("src <> dst").select("src", "dst", dist.alias("dist")), k)
        if size > extent:
            return met if done is None else done.unionByName(met)
        whole = Window.partitionBy("src")
        sure = met.withColumn("__n", F.count("*").over(whole)).withColumn("__far", F.max("dist").over(whole)).filter((F.col("__n") >= k) & (F.col("__far") <= size)).drop("__n", "__far")
        sure = settled(sure)
        done = sure if done is None else done.unionByName(sure)
        todo = settled(todo.join(sure.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti"))
        if not todo.limit(1).count():
            return done
        size *= 2


def in_blocks(nodes: DataFrame, columns: list[str], block: int = BLOCK) -> tuple[DataFrame, int]:
    """Pairs (i, j) of blocks as rows (pair, side, columns) for a grouped computation."""
    n = nodes.count()
    parts = max(1, -(-n // block))
    dealt = nodes.select(*columns, F.pmod(F.xxhash64("node_id"), F.lit(parts)).alias("own"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("other")
    left = dealt.select("*", each).select((F.col("own") * parts + F.col("other")).alias("pair"), F.lit(0).alias("side"), *columns)
    right = dealt.select("*", each).select((F.col("other") * parts + F.col("own")).alias("pair"), F.lit(1).alias("side"), *columns)
    return left.unionByName(right), parts


def distances(a: pd.Series, b: pd.Series) -> np.ndarray:
    x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
    out = np.empty((len(x), len(y)))
    for at in range(0, len(x), 64):
        out[at : at + 64] = np.sqrt(((x[at : at + 64, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column as a matrix; all must have the same length."""
    lists = column.combine_chunks()
    sizes = np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError("feature vectors of different lengths, or without values")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the k rows y[j] nearest to each x[i], of equal distances those with the smallest j.

    A matrix product leaves the rows that its rounding error allows; their distances are taken from the differences.
    The least squares of kept groups of rows are a bound for the kept-th least of all.
    """
    found, kept = [], min(k, len(y))
    per = 16 if len(y) >= 64 * kept else 1
    whole = len(y) // per * per
    yy, size = (y**2).sum(axis=1), y.shape[1]
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        xx = (part**2).sum(axis=1)
        square = part @ y.T
        square *= -2.0
        square += yy
        slack = 8.0 * (size + 4) * np.finfo(float).eps * (xx + yy.max())  # more than twice the error of an entry
        least = square[:, :whole].reshape(len(part), per, -1).min(axis=1)
        last = np.partition(least, kept - 1, axis=1)[:, kept - 1]
        # What is not finite is compared by its differences, as all others are.
        i, j = np.divmod(np.flatnonzero(~(square > (last + slack)[:, None])), len(y))
        dist = np.empty(len(i))
        for some in range(0, len(i), 1 << 16):
            here = slice(some, some + (1 << 16))
            dist[here] = np.sqrt(((part[i[here]] - y[j[here]]) ** 2).sum(axis=1))
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.searchsorted(i, np.arange(len(part)))
        top = np.arange(len(i)) - first[i] < kept
        found.append((i[top] + at, j[top], dist[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def knn_features(nodes: DataFrame, k: int = 20, block: int | None = None) -> DataFrame:
    """Edges (src, rank, dst, dist) to the k nearest nodes by feature vector f, itself left out; exact."""
    block = block or min(FEATURE_BLOCK, max(BLOCK, nodes.count() // 3))
    kinds = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())])

    def best(group: pa.Table) -> pa.Table:
        left, right = (group.filter(pc.equal(group["side"], side)) for side in (0, 1))
        if not len(left) or not len(right):
            return kinds.empty_table()
        right = right.sort_by("node_id")  # equal distances stay in the order of ids
        i, j, dist = nearest_rows(vectors_of(left["f"]), vectors_of(right["f"]), k + 1)
        src, dst = left["node_id"].to_numpy()[i], right["node_id"].to_numpy()[j]
        other = src != dst
        return pa.table([src[other], dst[other], dist[other]], schema=kinds)

    pairs, _ = in_blocks(nodes, ["node_id", "f"], block)
    return nearest(pairs.groupBy("pair").applyInArrow(best, "src long, dst long, dist double"), k)


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b of directed edges."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def snn_graph(neighbours: DataFrame, candidates: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(a, b, shared, weight) of candidate pairs a < b that share at least ``least`` of their k neighbours."""
    sets = neighbours.groupBy("src").agg(F.collect_set("dst").alias("s"))
    met = candidates.join(sets.select(F.col("src").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("src").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return met.select("a", "b", shared.alias("shared")).filter(F.col("shared") >= least).withColumn("weight", F.col("shared") / F.lit(float(k)))


def weighted_centroids(nodes: DataFrame, label: str = "label") -> DataFrame:
    """label, p, value: entries of the weighted mean vector of each label."""
    long = nodes.select(label, "weight", F.posexplode("f").alias("p", "x"))
    return long.groupBy(label, "p").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("value"))


def filled_centroids(nodes: DataFrame, clusters: int, seed: int = 0, label: str = "label") -> DataFrame:
    """label, f for every label below clusters; an empty one takes a seeded row."""
    found = weighted_centroids(nodes, label).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda s: s["value"]).alias("f"))
    want = nodes.sparkSession.range(clusters).select(F.col("id").alias(label))
    rows = nodes.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(clusters).select(F.col("f").alias("__g"), (F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id")) - 1).alias("__k"))
    out = want.join(found.withColumn(label, F.col(label).cast("long")), label, "left").join(rows, F.col("__k") == F.col(label), "left")
    return out.select(label, F.coalesce("f", "__g").alias("f"))


def compactness(nodes: DataFrame, label: str = "label") -> DataFrame:
    """One row: weighted scatter within labels over the whole scatter."""
    long = nodes.select("node_id", label, "weight", F.posexplode("f").alias("p", "x"))
    sums = lambda *by: long.groupBy(*by).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("x")).alias("wx"))
    centre = sums(label, "p").select(label, "p", (F.col("wx") / F.col("w")).alias("m"))
    middle = sums("p").select("p", (F.col("wx") / F.col("w")).alias("g"))
    off = long.join(centre, [label, "p"]).join(middle, "p")
    square = lambda c: F.col("weight") * (F.col("x") - F.col(c)) * (F.col("x") - F.col(c))
    return off.agg((F.sum(square("m")) / (F.sum(square("g")) + EPS)).alias("compactness"))


def disagreement(edges: DataFrame, labels: DataFrame, symmetric: bool = False) -> DataFrame:
    """One row: share of edges whose ends have different labels, over directed edges or distinct pairs."""
    pairs = undirected(edges) if symmetric else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    at = lambda c: labels.select(F.col("node_id").alias(c), F.col("label").alias(f"l{c}"))
    met = pairs.join(at("a"), "a").join(at("b"), "b")
    return met.agg((F.sum(F.when(F.col("la") != F.col("lb"), 1.0).otherwise(0.0)) / (F.count("*") + F.lit(EPS))).alias("disagreement"))


def silhouette(nodes: DataFrame, sample: Iterable[int] | None = None, block: int = BLOCK, label: str = "label", least_same: int = 1, fallback: bool = True) -> DataFrame:
    """node_id, label, weight, a, b, s: weighted Euclidean silhouettes of the sampled nodes (all if None).

    a is the weighted mean distance to the own sampled cluster, or to the whole cluster if the sample holds fewer
    than least_same others of it and fallback is set; without fallback such nodes are left out. A node alone in
    its whole cluster scores 0 and counts in either case. b is the least mean over the other sampled labels; with none, s is 0.
    """
    chosen = None if sample is None else nodes.sparkSession.createDataFrame([(int(i),) for i in sample], "node_id long")
    inside = nodes.withColumn("q", F.lit(True)) if chosen is None else nodes.join(chosen.withColumn("q", F.lit(True)), "node_id", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    pairs, _ = in_blocks(inside.withColumn("label", F.col(label)), ["node_id", "f", "label", "weight", "q"], block)

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[(group.side == 0) & group.q], group[group.side == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"node_id": [], "other": [], "q": [], "wd": [], "w": [], "n": []})
        d, out = distances(left.f, right.f), []
        ids = left.node_id.to_numpy()
        for (other, q), part in right.reset_index(drop=True).groupby(["label", "q"]):
            w = part.weight.to_numpy()
            self_ = ids[:, None] == part.node_id.to_numpy()[None, :]
            out.append(pd.DataFrame({"node_id": ids, "other": other, "q": q, "wd": (d[:, part.index] * w * ~self_).sum(1), "w": (w * ~self_).sum(1), "n": (~self_).sum(1)}))
        return pd.concat(out)

    parts = pairs.groupBy("pair").applyInPandas(sums, "node_id long, other long, q boolean, wd double, w double, n long")
    per = parts.groupBy("node_id", "other").agg(
        F.sum(F.when(F.col("q"), F.col("wd"))).alias("wd"), F.sum(F.when(F.col("q"), F.col("w"))).alias("w"), F.sum(F.when(F.col("q"), F.col("n"))).alias("n"),
        F.sum("wd").alias("all_wd"), F.sum("w").alias("all_w"), F.sum("n").alias("all_n"),
    )
    own = inside.filter("q").select("node_id", F.col(label).cast("long").alias("label"), "weight")
    met = own.join(per, "node_id")
    same = F.col("label") == F.col("other")
    few = F.coalesce(F.col("n"), F.lit(0)) < least_same
    a = F.when(~few, F.col("wd") / F.nullif("w", F.lit(0.0))).when(F.lit(fallback), F.col("all_wd") / F.nullif("all_w", F.lit(0.0)))
    found = met.groupBy("node_id", "label", "weight").agg(
        F.max(F.when(same, a)).alias("a"),
        F.max(F.when(same, F.when(few & (F.col("all_n") > 0) & (not fallback), 1).otherwise(0))).alias("skip"),
        F.min(F.when(~same & (F.col("w") > 0), F.col("wd") / F.nullif("w", F.lit(0.0)))).alias("b"),
    )
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(top, F.lit(0.0)))
    return found.filter("skip = 0").select("node_id", "label", "weight", "a", "b", score.alias("s"))


def seeded_sample(nodes: DataFrame, size: int | None = None, seed: int = 0) -> list[int] | None:
    """Sorted ids of a seeded draw of size nodes from all ids in order; None, for all, without a size below their number."""
    if size is None:
        return None
    if size <= 0:
        raise ValueError("size must be positive")
    ids = nodes.select("node_id").toPandas().node_id.sort_values().to_numpy()
    if size >= len(ids):
        return None
    return ids[np.sort(np.random.default_rng(seed).choice(len(ids), size=size, replace=False))].tolist()


def silhouette_mean(scores: DataFrame) -> DataFrame:
    mean = F.sum(F.col("weight") * F.col("s")) / F.sum("weight")
    return scores.agg(mean.alias("silhouette"), ((1 - mean) / 2).alias("silhouette_term"), F.count("*").alias("n"))


def snn_cut(snn: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: weights inside and between labels, the cut (0 without edges) and the number of edges."""
    at = lambda c: labels.select(F.col("node_id").alias(c), F.col("label").alias(f"l{c}"))
    met = snn.join(at("a"), "a").join(at("b"), "b")
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("weight"))), F.lit(0.0))
    out = met.agg(part(F.col("la") == F.col("lb")).alias("internal"), part(F.col("la") != F.col("lb")).alias("external"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"), F.count("*").alias("edges"))
    return out.withColumn("cut", F.coalesce(safe_ratio(F.col("external"), F.col("total")), F.lit(0.0)))


def mixed_fitness(term: DataFrame, term_column: str, spatial: DataFrame, term_weight: float = 0.7, spatial_weight: float = 0.3) -> DataFrame:
    """One row: weighted sum of a labeling's term and its spatial disagreement."""
    both = term.select(F.col(term_column).alias("term")).join(F.broadcast(spatial.select(F.col("disagreement").alias("spatial"))))  # one row each
    return both.select((term_weight * F.col("term") + spatial_weight * F.col("spatial")).alias("fitness"), "term", "spatial")


def adjusted_rand(rows: DataFrame, one: str, two: str) -> DataFrame:
    """One row: adjusted Rand index of two labelings; 1 where both put all rows into one cluster."""
    pairs = lambda n: n * (n - 1) / 2.0
    both = rows.select(F.col(one).alias("k1"), F.col(two).alias("k2"))
    cells = both.filter("k1 IS NOT NULL AND k2 IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").cast("double").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"s_{c}"))
    sums = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(F.broadcast(side("k1"))).join(F.broadcast(side("k2")))  # one row each
    a, b = F.col("s_k1"), F.col("s_k2")
    expected = a * b / F.nullif(pairs(F.col("n")), F.lit(0.0))
    return sums.select(F.coalesce((F.col("s") - expected) / F.nullif((a + b) / 2.0 - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def adjusted_rands(rows: DataFrame, by: list[str], one: str, two: str) -> DataFrame:
    """by, ari: the adjusted Rand index of two labelings for each group; 1 where both put all its rows into one cluster."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = rows.filter(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(*by, F.col(one).alias("k1"), F.col(two).alias("k2")).agg(F.count("*").cast("double").alias("n"))
    side = lambda c: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(f"s_{c}"))
    sums = cells.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(side("k1"), by).join(side("k2"), by)
    a, b = F.col("s_k1"), F.col("s_k2")
    expected = a * b / F.nullif(pairs(F.col("n")), F.lit(0.0))
    return sums.select(*by, F.coalesce((F.col("s") - expected) / F.nullif((a + b) / 2.0 - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def neighbour_support(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, label, support: share of each label among a node's labelled neighbours."""
    met = edges.join(labels.filter("label >= 0").select(F.col("node_id").alias("dst"), "label"), "dst")
    counts = met.groupBy("src", "label").agg(F.count("*").alias("n"))
    return counts.select("src", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("support"))


def centroid_scores(x: Column, centroids: list[list[float]], beta: float = 1.0) -> Column:
    """Normalised inverse squared distances to given centroids; an all-zero centroid scores 0.85 before."""
    from terrapart.functions.vectors import normalize_probabilities, squared_distance

    raw = [F.lit(0.85) if not any(c) else 1.0 / (squared_distance(x, F.array(*map(F.lit, c))) + 1e-6) for c in centroids]
    return normalize_probabilities(F.array(*[F.pow(r + EPS, F.lit(float(beta))) for r in raw]))

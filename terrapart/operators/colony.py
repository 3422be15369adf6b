"""Ant-colony clustering of weighted nodes.

Construction draws each node's label after the draws before it, so one fit runs inside one task, in which the ants
that share a state of the pheromone table go step by step together
(``run_configs``: one group of a DataFrame for each configuration and seed; nodes and neighbours are small
model data, at most ``MAX_MODEL_BYTES``, and go along as a broadcast whose size is checked first). For one large fit,
``fit_ants_parallel`` builds all ants of an iteration in parallel with a random stream of their own and
updates the pheromone table with the relational operators.
"""

from __future__ import annotations

import json
import pickle
import time
import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapart.operators.graph import vectors_of

#: Bytes of a model's features and neighbours; a lattice of 300,000 cells with 31 features has about 120 million.
MAX_MODEL_BYTES = 1 << 30
#: Nodes up to which a silhouette's distances are computed once for all labelings.
KEPT_DISTANCES = 4096
#: Bytes of a model's distances in single precision that cohesion keeps above that: 11,585 nodes.
KEPT_BYTES = 1 << 29
#: Rows of a block of distances above that; rows of a band that meets all nodes tile by tile, and nodes of such a tile.
ROWS = 128
BAND = 512
TILE = 2048
EPS = 1e-12


def as_probabilities(raw: np.ndarray) -> np.ndarray:
    """Rows finite, non-negative, summing to 1 with the rounding error in the last entry; uniform where all is lost."""
    p = np.asarray(raw, float)
    mass = p.sum(axis=-1, keepdims=True)
    if not np.isfinite(mass).all() or (p < 0.0).any():
        p = np.nan_to_num(p, nan=0.0, posinf=0.0, neginf=0.0).clip(0.0)
        mass = p.sum(axis=-1, keepdims=True)
    lost = mass <= 1e-15
    p = np.where(lost, 1.0 / p.shape[-1], p / np.where(lost, 1.0, mass)) if lost.any() else p / mass
    p[..., -1] = np.maximum(0.0, 1.0 - p[..., :-1].sum(axis=-1))
    return p / p.sum(axis=-1, keepdims=True)


def shares(raw: np.ndarray) -> np.ndarray:
    """``as_probabilities`` up to rounding, with few calls where all rows have a plain mass."""
    mass = raw.sum(axis=-1, keepdims=True)
    if mass.min() > 1e-15 and mass.max() < np.inf:
        return raw / mass
    return as_probabilities(raw)


@dataclass
class Model:
    """Nodes of a problem: features, weights, neighbours (a row of node places each), shared-neighbour edges."""

    x: np.ndarray
    weight: np.ndarray
    near: np.ndarray
    snn: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    far: dict = field(default_factory=dict, repr=False, compare=False)
    near_far: np.ndarray | None = field(default=None, repr=False, compare=False)

    def neighbour_distances(self) -> np.ndarray:
        """Distances to the neighbours, of the shape of ``near``; computed in blocks and kept."""
        if self.near_far is None:
            blocks = [slice(i, i + 1024) for i in range(0, len(self.x), 1024)]
            self.near_far = np.concatenate([np.linalg.norm(self.x[self.near[b]] - self.x[b, None, :], axis=2) for b in blocks])
        return self.near_far

    def neighbour_weights(self) -> np.ndarray:
        """(nodes, 2, neighbours): distances to the neighbours, and ones."""
        if "weights" not in self.far:
            self.far["weights"] = np.stack([self.neighbour_distances(), np.ones_like(self.near_far)], axis=1)
        return self.far["weights"]

    def kept(self) -> np.ndarray | None:
        """All distances in single precision, up to KEPT_BYTES."""
        n = len(self.x)
        if 4 * n * n > KEPT_BYTES:
            return None
        if "kept" not in self.far:
            out, every = np.empty((n, n), np.float32), self.places()
            for i, part in self.products(every):
                out[i : i + ROWS, i:] = part
                out[i:, i : i + ROWS] = part.T
            self.far["kept"] = out
        return self.far["kept"]

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and entries of the nodes that a node sees or is seen by."""
        if "seen" not in self.far:
            n = len(self.x)
            one, two = np.repeat(np.arange(n), self.near.shape[1]), self.near.ravel()
            pairs = np.unique(np.concatenate([one * n + two, two * n + one]))
            pairs = pairs[pairs // n != pairs % n]
            self.far["seen"] = np.searchsorted(pairs // n, np.arange(n + 1)), pairs % n
        return self.far["seen"]

    def places(self) -> np.ndarray:
        return np.arange(len(self.x))

    def distances(self, chosen: np.ndarray) -> np.ndarray:
        """Distances between the chosen nodes, kept for the next labeling."""
        key = chosen.tobytes()
        if key not in self.far:
            held = [k for k in self.far if isinstance(k, bytes)]
            for k in held[:-1]:  # all nodes and a sample at most
                del self.far[k]
            self.far[key] = np.concatenate([self.distances_from(chosen, i) for i in range(0, len(chosen), 64)])
        return self.far[key]

    def products(self, chosen: np.ndarray):
        """(i, distances of ROWS chosen nodes from i to those from i on), by a matrix product; pairs so near that it cancels by their differences."""
        x = self.x[chosen] - self.x.mean(axis=0)
        squares = (x**2).sum(axis=1)[:, None]
        ones, limit = np.ones_like(squares), 1e-8 * squares.max()
        left, right = np.hstack([-2.0 * x, ones, squares]), np.ascontiguousarray(np.hstack([x, squares, ones]).T)
        for i in range(0, len(x), ROWS):
            square = left[i : i + ROWS] @ right[:, i:]
            near, other = np.divmod(np.flatnonzero(square <= limit), square.shape[1])
            np.sqrt(np.maximum(square, 0.0, out=square), out=square)
            for at in range(0, len(near), 1 << 16):
                one, two = near[at : at + (1 << 16)], other[at : at + (1 << 16)]
                square[one, two] = np.sqrt(((self.x[chosen[i + one]] - self.x[chosen[i + two]]) ** 2).sum(axis=1))
            yield i, square

    def distances_from(self, chosen: np.ndarray, i: int) -> np.ndarray:
        x = self.x[chosen]
        return np.sqrt(((x[i : i + 64, None, :] - x[None, :, :]) ** 2).sum(axis=2))


class Members:
    """Nodes of each label of each ant, in an order that is uniformly random at every moment."""

    def __init__(self, labels: np.ndarray, k: int, rng: np.random.Generator) -> None:
        ants, n = labels.shape
        self.rng, self.rows = rng, np.arange(ants)
        self.count = np.zeros((ants, k), int)
        self.nodes, self.place = np.zeros((ants, k, n), np.int32), np.zeros((ants, n), np.int32)
        self.bases = (np.arange(ants * k) * n).reshape(ants, k, 1)
        for ant in range(ants):
            for label in range(k):
                mine = rng.permutation(np.flatnonzero(labels[ant] == label))
                self.count[ant, label] = len(mine)
                self.nodes[ant, label, : len(mine)] = mine
                self.place[ant, mine] = np.arange(len(mine))

    def move(self, i: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        """Node i of each ant goes from its old label (-1: none) to the new one."""
        had = np.flatnonzero(old >= 0)
        if len(had):
            self.count[had, old[had]] -= 1
            last = self.nodes[had, old[had], self.count[had, old[had]]]
            at = self.place[had, i[had]]
            self.nodes[had, old[had], at], self.place[had, last] = last, at
        # An entry of random place goes to the end, the node takes that place: the order stays uniformly random.
        end = self.count[self.rows, new]
        at = (self.rng.random(len(self.rows)) * (end + 1)).astype(int)
        other = self.nodes[self.rows, new, at]
        self.nodes[self.rows, new, end] = other
        self.place[self.rows, other] = np.where(at < end, end, self.place[self.rows, other])
        self.nodes[self.rows, new, at], self.place[self.rows, i] = i, at
        self.count[self.rows, new] += 1

    def some(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ants, labels, most) nodes and which of them count: all of a small cluster, otherwise a uniform choice without repeats.

        The choice is a stretch of the random order from a random start.
        """
        size = self.count[:, :, None]
        start = (self.rng.random(self.count.shape) * self.count).astype(int)
        start[self.count <= most] = 0
        steps = np.arange(most)
        at = start[:, :, None] + steps
        at -= size * (at >= size)
        if self.nodes.shape[2] < 2 * most:
            at = np.minimum(at, self.nodes.shape[2] - 1)  # beyond a small cluster's end, which does not count
        return self.nodes.ravel()[at + self.bases], steps < size


@dataclass
class Partial:
    """Labelings under construction, as heuristics see them: one ant, or several with a leading axis."""

    model: Model
    k: int
    labels: np.ndarray
    centres: np.ndarray
    rng: np.random.Generator
    members: Members | None = None

    def told(self, i: np.ndarray) -> np.ndarray:
        """(..., neighbours, k): which neighbour of a node has which label."""
        if self.labels.ndim == 1:
            return self.labels[self.model.near[i]][..., None] == np.arange(self.k)
        return self.labels[np.arange(len(i))[:, None], self.model.near[i]][..., None] == np.arange(self.k)

    def squares(self, i: np.ndarray) -> np.ndarray:
        """(..., k): squared distances to the centres."""
        off = self.centres - self.model.x[i][..., None, :]
        return np.einsum("...kp,...kp->...k", off, off)

    def placed(self) -> np.ndarray:
        """Which centres are no longer all zero."""
        return self.centres.any(axis=-1)

    def put(self, i: np.ndarray, label: np.ndarray) -> None:
        rows = np.arange(len(i))
        if self.members is not None:
            self.members.move(i, self.labels[rows, i], label)
        self.labels[rows, i] = label


@dataclass
class Visits(Partial):
    """Visits (ant, node) that do not see each other, with centres that stand still, as heuristics see them."""

    ants: np.ndarray | None = None
    reach: np.ndarray | None = None
    ready: np.ndarray | None = None

    def told(self, i: np.ndarray) -> np.ndarray:
        return self.labels[self.ants[:, None], self.model.near[i]][..., None] == np.arange(self.k)

    def squares(self, i: np.ndarray) -> np.ndarray:
        return self.reach[self.ants, i]

    def placed(self) -> np.ndarray:
        return self.ready[self.ants]


def support(told: np.ndarray, k: int) -> np.ndarray:
    """Share of each label among told."""
    return np.bincount(told, minlength=k) / len(told) if len(told) else np.zeros(k)


def by_centre(p: Partial, i: np.ndarray, beta: float) -> np.ndarray:
    closeness = 1.0 / (p.squares(i) + 1e-6)
    closeness = np.where(p.placed(), closeness, 0.85)  # a centre that is still all zero
    return shares((closeness + EPS) ** beta)


def neighbour_closeness(p: Partial, i: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Inverse mean distance to the labelled neighbours of each cluster, ``empty`` where there are none."""
    return closeness_and_counts(p, i, empty)[0]


def closeness_and_counts(p: Partial, i: np.ndarray, empty: float) -> tuple[np.ndarray, np.ndarray]:
    told = p.told(i)
    both = p.model.neighbour_weights()[i] @ told.astype(float)
    far, count = both[..., 0, :], both[..., 1, :]
    return np.where(count > 0, 1.0 / (far / np.maximum(count, 1) + 1e-6), empty), count


def by_neighbours(p: Partial, i: np.ndarray, beta: float) -> np.ndarray:
    close, count = closeness_and_counts(p, i, 1.0 / p.k)
    local = shares(close)
    whole = shares(1.0 / (np.sqrt(p.squares(i)) + 1e-6))
    trust = np.sqrt(count.sum(axis=-1) / max(1, p.model.near.shape[1]))[..., None]
    return shares((trust * local + (1.0 - trust) * whole + EPS) ** beta)


def by_space(p: Partial, i: np.ndarray, beta: float) -> np.ndarray:
    """Not normalised after the power; the draw normalises."""
    count = p.told(i).sum(axis=-2)
    return (shares(1.0 + count / np.maximum(count.sum(axis=-1, keepdims=True), 1)) + EPS) ** beta


def by_cohesion(p: Partial, i: np.ndarray, beta: float, most: int = 40, least: int = 15) -> np.ndarray:
    n = len(p.model.x)
    if p.members is None:
        p.members = Members(p.labels.reshape(-1, n), p.k, p.rng)
    at = np.atleast_1d(i)
    nodes, counts = p.members.some(most)
    if n <= KEPT_DISTANCES:
        far = p.model.distances(p.model.places())[at[:, None, None], nodes]
    elif (kept := p.model.kept()) is not None:
        far = kept.ravel()[at[:, None, None] * n + nodes]
    else:
        far = np.linalg.norm(p.model.x[nodes] - p.model.x[at][:, None, None, :], axis=-1)
    size = p.members.count
    mean = np.einsum("akm,akm->ak", far, counts) / np.minimum(np.maximum(size, 1), most)
    scores = np.where(size > least, 1.0 / (mean + 1e-6), 1.0 / p.k).reshape(*p.labels.shape[:-1], p.k)
    return shares((shares(scores) + EPS) ** beta)


HEURISTICS: dict[str, Callable] = {"centroid": by_centre, "graph": by_neighbours, "spatial": by_space, "cohesion": by_cohesion}


def centres_of(model: Model, labels: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted means; an empty cluster takes a random node."""
    out = np.empty((k, model.x.shape[1]))
    for label in range(k):
        mine = labels == label
        out[label] = np.average(model.x[mine], axis=0, weights=model.weight[mine]) if mine.any() else model.x[rng.integers(len(model.x))]
    return out


def spread_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding."""
    if not 0 < k <= len(x):
        raise ValueError("as many clusters as nodes at most")
    picked = [rng.integers(len(x))]
    least = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        mass = least.sum()
        picked.append(rng.choice(len(x), p=as_probabilities(least / mass)) if np.isfinite(mass) and mass > 1e-15 else rng.integers(len(x)))
        least = np.minimum(least, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked].copy()


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator, mode: str = "zeros", base: np.ndarray | None = None, base_share: float = 0.0, noise: float = 0.05) -> np.ndarray:
    if mode == "zeros":
        return np.zeros((k, x.shape[1]))
    if mode not in ("kmeanspp", "base_or_kmeanspp"):
        raise ValueError(mode)
    if mode == "base_or_kmeanspp" and base is not None and rng.random() < base_share:
        return np.asarray(base, float) + rng.normal(scale=noise, size=(k, x.shape[1]))
    return spread_centres(x, k, rng)


def picked(rng: np.random.Generator, odds: np.ndarray, draws: np.ndarray | None = None) -> np.ndarray:
    """One draw of an index for each row of odds, by ``draws`` if given; odds need not sum to 1."""
    ends = odds.cumsum(axis=-1)
    if not (ends[:, -1].min() > 1e-15 and ends[:, -1].max() < np.inf):
        ends = as_probabilities(odds).cumsum(axis=-1)
    draws = rng.random(len(odds)) if draws is None else draws
    return np.minimum((ends <= draws[:, None] * ends[:, -1:]).sum(axis=1), odds.shape[1] - 1)


def pulls(tau: np.ndarray, alpha: float) -> np.ndarray:
    """The pheromone's part of the odds, for all nodes; it stands still while a batch of ants is built."""
    return (as_probabilities(tau) + EPS) ** alpha


def orders(rng: np.random.Generator, ants: int, n: int) -> np.ndarray:
    """A random order of the nodes for each ant; row t holds what the ants visit in step t."""
    return np.ascontiguousarray(rng.permuted(np.tile(np.arange(n), (ants, 1)), axis=1).T)


def begun(model: Model, k: int, rng: np.random.Generator, ants: int, start: str) -> Partial:
    return Partial(model, k, np.full((ants, len(model.x)), -1), np.stack([first_centres(model.x, k, rng, start) for _ in range(ants)]), rng)


def all_centres(p: Partial) -> np.ndarray:
    return np.stack([centres_of(p.model, labels, p.k, p.rng) for labels in p.labels])


def layers(model: Model, order: np.ndarray, blind: bool):
    """Visits (ant, node) in groups: a node comes after all earlier nodes of its ant's order that it sees or that see it, and before the later ones; with blind, all at once."""
    n, ants = order.shape
    place = np.empty((ants, n), np.int64)
    place[np.arange(ants)[None, :], order] = np.arange(n)[:, None]
    flat = place.ravel()
    if blind:
        yield np.arange(ants * n), flat
        return
    starts, others = model.seen()
    owner = np.repeat(np.arange(n), np.diff(starts))
    waits = np.stack([np.bincount(owner[row[others] < row[owner]], minlength=n) for row in place]).ravel()
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        yield ready, flat
        node = ready % n
        size = starts[node + 1] - starts[node]
        at = np.repeat(starts[node] - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum())
        told = np.repeat(ready - node, size) + others[at]
        told = told[flat[told] > np.repeat(flat[ready], size)]
        np.subtract.at(waits, told, 1)
        ready = np.unique(told[waits[told] == 0])


def standing_pass(p: Partial, pull: np.ndarray, order: np.ndarray, draws: np.ndarray, heuristic: str, beta: float, forced: np.ndarray | None = None) -> None:
    """What a step for each node in turn gives while centres stand still, with draws (and labels forced, -1: none) by step and ant.

    A heuristic sees the labels of a node's neighbours only, so nodes that do not see each other go together.
    """
    n, ants = order.shape
    # Not the differences themselves: a product for all nodes; 1e-6 is added to these squares or their roots.
    middle = p.model.x.mean(axis=0)
    x, c = p.model.x - middle, p.centres - middle
    reach = ((c**2).sum(axis=-1)[:, None, :] + (x**2).sum(axis=-1)[None, :, None] - 2.0 * np.einsum("np,akp->ank", x, c, optimize=True)).clip(0.0)
    for ready, flat in layers(p.model, order, heuristic == "centroid"):
        for at in range(0, len(ready), 1 << 14):
            some = ready[at : at + (1 << 14)]
            ant, node = np.divmod(some, n)
            seen = Visits(p.model, p.k, p.labels, p.centres, p.rng, None, ant, reach, p.placed())
            label = picked(p.rng, pull[node] * HEURISTICS[heuristic](seen, node, beta), draws[flat[some], ant])
            if forced is not None:
                own = forced[flat[some], ant]
                label = np.where(own >= 0, own, label)
            p.labels[ant, node] = label


def build_once(model: Model, tau: np.ndarray, k: int, rng: np.random.Generator, ants: np.ndarray, n_ants: int, *, heuristic: str, alpha: float, beta: float, start: str = "zeros", moving: bool = True) -> tuple:
    """One pass in random order; with moving, an ant's centres follow the labels it has drawn so far."""
    p, pull, rows = begun(model, k, rng, len(ants), start), pulls(tau, alpha), np.arange(len(ants))
    sums, mass = np.zeros_like(p.centres), np.zeros((len(ants), k))
    order = orders(rng, len(ants), len(model.x))
    if not moving and heuristic != "cohesion":
        standing_pass(p, pull, order, rng.random(order.shape), heuristic, beta)
        return p.labels, all_centres(p)
    moving = moving and heuristic != "cohesion"  # which does not look at centres
    for i in order:
        label = picked(rng, pull[i] * HEURISTICS[heuristic](p, i, beta))
        p.put(i, label)
        if moving:
            sums[rows, label] += model.weight[i, None] * model.x[i]
            mass[rows, label] += model.weight[i]
            p.centres[rows, label] = sums[rows, label] / mass[rows, label, None]
    return p.labels, all_centres(p)


def build_refined(model: Model, tau: np.ndarray, k: int, rng: np.random.Generator, ants: np.ndarray, n_ants: int, *, heuristic: str, alpha: float, beta: float, start: str = "zeros", steps: int = 3) -> tuple:
    """Several passes; centres stand still within a pass, labels change in place."""
    p, pull = begun(model, k, rng, len(ants), start), pulls(tau, alpha)
    for _ in range(steps):
        order = orders(rng, len(ants), len(model.x))
        if heuristic != "cohesion":
            standing_pass(p, pull, order, rng.random(order.shape), heuristic, beta)
        else:
            for i in order:
                p.put(i, picked(rng, pull[i] * HEURISTICS[heuristic](p, i, beta)))
        p.centres = all_centres(p)
    return p.labels, p.centres


def build_static_graph(model: Model, tau: np.ndarray, k: int, rng: np.random.Generator, ants: np.ndarray, n_ants: int, *, alpha: float, beta: float) -> tuple:
    """One pass of the graph heuristic around seeded centres that stand still."""
    return build_once(model, tau, k, rng, ants, n_ants, heuristic="graph", alpha=alpha, beta=beta, start="kmeanspp", moving=False)


def build_colonies(
    model: Model, tau: np.ndarray, k: int, rng: np.random.Generator, ants: np.ndarray, n_ants: int, *, colonies: list[tuple[str, float]], alpha: float,
    mutation: float = 0.01, every: int = 3, most_mutations: float = 0.02,
) -> tuple:
    """One pass of each ant with the heuristic of its colony; every third ant may mutate a few draws."""
    if n_ants < 1:
        raise ValueError("n_ants must be positive")
    home = np.minimum(ants // -(-n_ants // len(colonies)), len(colonies) - 1)
    labels, centres = np.empty((len(ants), len(model.x)), int), np.empty((len(ants), k, model.x.shape[1]))
    pull = pulls(tau, alpha)
    for at, (name, beta) in enumerate(colonies):
        mine = np.flatnonzero(home == at)
        if not len(mine):
            continue
        p, order = begun(model, k, rng, len(mine), "kmeanspp"), orders(rng, len(mine), len(model.x))
        odd = (rng.random(order.shape) < mutation) & (ants[mine] % every == 0)
        odd &= odd.cumsum(axis=0) - odd < most_mutations * len(model.x)
        forced = np.where(odd, rng.integers(k, size=order.shape), -1)
        if name != "cohesion":
            standing_pass(p, pull, order, rng.random(order.shape), name, beta, forced)
        else:
            for i, own in zip(order, forced, strict=True):
                label = picked(rng, pull[i] * HEURISTICS[name](p, i, beta))
                p.put(i, np.where(own >= 0, own, label))
        labels[mine], centres[mine] = p.labels, all_centres(p)
    return labels, centres


#: Algorithms by name: builder and its settings; alpha and beta come from the configuration.
ALGORITHMS: dict[str, tuple[Callable, dict]] = {
    "aco_centroid": (build_once, {"heuristic": "centroid"}),
    "aco_cohesion": (build_once, {"heuristic": "cohesion"}),
    "aco_centroid_refinement": (build_refined, {"heuristic": "centroid"}),
    "aco_cohesion_refinement": (build_refined, {"heuristic": "cohesion"}),
    "aco_graph_local": (build_once, {"heuristic": "graph", "start": "kmeanspp"}),
    "aco_graph_local_refinement": (build_refined, {"heuristic": "graph", "start": "kmeanspp"}),
    "multi_centroid_graph_spatial": (build_colonies, {"heuristics": ["centroid", "graph", "spatial"]}),
    "multi_cohesion_graph_spatial": (build_colonies, {"heuristics": ["cohesion", "graph", "spatial"]}),
}


def builder(algorithm: str, alpha: float, beta: float) -> Callable:
    build, settings = ALGORITHMS[algorithm]
    settings = dict(settings) | {"alpha": alpha}
    if "heuristics" in settings:
        settings["colonies"] = [(h, beta) for h in settings.pop("heuristics")]
    else:
        settings["beta"] = beta
    return lambda *a: build(*a, **settings)


def scatter(model: Model, labels: np.ndarray, centres: np.ndarray) -> float:
    w = model.weight
    within = (w * ((model.x - centres[labels]) ** 2).sum(axis=1)).sum()
    middle = np.average(model.x, axis=0, weights=w)
    return float(within / ((w * ((model.x - middle) ** 2).sum(axis=1)).sum() + EPS))


def rough_edges(model: Model, labels: np.ndarray) -> float:
    """Share of directed neighbour pairs with different labels."""
    unlike = labels[model.near] != labels[:, None]
    return float(unlike.sum() / (unlike.size + EPS))


def silhouette_terms(model: Model, labelings: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """The term of each labeling (a row each); distances are computed once for all of them."""
    q = np.arange(len(model.x)) if chosen is None else chosen
    w, own = model.weight[q], labelings[:, q]
    names = [np.unique(row) for row in own]
    member = np.concatenate([np.where(row[:, None] == known, w[:, None], 0.0) for row, known in zip(own, names, strict=True)], axis=1)
    if len(q) <= KEPT_DISTANCES:
        far = model.distances(q) @ member
    else:
        far = np.zeros_like(member)
        for i, part in model.products(q):
            far[i : i + ROWS] += part @ member[i:]
            far[i + ROWS :] += part[:, ROWS:].T @ member[i : i + ROWS]
    ends = np.cumsum([len(known) for known in names])
    parts = np.split(far.T, ends[:-1])
    sums = np.split(member.T, ends[:-1])
    told = [silhouette_of(labels, row, known, w, f, m.sum(axis=1), (row[:, None] == known).sum(axis=0), chosen is not None) for labels, row, known, f, m in zip(labelings, own, names, parts, sums, strict=True)]
    return np.array([(1.0 - above / max(below, EPS)) / 2.0 for above, below in told])


def distances_to(model: Model, rows: slice, single: bool):
    """(tile of all nodes, distances of the rows to it): by products, in single precision where no more than a few pairs of a tile are so near that they lose by it; those are taken from their differences."""
    kind = np.float32 if single else np.float64
    if kind not in model.far:
        x = model.x - model.x.mean(axis=0)
        squares = (x**2).sum(axis=1)[:, None]
        ones = np.ones_like(squares)
        model.far[kind] = np.hstack([-2.0 * x, ones, squares]).astype(kind), np.ascontiguousarray(np.hstack([x, squares, ones]).T.astype(kind)), (0.05 if single else 1e-8) * squares.max()
    left, right, limit = model.far[kind]
    held = np.empty((rows.stop - rows.start, TILE), kind)
    for at in range(0, len(model.x), TILE):
        tile = slice(at, min(at + TILE, len(model.x)))
        square = np.matmul(left[rows], right[:, tile], out=held[:, : tile.stop - at] if tile.stop - at == TILE else None)
        near = np.flatnonzero(square <= limit) if square.min() <= limit else np.zeros(0, int)
        if single and len(near) > square.size // 64:
            square = left_over(model, rows, tile)
        else:
            np.sqrt(np.maximum(square, 0.0, out=square), out=square)
            one, two = np.divmod(near, square.shape[1])
            for first in range(0, len(near), 1 << 16):
                i, j = one[first : first + (1 << 16)], two[first : first + (1 << 16)]
                square[i, j] = np.sqrt(((model.x[rows.start + i] - model.x[at + j]) ** 2).sum(axis=1))
        yield tile, square


def left_over(model: Model, rows: slice, tile: slice) -> np.ndarray:
    """Distances of a tile from the differences."""
    return np.stack([np.sqrt(((model.x[tile] - own) ** 2).sum(axis=1)) for own in model.x[rows]])


def silhouette_shares(model: Model, labelings: np.ndarray, start: int, stop: int, single: bool = False) -> np.ndarray:
    """For each labeling (a row each) the weighted sum of the silhouettes of the nodes from start to stop, among all nodes, and their weight."""
    names = [np.unique(row) for row in labelings]
    member = np.concatenate([np.where(row[:, None] == known, model.weight[:, None], 0.0) for row, known in zip(labelings, names, strict=True)], axis=1)
    sizes = [(row[:, None] == known).sum(axis=0) for row, known in zip(labelings, names, strict=True)]
    ends = np.cumsum([len(known) for known in names])
    masses, member, out = np.split(member.sum(axis=0), ends[:-1]), member.astype(np.float32 if single else float), np.zeros((len(labelings), 2))
    for at in range(start, stop, BAND):
        rows = slice(at, min(at + BAND, stop))
        far = np.zeros((rows.stop - at, member.shape[1]))
        for tile, part in distances_to(model, rows, single):
            far += part @ member[tile]
        parts = np.split(far.T, ends[:-1])
        out += [silhouette_of(labels, labels[rows], known, model.weight[rows], f, mass, size, False) for labels, known, f, mass, size in zip(labelings, names, parts, masses, sizes, strict=True)]
    return out


def silhouette_of(labels: np.ndarray, own: np.ndarray, names: np.ndarray, w: np.ndarray, far: np.ndarray, mass: np.ndarray, size: np.ndarray, sampled: bool) -> tuple[float, float]:
    """Weighted sum of silhouettes, and weight, of nodes from their weighted sums of distances to each cluster (a row each), whose masses and sizes are given."""
    mine = own == names[:, None]
    total = mass[:, None] - np.where(mine, w, 0.0)  # without the node itself
    count = size[:, None] - mine
    mean = np.divide(far, total, out=np.full_like(total, np.nan), where=(count > 0) & (total > 0))
    at = np.searchsorted(names, own)
    a = mean[at, np.arange(len(own))]
    mean[at, np.arange(len(own))] = np.inf
    b = np.nanmin(mean, axis=0) if len(names) > 1 else np.full(len(own), np.inf)
    alone = np.isnan(a)
    # Sampled without others of a larger cluster: left out. Alone in its whole cluster: 0, and counted.
    scored = ~alone | (np.bincount(labels)[own] == 1) if sampled else np.ones(len(own), bool)
    top = np.maximum(a, b)
    told = ~alone & np.isfinite(b) & (top > 0)
    s = np.divide(b - a, top, out=np.zeros_like(a), where=told)
    return float((w[scored] * s[scored]).sum()), float(w[scored].sum())


def silhouette_term(model: Model, labels: np.ndarray, chosen: np.ndarray | None = None) -> float:
    return float(silhouette_terms(model, labels[None, :], chosen)[0])


def cut_term(model: Model, labels: np.ndarray) -> float:
    if model.snn is None or not len(model.snn[0]):
        return 0.0
    a, b, w = model.snn
    return float(w[labels[a] != labels[b]].sum() / w.sum())


#: Objectives: term and its name; the spatial disagreement has the rest of the weight.
OBJECTIVES: dict[str, Callable] = {
    "centroid": lambda m, labels, centres, chosen: scatter(m, labels, centres),
    "silhouette": lambda m, labels, centres, chosen: silhouette_term(m, labels, chosen),
    "snn": lambda m, labels, centres, chosen: cut_term(m, labels),
}


def score(model: Model, labels: np.ndarray, centres: np.ndarray, objective: str, chosen: np.ndarray | None = None) -> tuple[float, dict[str, float]]:
    term, space = OBJECTIVES[objective](model, labels, centres, chosen), rough_edges(model, labels)
    return 0.7 * term + 0.3 * space, {objective: term, "spatial": space}


def scores(model: Model, labelings: list[np.ndarray], centres: list[np.ndarray], objective: str, chosen: np.ndarray | None = None) -> list[tuple[float, dict[str, float]]]:
    """``score`` of each labeling; silhouettes of up to 64 labelings share their distances."""
    if objective != "silhouette":
        return [score(model, own, at, objective, chosen) for own, at in zip(labelings, centres, strict=True)]
    terms = np.concatenate([silhouette_terms(model, np.stack(labelings[i : i + 64]), chosen) for i in range(0, len(labelings), 64)])
    spaces = [rough_edges(model, own) for own in labelings]
    return [(0.7 * float(term) + 0.3 * space, {objective: float(term), "spatial": space}) for term, space in zip(terms, spaces, strict=True)]


def settled(tau: np.ndarray) -> np.ndarray:
    tau = tau.clip(1e-6, 1e6)
    return tau / (tau.sum(axis=1, keepdims=True) + EPS)


def amounts(fits: np.ndarray, rule: str, q: float, clip_first: bool = False) -> np.ndarray:
    """What each ant of a batch deposits."""
    if rule == "quality_weighted":
        quality = (fits.mean() - fits) / (fits.mean() - fits.min() + EPS) + EPS
        return q * (quality.clip(0, 1) ** 2 if clip_first else (quality**2).clip(0, 1))
    out = q / (fits + 1e-9)
    return out if rule == "all_ants" else np.where(np.arange(len(fits)) == fits.argmin(), out, 0.0)


def updated(tau: np.ndarray, solutions: list[tuple[float, np.ndarray]], rule: str, evaporation: float, q: float) -> np.ndarray:
    tau = tau * (1.0 - evaporation)
    places = np.arange(len(tau))
    for amount, (_, labels) in zip(amounts(np.array([f for f, _ in solutions]), rule, q), solutions, strict=True):
        tau[places, labels] += amount
    return settled(tau)


@dataclass
class Fit:
    """The outcome of a fit."""

    labels: np.ndarray
    centres: np.ndarray
    fitness: float
    terms: dict[str, float]
    tau: np.ndarray
    history: list[dict] = field(default_factory=list)


@dataclass
class Colony:
    """Settings of a fit; ``fit`` runs it with one random stream."""

    algorithm: str = "aco_centroid"
    update: str = "all_ants"
    objective: str = "centroid"
    clusters: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    evaporation: float = 0.02
    q: float = 0.05
    n_ants: int = 15
    n_iterations: int = 20
    batch: int | None = None
    seed: int = 0
    chosen: np.ndarray | None = None
    after: Callable | None = None

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS or self.objective not in OBJECTIVES or self.update not in ("all_ants", "best_ant", "quality_weighted"):
            raise ValueError("unknown algorithm, objective or update")
        if self.clusters < 1 or self.n_ants < 1 or self.n_iterations < 1 or not 0 <= self.evaporation < 1 or self.q <= 0:
            raise ValueError("settings out of range")

    def fit(self, model: Model) -> Fit:
        if len(model.x) < self.clusters or len(model.weight) != len(model.x) or len(model.near) != len(model.x):
            raise ValueError("nodes, weights and neighbours do not match")
        rng, build = np.random.default_rng(self.seed), builder(self.algorithm, self.alpha, self.beta)

        def told(tau: np.ndarray, iteration: int, ants: np.ndarray) -> tuple[list, list]:
            built = list(zip(*build(model, tau, self.clusters, rng, ants, self.n_ants), strict=True))
            if self.after is not None:
                built = [self.after(labels, centres, model) for labels, centres in built]
            return built, scores(model, [b[0] for b in built], [b[1] for b in built], self.objective, self.chosen)

        return self.run(len(model.x), told)

    def run(self, n: int, told: Callable) -> Fit:
        """The iterations of a fit; told(pheromone table, iteration, ants) gives the ants' (labels, centres) and their scores."""
        tau = np.full((n, self.clusters), 1.0 / self.clusters)
        best: Fit | None = None
        history = []
        for iteration in range(self.n_iterations):
            fits, tops = [], []
            size = self.batch or self.n_ants
            for first in range(0, self.n_ants, size):
                waiting = []
                for (labels, centres), (fitness, terms) in zip(*told(tau, iteration, np.arange(first, min(first + size, self.n_ants))), strict=True):
                    fits.append(fitness)
                    tops.append(terms)
                    waiting.append((fitness, labels))
                    if best is None or fitness < best.fitness:
                        best = Fit(labels.copy(), centres.copy(), fitness, terms, tau)
                tau = updated(tau, waiting, self.update, self.evaporation, self.q)
            at = np.array(fits)
            history.append({"iteration": iteration + 1, "iteration_best": float(at.min()), "global_best": best.fitness, "mean": float(at.mean()), "std": float(at.std()), "pheromone_min": float(tau.min()), "pheromone_max": float(tau.max())} | tops[int(at.argmin())])
        best.tau, best.history = tau, history
        return best


def collect_model(nodes: DataFrame, edges: DataFrame, snn: DataFrame | None = None) -> tuple[Model, np.ndarray]:
    """Model and node ids in order; model data only, at most MAX_MODEL_BYTES."""
    told = nodes.agg(F.count("*").alias("n"), F.sum(F.size("f") + 2).alias("values")).first()
    size = 8 * ((told["values"] or 0) + edges.count())
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes, more than {MAX_MODEL_BYTES}: aggregate to superpixels first")
    # As Arrow columns: rows of Python objects take ten times the driver's memory.
    rows = nodes.select("node_id", "f", "weight").toArrow().sort_by("node_id")
    ids = rows["node_id"].to_numpy()
    found = edges.select("src", "rank", "dst").toArrow()
    src, rank, dst = (found[c].to_numpy() for c in found.column_names)
    order = np.lexsort((rank, src))
    width = int(np.unique(src, return_counts=True)[1].min())
    order = order[rank[order] <= width]
    table = np.searchsorted(ids, dst[order]).reshape(len(ids), width)
    shared = None
    if snn is not None:
        s = snn.select("a", "b", "weight").toArrow()
        shared = np.searchsorted(ids, s["a"].to_numpy()), np.searchsorted(ids, s["b"].to_numpy()), s["weight"].to_numpy()
    return Model(vectors_of(rows["f"]), rows["weight"].to_numpy().astype(float), table, shared), ids


RUN_SCHEMA = "run_id long, seed long, mode string, feature_mode string, n_ants long, n_iterations long, final_pheromone_min double, final_pheromone_max double, final_iter_mean double, final_iter_std double, algorithm string, pheromone_update string, fitness_name string, alpha double, beta double, evaporation double, q double, status string, error string, best_fitness double, recomputed_fitness double, centroid_fitness double, silhouette_fitness double, snn_fitness double, runtime_sec double, config_json string, labels array<long>, history string"


def run_row(row: dict, n_ants: int, n_iterations: int, fit: Callable[[Colony], tuple[Fit, dict]], clusters: int, chosen: np.ndarray | None) -> dict:
    """The row of a configuration (with seed), by fit, which gives the outcome and all three objectives; a failure is a row too."""
    base = {k: row[k] for k in ("run_id", "seed", "algorithm", "pheromone_update", "fitness_name", "alpha", "beta", "evaporation", "q")}
    base |= {"mode": row.get("mode"), "feature_mode": row.get("feature_mode"), "n_ants": n_ants, "n_iterations": n_iterations}
    base = {k: (v.item() if hasattr(v, "item") else v) for k, v in base.items()}
    began = time.perf_counter()
    try:
        found, again = fit(Colony(base["algorithm"], base["pheromone_update"], base["fitness_name"], clusters, base["alpha"], base["beta"], base["evaporation"], base["q"], n_ants, n_iterations, seed=int(base["seed"]), chosen=chosen))
        out = {"status": "ok", "best_fitness": found.fitness, "recomputed_fitness": again[f"{base['fitness_name']}_fitness"], "labels": found.labels.tolist(), "history": json.dumps(found.history)} | again
        last = found.history[-1]
        out |= {"final_pheromone_min": last["pheromone_min"], "final_pheromone_max": last["pheromone_max"], "final_iter_mean": last["mean"], "final_iter_std": last["std"]}
    except Exception:
        out = {"status": "failed", "error": traceback.format_exc()[-2000:]}
    out |= {"runtime_sec": time.perf_counter() - began, "config_json": json.dumps(base, sort_keys=True)}
    return {c: (base | out).get(c) for c in (kind.split()[0] for kind in RUN_SCHEMA.split(", "))}


def run_configs(configs: DataFrame, model: Model, n_ants: int = 15, n_iterations: int = 20, clusters: int = 5, chosen: np.ndarray | None = None) -> DataFrame:
    """One row for each configuration (with seed): outcome, all three objectives, labels; failures are rows too.

    A fit is one task, but for a model of over KEPT_DISTANCES nodes with fewer configurations than the tasks that run at once:
    then each fit is spread over tasks (``spread_fit``), at once and not when the result is read.
    """
    spark = configs.sparkSession
    held = spark.sparkContext.broadcast((model, chosen))
    if len(model.x) > KEPT_DISTANCES and configs.count() < spark.sparkContext.defaultParallelism:
        rows = [r.asDict() for r in configs.collect()]
        groups = max(1, spark.sparkContext.defaultParallelism // max(1, len(rows)))
        with ThreadPoolExecutor(max(1, len(rows))) as pool:
            found = list(pool.map(lambda row: run_row(row, n_ants, n_iterations, lambda colony: spread_fit(spark, held, colony, groups), clusters, chosen), rows))
        plain = [tuple(v.item() if hasattr(v, "item") else v for v in row.values()) for row in found]
        return spark.createDataFrame(plain, RUN_SCHEMA, verifySchema=False)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, some = held.value

        def fit(colony: Colony) -> tuple[Fit, dict]:
            found = colony.fit(own)
            return found, {f"{o}_fitness": score(own, found.labels, found.centres, o, some)[0] for o in OBJECTIVES}

        return pd.DataFrame([run_row(group.iloc[0].to_dict(), n_ants, n_iterations, fit, clusters, some)])

    return configs.groupBy("run_id", "seed").applyInPandas(run, RUN_SCHEMA)


def in_tasks(spark: SparkSession, n: int, make: Callable) -> list:
    """make(0) to make(n - 1), a task each."""

    def run(parts):
        for part in parts:
            for i in part.id:
                yield pd.DataFrame({"id": [i], "made": [pickle.dumps(make(int(i)))]})

    rows = spark.range(0, n, 1, n).mapInPandas(run, "id long, made binary").collect()
    return [pickle.loads(r.made) for r in sorted(rows, key=lambda r: r.id)]


def spread_silhouettes(spark: SparkSession, held, labelings: np.ndarray, single: bool = False) -> np.ndarray:
    """``silhouette_terms`` over all nodes, a range of nodes to a task."""
    n = labelings.shape[1]
    sent = spark.sparkContext.broadcast(labelings.astype(np.min_scalar_type(int(labelings.max()))))
    parts = min(2 * spark.sparkContext.defaultParallelism, -(-n // BAND))
    ends = np.linspace(0, n, parts + 1).astype(int)
    try:
        above, below = sum(in_tasks(spark, parts, lambda i: silhouette_shares(held.value[0], sent.value, ends[i], ends[i + 1], single))).T
    finally:
        sent.destroy()
    return (1.0 - above / np.maximum(below, EPS)) / 2.0


def spread_fit(spark: SparkSession, held, colony: Colony, groups: int) -> tuple[Fit, dict]:
    """A fit of the broadcast model whose ants are built in groups, a task each with the random stream of (seed, iteration, first ant, group), and whose silhouettes are spread over tasks; with all three objectives of its outcome.

    Silhouettes of ants are in single precision (their terms differ by about 1e-9), those of the outcome are not.
    """
    model, chosen = held.value
    whole = colony.objective == "silhouette" and chosen is None

    def told(tau: np.ndarray, iteration: int, ants: np.ndarray) -> tuple[list, list]:
        now, count = spark.sparkContext.broadcast(tau), min(groups, len(ants))

        def make(part: int) -> tuple:
            own, _ = held.value
            mine = ants[part::count]
            build = builder(colony.algorithm, colony.alpha, colony.beta)
            labels, centres = build(own, now.value, colony.clusters, np.random.default_rng([colony.seed, iteration, int(ants[0]), part]), mine, colony.n_ants)
            found = None if whole else scores(own, list(labels), list(centres), colony.objective, chosen)
            return mine, labels.astype(np.min_scalar_type(colony.clusters)), centres, found

        try:
            made = in_tasks(spark, count, make)
        finally:
            now.destroy()
        order = np.argsort(np.concatenate([m[0] for m in made]))
        labels, centres = np.concatenate([m[1] for m in made])[order].astype(int), np.concatenate([m[2] for m in made])[order]
        if whole:
            terms, spaces = spread_silhouettes(spark, held, labels, single=True), [rough_edges(model, own) for own in labels]
            found = [(0.7 * float(t) + 0.3 * s, {"silhouette": float(t), "spatial": s}) for t, s in zip(terms, spaces, strict=True)]
        else:
            every = [f for m in made for f in m[3]]
            found = [every[i] for i in order]
        return list(zip(labels, centres, strict=True)), found

    best = colony.run(len(model.x), told)
    again = {f"{o}_fitness": score(model, best.labels, best.centres, o, chosen)[0] for o in OBJECTIVES if o != "silhouette" or chosen is not None}
    if chosen is None:
        again["silhouette_fitness"] = 0.7 * float(spread_silhouettes(spark, held, best.labels[None, :])[0]) + 0.3 * rough_edges(model, best.labels)
    if whole:
        best.fitness = again["silhouette_fitness"]
    return best, again


def labels_of(runs: DataFrame, ids: np.ndarray) -> DataFrame:
    """run_id, seed, node_id, label of successful runs."""
    names = F.array(*[F.lit(int(i)) for i in ids]) if len(ids) <= 5000 else None
    long = runs.filter("status = 'ok'").select("run_id", "seed", F.posexplode("labels").alias("at", "label"))
    if names is not None:
        return long.select("run_id", "seed", names[F.col("at")].cast("long").alias("node_id"), "label")
    table = runs.sparkSession.createDataFrame(pd.DataFrame({"at": np.arange(len(ids), dtype="int32"), "node_id": ids}))
    return long.join(table, "at").select("run_id", "seed", "node_id", "label")


def fit_ants_parallel(spark: SparkSession, model: Model, colony: Colony) -> Fit:
    """A fit whose ants run as tasks, each with the stream of (seed, iteration, ant); results differ from ``fit`` by design."""
    tau = np.full((len(model.x), colony.clusters), 1.0 / colony.clusters)
    held, best, history = spark.sparkContext.broadcast(model), None, []
    for iteration in range(colony.n_iterations):
        now = spark.sparkContext.broadcast(tau)

        def ants(groups, iteration=iteration, now=now):
            build = builder(colony.algorithm, colony.alpha, colony.beta)
            for part in groups:
                rows = []
                for ant in part.ant:
                    rng = np.random.default_rng([colony.seed, iteration, int(ant)])
                    (labels,), (centres,) = build(held.value, now.value, colony.clusters, rng, np.array([ant]), colony.n_ants)
                    fitness, _ = score(held.value, labels, centres, colony.objective, colony.chosen)
                    rows.append({"ant": int(ant), "fitness": fitness, "labels": labels.tolist()})
                yield pd.DataFrame(rows, columns=["ant", "fitness", "labels"])

        frame = spark.range(colony.n_ants, numPartitions=colony.n_ants).withColumnRenamed("id", "ant")
        found = frame.mapInPandas(ants, "ant long, fitness double, labels array<long>").toPandas().sort_values("ant")
        solutions = [(f, np.array(labels)) for f, labels in zip(found.fitness, found.labels, strict=True)]
        tau = updated(tau, solutions, colony.update, colony.evaporation, colony.q)
        top = int(found.fitness.to_numpy().argmin())
        if best is None or solutions[top][0] < best.fitness:
            labels = solutions[top][1]
            best = Fit(labels, centres_of(model, labels, colony.clusters, np.random.default_rng(colony.seed)), solutions[top][0], {}, tau)
        history.append({"iteration": iteration + 1, "iteration_best": float(found.fitness.min()), "global_best": best.fitness, "mean": float(found.fitness.mean()), "std": float(found.fitness.std(ddof=0))})
    best.tau, best.history = tau, history
    return best


def kmeans_baseline(nodes: DataFrame, clusters: int = 5, tries: int = 10, seed: int = 0) -> DataFrame:
    """node_id, label of the best of several k-means fits on unweighted feature vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = nodes.select("node_id", array_to_vector("f").alias("v")).cache()
    fits = [KMeans(k=clusters, seed=seed + t, featuresCol="v", predictionCol="label").fit(data) for t in range(tries)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    out = best.transform(data).select("node_id", F.col("label").cast("long").alias("label"))
    data.unpersist()
    return out

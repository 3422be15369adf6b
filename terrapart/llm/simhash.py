"""SimHash near-duplicates by tiled exact comparison.

Fingerprints (64 bits over three-word shingles) are made in Python, one pass over the texts. Distinct
fingerprints are then compared exactly: two within ``radius`` bits have population counts within ``radius``,
in every part of the word. The upper half's count is the strip of a fingerprint; a strip's fingerprints are
dealt into blocks of at most about ``block_rows``, and each block meets the fingerprints of its own strip and
of the next ``radius`` strips as they stream by. Inside, tiles are ordered by the counts of the four quarters,
tile pairs whose counts differ by more than the radius are skipped, and the rest are compared with exclusive
or and numpy's bit count. A union-find inside each block turns matches into at most one link for each row;
links of all blocks are joined by distributed union-find.

Scale: equal texts are one fingerprint, so groups of copies cost nothing; near copies give links, never all
pairs. Rows sent are copies = blocks of four strips for each distinct fingerprint; work is quadratic in the
number of distinct fingerprints, divided by what the counts exclude (about twenty-fold), as the method named
for this operator is. Memory in a task: one block and a batch.

``similar_documents`` is the form for a similarity: fingerprints of 128 bits over the distinct five-word
shingles find candidates, and the exact Jaccard index of the shingle sets confirms them. There a strip is a
range of shingle counts, since sets whose sizes differ by more than the similarity cannot match, tile pairs
are skipped by sizes and population counts, and the radius leaves a pair at the limit a chance of 0.001 to be
missed. Texts travel only for documents with a candidate; a block holds its members' shingles while the others
stream by, and every candidate pair is confirmed unless verified links have joined the two already.

Edge cases: null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; null doc_ids take part but name a component only if it has no other id (in
``similar_documents`` a text that has only null ids has component null); repeated rows get equal results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import blocks, lean, text_of, written
from terrapart.llm.components import components, forest
from terrapart.llm.line_dedup import mixed

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
TILE = 512
#: Rows of a tile that near_sets compares at once: what it holds of them stays in a core's cache.
ROWS = 64
#: The form for a similarity: words of a shingle, Jaccard index, 64-bit words of a fingerprint, shingles a block holds.
SIMILAR_SHINGLE = 5
SIMILAR = 0.8
WORDS = 2
BLOCK_SHINGLES = 4_000_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(run), seed) for run in runs], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed integer of the same bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(rows), "doc_id bigint, fp bigint")


def counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters, a row for each fingerprint."""
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


class Tiles:
    """Fingerprints in the order of their quarters' counts, with the counts' range in each tile."""

    def __init__(self, fps: np.ndarray):
        found = counts(fps)
        self.order = np.lexsort(found.T)
        self.fps, found = fps[self.order], found[self.order]
        self.starts = np.arange(0, len(fps), TILE)
        self.low = np.minimum.reduceat(found, self.starts, axis=0)
        self.high = np.maximum.reduceat(found, self.starts, axis=0)


def matches(left: Tiles, right: Tiles, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, in pieces of one tile pair."""
    for k, start in enumerate(left.starts):
        apart = np.maximum(right.low - left.high[k], left.low[k] - right.high).clip(0).sum(axis=1)
        own = left.fps[start : start + TILE, None]
        for other in right.starts[apart <= radius]:
            near = np.bitwise_count(own ^ right.fps[None, other : other + TILE]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                yield left.order[start + i], right.order[other + j]


def block_links(radius: int):
    """Streams rows (block, visits, fp), ordered, into links between fingerprints."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, parent, tiles = None, [], None, None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def begin() -> None:
            nonlocal own, parent, tiles
            own = np.concatenate(own)
            parent, tiles = np.arange(len(own)), Tiles(own)
            for i, j in matches(tiles, tiles, radius):
                parent = forest(parent, i, j)

        def end() -> pa.RecordBatch:
            if tiles is None:
                begin()
            moved = np.nonzero(parent != np.arange(len(own)))[0]
            return out(own[moved], own[parent[moved]])

        for batch in batches:
            ids, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.nonzero((np.diff(ids) != 0) | (np.diff(visits) != 0))[0] + 1, [len(ids)]])
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if ids[a] != block:
                    if block is not None and len(own):
                        yield end()
                    block, own, parent, tiles = ids[a], [], None, None
                if not visits[a]:
                    own.append(fps[a:b])
                    continue
                if not len(own):
                    continue
                if tiles is None:
                    begin()
                guests = fps[a:b]
                joint = np.concatenate([parent, np.arange(len(own), len(own) + len(guests))])
                for i, j in matches(tiles, Tiles(guests), radius):
                    joint = forest(joint, i, j + len(own))
                parent, met = joint[: len(own)], joint[len(own) :]
                linked = met < len(own)
                yield out(guests[linked], own[met[linked]])
        if block is not None and len(own):
            yield end()

    return rows


def links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = 1 << 16) -> DataFrame:
    """Links (a, b) that join all fingerprints within radius of each other, at most a few for each row."""
    half = F.bit_count(F.shiftrightunsigned("fp", 32))
    strips = distinct.select("fp", half.alias("strip"))
    sizes = dict(strips.groupBy("strip").count().collect())  # at most 33 rows
    parts = F.array(*[F.lit(blocks(sizes.get(s, 0), block_rows)) for s in range(33)])
    spread = F.pmod(F.xxhash64("fp"), F.lit(1 << 20))

    def to(step: int) -> DataFrame:
        strip = F.col("strip") - step
        ours = F.pmod(spread, F.get(parts, F.col("strip"))).cast("int")
        stops = F.when(strip >= 0, F.sequence(F.lit(0), F.get(parts, strip) - 1)).otherwise(F.array().cast("array<int>"))
        stops = F.filter(stops, lambda s: s <= ours) if step == 0 else stops
        visits = (F.col("part") != ours) if step == 0 else F.lit(True)
        return strips.withColumn("part", F.explode(stops)).select((strip * (1 << 20) + F.col("part")).cast("int").alias("block"), visits.alias("visits"), "fp")

    met = to(0)
    for step in range(1, radius + 1):
        met = met.unionByName(to(step))
    dealt = met.select("block", F.col("visits").cast("int").alias("visits"), "fp").repartition("block").sortWithinPartitions("block", "visits")
    return dealt.mapInArrow(lean(block_links(radius)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` (the smallest doc_id reachable) for every row of docs."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = written(links(distinct.select("fp"), radius), "fingerprint-links")
    roots = components(found)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "fingerprint-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(rooted.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words and case as in fingerprint."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    h = np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n, factor, total = len(h) - shingle + 1, 0x9E3779B97F4A7C15, np.zeros(len(h) - shingle + 1, np.uint64)
    for j in range(shingle):
        total += h[j : j + n] * np.uint64(pow(factor, j + 1, 2**64))
    return np.unique(mixed(total))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WORDS words of majority bits, each from a remixed set of hashes."""
    out = []
    for _ in range(WORDS):
        hashes = mixed(hashes + np.uint64(0xA24BAED4963EE407))
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 4096):
            ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True))
    return out


def reach(similar: float, bits: int = BITS * WORDS) -> int:
    """Radius within which fingerprints of sets with that index differ but for a chance of 0.001."""
    share = math.acos(2 * similar / (1 + similar)) / math.pi
    return math.ceil(bits * share + 3.1 * math.sqrt(bits * share * (1 - share)))


class Sets:
    """Fingerprints (a row for each word) and shingle counts, in the order of the counts, with ranges of each tile."""

    def __init__(self, size: np.ndarray, fps: np.ndarray):
        self.order = np.argsort(size, kind="stable")
        self.size, self.words = size[self.order], np.ascontiguousarray(fps[self.order].T)
        self.starts = np.arange(0, len(size), TILE)
        found = np.bitwise_count(self.words.T).astype(np.int16)
        self.low, self.high = (f.reduceat(found, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.least, self.most = self.size[self.starts], self.size[np.minimum(self.starts + TILE, len(size)) - 1]


def near_sets(left: Sets, right: Sets, radius: int, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius whose sizes allow the index, in pieces of one tile pair.

    Sizes are compared only for pairs within the radius, and counts of differing bits stay in bytes.
    """
    for k, start in enumerate(left.starts):
        apart = np.maximum(right.low - left.high[k], left.low[k] - right.high).clip(0).sum(axis=1) > radius
        apart |= (left.most[k] < similar * right.least) | (right.most < similar * left.least[k])
        found = []
        for other in right.starts[~apart]:
            for first in range(start, min(start + TILE, len(left.size)), ROWS):
                theirs = right.words[:, None, other : other + TILE]
                differ = np.bitwise_count(left.words[0, first : min(first + ROWS, start + TILE), None] ^ theirs[0])
                for w in range(1, WORDS):
                    differ += np.bitwise_count(left.words[w, first : min(first + ROWS, start + TILE), None] ^ theirs[w])
                i, j = np.divmod(np.flatnonzero(differ <= radius), differ.shape[1])
                i, j = i + first, j + other
                fits = np.minimum(left.size[i], right.size[j]) >= similar * np.maximum(left.size[i], right.size[j])
                found.append((i[fits], j[fits]))
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            found.clear()
            if len(i):
                yield left.order[i], right.order[j]


def size_strip(size: Column, similar: float) -> Column:
    """Sets of a strip match only sets of the same strip and its neighbours."""
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / similar))).cast("int")


def dealt_by_size(sets: DataFrame, similar: float, block_rows: int) -> DataFrame:
    """sets with (block, visits): every set in its own block, and as a guest in the later blocks of its strip and all of the next lower one."""
    strips = sets.withColumn("strip", size_strip(F.col("size"), similar))
    counts = dict(strips.groupBy("strip").count().collect())  # one row for each range of sizes, some hundred at most
    rows_of = lambda s: max(16, min(block_rows, int(BLOCK_SHINGLES * similar ** (s + 1))))
    last = max(counts, default=0)
    parts = F.array(*[F.lit(blocks(counts.get(s, 0), rows_of(s))) for s in range(last + 1)])
    ours = F.pmod(F.pmod(F.xxhash64("node"), F.lit(1 << 20)), F.get(parts, F.col("strip"))).cast("int")
    own = F.transform(F.sequence(F.lit(0), ours), lambda b: F.struct((F.col("strip") * (1 << 20) + b).alias("block"), (b != ours).cast("int").alias("visits")))
    lower = F.transform(F.sequence(F.lit(0), F.get(parts, F.col("strip") - 1) - 1), lambda b: F.struct(((F.col("strip") - 1) * (1 << 20) + b).alias("block"), F.lit(1).alias("visits")))
    stops = F.when(F.col("strip") > 0, F.concat(own, lower)).otherwise(own)
    out = strips.withColumn("stop", F.explode(stops)).select("stop.*", *sets.columns)
    return out.repartition("block").sortWithinPartitions("block", "visits", "node")


def met_sets(batches: Iterator[pa.RecordBatch], radius: int, similar: float, held) -> Iterator[pa.RecordBatch]:
    """Feeds (block, visits, node, size, fp...) rows in order to held: open(own rows), then meet(own, guests or None, pairs)."""

    def sets(part: pa.Table) -> Sets:
        return Sets(part["size"].to_numpy(), np.stack([part[f"fp{w}"].to_numpy() for w in range(WORDS)], axis=1).view(np.uint64))

    block, waiting, own = None, [], None

    def begin() -> Iterator[pa.RecordBatch]:
        nonlocal own, waiting
        if waiting:
            mine = pa.concat_tables(waiting)
            own, waiting = (mine, sets(mine)), []
            yield held(mine, None, near_sets(own[1], own[1], radius, similar))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ids, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.concatenate([[0], np.nonzero((np.diff(ids) != 0) | (np.diff(visits) != 0))[0] + 1, [len(ids)]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ids[a] != block:
                yield from begin()
                block, own = ids[a], None
            part = table.slice(a, b - a)
            if not visits[a]:
                waiting.append(part)
                continue
            yield from begin()
            if own is not None:
                yield held(own[0], part, near_sets(own[1], sets(part), radius, similar))
    yield from begin()


def candidate_nodes(sets: DataFrame, radius: int, similar: float, block_rows: int) -> DataFrame:
    """Nodes that have a candidate partner."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held(own: pa.Table, guests: pa.Table | None, pairs) -> pa.RecordBatch:
            here, there = np.zeros(len(own), bool), np.zeros(len(own if guests is None else guests), bool)
            for i, j in pairs:
                apart = i != j if guests is None else np.ones(len(i), bool)
                here[i[apart]], there[j[apart]] = True, True
            nodes = np.concatenate([own["node"].to_numpy()[here], (own if guests is None else guests)["node"].to_numpy()[there]])
            return pa.RecordBatch.from_arrays([pa.array(np.unique(nodes))], names=["node"])

        yield from met_sets(batches, radius, similar, held)

    return dealt_by_size(sets, similar, block_rows).mapInArrow(lean(rows), "node bigint").distinct()


def confirmed_links(sets: DataFrame, radius: int, similar: float, shingle: int, block_rows: int) -> DataFrame:
    """Links (a, b) that join all candidate pairs with the index; sets: node, size, fp0, ..., text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, shingles, root = None, [], None

        def held(own: pa.Table, guests: pa.Table | None, pairs) -> pa.RecordBatch:
            nonlocal mine, shingles, root
            if guests is None:
                mine, shingles, root = own, [shingle_hashes(t, shingle) for t in own["text"].to_pylist()], np.arange(len(own))
                both, roots, shift = shingles, root, 0
            else:
                both, shift = [*shingles, *[shingle_hashes(t, shingle) for t in guests["text"].to_pylist()]], len(own)
                roots = np.concatenate([root, np.arange(shift, len(both))])
            nodes = own["node"].to_numpy() if guests is None else np.concatenate([own["node"].to_numpy(), guests["node"].to_numpy()])
            found = []
            for i, j in pairs:
                j = j + shift
                while True:
                    apart = roots[i] != roots[j]
                    i, j = i[apart], j[apart]
                    if not len(i):
                        break
                    for x, y in zip(i[:256].tolist(), j[:256].tolist(), strict=True):
                        if roots[x] == roots[y]:
                            continue
                        common = len(np.intersect1d(both[x], both[y], assume_unique=True))
                        if common >= similar * (len(both[x]) + len(both[y]) - common):
                            found.append((nodes[x], nodes[y]))
                            low, high = sorted((roots[x], roots[y]))
                            roots[roots == high] = low
                    i, j = i[256:], j[256:]
            root = roots[: len(own)]  # own places come before guests, and the smallest place is a component's root
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        yield from met_sets(batches, radius, similar, held)

    return dealt_by_size(sets, similar, block_rows).mapInArrow(lean(rows), "a bigint, b bigint")


def similar_documents(docs: DataFrame, similar: float = SIMILAR, shingle: int = SIMILAR_SHINGLE, block_rows: int = 1 << 16) -> DataFrame:
    """doc_id and ``component_id`` for every row of docs: documents with the Jaccard index ``similar`` or more are linked."""
    names = ["doc_id", "content", "size", *[f"fp{w}" for w in range(WORDS)]]

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), shingle)
                rows.append((len(hashes), *wide_fingerprint(hashes)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * (1 + WORDS))]], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("content"), text_of().alias("text"))
    marked = source.mapInArrow(lean(marks), ", ".join(f"{n} bigint" for n in names))
    marked = written(marked.withColumn("content", F.when(F.col("size") == 0, 0).otherwise(F.col("content"))), "similar-marks")
    nodes = written(marked.groupBy(*names[1:]).agg(F.min("doc_id").alias("node")), "similar-nodes")
    sets = nodes.filter("size > 0 AND node IS NOT NULL")
    radius = reach(similar)
    some = written(candidate_nodes(sets.select("node", *names[2:]), radius, similar, block_rows), "similar-candidates")
    met = sets.join(some, "node").join(source.select(F.col("doc_id").alias("node"), "content", "text").dropDuplicates(["node", "content"]), ["node", "content"])
    texts = written(met.select("node", *names[2:], "text"), "similar-texts")
    found = written(confirmed_links(texts, radius, similar, shingle, block_rows), "similar-links")
    roots = written(components(found), "similar-roots")
    told = nodes.join(roots, "node", "left").select(*names[1:], F.coalesce("root", "node").alias("component_id"))
    return marked.join(told, names[1:]).select("doc_id", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

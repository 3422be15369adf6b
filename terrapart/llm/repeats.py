"""Removal of long repeated byte strings by difference-cover suffix sorting.

Every byte is removed that is covered by a string of ``length`` bytes which also starts anywhere else.
Distribution: a start (a position with ``length`` bytes after it) is dealt by its anchor, the smallest hashed
``gram``-byte string inside its window; equal windows have equal anchors at equal offsets, so suffixes that can
share ``length`` bytes meet in one task, and only starts whose anchor's string occurs twice are dealt at all.
Order: each task sorts the suffixes of its stretches by the difference cover {1, 2} modulo 3: it sorts sampled
triples, names them, recurses on the names, and merges the remaining suffixes by their first byte and the rank
of what follows. Then it compares the ``length``-byte prefixes of adjacent starts; equal neighbours repeat.
(One order over all suffixes of the corpus is not made: it would sort every position several times.)

Steps and scale: (1) one pass over the texts writes the runs of starts that share an anchor, about one for
every 140 bytes; (2) equal texts are counted by digest and represented once; (3) anchors that occur twice are
found by a native count; (4) texts with such anchors, and only those rows, meet their runs and are written;
(5) stretches of text are dealt by anchor, and an anchor with more than ``hot`` members is dealt in blocks of
offsets; a task streams its stretches in chunks and carries, for the key at hand, one stretch for each window
not met before; (6) repeated starts become ranges of their text. Results are exact at every size: anchors are
hashed, but windows are compared byte by byte. Nothing is capped.

Edge cases: null text is empty; texts shorter than ``length`` cannot lose bytes; matches never cross
documents; null and repeated doc_ids are allowed, and rows repeated in full repeat each other; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import slices, text_of, written

LENGTH = 400
GRAM = 128
HOT = 8192
OFFSET_BLOCK = 64
CHUNK_BYTES = 1_500_000
SLICE_CHARS = 1_000_000

RUN = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])


@lru_cache(maxsize=2)
def table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    base = int(np.random.default_rng(seed + 77).integers(0, 2**63)) * 2 + 1
    both = []
    for factor in (base, pow(base, -1, 2**64)):
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    up, down = both
    return up, down


def rolling(data: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the width bytes from each position on; equal strings have equal hashes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(seed, max(1 << 20, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table(seed)[data] * up[:n], out=sums[1:])
    h = (sums[width:] - sums[: n - width + 1]) * down[: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    after = np.minimum.accumulate(rows, axis=1).ravel()
    before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def anchor_runs(texts: list[bytes], length: int, gram: int, offset_block: int = OFFSET_BLOCK) -> pa.Array:
    """For each text, the runs (lo, hi) of starts with one anchor, the anchor's place (-1: several) and its hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int32)
    if len(data) < length:
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([], RUN))
    grams = rolling(data, gram, 1)
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    least = window_least((grams >> bits << bits) | place, length - gram + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.searchsorted(firsts, np.arange(len(at)), side="right") - 1
    valid = np.arange(len(at)) + length <= firsts[owner + 1]
    starts = np.nonzero(valid)[0]
    if not len(starts):
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([], RUN))
    turn = np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(at[starts]) != 0) | (np.diff(owner[starts]) != 0)])
    heads = np.nonzero(turn)[0]
    lo, hi = starts[heads], starts[np.concatenate([heads[1:], [len(starts)]]) - 1]
    doc, place = owner[lo], at[lo]
    # In periodic text one anchor string follows the other: such short runs become one, with no anchor place.
    near = place - lo < offset_block
    joins = (doc[1:] == doc[:-1]) & (lo[1:] == hi[:-1] + 1) & (grams[place[1:]] == grams[place[:-1]]) & near[1:] & near[:-1]
    heads = np.nonzero(np.concatenate([[True], ~joins]))[0]
    tails = np.concatenate([heads[1:], [len(lo)]]) - 1
    marks = grams[place[heads]]
    doc, lo, hi, place = doc[heads], lo[heads], hi[tails], np.where(heads == tails, place[heads], -1)
    offsets[1:] = np.cumsum(np.bincount(doc, minlength=len(texts)))
    base = firsts[doc]
    fields = [pa.array(x.astype(np.int32)) for x in (lo - base, hi - base, np.where(place < 0, -1, place - base))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*fields, pa.array(marks.view(np.int64))], fields=list(RUN)))


def anchored(docs: DataFrame, length: int, gram: int, offset_block: int) -> DataFrame:
    """doc_id, content (digest of the text), n_bytes and the runs of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "content", "n_bytes", "runs"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                part = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
                content = pa.array([hashlib.sha256(t).digest() for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), content, pa.array([len(t) for t in part], pa.int64()), anchor_runs(part, length, gram, offset_block)], names=names)

    schema = "doc_id bigint, content binary, n_bytes bigint, runs array<struct<lo:int,hi:int,at:int,h:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(rows, schema)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of an integer array in the order of their suffixes, by the difference cover {1, 2} modulo 3."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    t = np.zeros(n + 4, np.int64)
    t[:n] = symbols + 1
    # The sample: positions 1 and 2 modulo 3; where n is 1 modulo 3, an empty suffix ends the first row of names.
    at = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    bits = int(t.max()).bit_length()
    if 3 * bits <= 63:
        triple = (t[at] << (2 * bits)) | (t[at + 1] << bits) | t[at + 2]
        order = np.argsort(triple)
        new = np.diff(triple[order]) != 0
    else:
        order = np.lexsort((t[at + 2], t[at + 1], t[at]))
        a = at[order]
        new = (np.diff(t[a]) != 0) | (np.diff(t[a + 1]) != 0) | (np.diff(t[a + 2]) != 0)
    name = np.empty(len(at), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(new)])
    if not new.all():
        order = suffix_order(name)
        name[order] = np.arange(len(at))
    rank = np.zeros(n + 4, np.int64)
    rank[at] = name + 1
    sample = at[order]
    sample = sample[sample < n]
    # The rest: positions 0 modulo 3, by their symbol and the rank of the suffix after it.
    base, width = np.int64(len(at) + 2), np.int64(t.max() + 1)
    rest = np.arange(0, n, 3)
    key = t[rest] * base + rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[ones] * base + rank[ones + 1], key)
    if int(width) * int(width) * int(base) < 2**62:
        pair = lambda x: (t[x] * width + t[x + 1]) * base + rank[x + 2]
        before += np.searchsorted(pair(twos), pair(rest))
    else:  # the pair of symbols and rank as one number: ranks of the distinct pairs of both sides
        both = np.concatenate([twos, rest])
        _, pairs = np.unique(t[both] * width + t[both + 1], return_inverse=True)
        keys = pairs.astype(np.int64) * base + rank[both + 2]
        before += np.searchsorted(keys[: len(twos)], keys[len(twos) :])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sample
    return out


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes from each a equal those from each b."""
    same = np.ones(len(a), bool)
    if length < 8:
        for j in range(length):
            same &= data[a + j] == data[b + j]
        return same
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    live = np.arange(len(a))
    for j in [*range(0, length - 8, 8), length - 8]:
        live = live[words[a[live] + j] == words[b[live] + j]]
    same[:] = False
    same[live] = True
    return same


class Repeats:
    """Finds repeated windows in a stream of stretches sorted by key.

    Of the key that a chunk ends in, stretches are carried on that hold the first of some window.
    """

    def __init__(self, length: int):
        self.length = length
        self.key = None
        self.open: list[tuple[bytes, int, bytes, np.ndarray]] = []  # content, lo, piece, starts told already

    def found(self, keys: list, contents: list[bytes], los: list[int], pieces: list[bytes]) -> list[tuple[bytes, int, int]]:
        """(content, first, last) of repeated starts not told before."""
        length, out = self.length, []
        held = list(self.open) if self.key == keys[0] else []
        owners = [keys[0]] * len(held)
        whole = [False] * len(held)
        index = {piece: k for k, (_, _, piece, _) in enumerate(held)}
        for key, content, lo, piece in zip(keys, contents, los, pieces, strict=True):
            k = index.setdefault(piece, len(held))
            if k == len(held):
                held.append((content, lo, piece, np.zeros(len(piece) - length + 1, bool)))
                owners.append(key)
                whole.append(False)
            else:  # an equal stretch: all its starts repeat, and so do those of the first one
                out.append((content, lo, lo + len(piece) - length))
                whole[k] = True
        sizes = np.array([len(h[2]) for h in held], np.int64)
        data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        starts = sizes - length + 1
        piece = np.repeat(np.arange(len(held)), starts)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = (np.cumsum(sizes) - sizes)[piece] + offset
        rank = np.empty(len(data), np.int64)
        rank[suffix_order(data.astype(np.int64))] = np.arange(len(data))
        order = np.argsort(rank[at])
        same = same_prefix(data, at[order[:-1]], at[order[1:]], length)
        twice = np.array(whole, bool)[piece]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        told = np.concatenate([h[3] for h in held])
        hits = np.nonzero(twice & ~told)[0]
        if len(hits):
            turn = np.concatenate([[True], (np.diff(piece[hits]) != 0) | (np.diff(offset[hits]) != 1)])
            heads = np.nonzero(turn)[0]
            tails = np.concatenate([heads[1:], [len(hits)]]) - 1
            for a, b in zip(hits[heads].tolist(), hits[tails].tolist(), strict=True):
                content, lo = held[piece[a]][:2]
                out.append((content, lo + int(offset[a]), lo + int(offset[b])))
        told |= twice
        opens = np.nonzero(np.concatenate([[True], ~same]))[0]
        leads = np.unique(np.minimum.reduceat(piece[order], opens))
        cuts = np.split(told, np.cumsum(starts)[:-1])
        self.key = keys[-1]
        self.open = [(*held[k][:3], cuts[k]) for k in leads.tolist() if owners[k] == self.key]
        return out


def repeated_starts(stretches: DataFrame, length: int) -> DataFrame:
    """(content, lo, hi) of repeated starts, from stretches (h, block, content, lo, piece) sorted by key."""
    out = pa.schema([("content", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, last, held = Repeats(length), None, ([], [], [], [])
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            got = finder.found(*held)
            held, size = ([], [], [], []), 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else ([], [], []), out.types, strict=True)], schema=out)

        for batch in batches:
            for h, block, content, lo, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, block, content, lo) == last:
                    continue  # the same stretch of a row that is there twice
                last = (h, block, content, lo)
                for into, value in zip(held, ((h, block), content, lo, piece), strict=True):
                    into.append(value)
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield flush()
        if size:
            yield flush()

    return stretches.mapInArrow(rows, "content binary, lo int, hi int")


def without(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of text, the number of removed bytes and of removed runs."""
    left, spans, at = [], 0, 0
    for lo, hi in sorted(starts):
        if lo > at or not spans:
            left.append(text[at:lo])
            spans += 1
        at = max(at, hi + length)
    left.append(text[at:])
    kept = b"".join(left)
    return kept, len(text) - len(kept), spans


def trimmed(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """content, left (remaining bytes), n_removed, n_spans of the texts that have ranges."""
    starts = ranges.groupBy("content").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    out = pa.schema([("content", pa.binary()), ("left", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, text, found in zip(*(c for c in batch.columns), strict=True):
                got = without(text.as_py().encode("utf-8", "surrogatepass"), [(s["lo"], s["hi"]) for s in found.as_py()], length)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((content.as_py(), *got), out.types, strict=True)], schema=out)

    return texts.join(starts, "content").select("content", "text", "starts").mapInArrow(rows, "content binary, left binary, n_removed bigint, n_spans bigint")


def frequent_join(runs: DataFrame, twice: DataFrame, total: int) -> DataFrame:
    """runs with their anchor's members; anchors with over a thousandth of all runs, 1000 at most, are broadcast."""
    limit = max(1000, total // 1000)
    often = F.broadcast(twice.filter(F.col("members") > limit))
    rest = runs.join(F.broadcast(twice.filter(F.col("members") > limit).select("h")), "h", "left_anti")
    return runs.join(often, "h").unionByName(rest.join(twice.filter(F.col("members") <= limit), "h"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, offset_block: int = OFFSET_BLOCK) -> DataFrame:
    """doc_id, content, n_bytes, n_removed, n_spans and ``left`` for every row of docs.

    left: the remaining bytes where some but not all bytes were removed, empty where all were, and null where
    none were, in which case the text stands as it is (its SHA-256 is content).
    """
    gram = min(gram, length)
    spread = offset_block
    marked = written(anchored(docs, length, gram, offset_block), "repeats-anchors")
    unique = written(marked.groupBy("content").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("runs").alias("runs")), "repeats-texts")
    runs = unique.select("content", "rep", F.explode("runs").alias("r")).select("content", "rep", "r.*")
    twice = runs.groupBy("h").agg(F.sum(F.when(F.col("at") < 0, 2).otherwise(1)).alias("members")).filter("members > 1")
    met = frequent_join(runs, twice, unique.agg(F.sum(F.size("runs"))).first()[0] or 0)
    wanted = met.groupBy("content", "rep").agg(F.collect_list(F.struct("lo", "hi", "at", "h", (F.col("members") > hot).alias("hot"))).alias("runs"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    met = source.join(wanted, (source["content"] == wanted["content"]) & source["doc_id"].eqNullSafe(wanted["rep"])).select(source["content"], "text", "runs")
    texts = written(met, "repeats-candidates")
    r = texts.select("content", "text", F.explode("runs").alias("r")).select("content", "text", "r.*")
    low, high = F.floor((F.col("at") - F.col("hi")) / spread).cast("int"), F.floor((F.col("at") - F.col("lo")) / spread).cast("int")
    several = F.col("at") < 0  # all their offsets are in block 0
    block = F.explode(F.when(F.col("hot") & several, F.array(F.lit(0))).when(F.col("hot"), F.sequence(low, high)).otherwise(F.array(F.lit(-1))))
    dealt = (
        r.withColumn("block", block)
        .withColumn("first", F.when((F.col("block") < 0) | several, F.col("lo")).otherwise(F.greatest("lo", F.col("at") - F.col("block") * spread - spread + 1)))
        .withColumn("last", F.when((F.col("block") < 0) | several, F.col("hi")).otherwise(F.least("hi", F.col("at") - F.col("block") * spread)))
        .select("h", "block", "content", F.col("first").alias("lo"), F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + length).alias("piece"))
    )
    ranges = repeated_starts(dealt.repartition("h", "block").sortWithinPartitions("h", "block", "content", "lo"), length)
    one_text = texts.groupBy("content").agg(F.first("text").alias("text"))
    cut = written(trimmed(one_text, ranges, length), "repeats-left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    per_text = unique.select("content", "copies").join(cut, "content", "left")
    per_text = written(per_text.filter((F.col("copies") > 1) | F.col("n_spans").isNotNull()), "repeats-results")
    joined = marked.select("doc_id", "content", "n_bytes").join(per_text, "content", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "content",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("left")).alias("left"),
    )


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.coalesce(F.sha2("left", 256), F.lower(F.hex("content")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"))

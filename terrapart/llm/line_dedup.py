"""Fuzzy line deduplication: MinHash bands, exact Jaccard verification, distributed union-find.

Lines are normalised (lower case, single spaces); equal lines are one node. A line's character shingles are
hashed once each and dealt into bins, whose minima are its signature (empty bins borrow from others); groups
of bins form bands, and lines that share a band are candidates. Each candidate is compared with the smallest
member of its bucket by the exact Jaccard index of the shingle sets. Where a bucket then still holds several
components, every pair of members of different ones is compared, so no candidate pair that could join two
components is left out. Verified links are joined by distributed union-find, and the first occurrence (by
doc_id, then line) of each component is kept.

Scale: the texts are signed in one pass; bands travel as pairs of 64-bit numbers, sorted and streamed, so a
bucket never has to fit in memory, and an equal line is sent once by each task however often it occurs. Texts
of candidates are fetched by one join. Comparisons of a smallest member with many lines are spread over salts,
those of a bucket's components over blocks of its members; a task holds one block. No bucket, partner or
candidate is capped.

Limits: two lines with Jaccard index 0.8 share a band with probability about 0.98, more above it; two lines
without a common band are linked only through others. The comparisons in a bucket of many unlike lines grow
with the square of their number. Lines are told apart by 64-bit hashes.

Edge cases: null text is empty; blank lines are no lines and go only when other lines of their text go; lines
shorter than a shingle are one shingle; rows repeated in full count as one document; null doc_ids come first;
other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import WORD_BREAKS, checkpoint_dir, lean, let, release, slices, text_of, written
from terrapart.llm.components import components

SHINGLE = 8
SIMILAR = 0.8
BANDS, ROWS = 10, 5
BINS = BANDS * ROWS
HUB_SHARE = 200
BLOCK_CHARS = 1 << 18
EMPTY = np.uint32(0xFFFFFFFF)


def normalised(line: str) -> str:
    line = line.lower()
    for c in WORD_BREAKS:
        if c in line:
            line = line.replace(c, " ")
    return " ".join([w for w in line.split(" ") if w]) if "  " in line else line.strip(" ")


def shingle_set(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(len(line) - size + 1)} if len(line) > size else {line}


def packed(line: str) -> np.ndarray | None:
    """The distinct shingles of a Latin line as sorted numbers, which are their eight code points; None for other and for short lines."""
    if len(line) <= SHINGLE:
        return None
    try:
        codes = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    out = np.empty(len(codes) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        out[j::SHINGLE] = np.frombuffer(codes, "<u8", (len(codes) - j) // SHINGLE, j)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Shingled:
    """A normalised line and its shingle set: as numbers where they hold it exactly, else (or beside a line without them) as strings."""

    __slots__ = ("line", "numbers", "size", "strings")

    def __init__(self, line: str):
        self.line, self.numbers = line, packed(line)
        self.strings = shingle_set(line) if self.numbers is None else None
        self.size = len(self.strings if self.numbers is None else self.numbers)

    def common(self, other: Shingled) -> int:
        """Number of shingles in both."""
        if self.numbers is not None and other.numbers is not None:
            both = np.concatenate([self.numbers, other.numbers])
            both.sort()
            return int(np.count_nonzero(both[1:] == both[:-1]))
        for x in (self, other):
            if x.strings is None:
                x.strings = shingle_set(x.line)
        return len(self.strings & other.strings)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bands_of(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """Band hashes (a row for each line) of normalised, non-empty lines; a line's do not depend on the others."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # drawn before the loop, whose length depends on the lines
    padded = [x if len(x) >= size else x + "\0" * (size - len(x)) for x in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.array([len(x) - size + 1 for x in padded], np.int64)
    owner = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(len(owner)) + owner * (size - 1)
    h = np.zeros(len(points) - size + 1, np.uint64)
    for j in range(size):
        h += points[j : len(points) - size + 1 + j] * factors[j]
    h = mixed(h[at])
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    sig = np.full(len(lines) * BINS, EMPTY, np.uint32)
    np.minimum.at(sig, owner * BINS + bins, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    sig = sig.reshape(-1, BINS)
    empty = sig == EMPTY
    filled = sig.copy()
    for _ in range(64):  # empty bins borrow from a sequence of other bins that is the same for all lines
        source = rng.integers(0, BINS, BINS)
        take = empty & (sig[:, source] != EMPTY)
        filled[take] = sig[:, source][take]
        empty &= ~take
        if not empty.any():
            break
    left = np.nonzero(empty)
    filled[left] = sig.min(axis=1)[left[0]]
    rows = filled.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mixed((rows * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("fresh", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
SIGNED_SQL = "doc_id bigint, row bigint, at array<int>, ids array<bigint>, fresh array<bigint>, bands array<bigint>"


def signed(docs: DataFrame) -> DataFrame:
    """A row for each document: its lines' numbers and ids, and the bands of lines this task had not met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        met: set[int] = set()
        for batch in batches:
            keys, marks, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts, 250_000):
                out, new, owners = [], [], []
                if len(met) > 500_000:
                    met.clear()
                for k in range(a, b):
                    at, ids, fresh = [], [], []
                    for n, line in enumerate(texts[k].split("\n")):
                        if x := normalised(line):
                            i = xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) - (1 << 63)
                            at.append(n)
                            ids.append(i)
                            if i not in met:
                                met.add(i)
                                fresh.append(i)
                                new.append(x)
                    out.append((keys[k], marks[k], at, ids, fresh))
                    owners.append(len(fresh))
                flat = bands_of(new).view(np.int64).ravel() if new else np.zeros(0, np.int64)
                ends = np.cumsum([0, *owners], dtype=np.int32) * BANDS
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), SIGNED.types[:5], strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=SIGNED)

    source = identified(docs).select("__tp_id", "__tp_row", "__tp_text")
    return source.mapInArrow(lean(rows), SIGNED_SQL)


def identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__tp_text", text_of()).withColumns({"__tp_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__tp_row": F.xxhash64("doc_id", F.lit(0), "__tp_text")})


def buckets(marked: DataFrame) -> DataFrame:
    """(band, id, hub) for every line of a bucket but its smallest, the hub."""
    pair = pa.schema([("band", pa.int64()), ("id", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bands = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.repeat(ids, BANDS))], schema=pair)

    star = pa.schema([("band", pa.int64()), ("id", pa.int64()), ("hub", pa.int64())])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_band = last_id = hub = None
        for batch in batches:
            band, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(band):
                continue
            opens = np.concatenate([[band[0] != last_band], band[1:] != band[:-1]])
            heads = np.nonzero(opens)[0]
            which = np.cumsum(opens) - 1
            hubs = np.where(which >= 0, ids[heads[which.clip(0)]] if len(heads) else 0, 0)
            if not opens[0]:
                hubs[which < 0] = hub
            same = np.concatenate([[band[0] == last_band and ids[0] == last_id], (band[1:] == band[:-1]) & (ids[1:] == ids[:-1])])
            use = ~same & (ids != hubs)
            last_band, last_id, hub = band[-1], ids[-1], hubs[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (band, ids, hubs)], schema=star)

    rows = marked.select("fresh", "bands").mapInArrow(lean(spread), "band bigint, id bigint")
    return rows.repartition("band").sortWithinPartitions("band", "id").mapInArrow(lean(stars), "band bigint, id bigint, hub bigint")


def compared(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, hub, similar) with the exact Jaccard index of every distinct pair; lines: id, line."""
    limit = max(HUB_SHARE, pairs.count() // 1000)
    large = pairs.groupBy("hub").agg(F.count("*").alias("n")).filter(F.col("n") > limit)  # at most 1000 rows
    large = F.broadcast(large.select("hub", F.ceil(F.col("n") / limit).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(large, "hub", "left").select("id", "hub", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    members = salted.join(lines, "id").select("hub", "salt", F.lit(1).alias("kind"), "id", "line")
    each = pairs.select("hub").distinct().join(large, "hub", "left").select("hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hubs = each.join(lines.withColumnRenamed("id", "hub"), "hub").select("hub", "salt", F.lit(0).alias("kind"), F.col("hub").alias("id"), "line")
    out = pa.schema([("id", pa.int64()), ("hub", pa.int64()), ("similar", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_hub, own = None, None
        for batch in batches:
            ids, hubs_, found = [], [], []
            for hub, kind, i, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    open_hub, own = hub, Shingled(normalised(line))
                    continue
                other = Shingled(normalised(line))
                common = own.common(other)
                ids.append(i)
                hubs_.append(open_hub)
                found.append(common / (own.size + other.size - common))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hubs_, pa.int64()), pa.array(found, pa.float64())], schema=out)

    dealt = members.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return dealt.select("hub", "kind", "id", "line").mapInArrow(lean(rows), "id bigint, hub bigint, similar double")


def candidate_lines(docs: DataFrame, ids: DataFrame, first: DataFrame) -> DataFrame:
    """(id, line) of the wanted ids, taken from the first text that holds each."""
    places = ids.join(first, "id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "id")).alias("wanted"))
    source = identified(docs).select(F.col("__tp_id").alias("doc_id"), F.col("__tp_row").alias("row"), "__tp_text")
    met = source.join(places, ["doc_id", "row"])
    lines = let(F.split("__tp_text", "\n"), lambda x: F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), x[w["at"]].alias("line"))))
    return met.select(F.explode(lines).alias("l")).select("l.id", "l.line")


def leftovers(stars: DataFrame, told: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, c, id) of all members but the hub, with their component c, of buckets with a member outside the hub's component."""
    root = lambda column: roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    rows = stars.join(told.select("id", "hub"), ["id", "hub"]).join(root("id"), "id", "left").join(root("hub"), "hub", "left")
    rows = rows.select("band", "id", F.coalesce("id_root", "id").alias("c"), F.coalesce("hub_root", "hub").alias("hc"))
    split = rows.filter("c <> hc").select("band").distinct()
    return rows.join(split, "band", "left_semi").select("band", "c", "id")


def led(rest: DataFrame, lines: DataFrame, similar: float, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Links (a, b), a > b, that join all components of a bucket with a similar pair between them; rest: band, c, id.

    The members outside a bucket's largest component, which leads it, are dealt into blocks of about block_chars
    characters. Each block is held while all members of the bucket stream by; every pair of different components
    is compared, unless links found in the block have joined the two already.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, joined, block, arrays = None, {}, [], None

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for batch in batches:
            found = []
            for band, part, kind, c, i, line in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (band, part) != last:
                    last, joined, block, arrays = (band, part), {}, [], None
                own = Shingled(normalised(line))
                if kind == 0:
                    block.append((c, i, own))
                    continue
                if arrays is None:
                    arrays = [np.array(x, np.int64) for x in zip(*((c, i, held.size) for c, i, held in block), strict=True)] if block else [np.zeros(0, np.int64)] * 3
                roots, ids, sizes = arrays
                c = root(c)
                meet = (roots != c) & (np.minimum(sizes, own.size) >= similar * np.maximum(sizes, own.size))
                if kind == 1:  # of two members outside the largest component, the one with the smaller id streams by
                    meet &= ids > i
                for k in np.nonzero(meet)[0].tolist():
                    if roots[k] == c:
                        continue
                    held = block[k][2]
                    common = own.common(held)
                    if common >= similar * (own.size + held.size - common):
                        other = int(ids[k])
                        found.append((max(i, other), min(i, other)))
                        joined[int(roots[k])] = c
                        roots[roots == roots[k]] = c
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=out)

    sized = rest.join(lines, "id")
    groups = sized.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
    per = groups.groupBy("band").agg(F.max(F.struct("n", "c", "chars")).alias("most"), F.sum("chars").alias("chars"), F.count("*").alias("k")).filter("k > 1")
    per = per.select("band", F.col("most.c").alias("main"), F.ceil((F.col("chars") - F.col("most.chars") + 1) / block_chars).cast("int").alias("parts"))
    met = sized.join(per, "band")
    held = met.filter("c <> main").select("band", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "c", "id", "line")
    stream = met.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.when(F.col("c") == F.col("main"), 2).otherwise(1).alias("kind"), "c", "id", "line")
    dealt = held.unionByName(stream).repartition("band", "part").sortWithinPartitions("band", "part", "kind", "id")
    return dealt.mapInArrow(lean(rows), "a bigint, b bigint")


def line_components(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed documents, first occurrences (id, doc_id, row, at) and roots (node, root) of linked lines."""
    checkpoint_dir(docs.sparkSession)
    marked = written(signed(docs), "lines-signed")
    places = marked.select("doc_id", "row", F.explode(F.arrays_zip("ids", "at")).alias("l")).select(F.col("l.ids").alias("id"), F.struct("doc_id", "row", F.col("l.at").alias("at")).alias("p"))
    first = written(places.groupBy("id").agg(F.min("p").alias("p")).select("id", "p.*"), "lines-first")
    stars = written(buckets(marked), "lines-buckets")
    pairs = written(stars.select("id", "hub").distinct(), "lines-pairs")
    ids = pairs.select(F.explode(F.array("id", "hub")).alias("id")).distinct()
    lines = written(candidate_lines(docs, ids, first), "lines-texts")
    told = written(compared(pairs, lines), "lines-compared")
    links = told.filter(F.col("similar") >= similar).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    roots = components(links)
    rest = written(leftovers(stars, told, roots), "lines-leftover")
    more = written(led(rest, lines, similar), "lines-led")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    release(docs.sparkSession)
    return marked, first, written(roots, "lines-roots")


def kept_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, row, at (numbers of all lines with a word) and kept (numbers of those that stay)."""
    marked, first, roots = line_components(docs, similar)
    rooted = first.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("root"), F.struct("doc_id", "row", "at").alias("p"))
    keepers = rooted.groupBy("root").agg(F.min("p").alias("p")).select("p.*").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("at")).alias("kept"))
    return marked.select("doc_id", "row", "at").join(keepers, ["doc_id", "row"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))


def dedup_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with ``text`` reduced to its kept lines; texts that lose no line stay as they are."""
    kept = kept_lines(docs, similar).select(F.col("doc_id").alias("__tp_id"), F.col("row").alias("__tp_row"), "kept", (F.size("at") - F.size("kept")).alias("__tp_gone")).distinct()
    changed = kept.filter("__tp_gone > 0").withColumnRenamed("kept", "__tp_kept")
    met = identified(docs).join(changed, ["__tp_id", "__tp_row"], "left")
    short = let(F.split("__tp_text", "\n"), lambda x: F.array_join(F.transform("__tp_kept", lambda i: x[i]), "\n"))
    out = met.withColumn("text", F.when(F.col("__tp_gone").isNull(), F.col("text")).otherwise(short))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept_lines(docs).select("doc_id", F.size("at").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), "kept")

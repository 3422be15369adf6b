"""Benchmark decontamination: BM25 over an inverted index of test items, pruned with block maxima.

The index holds the test items; every passage of every training text is a query. Impacts are BM25 weights
divided by the item's score against itself, so one threshold serves all items: an item is retrieved if a
passage reaches ``retrieve`` of what the item's own text would. Passages are windows of twice the longest
item's words, by half, so a copied item stands whole in at least one passage. Postings are cut into blocks of
items with the largest impact of each term in the block. An item's rarest terms, without which the rest cannot
reach half the threshold, are its leading terms; a vectorised sum of their block maxima over a batch of
passages leaves the passages in which some block can still reach the threshold, and these are evaluated by
block-max WAND. Each retrieved item is then verified on the whole text: the share of its five-word shingles
found there must reach ``overlap`` for the question (all but the last sentence) and, where an item has one, for
the answer (the last sentence).

Scale: one pass over the texts, no shuffle of them. Document frequencies, number and mean length of items and
the passage length are counted over the whole benchmark in Spark. The index is built from items of at most
``index_bytes`` of text; a larger benchmark is dealt into parts with the same global statistics, and the texts
are searched once for each part, with one part broadcast at a time, so scores and finds do not depend on the
number of parts. An index holds a few numbers for each posting.

Edge cases: null texts and items are empty; an item without words is never found; fewer words than a shingle
must stand in the text in a row; repeated rows get equal results; an empty benchmark finds nothing. Words are
lower case with ASCII punctuation as white space.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import blocks, give_back, lean, slices, text_of, written

SHINGLE = 5
OVERLAP = 0.8
RETRIEVE = 0.6
K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
INDEX_BYTES = 32 << 20
#: What an item's terms other than the leading ones may reach, as a share of the threshold.
REST = 0.5
PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})

HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,overlap:double>>"
HIT = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap", "overlap"))]))


def words_in(text: str) -> list[str]:
    return text.lower().translate(PUNCTUATION).split()


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer, the last sentence; an item of one sentence is a question."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words_in(p)]
    if len(parts) < 2:
        return words_in(text), []
    return [w for p in parts[:-1] for w in words_in(p)], words_in(parts[-1])


def runs_of(keys: np.ndarray, n: int) -> np.ndarray:
    """First places of 0 to n in sorted keys, and the end."""
    return np.searchsorted(keys, np.arange(n + 1))


def largest(term: np.ndarray, block: np.ndarray, impact: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, block) in order with their largest impact, rounded up."""
    key = term.astype(np.int64) * n_blocks + block
    order = np.argsort(key, kind="stable")
    key, impact = key[order], impact[order]
    heads = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(impact, heads) if len(heads) else np.zeros(0)
    return key[heads] // n_blocks, (key[heads] % n_blocks).astype(np.int32), (most * 1.00001).astype(np.float32)


class Index:
    """Inverted index of items with block maxima; df, n, mean and half are those of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, half: int, retrieve: float = RETRIEVE):
        kept = [(i, t, words_in(t)) for i, t in items if words_in(t)]
        self.ids, self.half, self.retrieve = [i for i, _, _ in kept], max(1, half), retrieve
        self.answers = array("i", [len(question_answer(t)[1]) for _, t, _ in kept])
        self.term = {t: k for k, t in enumerate(dict.fromkeys(w for _, _, words in kept for w in words))}
        self.words = array("i", [self.term[w] for _, _, words in kept for w in words])
        self.word_ends = array("q", np.cumsum([0, *(len(w) for _, _, w in kept)]).tolist())
        self.n_blocks = blocks(len(kept), BLOCK_ITEMS)
        names = list(self.term)
        counts = np.array([df[t] for t in names], np.int64)
        idf = [math.log(1 + (n - c + 0.5) / (c + 0.5)) for c in counts.tolist()]
        rows, rest = [], np.zeros(self.n_blocks)
        for k in range(len(kept)):
            words = self.item_words(k)
            tf = Counter(words)
            raw = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for t, c in tf.items()}
            own, left = sum(raw.values()), 1.0
            for t in sorted(raw, key=lambda t: (counts[t], t)):
                leads = left > REST * retrieve
                rows.append((t, k, raw[t] / own, leads))
                left -= raw[t] / own
                if not leads:
                    rest[k // BLOCK_ITEMS] = max(rest[k // BLOCK_ITEMS], left + raw[t] / own)
        term, item, impact, leads = (np.array(c) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, d) for d in (int, int, float, bool))
        block = item // BLOCK_ITEMS
        self.firsts = array("q", runs_of(term, len(names)).tolist())
        self.items, self.impacts = array("i", item.tolist()), array("d", impact.tolist())
        at, where, most = largest(term, block, impact, self.n_blocks)
        self.block_firsts = array("q", runs_of(at, len(names)).tolist())
        self.blocks, self.tops = array("i", where.tolist()), array("f", most.tolist())
        self.most = array("f", np.maximum.reduceat(most, np.array(self.block_firsts[:-1])).tolist() if len(most) else [])
        at, self.lead_blocks, self.lead_tops = largest(term[leads], block[leads], impact[leads], self.n_blocks)
        self.lead_firsts, self.rest = runs_of(at, len(names)), rest

    def item_words(self, k: int) -> list[int]:
        return self.words[self.word_ends[k] : self.word_ends[k + 1]].tolist()

    def top(self, term: int, block: int) -> float:
        """The largest impact of a term in a block."""
        end = self.block_firsts[term + 1]
        at = bisect_left(self.blocks, block, self.block_firsts[term], end)
        return self.tops[at] if at < end and self.blocks[at] == block else 0.0

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose impacts over distinct terms add up to least or more."""
        lists = [[self.items[self.firsts[t]], self.firsts[t], t] for t in terms]
        found = []
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                total += self.most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(self.top(t, block) for _, _, t in lists[: pivot + 1]) >= least:
                if lists[0][0] == item:
                    score = sum(self.impacts[at] for _, at, _ in lists[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:  # no item of this block before the next list's item can do
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                target = max(target, item + 1) if lists[0][0] == item else max(target, item)
            left = []
            for k, (at_item, at, t) in enumerate(lists):
                if k <= pivot and at_item < target:
                    at = bisect_left(self.items, target, at, self.firsts[t + 1])
                    if at == self.firsts[t + 1]:
                        continue
                    at_item = self.items[at]
                left.append([at_item, at, t])
            lists = left
        return found

    def open_windows(self, where: np.ndarray, term: np.ndarray, follows: np.ndarray) -> list[int]:
        """Windows (of half p and the next one, where that follows) in which some block can reach the threshold.

        where, term: distinct terms of each half, in order of where.
        """
        first = self.lead_firsts[term]
        count = self.lead_firsts[term + 1] - first
        total = np.cumsum(count)
        if not len(total) or not total[-1]:
            return []
        at = np.repeat(first - (total - count), count) + np.arange(total[-1])
        pairs, back = np.unique(np.repeat(where, count) * self.n_blocks + self.lead_blocks[at], return_inverse=True)
        sums = np.bincount(back, weights=self.lead_tops[at])
        half, block = pairs // self.n_blocks, pairs % self.n_blocks
        least = self.retrieve * 0.9999 - self.rest[block]
        after = np.minimum(np.searchsorted(pairs, pairs + self.n_blocks), len(pairs) - 1)
        both = sums + np.where((pairs[after] == pairs + self.n_blocks) & follows[half], sums[after], 0.0)
        before = (half > 0) & follows[half - 1]  # the window that begins with the half before
        return np.union1d(half[both >= least], half[before & (sums >= least)] - 1).tolist()

    def candidates(self, texts: list[list[int]]) -> dict[int, dict[int, float]]:
        """For each text (term numbers, -1 for others) with any: its items with their best passage's score."""
        half, size = self.half, max(1, len(self.term))
        lengths = np.array([len(w) for w in texts], np.int64)
        counts = -(-lengths // half)
        firsts = np.cumsum(counts) - counts
        terms = np.concatenate([np.array(w, np.int64) for w in texts]) if texts else np.zeros(0, np.int64)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        halves = np.repeat(firsts, lengths) + place // half
        known = terms >= 0
        keys = np.unique(halves[known] * size + terms[known])
        where, term = keys // size, keys % size
        owner = np.repeat(np.arange(len(texts)), counts)
        follows = np.append(owner[1:] == owner[:-1], False)
        found: dict[int, dict[int, float]] = {}
        for p in self.open_windows(where, term, follows):
            a, b = np.searchsorted(where, [p, p + 2 if follows[p] else p + 1])
            for item, score in self.search(sorted(set(term[a:b].tolist())), self.retrieve):
                best = found.setdefault(int(owner[p]), {})
                best[item] = max(score, best.get(item, 0.0))
        return found

    def hits(self, texts: list[str], overlap: float) -> list[list[dict]]:
        get = self.term.get
        words = [[get(w, -1) for w in words_in(t)] for t in texts]
        out: list[list[dict]] = [[] for _ in texts]
        for k, items in self.candidates(words).items() if self.ids else ():
            own, line = shingles(words[k]), f" {' '.join(map(str, words[k]))} "
            for item, score in sorted(items.items()):
                whole = self.item_words(item)
                cut = len(whole) - self.answers[item]
                q, a = share(whole[:cut], own, line), share(whole[cut:], own, line) if self.answers[item] else None
                if q >= overlap and (a is None or a >= overlap):
                    out[k].append({"item_id": self.ids[item], "score": score, "question_overlap": q, "answer_overlap": a, "overlap": share(whole, own, line)})
        return out


def share(part: list[int], own: set[tuple], line: str) -> float:
    """Share of part's shingles in own; a part shorter than a shingle must stand in line."""
    if len(part) < SHINGLE:
        return float(f" {' '.join(map(str, part))} " in line)
    wanted = shingles(part)
    return len(wanted & own) / len(wanted)


def weighed(benchmark: DataFrame) -> DataFrame:
    """item_id, text, number of words and distinct words of each distinct item with words."""
    out = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("terms", pa.list_(pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_in(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], out.field("terms").type)], schema=out)

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    return items.mapInArrow(lean(rows), "item_id bigint, text string, n_words bigint, terms array<string>").filter("n_words > 0")


def indexes(benchmark: DataFrame, retrieve: float = RETRIEVE, index_bytes: int = INDEX_BYTES) -> tuple[int, Iterator[Index]]:
    """The number of parts, and an index of each, built from about index_bytes of text and statistics of all items."""
    items = written(weighed(benchmark), "benchmark-items")
    told = items.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean"), F.max("n_words").alias("most"), F.sum(F.octet_length("text")).alias("size")).first()
    parts = blocks(told["size"] or 0, index_bytes)
    df = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))

    def build() -> Iterator[Index]:
        for part in range(parts):
            own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
            counts = df.join(own.select(F.explode("terms").alias("term")).distinct(), "term").collect()
            rows = sorted({(r.item_id, r.text) for r in own.select("item_id", "text").collect()}, key=lambda r: (r[0] is None, r))
            yield Index(rows, {r.term: r.n for r in counts}, told.n, told.mean, told.most or 1, retrieve)

    return parts, build()


def searched(text: Column, index: Broadcast, overlap: float) -> Column:
    @F.arrow_udf(HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array([hits for a, b in slices(texts, 1_000_000) for hits in index.value.hits(texts[a:b], overlap)], HIT)
        give_back()

    # Not declared deterministic, so that the planner leaves the search where it is and runs it once a row.
    return search.asNondeterministic()(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with ``leaks``: array of the verified items with their scores (an input column of that name is replaced)."""
    context = docs.sparkSession.sparkContext
    parts, built = indexes(benchmark, retrieve, index_bytes)
    if parts == 1:
        return docs.withColumn("leaks", searched(text_of(), context.broadcast(next(built)), overlap))
    rows = written(docs.drop("leaks").withColumn("__tp_n", F.monotonically_increasing_id()), "leaks-documents")
    tables = []
    for index in built:
        held = context.broadcast(index)
        tables.append(written(rows.select("__tp_n", searched(text_of(), held, overlap).alias("leaks")).filter(F.size("leaks") > 0), "leaks-part"))
        held.destroy()
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    found = found.groupBy("__tp_n").agg(F.sort_array(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    none = F.array().cast(HITS)
    met = rows.join(found, "__tp_n", "left").withColumn("leaks", F.coalesce("leaks", none))
    return met.select(*[f"`{c}`" for c in docs.columns if c != "leaks"], "leaks")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified item."""
    return find_leaks(docs, benchmark).filter(F.size("leaks") == 0).drop("leaks")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")

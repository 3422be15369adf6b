"""Token files with directly addressable codes.

A token file is a folder of segments. A segment holds the ids of whole documents, split into chunks of eight
bits by level: level 0 has the lowest chunk of every id and a continuation bitmap that says which ids have
more; each further level has the next chunk of those only. A rank directory counts the set bits before each
block of 512, so any token is read by one bit test and one rank for each level, without decoding others.
Segments are stored as rows of binary columns in Parquet, which any store that Spark reaches can hold; ids of
a document stand in one segment, and segments follow ascending doc_id.

Writing: documents are range-partitioned and sorted by (doc_id, text hash), encoded in Arrow batches, and
written; the first position of each partition (one row for each partition, a bounded table) comes from a
running sum. Reading streams segments. Memory follows a segment, or one document if that is longer.

Edge cases: null text is empty (only the end id); null doc_ids come first; repeated rows each have their own
place; a special token inside a text becomes its id, as in the library; an empty table gives empty files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapart.llm.common import scratch_path, slices, text_of

CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 18
#: Words remembered in each of two generations; what is still in use moves on to the newer one.
CACHE_WORDS = 450_000
SLICE_CHARS = 2_000_000
#: What a plain text must not hold: other white space, runs of white space, apostrophes, opened special tokens.
BREAKS = ["  ", " \n", "\n ", "\n\n", "'", "<|", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"]
#: Beyond ASCII, anything but letters of the Latin ranges.
BEYOND = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
#: Classes of bytes; those of a character beyond ASCII count as letters.
SPACE, BREAK, LETTER, DIGIT, SIGN = range(5)
CLASS = np.full(256, SIGN, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58], CLASS[32], CLASS[10] = DIGIT, SPACE, BREAK
SPACED = re.compile(rb" [A-Za-z\x80-\xff]+").fullmatch

LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))]
)
SEGMENT_SQL = "part int, segment int, start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, levels array<struct<chunks:binary,more:binary,ranks:binary>>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The library's encoding of whole texts; words of plain texts are encoded once and remembered.

    A text is plain if it has single spaces and line breaks between other characters, no apostrophe, no opening
    of a special token, and beyond ASCII only Latin letters. Its cut is then a matter of character classes, and
    many texts are cut at once on their bytes: a word begins where the class changes, a space belongs to what
    follows. Equal words of many texts are found by a hash and compared byte by byte (should two unlike words
    share a hash, the library takes these texts whole); remembered words are found by their bytes, and those
    not seen before go to the library, many in a row. Other texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mixed = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64)
        self.up, self.down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[bytes]) -> None:
        """Remember words: rows of words that are a space and letters at once, others one by one."""
        spaced, rest = [w for w in words if SPACED(w)], [w for w in words if not SPACED(w)]
        for at in range(0, len(spaced), 4000):
            row = spaced[at : at + 4000]
            ids = np.array(self.library.encode_batch_fast([b"".join(row).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.nonzero(self.opens[ids])[0] * 4).tolist()
            data = ids.tobytes()
            self.seen.update(zip(row, [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)], strict=True))
        for word, got in zip(rest, self.library.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.seen[word] = np.array(got.ids, "<u4").tobytes()

    def powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            odd = 0x9E3779B97F4A7C15
            for name, factor in (("up", odd), ("down", pow(odd, -1, 2**64))):
                steps = np.full(1 << size.bit_length(), factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:size], self.down[:size]

    def plain_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        kind = CLASS[data]
        begins = np.empty(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) | (kind[1:] == BREAK)
        begins[firsts] = True
        starts = np.nonzero(begins)[0]
        ends = np.append(starts[1:], len(data))
        up, down = self.powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.mixed[data] * up[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9FB21C651E98DF25)
        _, where, back = np.unique(h, return_index=True, return_inverse=True)
        if not same_words(data, starts, ends, where[back]):
            return [self.whole(t.decode()) for t in texts]
        names = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if len(self.seen) > CACHE_WORDS:
            self.older, self.seen = self.seen, {}
        seen, older = self.seen, self.older
        seen.update((name, older[name]) for name in names if name not in seen and name in older)
        if fresh := [name for name in names if name not in seen]:
            self.learn(fresh)
        found = [seen[name] for name in names]
        lengths = np.array([len(f) for f in found], np.int64) // 4
        offsets = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(found), "<u4")
        count = lengths[back]
        total = np.cumsum(count)
        ids = flat[np.repeat(offsets[back] - (total - count), count) + np.arange(total[-1])]
        return np.split(ids, (total - count)[np.searchsorted(starts, firsts[1:])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        easy = [k for k, t in enumerate(texts) if plain(t)]
        out: list = [None] * len(texts)
        if easy:
            for k, ids in zip(easy, self.plain_ids([texts[k].encode() for k in easy]), strict=True):
                out[k] = ids
        return [self.whole(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word (bytes from starts to ends, all of data in order) equals the word numbered like."""
    sizes = ends - starts
    if (sizes != sizes[like]).any():
        return False
    other = np.arange(len(data)) + np.repeat(starts[like] - starts, sizes)
    return bool((data[other] == data).all())


def plain(text: str) -> bool:
    """Whether the cut of a text follows from its bytes' classes (see Encoder)."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in BREAKS):
        return False
    return text.isascii() or not BEYOND.search(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray) -> list[dict]:
    """Levels of directly addressable codes of unsigned ids."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest) or not levels:
        more = rest >> np.uint64(CHUNK_BITS)
        bits = more > 0
        sums = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])[:-1:RANK_BLOCK] if len(bits) else np.zeros(0)
        levels.append({"chunks": (rest & np.uint64(255)).astype(np.uint8).tobytes(), "more": np.packbits(bits, bitorder="little").tobytes(), "ranks": sums.astype("<u4").tobytes()})
        rest = more[bits]
        if not len(rest):
            return levels
    return levels


def unpack(levels: list[dict]) -> np.ndarray:
    """All ids of a segment."""
    ids, at = np.zeros(0, np.uint64), None
    for depth, level in enumerate(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint64) << np.uint64(CHUNK_BITS * depth)
        if at is None:
            ids, at = chunks, np.arange(len(chunks))
        else:
            ids[at] |= chunks
        at = at[np.unpackbits(np.frombuffer(level["more"], np.uint8), bitorder="little", count=len(at)).astype(bool)]
    return ids


def access(levels: list[dict], place: int) -> int:
    """The id at one place of a segment, read without decoding any other."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["chunks"][place] << (CHUNK_BITS * depth)
        if not level["more"][place >> 3] >> (place & 7) & 1:
            break
        block = place // RANK_BLOCK
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        first = block * RANK_BLOCK // 8
        rank += int.from_bytes(level["more"][first : place >> 3], "little").bit_count()
        place = rank + (level["more"][place >> 3] & ((1 << (place & 7)) - 1)).bit_count()
    return value


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode docs (doc_id, text) and write the token file at path."""
    tokenizer = tokenizer or default_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        number, start, ids, held, rows = 0, 0, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number, start, ids, held, rows
            flat = np.concatenate(ids)
            row = {"part": part, "segment": number, "start": start, "n_tokens": len(flat), "doc_ids": [i for i, _ in rows], "doc_tokens": [n for _, n in rows], "levels": pack(flat)}
            number, start, ids, held, rows = number + 1, start + len(flat), [], 0, []
            return pa.RecordBatch.from_pylist([row], SEGMENT)

        end = np.array([end_id], "<u4")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                for key, got in zip(keys[a:b], own.encode(texts[a:b]), strict=True):
                    if held and held + len(got) >= segment_tokens:
                        yield flush()
                    ids += [got, end]
                    held += len(got) + 1
                    rows.append((key, len(got) + 1))
        if rows:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .withColumn("__tp_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "__tp_tie")
        .sortWithinPartitions("doc_id", "__tp_tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(segments, SEGMENT_SQL).write.parquet(f"{path}/segments")
    totals = read_segments(docs.sparkSession, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SQL).parquet(f"{path}/segments")


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start`` counted over the whole file; the parts table has one row for each partition."""
    parts = spark.read.schema("part int, base bigint").parquet(f"{path}/parts")
    return read_segments(spark, path).join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document of a token file."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = unpack(row["levels"]).astype("<u4")
                ends = np.cumsum([0, *row["doc_tokens"]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + row["start"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())], schema=out
                )

    return with_start(spark, path).select("start", "doc_ids", "doc_tokens", "levels").mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_tokens(spark: SparkSession, path: str, places: DataFrame, block: int = 1 << 18) -> DataFrame:
    """place, id for each row of places (a column ``place`` of positions in the whole file), by random access.

    Segments and places meet by the blocks of positions that a segment covers; places outside the file give
    no row. The places of one segment are looked up one by one in its codes.
    """
    found = with_start(spark, path).filter("n_tokens > 0")
    keyed = found.withColumn("__tp_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block))))
    wanted = places.select(F.col("place").cast("long").alias("place")).withColumn("__tp_block", F.floor(F.col("place") / block))
    met = keyed.join(wanted, "__tp_block").filter("place >= start AND place < start + n_tokens").groupBy("part", "segment").agg(
        F.first("start").alias("start"), F.first("levels").alias("levels"), F.collect_list("place").alias("places")
    )
    out = pa.schema([("place", pa.int64()), ("id", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                got = [access(row["levels"], p - row["start"]) for p in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array(got, pa.int64())], schema=out)

    return met.select("start", "levels", "places").mapInArrow(look, "place bigint, id bigint")


def op3_token_file(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)

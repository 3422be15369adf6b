"""Sharding by a two-pass external shuffle, in DataFrame expressions only.

Pass one scatters every record by seeded hashes: the shard follows the ``key`` law (the shard whose hash
with the id is largest, so one more shard takes rows only into itself), and within its shard a record goes
to one of so many buckets that a bucket fits in memory. Pass two collects each bucket, brings it into an
order that does not depend on arrival, and permutes it with the engine's seeded Fisher-Yates ``shuffle``, the
buckets of a task in a fixed order. Slots run through the buckets of a shard without gaps. ``write_shards``
writes the shards as files.

Scale: each text moves once. Bucket sizes are near equal because records are scattered by a hash of the
whole record, so equal texts and a hot source are spread out; a bucket holds about ``bucket_bytes``. Rows
repeated in full more than ``copies`` times, found by a narrow count, are counted, then written out again in
pieces and scattered by their number (rows with a map column, which cannot be counted, are not). One count of
bytes is sent to the driver, and one row for each bucket is used to number the slots.

Edge cases: null text counts as no bytes (size 1, crc of the empty string); null ids share one shard, as the
law demands, but not one bucket; repeated rows each get a slot of their own; input columns named like a
result are replaced; an empty table gives an empty result. A single record larger than a bucket is a bucket
by itself in effect, so memory follows the longest text; null ids and their copies share a shard.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapart.llm.common import blocks, scratch_path, text_of, written

SEED = 20240229
#: Rows repeated in full more often are spread over buckets; the most hashes of such rows, or buckets, that are broadcast.
COPIES = 1024
MOST_BROADCAST = 1 << 20
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def key_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of key; a further shard only wins rows for itself."""
    bids = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("bid"), F.lit(s).alias("shard")) for s in range(shards)]
    return F.greatest(*bids, *bids[:1])["shard"]


def record_size(text: Column) -> Column:
    return (F.octet_length(text) + 1).cast("long")


def spread_copies(placed: DataFrame, copies: int) -> DataFrame:
    """placed with ``__tp_copy``: 0, but for rows repeated in full more than ``copies`` times their number among their equals."""
    often = written(placed.groupBy("__tp_hash").agg(F.count("*").alias("n")).filter(F.col("n") > copies).select("__tp_hash"), "shard-copies")
    n = often.count()
    single = placed.withColumn("__tp_copy", F.lit(0).cast("long"))
    if not n:
        return single
    often = F.broadcast(often) if n <= MOST_BROADCAST else often
    counted = placed.join(often, "__tp_hash", "left_semi").groupBy(*[f"`{c}`" for c in placed.columns]).agg(F.count("*").alias("__tp_n"))
    parts = counted.withColumn("__tp_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__tp_n") - 1) / copies)))).repartition("__tp_hash", "__tp_part")
    numbers = F.sequence(F.col("__tp_part") * copies, F.least("__tp_n", (F.col("__tp_part") + 1) * copies) - 1)
    return single.join(often, "__tp_hash", "left_anti").unionByName(parts.withColumn("__tp_copy", F.explode(numbers)).drop("__tp_n", "__tp_part"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = 8 << 20, copies: int = COPIES, most_tasks: int = 1 << 16) -> DataFrame:
    """docs with RESULTS added. The same rows and parameters give the same slots, however docs is partitioned."""
    total = docs.agg(F.sum(record_size(text_of()))).first()[0] or 0
    buckets = blocks(total, bucket_bytes * shards)
    inputs = [c for c in docs.columns if c.lower() not in RESULTS]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name in inputs and not re.search("map<|variant", f.dataType.simpleString())]
    placed = docs.select(*[f"`{c}`" for c in inputs]).withColumn("__tp_hash", F.xxhash64(F.lit(seed + 2), *hashed))
    placed = spread_copies(placed, copies) if len(hashed) == len(inputs) else placed.withColumn("__tp_copy", F.lit(0).cast("long"))
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), "__tp_hash", "__tp_copy"), F.lit(buckets)).cast("int")
    placed = placed.withColumns({"__tp_shard": key_shard(F.col("doc_id"), shards, seed), "__tp_bucket": spread})
    scattered = placed.repartition(min(shards * buckets, most_tasks), "__tp_shard", "__tp_bucket")
    record = F.struct(*[F.col(f"`{c}`") for c in inputs])
    rows = F.collect_list(F.struct(F.col("__tp_hash").alias("o"), F.col("doc_id").alias("i"), record.alias("r")))
    bucket = scattered.groupBy("__tp_shard", "__tp_bucket").agg(rows.alias("__tp_rows"))
    before = Window.partitionBy("__tp_shard").orderBy("__tp_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__tp_shard", "__tp_bucket").agg(F.count("*").alias("__tp_n"))
    starts = counts.select("__tp_shard", "__tp_bucket", F.coalesce(F.sum("__tp_n").over(before), F.lit(0)).alias("__tp_start"))
    starts = F.broadcast(starts) if shards * buckets <= MOST_BROADCAST else starts
    # A task draws from one random stream, bucket after bucket; the sort fixes the buckets' order.
    ordered = bucket.sortWithinPartitions("__tp_shard", "__tp_bucket")
    permuted = F.shuffle(F.array_sort(F.col("__tp_rows"), by_order), F.lit(seed + 3))
    out = ordered.select("__tp_shard", "__tp_bucket", F.posexplode(permuted).alias("__tp_at", "__tp_row")).join(starts, ["__tp_shard", "__tp_bucket"])
    out = out.select(*[F.col(f"__tp_row.r.`{c}`").alias(c) for c in inputs], "__tp_shard", "__tp_start", "__tp_at")
    return out.select(
        *[f"`{c}`" for c in inputs],
        record_size(text_of()).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__tp_shard").alias("shard"),
        (F.col("__tp_start") + F.col("__tp_at")).cast("long").alias("slot"),
        key_shard(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )


def by_order(a: Column, b: Column) -> Column:
    """Order of records before the permutation: a seeded hash of the record, then its id."""
    less = (a["o"] < b["o"]) | ((a["o"] == b["o"]) & (F.coalesce(a["i"], F.lit(0)) < F.coalesce(b["i"], F.lit(0))))
    more = (a["o"] > b["o"]) | ((a["o"] == b["o"]) & (F.coalesce(a["i"], F.lit(0)) > F.coalesce(b["i"], F.lit(0))))
    return F.when(less, -1).when(more, 1).otherwise(0)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; every file holds whole buckets in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, like: DataFrame) -> DataFrame:
    """The written shards, with the columns of ``like``; also where nothing was written."""
    return spark.read.schema(like.schema).parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "shards")
    sharded = shard_documents(docs)
    write_shards(sharded, path)
    return read_shards(spark, path, sharded).select("doc_id", *RESULTS)

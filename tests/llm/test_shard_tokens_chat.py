import hashlib
import zlib

import random

import numpy as np
import pytest
from fixtures import awkward, empty, stored
from pyspark.sql import functions as F

from terrapart.llm import sharding
from terrapart.llm import chat_format as cf
from terrapart.llm import token_file as tf
from terrapart.llm import word_bpe as wb
from terrapart.llm.sharding import op2_sharding, read_shards, shard_documents, write_shards


def test_shards(spark, tmp_path):
    docs = awkward(spark)
    sharded = shard_documents(docs, bucket_bytes=2000)
    write_shards(sharded, str(tmp_path / "s"))
    got = read_shards(spark, str(tmp_path / "s"), sharded).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    shard_of = {}
    for r in got:
        text = (r.text or "").encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text) and r.law == "key"
        assert r.grown_shard in (r.shard, 8) and shard_of.setdefault(r.doc_id, r.shard) == r.shard
    again = {(r.doc_id, r.text, r.slot) for r in shard_documents(docs.repartition(7), bucket_bytes=2000).collect()}
    assert again == {(r.doc_id, r.text, r.slot) for r in got}
    assert shard_documents(docs, shards=9).filter("shard = 8").select("doc_id").distinct().count() == len({r.doc_id for r in got if r.grown_shard == 8} - {None}) + (any(r.doc_id is None and r.grown_shard == 8 for r in got))


def slots(sharded):
    return sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in sharded.select("doc_id", "text", "shard", "slot").collect())


def test_slots_do_not_depend_on_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 700) AS text")
    docs = docs.unionByName(docs.limit(40)).unionByName(docs.filter("doc_id = 5").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    settings = {"bucket_bytes": 300, "copies": 20, "most_tasks": 6}  # several buckets a task
    first = slots(shard_documents(docs.repartition(1), **settings))
    assert all(slots(shard_documents(docs.repartition(n), **settings)) == first for n in (3, 7))
    assert len(first) == docs.count()


def test_equal_rows_are_spread(spark):
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "'the same row' AS text").unionByName(spark.range(50).selectExpr("id AS doc_id", "concat('t', id) AS text"))
    got = shard_documents(docs, bucket_bytes=4096)
    assert sorted(r.slot for r in got.filter("doc_id = 7 AND text = 'the same row'").select("slot").collect())[-1] >= 99_999
    placed = sharding.spread_copies(docs.withColumn("__tp_hash", F.xxhash64("doc_id", "text")), 1024)
    assert placed.groupBy("__tp_hash", "__tp_copy").count().agg(F.max("count")).first()[0] == 1 and placed.count() == 100_050
    assert got.count() == 100_050 and got.groupBy("shard", "slot").count().filter("count > 1").count() == 0


def test_shards_are_shuffled(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' || id AS text")
    order = [r.doc_id for r in shard_documents(docs, shards=1).orderBy("slot").collect()]
    assert order != sorted(order) and sorted(order) == list(range(2000))


def test_empty_shards(spark, tmp_path):
    assert op2_sharding(spark, stored(empty(spark), tmp_path)).count() == 0


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


SPECIAL = ["", " ", "a  b", "x\n\ny", "it's <|endoftext|> gone", "tab\there", "日本 ok", "½ 12²", "x y", "a\x1cb", "don't", "end \n", "<|startoftext|>A<|endoftext|>"]


@pytest.mark.parametrize("segment", [50, 1 << 18])
def test_token_file(spark, tmp_path, segment):
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(SPECIAL, 100)), "doc_id long, text string"))
    path = str(tmp_path / "t")
    tf.write_tokens(docs, path, segment_tokens=segment)
    got = tf.read_documents(spark, path).collect()
    own, at, stream = library(tf.default_path()), 0, []
    encoded = {}
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        encoded.setdefault((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(ids)
    keys = [(r.doc_id is not None, r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys) and len(got) == docs.count()
    for r in sorted(got, key=lambda r: r.start):
        ids = encoded[r.doc_id, r.n_tokens, r.ids_crc32].pop()
        assert r.start == at
        at += len(ids)
        stream += ids
    places = spark.createDataFrame([(p,) for p in range(0, len(stream), 97)], "place long")
    assert all(stream[r.place] == r.id for r in tf.read_tokens(spark, path, places).collect())
    assert tf.read_tokens(spark, path, places).count() == len(range(0, len(stream), 97))


def unusual(rng, n=800):
    """Texts with every character up to U+024F and some beyond, and long words without white space."""
    out = [f"ab{chr(c)}cd {chr(c)} e{chr(c)}" for c in [*range(0x250), 0x300, 0x3B1, 0x431, 0x4E00, 0x3000, 0xFEFF, 0x1F600]]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x24F), 32, 10, 101, 39])) for _ in range(60)) for _ in range(n)]
    return [*out, "и ещё один пример текста " * 40, "日本語の文章" * 300, "x" * 5000, "<|endoftext|>" + chr(0) + "é"]


def test_encoders_equal_the_library(monkeypatch):
    texts = unusual(random.Random(2))
    own, plain = tf.Encoder(tf.default_path()), library(tf.default_path())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in own.encode(texts)] == want and [list(x) for x in own.encode(texts)] == want
    own.mixed = np.zeros(256, np.uint64)  # all words of one length share a hash
    assert [list(x) for x in own.encode(texts)] == want
    monkeypatch.setattr(wb, "CACHE_BYTES", 20_000)
    codec, plain = wb.Codec(wb.default_path()), library(wb.default_path())
    plain.no_truncation()
    for a in range(0, len(texts), 50):
        part = texts[a : a + 50]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_batch(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]
    pieces = [u[0] if isinstance(u, tuple) else u for u in [*codec.seen, *codec.older]]
    assert max(map(len, pieces)) <= wb.CACHE_CHARS and codec.held < 200_000


def test_codes_hold_any_width():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1, 7] * 300, np.uint64)
    levels = tf.pack(ids)
    assert (tf.unpack(levels) == ids).all() and all(tf.access(levels, i) == ids[i] for i in range(len(ids)))


def test_empty_token_file(spark, tmp_path):
    tf.write_tokens(empty(spark), str(tmp_path / "t"))
    assert tf.read_documents(spark, str(tmp_path / "t")).count() == 0


def test_word_bpe(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(SPECIAL, 100)], "doc_id long, text string"), allowMissingColumns=True)
    own = library(wb.default_path())
    done = wb.decode_documents(wb.encode_documents(docs)).select("doc_id", "text", "ids", "decoded").collect()
    for r in done:
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == own.decode(ids, skip_special_tokens=False)
    by_text = sorted((str(r.doc_id), len(r.ids), hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in done)
    assert sorted((str(r.doc_id), *r[1:]) for r in wb.digests(docs).collect()) == by_text
    assert wb.digests(empty(spark)).count() == 0


def test_speculation_is_exact():
    own = wb.codec(wb.default_path())
    words = sorted({a + b for a in ("aa", "hah", "thth", "x", "ing") for b in ("aaa", "hahaha", "er", "ington", "")})
    exact = dict(zip(words, own.merged(words), strict=True))
    assert all(np.frombuffer(ids, "<u4").tolist() == exact[w].tolist() for w, ids in own.encode_words(words).items())


TURNS = [
    (1, 0, "user", "hi <|end|> \\ <\\ [x"), (1, 1, "assistant", "yes\nno"), (1, 2, "assistant", ""), (1, 3, "assistant", "<|turn|>"), (1, 4, None, "sys"),
    (2, 5, "user", None), (2, None, "assistant", "é[/INST]</s>"), (2, 5, "user", None), (None, 1, "assistant", "lost"), (3, 0, "a<|text|>b", "\\\\<|next|>"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS blocks", "2 AS turns", "'x' AS formatted")
    found = cf.format_conversations(rows)
    done = found.withColumn("back", cf.read_back(found["formatted"])).withColumn("loss", cf.loss_text(found["formatted"], found["loss_mask"])).collect()
    want = {}
    for c, t, role, text in sorted(TURNS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(done) == len(want)
    for r in done:
        assert [tuple(t) for t in r.back] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert r.formatted.count("<|turn|>") == sum(i == 0 or want[r.conv_id][i - 1][0] != t[0] for i, t in enumerate(want[r.conv_id]))
        assert "</s>" not in r.formatted and "[/INST]" not in r.formatted
    assert cf.format_conversations(rows.limit(0)).count() == 0

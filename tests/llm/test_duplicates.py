import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, empty, stored
from pyspark.sql import functions as F

from terrapart.llm import line_dedup as ld
from terrapart.llm import repeats as rp
from terrapart.llm import simhash as sh
from terrapart.llm.components import components, forest


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(9000, 1000 + i) for i in range(1500)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    roots = forest(np.arange(len(nodes)), np.array([at[a] for a, _ in real]), np.array([at[b] for _, b in real]))
    assert got == {x: nodes[roots[i]] for x, i in at.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def all_within(fps, radius):
    parent = np.arange(len(fps))
    for i in range(len(fps)):
        j = np.nonzero(np.bitwise_count(fps ^ fps[i]) <= radius)[0]
        parent = forest(parent, np.full(len(j), i), j)
    return parent


@pytest.mark.parametrize("block", [40, 1 << 16])
def test_tiles_lose_no_link(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 5), replace=False))) for b in base for _ in range(3)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = sh.links(table, 3, block).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    a, b = np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links])
    assert (np.bitwise_count(fps[a] ^ fps[b]) >= 0).all() and len(links) <= 8 * len(fps)
    assert (forest(np.arange(len(fps)), a, b) == all_within(fps, 3)).all()


def test_simhash_documents(spark):
    docs = awkward(spark)
    got = sh.near_duplicates(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    marks = {(r.doc_id, r.text): sh.fingerprint(r.text or "") for r in texts}
    assert sorted(str((r.doc_id, r.fp % 2**64)) for r in got) == sorted(str((r.doc_id, marks[r.doc_id, r.text])) for r in texts)
    fps = np.array(sorted(set(marks.values())), np.uint64)
    roots = all_within(fps, 3)
    of = {int(f): int(roots[i]) for i, f in enumerate(fps)}
    least = {}
    for (i, _), f in marks.items():
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    assert all(r.component_id == least.get(of[r.fp % 2**64]) for r in got)
    assert sh.near_duplicates(empty(spark)).count() == 0


def brute_similar(texts, similar=0.8, shingle=5):
    """Root of each text, by the exact index of all pairs of word shingle sets."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} if len(words) >= shingle else {tuple(words)} - {()})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])]
    return forest(np.arange(len(sets)), np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))


def near_texts(rng, families=12, copies=12):
    """Families of texts with some words changed, added or cut off, from near copies to unlike ones."""
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 300))]
        for _ in range(copies):
            mine = list(base)
            for _ in range(int(len(mine) * rng.choice([0, 0.01, 0.02, 0.04, 0.08]))):
                mine[rng.randrange(len(mine))] = rng.choice(vocabulary)
            out.append(" ".join(mine[: len(mine) - rng.choice([0, 0, len(mine) // 10])]))
    return out


@pytest.mark.parametrize("block", [30, 1 << 16])
def test_similar_documents(spark, block):
    texts = [*near_texts(random.Random(21)), None, "", " \n", "one", "ONE", "one two", "a b c d e f", "A  b c d e\tf"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: r.component_id for r in sh.similar_documents(docs, block_rows=block).collect()}
    want = brute_similar(texts)
    empties = [i for i, t in enumerate(texts) if not (t or "").split()]
    assert all(got[i] == (empties[0] if i in empties else want[i]) for i in range(len(texts)))
    assert len(set(want.tolist())) < len(texts) - 60


def test_near_sets_hold_little_at_once():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, (1100, sh.WORDS)).astype(np.uint64)
    fps[550:] = fps[:550] ^ (np.uint64(1) << rng.integers(0, 63, (550, sh.WORDS)).astype(np.uint64))
    size = rng.integers(80, 130, len(fps))
    left, right = sh.Sets(size[:600], fps[:600]), sh.Sets(size[500:], fps[500:])
    tracemalloc.start()
    got = {(int(a), int(b) + 500) for i, j in sh.near_sets(left, right, 32, 0.8) for a, b in zip(i, j, strict=True)}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bits = np.bitwise_count(fps[:600, None] ^ fps[None, 500:]).sum(axis=2)
    fits = np.minimum(size[:600, None], size[None, 500:]) >= 0.8 * np.maximum(size[:600, None], size[None, 500:])
    assert got == {(int(a), int(b) + 500) for a, b in zip(*np.nonzero((bits <= 32) & fits), strict=True)}
    assert len(got) > 400 and most < 2_000_000


def test_large_family_is_confirmed_without_all_pairs(spark):
    rng = random.Random(2)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    texts = []
    for _ in range(1200):
        mine = list(base)
        mine[rng.randrange(120)] = str(rng.randrange(10**6))
        texts.append(" ".join(mine))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in sh.similar_documents(docs, block_rows=300).collect()} == {0}


def test_similar_documents_awkward(spark):
    docs = awkward(spark)
    got = sh.similar_documents(docs).collect()
    assert len(got) == docs.count() and all(r.doc_id is None or r.component_id <= r.doc_id for r in got)
    assert sh.similar_documents(empty(spark)).count() == 0


def brute_lines(texts):
    """Components of all distinct lines by the exact index, and the kept places."""
    first, order = {}, []
    for key, text in texts:
        for n, line in enumerate((text or "").split("\n")):
            x = ld.normalised(line)
            if x and x not in first:
                first[x] = (key, n)
                order.append(x)
    sets = [ld.shingle_set(x) for x in order]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = forest(np.arange(len(order)), np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))
    return {first[order[r]] for r in set(roots.tolist())}


def test_line_dedup(spark):
    rng = random.Random(7)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]) + str(rng.randint(0, 99)) for _ in range(25)) for _ in range(30)]
    texts = [(i, "\n".join([rng.choice(long).replace("a", "a", 1), rng.choice(long) + rng.choice(["", " x", " tail"]), "", "Short"])) for i in range(60)]
    texts += [(60, None), (61, ""), (62, " \n"), (63, "short"), (64, "日本 " * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("at", F.lit(2))
    kept = brute_lines(texts)
    got = {r.doc_id: list(r.kept) for r in ld.kept_lines(docs).collect()}
    assert {(d, n) for d, ns in got.items() for n in ns} == kept and len(got) == len(texts)
    done = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    for d, text in texts:
        lines = (text or "").split("\n")
        full = [n for n, x in enumerate(lines) if ld.normalised(x)]
        assert done[d] == (text if got[d] == full else "\n".join(lines[n] for n in got[d]))


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    done = ld.dedup_lines(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    lines = [ld.normalised(x) for r in done.dropDuplicates(["doc_id", "text"]).collect() for x in (r.text or "").split("\n")]
    assert max(Counter(x for x in lines if x).values()) == 1
    assert ld.dedup_lines(empty(spark)).count() == 0


def test_leaders_join_buckets(spark):
    lines = [(i, "the quick brown fox jumps over the lazy dog again and again " + "z" * i) for i in range(6)] + [(10, "something else entirely, with no relation to it")]
    rest = spark.createDataFrame([(1, i, i) for i, _ in lines], "band long, c long, id long")
    found = ld.led(rest, spark.createDataFrame(lines, "id long, line string"), 0.8).collect()
    assert {r.a for r in found} >= {1, 2, 3} and 10 not in {r.a for r in found}


def drifting(n=1000, words=30, step=1):
    """Lines each of which is like its next ones only."""
    rng = random.Random(4)
    text = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n * step + words)]
    return [" ".join(text[i * step : i * step + words]) for i in range(n)]


def candidate_components(lines):
    """Root of each line, from all pairs that share a band and have the index."""
    bands = [set(row) for row in ld.bands_of(lines).tolist()]
    sets = [ld.shingle_set(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return forest(np.arange(len(lines)), np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))


def test_drifting_lines_meet_all_candidates(spark):
    lines = drifting()
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r.doc_id for r in ld.kept_lines(docs).collect() if len(r.kept)}
    assert kept == set(candidate_components(lines).tolist())


def test_families_of_near_lines(spark):
    """25 families of 60 lines with one or two of 30 words changed: links of 0.8 or more, by exact comparison of all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    lines = []
    for _ in range(25):
        base = [word() for _ in range(30)]
        for _ in range(60):
            mine = list(base)
            for at in rng.sample(range(30), rng.randint(1, 2)):
                mine[at] = word()
            lines.append(" ".join(mine))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r.doc_id for r in ld.kept_lines(docs).collect() if len(r.kept)}
    sets = [ld.shingle_set(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i - i % 60, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    exact = forest(np.arange(len(lines)), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    assert kept == set(candidate_components(lines).tolist())
    merges = len(lines) - len(set(exact.tolist()))
    assert len(lines) - len(kept) >= 0.97 * merges > 500


def test_normalised_lines():
    rng = random.Random(4)
    for _ in range(2000):
        line = "".join(rng.choice("aÉß x  \t\r\x0b\x0c\u00a0\u3000\x1c") for _ in range(rng.randrange(12)))
        plain = line.lower().translate(dict.fromkeys(map(ord, "\t\x0b\x0c\r"), " "))
        assert ld.normalised(line) == " ".join(w for w in plain.split(" ") if w)


def test_bands_of_a_line_do_not_depend_on_other_lines():
    rng = random.Random(2)
    long = [" ".join(f"{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    lines = [*long, "a", "short line", *long[:3]]
    whole = ld.bands_of(lines)
    assert (whole[:20] == ld.bands_of(long)).all()
    for line, bands in zip(lines, whole, strict=True):
        assert (ld.bands_of([line])[0] == bands).all()


def test_shingles_in_common_are_exact():
    rng = random.Random(8)
    lines = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aé\x00ÿ", "aé\u0100", "a\ud800漢") for n in (1, 7, 8, 9, 15, 16, 17, 40, 300)]
    lines += [x[3:] + x[:5] for x in lines] + ["a" * 50, "ab" * 20]
    kinds = [ld.Shingled(x) for x in lines]
    for x, a in zip(lines, kinds, strict=True):
        assert a.size == len(ld.shingle_set(x))
        assert [a.common(b) for b in kinds] == [len(ld.shingle_set(x) & ld.shingle_set(y)) for y in lines]
    assert [x.numbers is None for x in map(ld.Shingled, ["a" * 8, "a" * 9, "é" * 9, "\u0100" * 9])] == [True, False, False, True]


def test_words_end_at_fixed_characters():
    assert ld.normalised("A\u00a0b\t c\u3000\x1cd ") == "a\u00a0b c\u3000\x1cd"


@pytest.mark.parametrize("block", [2000, 1 << 18])
def test_bucket_is_compared_in_full(spark, block):
    lines = drifting(200, 30)
    sets = [ld.shingle_set(x) for x in lines]
    c = [i if i % 3 else 0 for i in range(200)]  # every third line is in one large component
    rest = spark.createDataFrame([(b, c[i], i) for b in (1, 2) for i in range(200)], "band long, c long, id long")
    found = [(r.a, r.b) for r in ld.led(rest, spark.createDataFrame(list(enumerate(lines)), "id long, line string"), 0.8, block).collect()]
    want = [(i, j) for i in range(200) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert set(found) <= set(want)
    known = list(enumerate(c))
    roots = [forest(np.arange(200), *map(np.array, zip(*(known + links), strict=True))).tolist() for links in (found, want)]
    assert roots[0] == roots[1]


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_order():
    rng = random.Random(9)
    for n in [*range(1, 40), 200, 201, 202]:
        for letters in (1, 2, 3, 200):
            text = bytes(rng.randrange(letters) for _ in range(n))
            assert rp.suffix_order(np.frombuffer(text, np.uint8).astype(np.int64)).tolist() == sorted(range(n), key=lambda i: text[i:])
    wide = np.array([rng.choice([0, 2**30, 2**30 + 1]) for _ in range(50)])
    assert rp.suffix_order(wide).tolist() == sorted(range(50), key=lambda i: wide[i:].tolist())


@pytest.mark.parametrize(("gram", "hot", "chunk", "block"), [(7, 10**9, 10**6, 64), (7, 2, 700, 4), (1, 3, 300, 3), (4, 1, 500, 64)])
def test_repeats(spark, monkeypatch, gram, hot, chunk, block):
    monkeypatch.setattr(rp, "CHUNK_BYTES", chunk)
    rng = random.Random(gram)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 90))) for _ in range(12)]
    texts = [None, ""] + ["".join(rng.choice(base)[rng.randint(0, 10) :] for _ in range(rng.randint(0, 5))) for _ in range(120)]
    texts += [*texts[5:12], "a" * 100, "a" * 61, "ab" * 80, "abc" * 90, "x" + "bca" * 30, "abcdefgh" * 9, "é" * 70, "zyx" * 14]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("content", F.lit("clash")).repartition(3)
    digest = F.coalesce(F.sha2("left", 256), F.lower(F.hex("content")))
    got = rp.remove_repeats(docs, 20, gram, hot, block).select("doc_id", "n_bytes", "n_removed", "n_spans", digest).collect()
    want = brute_repeats([(t or "").encode() for t in texts], 20)
    assert len(got) == len(texts) and all(tuple(r[1:]) == want[r.doc_id] for r in got)


def test_repeats_awkward(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    want = Counter(zip([r.doc_id for r in rows], brute_repeats([(r.text or "").encode() for r in rows], 60), strict=True))
    digest = F.coalesce(F.sha2("left", 256), F.lower(F.hex("content")))
    got = rp.remove_repeats(docs, 60, 20).select("doc_id", "n_bytes", "n_removed", "n_spans", digest).collect()
    assert Counter((r[0], tuple(r[1:])) for r in got) == want
    assert rp.remove_repeats(empty(spark)).count() == 0


def test_repeats_catch_planted_passages(spark, tmp_path):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(3, 6))) for _ in range(n))
    passages = [words(80).encode()[:n].decode(errors="ignore") for n in (*range(396, 405), 430)] + [words(51 + i) for i in range(20)]
    clean = [words(rng.randint(0, 200)) for _ in range(30)]
    texts = [f"{words(30)}{left}{p}{right}{words(30)}" for p in passages for left, right in ("<>", "{}")] + clean
    assert all(len(p.split()) > 50 for p in passages)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    path = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path)
    got = [tuple(r[1:]) for r in sorted(rp.op9_repeats(spark, path).collect())]
    sizes = [len(p.encode()) for p in passages for _ in range(2)]
    assert [r[1] for r in got] == [n if n >= 400 else 0 for n in sizes] + [0] * len(clean)
    assert got == brute_repeats([t.encode() for t in texts], 400)

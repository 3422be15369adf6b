"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["n_words", "kept", "clean_text", "size", "shard", "slot", "law", "ids", "decoded", "secrets", "leaks", "fp", "component_id", "root", "node", "id", "at", "row", "h", "hub", "band", "line", "copies", "runs", "content", "lo", "hi", "p", "x", "count"]


def words(rng, n):
    vocabulary = ["the", "of", "and", "river", "Stone", "épée", "größe", "lamp", "under", "light,", "moving.", "tree", "cloud", "12", "x-ray", "it's"]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6)))
        out.append((i, text, "en", f"src{i % 3}", len(text)))
    near = out[3][1].split(" ")
    near[len(near) // 2] = "changed"
    out += [(n, " ".join(near), "en", "src0", 1), (n + 1, out[3][1], "en", "src1", 1), (n + 2, out[3][1], None, None, None)]
    out += [(n + 3, None, None, None, None), (n + 4, "", "en", "src0", 0), (n + 5, "\n \t\n", "en", "src0", 0), (None, "a lost row", "en", "src0", 1), (None, None, None, None, None)]
    out += [(n + 6, words(rng, 20_000), "en", "src0", 1), (n + 7, "one", "en", "src0", 3), (n + 8, "AAAA" * 300, "en", "src2", 1200)]
    out += [out[5], out[5], out[6]]
    return out


def awkward(spark, seed=1, n=40):
    docs = spark.createDataFrame(rows(seed, n), SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


def stored(docs, path):
    """docs as documents.parquet below path, for queries."""
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)

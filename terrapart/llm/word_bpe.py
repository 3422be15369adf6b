"""BPE encoding and decoding by speculation and verification, for vocabularies with word ends.

Encoding: a text is normalised and cut into words as the tokenizer file says; greedy longest match proposes
tokens for each word not seen before; all adjacent pairs of all proposals are then tested at once with
numpy: a pair is compatible if no merge across its border would have come before the merges that built its
two tokens. A proposal whose pairs are all compatible is the exact encoding; only failing words are merged
exactly. Decoding joins token strings with a space, as the library does for a file without a decoder.

Scale: one pass, no shuffle. Each Python worker remembers encodings of pieces of up to 64 characters between
white space, bounded in bytes, until it has been idle for some seconds; the cache only saves time. Texts are read whole.

Edge cases: null text is empty: no tokens, empty string; the file's special tokens inside a text become their
ids, as in the library; texts with characters outside the Latin range are normalised and cut by the library,
and their words are encoded like any other.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import give_back, lean, slices, text_of

#: Bytes of pieces and their ids remembered in each of two generations, and the longest piece remembered; what is
#: still in use moves on to the newer generation.
CACHE_BYTES = 48 << 20
CACHE_CHARS = 64
SLICE_CHARS = 2_000_000
#: A worker that has encoded nothing for so long lets go of its codec.
IDLE_SECONDS = 5.0
#: Words of a normalised Latin text: contractions, letters, single digits, other signs.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters on which Python's classes and the library's may differ, and control characters that do not stand for
#: themselves in byte characters; such texts take the library's own cut.
UNSAFE = re.compile("[^\\t-\\r\\x20-\\x7e\\x80-İĲ-žƀ-ǃǍ-ɀ]|[²³¹¼-¾İ]")
NEVER = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.library = Tokenizer.from_file(path)
        model = told["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = text
        self.decimal = [str(i) for i in range(size)]
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = a + b
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[made]
            self.merges[i, j] = (rank, k)
            self.rank[k], self.left[k], self.right[k] = rank, i, j
        keys = np.array([(i << 32) | j for i, j in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.chars = byte_chars()
        self.table = str.maketrans({chr(b): c for b, c in self.chars.items()})
        self.made = np.array([k for _, k in self.merges.values()], np.int64)
        self.inner_of, self.final_of = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in self.chars.values():
            self.inner_of[ord(c)], self.final_of[ord(c)] = self.vocab[c], self.vocab[c + self.suffix]
        self.inner, self.final = self.reachable()
        self.longest = max(map(len, self.final), default=1)
        self.reach: dict[str, int] = {}  # by first two characters, the length of the longest token inside words
        for text in self.inner:
            self.reach[text[:2]] = max(len(text), self.reach.get(text[:2], 1))
        self.seen: dict[str | tuple[str], bytes] = {}
        self.older: dict[str | tuple[str], bytes] = {}
        self.held = 0

    def reachable(self) -> tuple[dict[str, int], dict[str, int]]:
        """Tokens that are the exact encoding of their own string, within words and at their ends."""
        good = self.rank < 0
        built = np.nonzero(self.rank >= 0)[0]
        built = built[np.argsort(self.rank[built], kind="stable")]
        fits = self.compatible(self.left[built], self.right[built], self.rank[built])
        for k, fit in zip(built.tolist(), fits.tolist(), strict=True):
            good[k] = fit and good[self.left[k]] and good[self.right[k]]
        inner, final = {}, {}
        for text, i in self.vocab.items():
            if good[i]:
                if self.suffix and text.endswith(self.suffix) and text != self.suffix:
                    final[text[: -len(self.suffix)]] = i
                else:
                    inner[text] = i
        return inner, final

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = (x.astype(np.int64) << 32) | y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether the border between its tokens outlives all merges (those ranked under below)."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until = np.full(len(a), NEVER) if below is None else below.astype(np.int64)
        y_until = np.full(len(a), NEVER) if below is None else below.astype(np.int64) - 1
        while len(live):
            merge = self.pair_rank(x, y)
            crossed = (merge < x_until) & (merge <= y_until)
            ok[live[crossed]] = False
            undo_x = self.rank[x] > self.rank[y]
            more = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            x_until = np.where(undo_x, self.rank[x], x_until)
            y_until = np.where(undo_x, y_until, self.rank[y])
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            live, x, y, x_until, y_until = live[more], x[more], y[more], x_until[more], y_until[more]
        return ok

    def proposed(self, word: str) -> list[int] | None:
        """Greedy longest match; None if it gets stuck."""
        out, at, end = [], 0, len(word)
        inner, final, longest, reach = self.inner, self.final, self.longest, self.reach
        last = end - 1 if self.suffix else end
        while at < end:
            if end - at <= longest and (i := final.get(word[at:])) is not None:
                out.append(i)
                return out
            for stop in range(min(last, at + reach.get(word[at : at + 2], 1)), at, -1):
                if (i := inner.get(word[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break
            else:
                return None
        return out

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """Exact merging of many words at once: in each round every word merges its pair of lowest rank."""
        codes = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        tokens = self.inner_of[codes]
        tokens[ends - 1] = self.final_of[codes[ends - 1]]
        out: list = [None] * len(words)
        owner = np.arange(len(words))
        while len(owner):
            word = np.repeat(np.arange(len(owner)), sizes)
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(tokens), NEVER)
            inside = np.nonzero(word[1:] == word[:-1])[0]
            rank[inside] = self.pair_rank(tokens[inside], tokens[inside + 1])
            low = np.minimum.reduceat(rank, starts)
            ready = low >= NEVER
            for k in np.nonzero(ready)[0].tolist():
                out[owner[k]] = tokens[starts[k] : starts[k] + sizes[k]]
            hit = np.nonzero((rank == low[word]) & (rank < NEVER))[0]
            # In a row of one repeated token the pairs overlap; the leftmost goes first, then every second.
            first = np.concatenate([[True], np.diff(hit) > 1]) if len(hit) else np.zeros(0, bool)
            lead = hit[first][np.cumsum(first) - 1]
            hit = hit[(hit - lead) % 2 == 0]
            tokens = tokens.copy()
            tokens[hit] = self.made[rank[hit]]
            stay = ~ready[word]
            stay[hit + 1] = False
            sizes = np.bincount(word[stay], minlength=len(owner))[~ready]
            owner, tokens = owner[~ready], tokens[stay]
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32-bit) of distinct words in byte characters."""
        proposals = [self.proposed(w) for w in words]
        lengths = np.array([len(p) if p else 0 for p in proposals])
        flat = np.array([i for p in proposals if p for i in p], np.int64)
        failed = lengths == 0
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), lengths)
            inside = np.nonzero(owner[1:] == owner[:-1])[0]
            bad = ~self.compatible(flat[inside], flat[inside + 1])
            failed[owner[inside[bad]]] = True
        data, cuts = flat.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(lengths)])).tolist()
        found = {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}
        redo = [w for w, f in zip(words, failed.tolist(), strict=True) if f]
        if redo:
            found.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(redo, self.merged(redo), strict=True))
        return found

    def cut(self, text: str) -> list[str]:
        """Words of a safe text without special tokens, in byte characters or, if ASCII, as they are."""
        if text.isascii() and text[:-1].isalpha() and (text[-1] in ".," or text[-1].isalpha()):  # the common cases
            return [text.lower()] if text[-1].isalpha() else [text[:-1].lower(), text[-1]]
        if text.isascii():
            return WORDS.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return [w if w.isascii() else w.encode().decode("latin-1").translate(self.table) for w in WORDS.findall(text.lower())]

    def units(self, text: str) -> list[str] | list[tuple[str]]:
        """Pieces that are cut alike alone: what stands between white space, in lower case; of an unsafe text, its words (as tuples)."""
        if UNSAFE.search(text):
            return [(w,) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return text.lower().split() if text.isascii() else unicodedata.normalize("NFC", text).lower().split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        pieces = [self.splitter.split(t) if "<|" in t else [t] for t in texts]
        parts = [[np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.units(p) for p in row] for row in pieces]
        if self.held > CACHE_BYTES:
            self.older, self.seen, self.held = self.seen, {}, 0
        seen, older = self.seen, self.older
        missing = set(chain.from_iterable(p for row in parts for p in row if isinstance(p, list))).difference(seen)
        seen.update((u, older[u]) for u in missing if u in older)
        fresh = missing.difference(seen)
        if fresh:
            cuts = [(u, list(u) if isinstance(u, tuple) else self.cut(u)) for u in fresh]
            words = self.encode_words(list(set(chain.from_iterable(c for _, c in cuts))))
            seen.update((u, words[c[0]] if len(c) == 1 else b"".join([words[w] for w in c])) for u, c in cuts)
        get = seen.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in row]) for row in parts]
        for u in missing:
            if len(u[0] if isinstance(u, tuple) else u) > CACHE_CHARS:
                del seen[u]
            else:
                self.held += getsizeof(u) + getsizeof(seen[u])
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def forget() -> None:
    """Let go of the codecs; a task that still uses one keeps it until its end."""
    codec.cache_clear()
    give_back()


idle: threading.Timer | None = None


def rest(seconds: float | None = None) -> None:
    """Forget, unless a task begins within IDLE_SECONDS: an idle worker counts as its executor's memory for a minute."""
    global idle
    wake()
    idle = threading.Timer(IDLE_SECONDS if seconds is None else seconds, forget)
    idle.daemon = True
    idle.start()


def wake() -> None:
    if idle is not None:
        idle.cancel()


def encoded(text: Column, path: str) -> Column:
    """array<int> of token ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            rows = [ids for a, b in slices(texts) for ids in own.encode_batch(texts[a:b])]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int64)
            flat = np.frombuffer(b"".join(rows), "<i4")
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            yield pa.array([own.decode(ids.as_py() or []) for ids in batch], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids``."""
    return docs.withColumn("ids", encoded(text_of(), path or default_path()))


def decode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``decoded`` from ``ids``."""
    return docs.withColumn("decoded", decoded(F.col("ids"), path or default_path()))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass."""
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wake()
        own = codec(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                ids = [np.frombuffer(e, "<u4").tolist() for e in own.encode_batch(texts[a:b])]
                told = [sha(" ".join([own.decimal[i] for i in row])) for row in ids]
                back = [sha(own.decode(row)) for row in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, ids), pa.int64()), pa.array(told), pa.array(back)], names=names)
        rest()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(lean(rows), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

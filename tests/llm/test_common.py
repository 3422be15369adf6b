import re
import time
from pathlib import Path

import pytest

from terrapart.llm import word_bpe
from terrapart.llm.common import lean


def held_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_lean_gives_freed_memory_back():
    pins = []

    def rows(batches):
        held = [b"%1000d" % i for i in range(200_000)]
        pins.append(b"%1000d" % 0)  # stays above what is freed
        yield len(held)

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    before = held_mb()
    assert list(rows(iter(()))) == [200_000]
    assert held_mb() - before > 100
    assert list(lean(rows)(iter(()))) == [200_000]
    assert held_mb() - before < 50


def test_idle_codec_is_forgotten():
    path = word_bpe.default_path()
    word_bpe.codec.cache_clear()
    own = word_bpe.codec(path)
    want = own.encode_batch(["one two three"])
    word_bpe.rest(0.3)
    word_bpe.wake()
    time.sleep(0.6)
    assert word_bpe.codec(path) is own
    word_bpe.rest(0.1)
    time.sleep(0.5)
    assert word_bpe.codec.cache_info().currsize == 0
    assert own.encode_batch(["one two three"]) == want == word_bpe.codec(path).encode_batch(["one two three"])

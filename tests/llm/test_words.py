import re

import numpy as np
import pyarrow as pa

from pairloom.llm.words import Powers, mix, shingles_of, slices, words_of

TEXTS = ["", None, "one", " A b\tC\x0bd  e f ", "é É x\x85y z", "word " * 50, "a b c d", "a b c d e", "\n\n"]


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(text or "")) if w]


def test_words_are_those_of_the_pattern():
    known = {}
    for size in (1, 10, 1 << 20):
        for part in slices(pa.array(TEXTS), size):
            words = words_of(part, Powers())
            for i in range(part.count):
                own = range(words.begin[i], words.begin[i + 1])
                found = [lower(bytes(part.data[words.starts[j]:words.ends[j]]).decode()) for j in own]
                assert found == split(TEXTS[part.first + i])
                for w, j in zip(found, own):
                    assert known.setdefault(w, words.hashes[j]) == words.hashes[j]
    assert len(set(known.values())) == len(known)


def test_shingles_are_runs_of_five_words():
    known = {}
    for size in (1, 1 << 20):
        for part in slices(pa.array(TEXTS), size):
            found, begin = shingles_of(words_of(part, Powers()))
            for i in range(part.count):
                words = split(TEXTS[part.first + i])
                runs = [tuple(words[j:j + 5]) for j in range(len(words) - 4)] or ([tuple(words)] if words else [])
                own = found[begin[i]:begin[i + 1]]
                assert len(own) == len(runs)
                for run, h in zip(runs, own):
                    assert known.setdefault(run, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_cover_sliced_arrays():
    column = pa.array(["xx", "a b", None, "c"]).slice(1)
    parts = list(slices(column, 2))
    assert sum(p.count for p in parts) == 3
    assert b"".join(bytes(p.data) for p in parts) == b"a bc"
    assert list(slices(pa.array([], pa.string()))) == []


def test_mix_is_a_bijection_on_a_range():
    assert len(np.unique(mix(np.arange(100_000, dtype=np.uint64)))) == 100_000


def test_tasks_give_freed_memory_back():
    """Blocks too small for pages of their own, with one left behind them, stay with the process unless they are released."""
    from pairloom.llm.words import tidy

    def kept():
        return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon"))

    left = []

    def run(batches):
        blocks = [np.ones(8000) for _ in range(2000)]  # 128 MB
        left.append(np.ones(8000))
        yield len(blocks)

    before = kept()
    assert list(tidy(run)(iter(()))) == [2000]
    assert kept() - before < 64 << 10

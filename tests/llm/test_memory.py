"""What the Python side of a task holds at once, without Spark: arrays and objects are counted by tracemalloc."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from umbra.llm import near_dedup, packing, substring_dedup
from umbra.llm.queries import tokenizer_path


def texts(rows: int, words: int, seed: int = 3) -> list[str]:
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in row) for row in rng.integers(0, 5000, (rows, words)).tolist()]


def peak(run) -> tuple[list, float]:
    """What run() gives and the most MB that were held in it beyond those before."""
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_ids_are_laid_out_in_slices(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = texts(600, 1500)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": rows})
    pieces = lambda: sum(x.num_rows for x in packing._packed(tokenizer_path(), 1024, 2)(iter([batch])))
    pieces()  # opens the tokenizer
    n, mb = peak(pieces)
    assert n > 1200
    assert mb < 10 * batch.nbytes / 1e6


def test_sliced_ids_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "LAID_WORDS", 7)
    rows = ["", " ", "a b  c \n d", "\n", "one two three four five six seven eight nine ten", "x\0y z", "", "a\n\nb c", "end "]
    encoder = packing.Encoder.at(tokenizer_path())
    found = list(encoder.encode(pa.array(rows), 2))
    assert len(found) > 3 and [x[0] for x in found][1:] == [x[1] for x in found][:-1] and found[-1][1] == len(rows)
    ids = [every[x:y].tolist() for _, _, every, first in found for x, y in zip(first[:-1], first[1:])]
    assert ids == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in rows]


@pytest.mark.parametrize("hot_only", [False, None])
def test_passages_are_sent_in_slices(monkeypatch, hot_only):
    monkeypatch.setattr(substring_dedup, "SENT_BYTES", 100_000, raising=False)
    rows = texts(300, 1500)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": rows, "mark": pa.array([0] * 300, pa.int32())})
    shared = SimpleNamespace(value=(b"\xff" * (1 << (substring_dedup.TABLE_BITS - 3)), np.zeros(0, np.uint64)))
    found = list(substring_dedup._suspects(shared, hot_only)(iter([batch])))
    placed = {(d, s + k) for x in found for d, s, w in zip(*(x.column(c).to_pylist() for c in ("doc_id", "start", "windows"))) for k in range(w)}
    assert placed == {(d, s) for d in range(300) for s in range(1500 - 19)}
    if hot_only is None:
        return
    assert max(x.column("words").nbytes for x in found) < 300_000
    for x in found[::5]:
        for d, s, w, words in zip(*(x.column(c).to_pylist() for c in ("doc_id", "start", "windows", "words"))):
            assert words.decode() == " ".join(rows[d].split(" ")[s : s + w + 19])


def test_large_families_are_compared_in_strips():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 62, 40, dtype=np.uint64))
    sets = [base.copy() for _ in range(1500)]
    for i, s in enumerate(sets):
        s[i % 40] = np.uint64((1 << 63) + i)
    rows = pd.DataFrame({"node": np.arange(1500), "family": 1, "shingles": [np.sort(s).tobytes() for s in sets]})
    out, mb = peak(lambda: near_dedup._link(75)(rows))
    assert sorted(out["u"]) == list(range(1, 1500)) and set(out["v"]) == {0}
    assert mb < 30

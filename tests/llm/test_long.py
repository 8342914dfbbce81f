"""One text of 50 MB: the work in a task takes memory in proportion to the words it must keep, not to tables as long as the text."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from trackframe.llm import decontaminate, lines, minhash, quality, substrings, tokens

SIZE = 50_000_000


@pytest.fixture(scope="module")
def text():
    r = np.random.default_rng(0)
    words = [b"w%x" % x for x in r.integers(0, 1 << 30, 1 << 14)]
    part = b" ".join(words[i] for i in r.integers(0, len(words), 300_000))
    out = bytearray()
    while len(out) < SIZE:
        out += part + b"%d " % len(out)
    return bytes(out[:SIZE])


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / SIZE
    finally:
        tracemalloc.stop()


def batch(text, *names):
    return pa.record_batch([pa.array([7]) for _ in names] + [pa.array([text]).cast(pa.string())], names=[*names, "text"])


def test_sketches_and_sets(text):
    rows, times = peak(lambda: [x for b in minhash._sketches(5, 32, 4, 32)([batch(text, "doc_id")]) for x in b.to_pylist()])
    assert rows[0]["n"] > 100_000 and times < 12
    sets, times = peak(lambda: next(minhash._sets(5)([batch(text).select(["text"])])))
    assert sets.column("n")[0].as_py() == rows[0]["n"] and times < 12


def test_statistics(text):
    rows, times = peak(lambda: next(quality._stats([batch(text, "doc_id")])).to_pylist())
    assert np.isfinite(rows[0]["x"]).all() and times < 12


def test_windows_of_a_benchmark(text):
    item = text[SIZE // 2 : SIZE // 2 + 400]
    made = next(decontaminate._hashed_items(10)([pa.record_batch([pa.array([5]), pa.array([item.decode()])], names=["item_id", "text"])])).to_pylist()
    shared = SimpleNamespace(value=decontaminate.build_index([SimpleNamespace(**r) for r in made]))
    rows, times = peak(lambda: next(decontaminate._scan(shared)([batch(text, "doc_id", "tkey")])).to_pylist())
    assert rows[0]["items"] == [5] and rows[0]["n_hit"] > 10 and times < 12


@pytest.mark.parametrize("lines_of", [40, 0])
def test_lines(text, lines_of):
    if lines_of:  # a million lines; else a single one
        raw = np.frombuffer(text, dtype=np.uint8).copy()
        raw[::lines_of] = 10
        text = raw.tobytes()
    n, times = peak(lambda: sum(b.num_rows for b in lines._sketched(32)([batch(text, "doc_id")])))
    assert n > 1 and times < 12


def test_segments(text):
    blob = substrings._pack(np.array([1]), np.array([False]), np.array([len(text)], dtype=np.int64), np.frombuffer(text, dtype=np.uint8))
    runs, times = peak(lambda: substrings.Runs(blob, 50))
    assert len(runs.fp) > 1_000_000 and times < 12


@pytest.mark.parametrize("text", [" " * 50_000_000, "\n" * 50_000_000 + "x", "a" * 20_000_000], ids=["spaces", "line feeds", "letters"])
def test_tokens_of_one_long_run(text):
    ids = tokens.encoded(tokens.encoder(tokens.RANKS), text)
    n = sum(len(x) for x in (tokens.encoder(tokens.RANKS).decode_bytes(ids[i : i + 100_000].tolist()) for i in range(0, len(ids), 100_000)))
    assert n == len(text)


def test_tokens_are_the_encoders(monkeypatch):
    e, r = tokens.encoder(tokens.RANKS), random.Random(1)
    for text in (" " * 900_000, " \n" * 400_000 + "x", "ab" + "\n" * 40_000 + " c" + "\t" * 40_000):
        assert tokens.encoded(e, text).tolist() == e.encode_ordinary(text)
    monkeypatch.setattr(tokens, "_LONG_RUN", re.compile(tokens._LONG_RUN.pattern.replace("{%d,}" % tokens.LONG, "{5,}")))
    for _ in range(2000):
        text = "".join(r.choice([" " * r.randint(1, 12), "\n" * r.randint(1, 9), "ab", "'s", "7", "!?", "　", "\x1c", "é", ".\n"]) for _ in range(r.randint(0, 9)))
        assert tokens.encoded(e, text).tolist() == e.encode_ordinary(text)

"""Ordered line scans and blocks of one JSON document, against plain readers at every block size."""

import hashlib
import json
import os
import random

import pyarrow as pa
import pytest

from trackframe.sources import documents, files, streams


def rows_of_blocks(stream, block):
    return [{"stream": stream.name, "size": stream.size, "block": i, "start": i * block, "n": min(block, stream.size - i * block)} for i in range(-(-stream.size // block))]


def scanned(stream, block, max_length=1 << 20):
    """lines() without Spark: the same passes over the same rows."""
    before, out = 0, []
    for row in rows_of_blocks(stream, block):
        row = next(streams._counting(stream, row)).to_pylist()[0]
        if row["lines"]:
            for batch in streams._numbering(max_length)(stream, row | {"before": before}):
                out += batch.to_pylist()
        before += row["lines"]
    return out


def plain(raw, max_length=1 << 20):
    out, at = [], 0
    for i, line in enumerate(raw.splitlines(True) if b"\r" not in raw.replace(b"\r\n", b"") else [x + b"\n" for x in raw.split(b"\n")]):
        value = line[:-1] if line.endswith(b"\n") else line
        value = value[:-1] if value.endswith(b"\r") else value
        out.append((i, at, len(line), value if len(value) <= max_length else None))
        at += len(line)
    return out


TEXTS = [b"", b"\n", b"a", b"a\n", b"\n\n\na", b"one\r\ntwo\r\n\r\nfour", "é\nüü\r\n".encode() * 3, b"x" * 70 + b"\n" + b"y" * 9 + b"\n\n" + b"z" * 200]


@pytest.mark.parametrize("raw", TEXTS)
def test_lines_at_every_block_size(tmp_path, raw):
    p = tmp_path / "t.txt"
    p.write_bytes(raw)
    (s,) = streams.streams(str(p))
    for block in range(1, len(raw) + 2):
        got = [(r["ordinal"], r["offset"], r["n_bytes"], r["value"]) for r in scanned(s, block)]
        assert got == plain(raw), block
        for r in scanned(s, block):
            assert s.read(r["offset"], r["n_bytes"]).rstrip(b"\r\n") == r["value"]


def test_long_lines_are_cut_off(tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "MORE", 16)
    p = tmp_path / "t.txt"
    raw = b"ab\n" + b"x" * 500 + b"\ncd\n" + b"y" * 60
    p.write_bytes(raw)
    (s,) = streams.streams(str(p))
    for block in (1, 7, 64, 1000):
        got = scanned(s, block, max_length=50)
        assert [r["value"] for r in got] == [b"ab", None, b"cd", None] and [r["offset"] for r in got] == [0, 3, 504, 507]
        assert all(r["n_bytes"] in (None, n) for r, n in zip(got, (3, 501, 3, 60)))


def test_a_folder_is_one_stream(spark, tmp_path):
    raw = [b"a\nb\n", b"", b"c\r\n\nd"]
    for i, x in enumerate(raw):
        (tmp_path / f"part-{i}").write_bytes(x)
    (tmp_path / "_SUCCESS").write_bytes(b"no")
    whole = b"".join(raw)
    of = streams.streams(str(tmp_path), together=True)
    assert of[0].read(0, 100) == whole and of[0].read(2, 4) == whole[2:6]
    for block in (2, 3, 100):
        got = streams.lines(spark, of, block).orderBy("ordinal").collect()
        assert [(r.ordinal, r.offset, r.n_bytes, bytes(r.value)) for r in got] == plain(whole)
    single = streams.streams(str(tmp_path))
    got = streams.lines(spark, single, 2).orderBy("stream", "ordinal").collect()
    assert [(os.path.basename(r.stream), r.ordinal, bytes(r.value)) for r in got] == [("part-0", 0, b"a"), ("part-0", 1, b"b"), ("part-2", 0, b"c"), ("part-2", 1, b""), ("part-2", 2, b"d")]
    seen = streams.counted(spark, of, 3).orderBy("block").collect()
    assert [r.sha256 for r in seen] == [hashlib.sha256(whole[i : i + 3]).hexdigest() for i in range(0, len(whole), 3)]
    with pytest.raises(FileNotFoundError):
        streams.streams(str(tmp_path / "none"))


def test_tracking_keeps_the_order_of_lines(spark, tmp_path):
    line = '{"frame":%d,"timestamp":"00:00:00.00","period":1,"ball_data":null,"possession":null,"image_corners_projection":null,"player_data":[]}'
    text = "\n".join([line % 4, "", line % 2, line % 2, "{}", line % 9]) + "\n"
    p = tmp_path / "m.jsonl"
    p.write_text(text)
    for block in (5, 64, 4096):
        rows, rejects = files.read_tracking_ordered(spark, str(p), block=block)
        assert [(r.ordinal, r.frame) for r in rows.orderBy("ordinal").collect()] == [(0, 4), (2, 2), (3, 2), (5, 9)]
        assert [(r.ordinal, r.problem) for r in rejects.orderBy("ordinal").collect()] == [(1, "blank"), (4, "keys")]
    from trackframe.operators import sequences

    got = sequences.frame_order(rows, ["file"], "ordinal", "frame").orderBy("ordinal").collect()
    assert [r.frame_status for r in got] == ["first", "nonmonotonic", "duplicate", "ok"]


# --- one JSON document ---


def cut(stream, block, name=None):
    """elements() without Spark."""
    wanted = None if name is None else name.encode()
    t = [next(documents._summarising(stream, r)) for r in rows_of_blocks(stream, block)]
    if not t:
        return []
    at = documents._composed(pa.Table.from_batches(t)).to_pylist()
    open_, before, out = False, 0, []
    for row in at:
        found = next(documents._finding(wanted)(stream, row)).to_pylist()[0]
        own = found["found"][open_]
        if own:
            for batch in documents._cutting(wanted, 1 << 20)(stream, row | {"open": open_, "before": before}):
                out += batch.to_pylist()
        before += own
        open_ = open_ if found["open_after"] is None else found["open_after"]
    return out


STRINGS = ['"', "\\", '\\"', "],[", "}{", ",", "a\nb", "é😀", '\\\\"]', ""]


def value(r, depth=0):
    kind = r.randint(0, 6 if depth < 3 else 3)
    if kind < 4:
        return [r.choice(STRINGS), r.randint(-5, 10**6), None, r.random() < 0.5][kind]
    if kind < 6:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(STRINGS): value(r, depth + 1) for _ in range(r.randint(0, 3))}


def test_elements_at_every_block_size(tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MORE", 7)
    r = random.Random(4)
    p = tmp_path / "d.json"
    for k in range(25):
        items = [value(r) for _ in range(r.choice([0, 1, 2, 5]))]
        doc = items if k % 3 == 0 else {"x": value(r, 2), "other": [[1, 2], {"rows": [3]}], "rows": items, 'r"ows': [7], "z": {"rows": [1, 2]}, "after": [value(r)]}
        name = None if k % 3 == 0 else "rows"
        p.write_text(json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5))
        (s,) = streams.streams(str(p))
        for block in [*range(1, 12), 31, 64, s.size]:
            got = cut(s, block, name)
            assert [json.loads(x["value"]) for x in got] == items, (k, block)
            assert [x["ordinal"] for x in got] == list(range(len(items)))


def test_elements_of_a_document_in_parts(spark, tmp_path):
    items = [{"i": i, "t": STRINGS[i % len(STRINGS)] * (i % 4), "v": [i, [i]]} for i in range(3000)]
    raw = json.dumps({"n": len(items), "rows": items, "end": []}).encode()
    for i in range(3):
        (tmp_path / f"part-{i}").write_bytes(raw[i * len(raw) // 3 : (i + 1) * len(raw) // 3])
    of = streams.streams(str(tmp_path), together=True)
    got = documents.elements(spark, of, "rows", block=5000).orderBy("ordinal").collect()
    assert [json.loads(x.value) for x in got] == items and [x.ordinal for x in got] == list(range(len(items)))
    assert documents.elements(spark, of, "end", block=5000).count() == documents.elements(spark, of, "none", block=5000).count() == 0
    (tmp_path / "part-3").write_bytes(b'{"rows": [1, 2')
    with pytest.raises(Exception, match="ends inside"):
        documents.elements(spark, streams.streams(str(tmp_path / "part-3")), "rows").collect()

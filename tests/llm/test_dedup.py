"""Near-duplicates, lines, substrings: against brute force on small tables."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from trackframe.llm import common, lines, minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, 60))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "two words"), (7, "two words"), (9, "x " * 4000)]
    for i in range(60):
        ws = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        if r.random() < 0.3:
            ws = ws + ["\n"] + r.choice(base)
        rows.append((10 + i, " ".join(ws)))
    rows += [rows[20], rows[21], (None, rows[22][1]), (None, "only me")]  # repeated rows, no id
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n", F.lit(1)).withColumn("h", F.lit("x")).withColumn("id", F.lit(0)).withColumn("bucket", F.lit(2))  # clashing extra columns


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def shingles(text, k):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("rounds", [False, True])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, rounds):
    if rounds:  # as if every cluster were too large for one task
        monkeypatch.setattr(common, "CLUSTER", 1)
    rows = corpus()
    sets = [shingles(t, 2) for _, t in rows]
    group = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted((str(d), len(s), str(least.get(g)), d == least.get(g)) for (d, _), s, g in zip(rows, sets, group))
    got = minhash.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, []), shingle=2).count() == 0
    assert [r.kept for r in minhash.near_duplicates(frame(spark, [(1, None), (2, "")])).collect()] == [True, True]


def test_keep_one_leaves_one_row_of_a_class(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    rows = [(1, text), (1, text), (2, text), (3, text + "more"), (4, "other words that stand on their own feet"), (5, None), (6, "")]
    got = minhash.keep_one(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "text", "n", "h", "id", "bucket"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6]


def line_set(line, k=lines.SHINGLE):
    return {line[i : i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


def brute_lines(rows, last=lines.LAST):
    found = []
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                found.append((last if d is None else d, n, x.strip(" \t\n\x0b\x0c\r")))
    sets = [line_set(x) for *_, x in found]
    group = union(len(found), [(i, j) for i in range(len(found)) for j in range(i) if similar(sets[i], sets[j])])
    keep = {}
    for (d, n, _), g in zip(found, group):
        keep[g] = min((d, n), keep.get(g, (d, n)))
    gone = {(d, n) for (d, n, _), g in zip(found, group) if (d, n) != keep[g]}
    out = []
    for d, t in rows:
        own = last if d is None else d
        parts = (t or "").split("\n")
        kept = [x for n, x in enumerate(parts) if (own, n) not in gone]
        out.append((str(d), sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    r = random.Random(8)
    base = ["".join(r.choice("abcdefghijk éßдж语") for _ in range(r.randint(30, 120))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "ab\nab\n ab "), (5, "x" * 3000)]
    for i in range(40):
        parts = []
        for _ in range(r.randint(1, 6)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                x[r.randrange(len(x))] = r.choice("abcdefghijk")
            parts.append("".join(x))
        rows.append((10 + i, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("rounds", [False, True])
def test_line_dedup_is_that_of_brute_force(spark, tmp_path, monkeypatch, rounds):
    if rounds:
        monkeypatch.setattr(common, "CLUSTER", 1)
    rows = line_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = lines.op6_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_sha256) for r in got) == brute_lines(rows)


def test_lines_that_stay_are_not_shuffled_for_what_goes(spark, monkeypatch):
    """What the lines are joined with to find those that go has a row for each line of a class of two or more only."""
    said, own = {}, lines.save_seen

    def seen(df, name, *sums):
        said[name] = own(df, name, *sums)
        return said[name]

    monkeypatch.setattr(lines, "save_seen", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = "the same line of the same words as ever"
        docs = frame(spark, [(i, f"{text}\n{hashlib.md5(b'%d' % i).hexdigest()}") for i in range(60)] + [(99, text + "!")])
        gone = lines.duplicate_lines(docs)
        plan = gone._jdf.queryExecution().executedPlan().toString()
        rows = {r.doc_id: len(r.gone) for r in gone.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # of the marks, by document
    assert rows == dict.fromkeys([*range(1, 60), 99], 1) and said["keep"][1] == [2]



def test_line_stage_drops_emptied_documents_only(spark):
    rows = [(1, "a line that is long enough to count\nand another line of this document"), (2, "a line that is long enough to count"), (3, None), (4, "")]
    got = lines.drop_lines(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "text", "n", "h", "id", "bucket"]
    assert sorted(str(r.text) for r in got.collect()) == sorted([rows[0][1], "None", ""])
    assert lines.drop_lines(spark, frame(spark, []), "").count() == 0


def brute_repeats(rows, n):
    first = {}
    texts = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            first[w] = min(d, first.get(w, d))
    out = []
    for (d, t), (name, _) in zip(texts, rows):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(name), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def test_substring_dedup_is_that_of_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    passages = ["".join(r.choice("abcde é") for _ in range(r.randint(49, 140))) for _ in range(5)] + ["ab" * 80, "a" * 120]
    rows = [(1, None), (2, ""), (3, "a" * 49), (4, "a" * 50), (None, "a" * 60), (5, "\x00" * 80), (6, "\x00" * 70)]
    for i in range(40):
        rows.append((10 + i, "".join("".join(r.choice("abcde fghé") for _ in range(r.randint(0, 60))) + r.choice(passages)[r.randint(0, 30) :] for _ in range(r.randint(0, 4)))))
    rows += [rows[10], rows[11]]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for chunk, shard in ((substrings.CHUNK, substrings.SHARD), (700, 60)):
        monkeypatch.setattr(substrings, "PART", min(chunk, 64) if chunk == 700 else substrings.PART)
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        monkeypatch.setattr(substrings, "SHARD", shard)
        got = substrings.op3_suffix_array_dedup(spark, str(tmp_path)).collect()
        assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute_repeats(rows, 50)


def test_merged_shards_agree_with_one(monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    size = r.integers(50, 77, 60)
    text = r.choice(np.frombuffer(b"ab", dtype=np.uint8), int(size.sum()))
    least = r.integers(0, 40, 60)
    one = substrings.least_documents(text, size, least, 50)
    monkeypatch.setattr(substrings, "SHARD", 50)
    assert (substrings.least_documents(text, size, least, 50) == one).all()


def test_suffix_arrays_and_common_prefixes(monkeypatch):
    import numpy as np

    r = random.Random(2)
    for lanes in (4, 4096):
        monkeypatch.setattr(substrings, "LANES", lanes)
        for n in (1, 2, 7, 60, 400):
            for alphabet in (b"a", b"ab", b"ab\x00", bytes(range(256))):
                raw = bytes(r.choice(alphabet) for _ in range(n))
                text = np.frombuffer(raw, dtype=np.uint8)
                order = substrings.suffix_array(text, 50)
                cut = [raw[i : i + 50].ljust(58, b"\0")[:50] for i in order]
                assert sorted(order.tolist()) == list(range(n)) and cut == sorted(cut)
                want = [0] + [len(os.path.commonprefix([raw[a : a + 50], raw[b : b + 50]])) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]
                assert substrings.common_prefixes(text, order, 50).tolist() == want

"""The pipeline and the classifier against plain forms, empty tables, repeated rows, clashing columns, an independent reading of pages."""

import html.parser
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from trackframe.llm import ann, decontaminate, html_text, lines, minhash, mixing, quality, substrings, tokens

from .test_dedup import brute_lines, frame, similar, union

# --- classifier ---


def plain_statistics(text):
    """The statistics of quality.statistics by plain Python."""
    t = text or ""
    raw = t.encode()
    words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    n = len(words)
    share = lambda x, m: math.log((x + 0.5) / (max(m - x, 0) + 0.5) + 1e-3)
    kinds = Counter(words)
    chars = sum(1 for b in raw if b & 0xC0 != 0x80)
    count = lambda s: sum(raw.count(bytes([c])) for c in s)
    lower, upper, digits = (sum(a <= b <= z for b in raw) for a, z in ((97, 122), (65, 90), (48, 57)))
    letters = lower + upper + sum(b >= 0xC0 for b in raw)
    known = sum(chr(b).isalnum() for b in raw if b < 128) + count(b" \t\r\x0b\x0c\n.,#$%&*@^~|<>{}[]\\/=_+`") + sum(b >= 0x80 for b in raw)
    ls = raw.split(b"\n")
    length, squares = sum(map(len, words)), sum(len(w) ** 2 for w in words)
    entropy = sum(c * math.log(c) for c in kinds.values())
    return [
        math.log(n + 1), math.log((length + 5) / (n + 1)), math.log(squares / (n + 1) + 1), share(sum(a == b for a, b in zip(words, words[1:])), n), math.log((len(kinds) + 1) / (n + 1)), math.log(n + 1) - entropy / (n + 1),
        math.log((max(kinds.values(), default=0) + 1) / (n + 1)), math.log((len(set(zip(words, words[1:]))) + 1) / (n + 1)), share(sum(len(w) <= 3 for w in words), n), share(sum(w.endswith(b".") for w in words), n),
        share(sum(w[-1:] in b"#$%&*@^~|<>{}[]\\/=_+`" for w in words), n), share(upper, letters), share(digits, chars), share(count(b","), chars), share(count(b"#$%&*@^~"), chars),
        share(count(b"|<>{}[]\\/=_+`") + len(raw) - known, chars), math.log((len(ls) + 1) / (n + 1)), share(len(ls) - len(set(ls)), len(ls)),
    ]


def plain_scores(x, y, train):
    """Quadratic discriminant with the operator's shrinkage, by determinants and inverses."""
    cov = [np.cov(x[train & (y == k)].T, bias=True) for k in (0, 1)]
    n = [int((train & (y == k)).sum()) for k in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    out = []
    for k in (0, 1):
        c = (1 - quality.POOLED) * cov[k] / np.outer(scale, scale) + quality.POOLED * both / np.outer(scale, scale)
        c = (1 - quality.ROUND) * c + quality.ROUND * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        d = x / scale - x[train & (y == k)].mean(axis=0) / scale
        out.append(math.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    return 1 / (1 + np.exp(-np.clip((out[1] - out[0]) / math.sqrt(x.shape[1]), -60, 60)))


def quality_rows():
    r = random.Random(3)
    rows = []
    for i in range(160):
        good = i % 2
        ws = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) + ("." if good and r.random() < 0.2 else "" if good else r.choice(["###", "$", "&&", "9"])) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(ws) + ("\n" + " ".join(ws[:5])) * r.randint(0, 2), good))
    return rows + [(160, None, 1), (161, "", 0), (162, "É à\n\nx, y|z ab-c (d) 12", 1)]


def test_classifier_is_the_plain_one(spark):
    rows = quality_rows()
    x = np.array([plain_statistics(t) for _, t, _ in rows])
    assert np.allclose(quality.statistics([(t or "").encode() for _, t, _ in rows]), x, atol=1e-9)
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows])
    want = plain_scores(x, np.array([y for *_, y in rows]), train)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("quality", F.lit("clash")).repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels.unionByName(labels.limit(30))).collect()}  # repeated labels count once
    assert np.allclose([got[i] for i, *_ in rows], want, atol=1e-7)
    twice = quality.classify(docs.unionByName(docs), labels).collect()  # repeated documents train twice as much of each, and score alike
    assert len(twice) == 2 * len(rows) and len({(r.doc_id, round(r.score, 9)) for r in twice}) == len(rows)


def test_keep_accepted_keeps_columns_and_rows(spark, tmp_path):
    rows = quality_rows()
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t, _ in rows], "doc_id long, text string, y int, __id string")
    docs = docs.withColumnRenamed("__id", "score")
    kept = quality.keep_accepted(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    score = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in score.items() if s >= quality.CUT)


# --- pipeline ---


def shingles(text, k=5):
    ws = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    shared = [sentence(14) for _ in range(3)]
    item = " ".join(word() for _ in range(16))
    rows = []
    for i in range(40):
        parts = [sentence(r.randint(8, 20)) for _ in range(r.randint(2, 6))]
        if i % 4 == 0:
            parts.insert(r.randint(0, 2), r.choice(shared))
        if i % 9 == 0:
            parts.insert(1, "Then " + item + " so.")
        if i % 7 == 0:  # junk
            parts = [" ".join(word() + r.choice(["###", "$$", "&&&", "%"]) for _ in range(30))]
        rows.append((i, "\n".join(parts), "en", f"s{i % 3}", 0))
    rows += [(50, rows[1][1], "en", "s0", 0), (51, " ".join(rows[2][1].split() + ["more"]), "en", "s1", 0), (52, None, "en", None, 0), (53, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i, *_ in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    x = np.array([plain_statistics(t) for _, t, *_ in rows])
    y = np.array([int(i % 7 != 0) if i < 40 else -1 for i, *_ in rows])
    train = np.array([i < 40 and zlib.crc32(str(i).encode()) % 5 != 0 for i, *_ in rows])
    kept = [(i, t) for (i, t, *_), s in zip(rows, plain_scores(x, y, train)) if s >= quality.CUT]
    assert 0 < len(kept) < len(rows)
    # lines: as the brute force of the operator, then texts without the lines that go
    found = [(i, n, ln.strip(" \t\n\x0b\x0c\r")) for i, t in kept for n, ln in enumerate((t or "").split("\n")) if ln.strip(" \t\n\x0b\x0c\r")]
    grams = [{ln[a : a + lines.SHINGLE] for a in range(max(1, len(ln) - lines.SHINGLE + 1))} for *_, ln in found]
    group = union(len(found), [(a, b) for a in range(len(found)) for b in range(a) if similar(grams[a], grams[b])])
    first = {}
    for (i, n, _), g in zip(found, group):
        first[g] = min((i, n), first.get(g, (i, n)))
    gone = {(i, n) for (i, n, _), g in zip(found, group) if (i, n) != first[g]}
    assert gone and len(brute_lines(kept)) == len(kept)
    left = []
    for i, t in kept:
        own = [n for j, n, _ in found if j == i]
        if not own or any((i, n) not in gone for n in own):
            left.append((i, t if t is None else "\n".join(ln for n, ln in enumerate(t.split("\n")) if (i, n) not in gone)))
    sets = [shingles(t) for _, t in left]
    near = union(len(left), [(a, b) for a in range(len(left)) for b in range(a) if sets[a] and sets[b] and similar(sets[a], sets[b])])
    least = {}
    for (i, _), g in zip(left, near):
        least[g] = min(i, least.get(g, i))
    one = [(i, t) for (i, t), g in zip(left, near) if i == least[g]]
    clean = [(i, t) for i, t in one if f" {item} " not in f" {' '.join(re.findall(r'[a-z0-9]+', (t or '').lower()))} "]
    assert len(clean) < len(one) < len(left) < len(kept)
    assert set(got) == {i for i, _ in clean}
    sizes = {i: len(re.findall(r"[^ \t-\r]+", t or "")) for i, t in clean}
    assert all(0 <= got[i] <= 2 * sizes[i] for i in got) and abs(sum(got.values()) - 1.5 * sum(sizes.values())) <= 3


# --- empty tables, repeated rows, partitions ---


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for f in (substrings.op3_suffix_array_dedup, lines.op6_line_dedup, tokens.op10_token_counts, minhash.op2_minhash_near_dedup, mixing.op8_mixing):
        assert f(spark, str(tmp_path)).count() == 0, f


def test_search_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(6)
    rows = [(int(i), r.normal(size=16).tolist()) for i in range(3000)] + [(int(i), [1.0] * 16) for i in range(3000, 3400)]
    rows += rows[:50]  # repeated rows are candidates of their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append([tuple(x) for x in ann.search(df.repartition(n), F.col("id") % 100 == 0, rerank=30).orderBy("query_id", "rank").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] and len(found[0]) == 20 * 34  # a repeated query asks once


def test_taken_words_are_those_of_the_shards(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 40 + 1), f"s{i % 4}") for i in range(300)], "doc_id long, text string, source string")
    whole = {r.doc_id: r.taken for r in mixing.digest(df).collect()}
    real = mixing.tree
    monkeypatch.setattr(mixing, "tree", lambda q, n: real(q, n).withColumn("n", F.greatest(F.col("n") - 1, F.lit(0))))
    less = {r.doc_id: r.taken for r in mixing.digest(df).collect()}
    assert sum(less.values()) < sum(whole.values()) and all(less[i] <= whole[i] for i in whole)
    monkeypatch.setattr(mixing, "tree", real)
    rows = mixing.shard_rows(df, block=64, levels=1, texts=True).collect()
    assert all(len(x.text.split()) == x.n for x in rows) and sum(x.n for x in rows) == sum(whole.values())


def test_an_index_of_a_million_windows_is_small():
    n = 1 << 20
    words = b" ".join(b"%06x" % i for i in range(n // 8))
    r = np.random.default_rng(1)
    at = np.arange(n // 8, dtype=np.int64) * 7
    items = [SimpleNamespace(item_id=i, k=10, hashes=r.integers(0, 1 << 62, len(at)).astype(np.uint64).tobytes(), starts=at.tobytes(), ends=(at + 6).tobytes(), words=words) for i in range(8)]
    tracemalloc.start()
    index = decontaminate.build_index(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index["by"][10][0]) == n and peak < 200 << 20


# --- pages ---


class Reader(html.parser.HTMLParser):
    """Text blocks of the articles of a page, by the library's parser: another way than html_text's."""

    BLOCK = set("article p h1 h2 h3 h4 li div section ul ol table tr td blockquote pre header footer nav aside form".split())
    LEFT = set("script style nav aside form footer head button select textarea noscript template".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.blocks, self.piece = 0, [], [], []

    def flush(self):
        text = " ".join("".join(self.piece).split())
        self.piece = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        self.inside += tag == "article"
        names = set((dict(attrs).get("class") or "").split())
        if self.out and tag == self.out[-1] or self.inside and tag != "article" and (tag in self.LEFT or names & {"ad", "share", "comments", "related"}):
            self.out.append(tag)
        if tag == "br" and self.inside:
            self.piece.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        self.inside -= tag == "article"
        if self.out and tag == self.out[-1]:
            self.out.pop()

    def handle_data(self, data):
        if self.inside > 0 and not self.out:
            self.piece.append(data)


def test_texts_are_those_of_another_parser(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Reader()
        p.feed(r.html or "")
        p.flush()
        want[r.page_id] = "\n\n".join(p.blocks)
    got = html_text.op9_html_extraction(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

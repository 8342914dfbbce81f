"""Archives, decontamination, classifier, search, mixing, pages, token counts, pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackframe.llm import ann, decontaminate, html_text, mixing, quality, tokens, warc
from trackframe.llm.common import components, fresh

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 9), (20, 20)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.comp for r in components(chain).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- archives ---


def pages(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://www.a.com/x", big), (3, "https://b.org:8443/y?z=1#t", big), (9, None, big), (4, "http://a.com", "short"), (6, "http://a.com/", "short"), (7, "http://a.com/ n\n", None), (8, "", ""), (None, "http://c.d/", big), (3, "https://b.org:8443/y?z=1#t", big)]
    rows += [(100 + i, f"http://h{i % 7}.net/{i}", f"page {i} " * 40) for i in range(60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("digest", F.lit(1))


def test_archives_come_back_whole(spark, tmp_path):
    rows, df = pages(spark)
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op1_warc(spark, str(tmp_path)).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == b and j is not None]
        first = min(same) if len(b) >= 100 and same else i
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_lookup_finds_every_capture(spark):
    rows, df = pages(spark)
    folder = fresh(spark, "t")
    directory = warc.index(warc.write(df, folder), folder, block_lines=4)
    assert directory.count() > 10
    urls = [u for _, u, _ in rows if u] + ["http://nowhere.example/", "http://a.com"]
    got = warc.lookup(directory, folder, spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for u in set(urls):
        want = sorted(str(i) for i, x, _ in rows for _ in range(urls.count(u)) if x is not None and warc.url_key(x) == warc.url_key(u))
        assert sorted(str(r.page_id) for r in got if r.url == u) == want
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example,www)/a?b"


def test_archives_of_nothing(spark):
    folder = fresh(spark, "t")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    directory = warc.index(warc.write(none, folder), folder)
    assert warc.read(warc.captures_of(directory, folder, directory.selectExpr('first as key')), folder).count() == 0


# --- decontamination ---


def brute_hits(docs, items, n=10):
    windows = {}
    for i, t in items:
        ws = PLAIN.findall(lower(t))
        k = min(n, len(ws))
        for j in range(len(ws) - k + 1 if k else 0):
            windows.setdefault(tuple(ws[j : j + k]), set()).add(i)
    out = []
    for d, t in docs:
        ws = PLAIN.findall(lower(t))
        hit, found = set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(ws) - k + 1):
                if (w := tuple(ws[j : j + k])) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[w] - {None}
        out.append((d, len(ws), len(hit), sorted(found)))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_contamination_is_that_of_brute_force(spark, most):
    r = random.Random(1)
    v = [f"W{i}é" if i % 3 else f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(1, 25)))) for i in range(10)] + [(50, None), (51, "..."), (None, "zq zr zs"), (3, "again another one"), (3, "again another one")]
    docs = [(1, None), (2, ""), (3, "- - -"), (4, "xx zq, ZR; zs yy")]
    for i in range(50):
        parts = [r.choice([t for _, t in items if t]) if r.random() < 0.4 else " ".join(r.choice(v) for _ in range(9)) for _ in range(4)]
        docs.append((10 + i, "; ".join(parts).replace(" ", "\n", 2)))
    docs += [docs[10], (None, docs[11][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("item_id", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contamination(d, b, most=most).collect()
    assert sorted(str((x.doc_id, x.n_words, x.n_hit, list(x["items"]))) for x in got) == brute_hits(docs, items)
    assert all(sum(s.b - s.a for s in x.spans) == x.n_hit for x in got)
    clean = decontaminate.clean_documents(d, b, most=most)
    assert clean.columns == d.columns
    want = [x for x in brute_hits(docs, items) if eval(x)[2] == 0]
    assert clean.count() == len(want)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, b).count() == 0
    one = decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b).first()
    assert (one.n_words, one.n_hit, list(one["items"])) == (2, 0, [])


# --- classifier ---


def test_classifier_is_right_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op5_quality_classifier(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((held.quality == 1) & (held.predicted == 0)).sum() <= 2


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "x" * 100_000)], "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("y", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels).collect())


# --- search ---


def test_search_recall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32), (5060, [1.0] * 3), (5080, [None] + [1.0] * 31), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    got = ann.search(df, F.col("id") % 20 == 0).toPandas()
    assert len(got) == 150 * 20
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        assert np.allclose(g.score, s[g.vec_id]) and q not in set(g.vec_id) and (np.diff(g.score) <= 0).all()
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert hits / len(got) >= 0.95


def test_search_ties_and_few(spark):
    rows = [(i, [1.0, 0.0, 0.0, 1.0]) for i in range(40)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    assert [r.vec_id for r in few] == [1, 2]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") == 0).count() == 0


def test_copies_do_not_fill_the_list(spark):
    """Thousands of copies of one vector, which is at true rank 21 to 40 of the queries."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x[:60] = x[0] + 0.05 * rng.normal(size=(60, 64))  # the queries, which are no candidates of note
    x[:60] /= 10
    near = np.argsort(-(x @ x[0]))[24:26]
    x = np.concatenate([x, np.repeat(x[near].mean(axis=0)[None], 8000, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.col("id") < 60).toPandas()
    assert len(got) == 60 * 20
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & set(g.vec_id))
    assert hits / len(got) >= 0.95


def test_copies_and_repeated_rows(spark):
    """Copies give their smallest ids; no row of the query itself counts, and each repeated row does."""
    one, other = [1.0, 0.0, 0.0, 1.0], [0.9, 0.0, 0.0, 1.0]
    rows = [(7, one)] * 30 + [(i, one) for i in range(8, 13)] + [(i, other) for i in range(20, 900)] + [(900, other)] * 2
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 900).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7] * 20
    got = ann.search(spark.createDataFrame(rows[29:], "vec_id long, embedding array<float>"), F.col("id") == 7).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [8, 9, 10, 11, 12, *range(20, 35)]


# --- mixing ---


def brute_targets(sizes, weights=(5, 2, 1)):
    w = [weights[i % 3] for i in range(len(sizes))]
    t, total = [0.0] * len(sizes), 1.5 * sum(sizes)
    full = set()
    while True:
        left = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(2 * sizes[i] for i in full)
        for i in left:
            t[i] = rest * w[i] / sum(w[j] for j in left)
        over = [i for i in left if t[i] > 2 * sizes[i]]
        if not over:
            return t
        for i in over:
            full.add(i)
            t[i] = 2.0 * sizes[i]


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["a", "a", "a", "b", "c", "d", None, "Z"])) for i in range(400)]
    rows += [(900, None, "empty"), (901, "", "empty"), rows[0], (None, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("key", F.lit("k"))
    got = mixing.digest(df).collect()
    again = mixing.digest(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    for n, size, t in zip(names, sizes, brute_targets(sizes)):
        own = [x for x in got if x.source == n]
        assert {x.source_size for x in own} == {size}
        assert all(abs(x.target - t) < 1e-6 for x in own)
        assert abs(sum(x.taken for x in own) - t) <= 1 and all(x.taken <= 2 * x.size for x in own)
    assert mixing.digest(df.limit(0)).count() == 0


def test_tree_splits_quotas_exactly_and_fairly(spark):
    quotas = {"a": 900, "b": 90, "c": 11, "d": 0}
    q = spark.createDataFrame(list(quotas.items()), "key string, quota long")
    got = mixing.tree(q, 4).toPandas()
    assert got.groupby("key").n.sum().to_dict() == quotas and (got.n >= 0).all()
    per = got.groupby("shard").n.sum()
    assert len(per) == 16 and per.max() - per.min() <= 4
    assert abs(got[got.key == "a"].n.mean() - 900 / 16) < 1e-9


def test_draws_are_hypergeometric(spark):
    n, q, d = 200, 60, 100
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    x = u.select(mixing.draw(F.lit(n).cast("long"), F.lit(q).cast("long"), F.lit(d).cast("long"), F.col("u")).alias("x")).toPandas().x
    mean, var = d * q / n, d * q / n * (1 - q / n) * (n - d) / (n - 1)
    assert abs(x.mean() - mean) < 0.02 and abs(x.var() - var) < 0.1 * var


def test_shards_hold_the_mix(spark):
    rows = [(i, "w " * (i % 50), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    j = mixing.shard_rows(df, block=64, levels=3).toPandas()
    assert set(j.shard) == set(range(8))
    assert j.groupby(["key", "block"]).n.sum().max() <= 64 and (j.groupby(["key", "block"]).shard.nunique() == 1).all()
    want = {r.doc_id: r.taken for r in mixing.digest(df).collect() if r.taken}
    assert j.groupby("doc_id").n.sum().to_dict() == want
    assert all((g.position.diff().dropna() >= 0).all() for _, g in j.groupby("shard"))


# --- pages ---

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav-open"><header>Site</header>
<nav><ul><li>menu</ul></nav><!-- x <p>no</p> --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One&nbsp;two<br>three
 four</b><p>Five <i>six</i>&#33;<aside>side</aside><form>f</form><section id="comments"><p>me first</p></section><p>a < b</article><div class="cookie-notice">c</div><footer>&copy;</footer></body></html>"""


def test_article_blocks():
    assert html_text.blocks(ARTICLE) == (["Head & line", "One two three four", "Five six!", "a < b"], True)
    assert html_text.blocks("") == ([], False)
    assert html_text.blocks("<article><p>cut<p>off in a ta<a hre") == (["cut", "off in a ta"], True)
    assert html_text.blocks("<main><p>x</main><p>y") == (["x"], True)
    assert html_text.blocks("<p>plain<script>a</script> text") == (["plain text"], False)


def test_names_do_not_cost_the_article():
    for wrap in ('div class="content-sidebar-wrap"', "div class='has-sidebar'", "div id=no-nav", 'div class="sidebar"', "form", 'div class="modal" role="dialog"'):
        for inner in ("<article><p>Story</article>", "<main><p>Story</main>", '<div role="main" class="comments"><p>Story</div>'):
            assert html_text.blocks(f"<p>Top<{wrap}><p>Menu</p>{inner}</{wrap.split()[0]}>") == (["Story"], True), (wrap, inner)
    kept = '<h2 id="search">A</h2><section id="related-work"><p>B</section><p class="social-policy">C</p><p data-id="nav" data-role="ad" title="x id=nav">D</p>'
    assert html_text.blocks(f"<article>{kept}</article>") == (["A", "B", "C", "D"], True)
    assert html_text.blocks(f"<main><header><h1>T</h1></header>{kept}</main>") == (["T", "A", "B", "C", "D"], True)
    gone = '<div class="x share">s</div><div class="ad">a</div><div role="navigation">n</div><section id="comments"><article>first</article></section>'
    assert html_text.blocks(f"<article><p>A</p>{gone}</article>") == (["A"], True)
    # comments and teasers are not the page's article
    assert html_text.blocks('<p>Story<section id="comments"><article>first</article></section><aside><article>more</article></aside>') == (["Story"], False)
    assert html_text.blocks('<div class="cookie-notice">c</div><div class="nav-bar">n</div><div class="has-sidebar"><p>Story</div>') == (["Story"], False)


def test_common_subsequences():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(0, 14)), r.integers(0, 5, r.integers(0, 14))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (x == y))
        assert html_text.common(a, b).sum() == t[-1, -1]
    a, b = r.integers(0, 400, 2300), r.integers(0, 400, 2300)
    keep = html_text.common(a, b)
    it = iter(b.tolist())
    assert all(x in it for x in a[keep].tolist())


def test_differencing_deletes_shared_lines(spark):
    page = "<div><p>Top of site</p><p>Story {0} one</p><p>Story {0} two</p><p>Bottom of site</p></div>"
    rows = [(i, f"http://h.com/a/{i:03d}", page.format(i)) for i in range(40)] + [(90, None, page.format(90)), (91, "http://alone.org/", page.format(91)), (92, "http://h.com/m", ARTICLE), (93, "http://h.com/n", None), (94, "http://h.com/a/000", page.format(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("host", F.lit(3))
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Story {i} one\n\nStory {i} two" for i in range(1, 40))
    # copies are passed over
    assert got[0] == got[94] == "Story 0 one\n\nStory 0 two"
    assert got[91].startswith("Top of site") and got[90].startswith("Top of site") and got[93] == ""
    assert got[92].startswith("Head & line")
    assert html_text.extract(df.limit(0)).count() == 0


def test_neighbours_are_those_of_brute_force(spark):
    r = random.Random(4)
    rows = []
    for host in "abc":
        n = 0
        while n < 120:  # runs of up to a partition and more
            run, group = r.choice([1, 1, 2, 90]), r.randrange(3)
            rows += [(host, f"/{n + i:04d}", len(rows) + i, group, [group, group]) for i in range(run)]
            n += run
    df = spark.createDataFrame(rows, "host string, path string, page_id long, list long, hashes array<long>").repartition(3)
    got = html_text.neighbours(df, ["host", "path", "page_id"], ["host", "list"], "hashes").collect()
    assert len(got) == len(rows)
    place = {x[2]: i for i, x in enumerate(rows)}
    for x in got:
        i = place[x.page_id]
        before = [y[2] for y in rows[:i] if (y[0], y[3]) != (x.host, x.list)]
        after = [y[2] for y in rows[i:] if (y[0], y[3]) != (x.host, x.list)]
        assert (x.before and x.before.page_id) == (before[-1] if before else None)
        assert (x.after and x.after.page_id) == (after[0] if after else None)


def test_differencing_among_copies_and_marked_pages(spark):
    page = "<div><p>Top of site</p>{}<p>Story {} one</p>{}<p>Bottom of site</p></div>"
    rows = [(i, f"http://h.com/a/{i:04d}", page.format("", 1, "")) for i in range(300)] + [(400, "http://h.com/b", page.format("", 2, ""))]
    rows += [(500, "http://m.com/1", page.format("<article>", 5, "</article>")), (501, "http://m.com/2", page.format("", 5, "")), (502, "http://m.com/3", page.format("", 6, ""))]
    rows += [(600, "http://n.com/1", page.format("<article>", 7, "</article>")), (601, "http://n.com/2", page.format("", 7, ""))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert len(got) == len(rows)
    assert {got[i] for i in range(300)} == {"Story 1 one"} and got[400] == "Story 2 one"
    assert [got[i] for i in (500, 501, 502)] == ["Story 5 one", "Story 5 one", "Story 6 one"]
    assert got[600] == got[601] == "Story 7 one"


# --- token counts ---


def test_token_counts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (None, "no id"), (3, "again")] + [(10 + i, f"some text {i} " * (i % 9)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("x")).withColumn("n_tokens", F.lit(0))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    e = tokens.encoder(tokens.RANKS)
    want = sorted((str(i), len(e.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.op10_token_counts(spark, str(tmp_path)).collect()) == want
    folder = fresh(spark, "t")
    order = tokens.write(df, folder)
    files = order.groupBy("file").agg(F.sum("ids").alias("n"))
    for block in (1, 7, 100):
        counts = tokens.count(files, folder, block_ids=block) if block > 1 else tokens.count(files.where("n < 3000"), folder, block_ids=block)
        j = order.join(counts, ["file", "ordinal"])
        if block > 1:
            assert sorted((str(r.doc_id), r.n_tokens) for r in j.collect()) == want


def test_open_end_of_a_token_file(spark, tmp_path):
    np.array([1, 2, 9, 3, 9, 9, 4, 5, 6], dtype="<u2").tofile(f"{tmp_path}/a.bin")
    files = spark.createDataFrame([(f"{tmp_path}/a.bin", 9)], "file string, n long")
    for block in (1, 2, 4, 100):
        got = tokens.count(files, f"file://{tmp_path}", eod=9, block_ids=block).orderBy("ordinal").collect()
        assert [r.n_tokens for r in got] == [2, 1, 0, 3]


# --- pipeline ---


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.save(f(spark, before, sf), name)
        if name != "mixing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert 0 < out.count() <= before.count()
        else:
            assert out.count() == before.count()
        before = out
    hit = decontaminate.contamination(corpus_pipeline.table(spark, sf, "documents"), corpus_pipeline.table(spark, sf, "benchmark")).where("n_hit > 0")
    assert hit.join(before, "doc_id").count() == 0


def test_pages_are_parsed_in_linear_time():
    import time

    took = []
    for m in (20_000, 80_000):
        began = time.process_time()
        html_text.blocks_and_others("<article>" + "<div>" * m + "x</span>" * m)
        html_text.blocks_and_others("<article><div>" + "<span>" * m + "<p>a</p>" * m)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_embedded_text_is_content_of_a_marked_article_only():
    page = "<article><p>a<math><mi>x</mi></math> b</p><object>plain</object></article><p>after<svg><text>t</text></svg></p>"
    assert html_text.blocks_and_others(page) == (["ax b", "plain"], True, ["after"])


def test_no_pages_and_repeated_pages(spark):
    rows = [(1, "http://h/a", "<article><p>one</p></article>"), (1, "http://h/a", "<article><p>one</p></article>"), (2, "http://h/b", None), (None, None, "<p>two</p>"), (3, "http://h/c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages)
    assert sorted((str(x.page_id), x.text) for x in got.collect()) == [("1", "one"), ("1", "one"), ("2", ""), ("3", ""), ("None", "two")]
    assert html_text.extract(pages.limit(0)).count() == 0

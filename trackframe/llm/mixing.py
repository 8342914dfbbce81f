"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions are used. Each source's documents are put in a seeded random
order (by md5, so reruns agree) and its words are numbered along it. The words that the mix
takes of a source, its target, are cut into blocks of ``block`` words, and a second pass over
the source begins where the first has taken all of it. The number of blocks of each source is
its quota. A binary tree of output shards splits the quotas exactly: at each node the blocks
that go left are a multivariate-hypergeometric draw of the node's blocks, so any shard is a
fair sample of the whole mix and the sums are the quotas. A shard then takes the next
disjoint run of each source's permuted blocks and orders its blocks by a hash.

Running word numbers come from two levels: windows inside small hash ranges of a source
(4,096 at most for one source), and a prefix sum over the ranges' totals. So no task holds a
whole source, even one with a third of all rows. Trees and quotas are tables of (shard,
source); they hold no documents.

Defined cases: null and empty texts have size 0 and give nothing; a null source is a source
and sorts last; an empty table gives no rows; repeated rows are documents of their own
(equal rows are interchangeable); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, save, save_seen, table

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it, so that slices keep the text's lines.
SPACED_WORD = WORD + r"[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 2048
SEED = "mix"


def source_key(c: str = "source") -> Column:
    """Sorts by code point, null last, and never is null."""
    return F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(c)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source_size) to (key, source_size, target): words to take of each source.

    Weights repeat along the order of keys. Targets share ``share`` of all words; no target is
    over ``most`` times its source, and the excess goes to the others by weight. That
    is one water level L with target = min(cap, weight * L): sources fill in order of
    cap / weight, and the first that doesn't fill sets the level. One row a source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total * F.lit(float(share)) - before) / left)
    place = F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("key").alias("k"), F.col("level").alias("level"))
    level = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), place)).over(Window.partitionBy())["level"]
    return s.withColumn("l", level).select(
        "key", "source_size", F.when(F.col("l").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("l"))).alias("target")
    )


def numbered(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, source, key, size and the place of each document in its source's order; its text too, if asked for."""
    d = docs.select(
        F.col("doc_id"),
        *([F.col("text").cast("string").alias("text")] if texts else []),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("m"),
    ).withColumn("key", source_key())
    return d.withColumn("range", F.substring("m", 1, 3))


def offsets(d: DataFrame) -> DataFrame:
    ranges = d.groupBy("key", "range").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key", "range", F.coalesce(F.sum("words").over(up), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "range").orderBy("m", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, ["key", "range"])
        .withColumn("at", F.col("base") + F.col("own"))
        .drop("m", "range", "base", "own", "words")
    )


def unit(*parts) -> Column:
    """A uniform number in (0, 1) from a hash of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 52)


def tree(quotas: DataFrame, levels: int) -> DataFrame:
    """(key, quota) to (shard, key, n): an exact split of each quota among 2**levels shards.

    Rows are (node, source). At a node with N blocks the left child gets floor(N / 2) or, for
    odd N by a hash, one more. Sources are drawn one after the other along their order:
    source i gives its left child hypergeometric(blocks of sources from i on, own blocks,
    draws left). A draw depends on the earlier ones, so a node's quotas are one array (one
    entry a source) that a fold walks over.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("key", "quota"))).alias("qs")).select(F.lit(0).cast("long").alias("node"), "qs")
    for level in range(levels):
        seed = F.concat_ws("/", F.lit(level), F.col("node"))
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda s, q: s + q["quota"])
        node = node.withColumn("total", total).withColumn(
            "half", F.floor(F.col("total") / 2) + F.when((F.col("total") % 2 == 1) & (unit(F.lit("odd"), seed) < 0.5), 1).otherwise(0)
        )
        zero = F.struct(F.col("total").alias("n"), F.col("half").alias("d"), F.array().cast("array<struct<key:string,quota:bigint>>").alias("out"))

        def step(st, x):
            n, d, q = st["n"], st["d"], x["quota"]
            got = draw(n, q, d, unit(seed, x["key"]))
            one = F.transform(
                F.array(got),
                lambda g: F.struct((n - q).alias("n"), (d - g).alias("d"), F.concat(st["out"], F.array(F.struct(x["key"].alias("key"), g.alias("quota")))).alias("out")),
            )
            return one[0]

        node = node.withColumn("left", F.aggregate("qs", zero, step, lambda st: st["out"]))
        right = F.zip_with("qs", "left", lambda a, b: F.struct(a["key"].alias("key"), (a["quota"] - b["quota"]).alias("quota")))
        node = node.select(
            F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("qs")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("qs")))).alias("x")
        ).select("x.node", "x.qs")
        if level >= 10:
            node = node.repartition(max(1, 2**level // 1024), "node")
        node = save(node, "tree")
    return node.select(F.col("node").alias("shard"), F.explode("qs").alias("q")).select("shard", "q.key", F.col("q.quota").alias("n"))


def draw(n: Column, q: Column, d: Column, u: Column) -> Column:
    """How many of ``d`` draws without replacement from ``n`` things are among ``q`` marked ones:
    inversion of the hypergeometric distribution at u, its values taken from the mode up, then
    from the mode down.

    Relative weights are 1 at the mode and follow by the ratio of neighbours in both directions,
    as far as ten standard deviations and twelve more: what lies beyond is under 1e-20.
    """
    low, high = F.greatest(F.lit(0).cast("long"), d - (n - q)), F.least(d, q)
    mode = F.least(high, F.greatest(low, F.floor((d + 1).cast("double") * (q + 1) / (n + 2))))
    share = q / F.greatest(n, F.lit(1).cast("long"))
    reach = F.ceil(F.sqrt(d * share * (1 - share)) * 10 + 12)

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k"))

    def up(k):
        return (q - k + 1).cast("double") * (d - k + 1) / (k.cast("double") * (n - q - d + k))

    def down(k):
        return (k + 1).cast("double") * (n - q - d + k + 1) / ((q - k).cast("double") * (d - k))

    def walk(first, last, step, ratio, stop):
        """Sum of the weights from first to last, and how many steps leave the sum under stop."""
        steps = F.when((last - first) * step >= 0, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))

        def go(st, k):
            w = st["w"] * ratio(k)
            return F.struct(w.alias("w"), (st["s"] + w).alias("s"), (st["k"] + F.when(st["s"] + w < stop, 1).otherwise(0)).alias("k"))

        return F.aggregate(steps, zero, go)

    def at(p):
        m, a, b = p["m"], p["a"], p["b"]
        never = F.lit(0.0)
        sums = F.struct(walk(m + 1, b, 1, up, never)["s"].alias("u"), walk(m - 1, a, -1, down, never)["s"].alias("d"))

        def choose(s):
            v = u * (s["u"] + s["d"] + 1)
            higher = F.least(m + 1 + walk(m + 1, b, 1, up, v - 1)["k"], b)
            lower = F.greatest(m - 1 - walk(m - 1, a, -1, down, v - 1 - s["u"])["k"], a)
            return F.when(v < 1, m).when(v < s["u"] + 1, higher).otherwise(lower)

        return F.transform(F.array(sums), choose)[0]

    bounds = F.array(F.struct(mode.cast("long").alias("m"), F.greatest(low, mode - reach).cast("long").alias("a"), F.least(high, mode + reach).cast("long").alias("b")))
    return F.when(q == 0, F.lit(0).cast("long")).when(q == n, d).otherwise(F.transform(bounds, at)[0])


def mix(docs: DataFrame, block: int = BLOCK, levels: int | None = None, shard_words: int = 1 << 22, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, slices).

    documents: doc_id, source, key, size, source_size, target, at, pieces: one row per row of docs;
    pieces is an array of (block, start, n): words [start, start + n) of the document are part
    of that block of its source; with texts also the words, each with the white space after it. No two documents of a
    source with words have the same place ``at``.
    slices: the blocks' places: key, block, shard, position. A shard is written by joining
    pieces with slices on (key, block) and sorting by position.
    levels: depth of the tree; by default about ``shard_words`` words a shard.
    """
    d = save(offsets(save(numbered(docs, texts), "sizes")), "numbered")
    sizes = d.groupBy("key").agg(F.sum("size").alias("source_size"))
    t = save(targets(sizes).withColumn("take", F.round("target").cast("long")), "targets")
    quotas = t.select("key", F.ceil(F.col("take") / block).cast("long").alias("quota"))
    if levels is None:
        words = t.agg(F.sum("take")).first()[0] or 0
        levels = max(0, (-(-words // shard_words) - 1).bit_length())
    shards = tree(quotas, levels)
    up = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = shards.withColumn("first", F.coalesce(F.sum("n").over(up), F.lit(0)))
    slices = runs.where("n > 0").select("key", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block")).withColumn(
        "position", F.xxhash64(F.lit(SEED), "key", "block")
    )
    columns = ["doc_id", "source", "key", "size", "source_size", "target", "at"]
    return d.join(t, "key").select(*columns, pieces(block, texts).alias("pieces")), slices


def placed(documents: DataFrame, slices: DataFrame) -> DataFrame:
    """The rows of all shards: shard, position, key, block, at, doc_id, start, n and, if pieces have it, text."""
    slices, (n,) = save_seen(slices, "slices", F.count(F.lit(1)))
    if n <= BROADCAST_IDS:  # else both sides are shuffled
        slices = F.broadcast(slices)
    parts = documents.select("key", "at", "doc_id", F.explode("pieces").alias("p")).select("key", "at", "doc_id", "p.*")
    text = [c for c in parts.columns if c == "text"]
    return parts.join(slices, ["key", "block"]).select("shard", "position", "key", "block", "at", "doc_id", "start", "n", *text)


def ordered(rows: DataFrame) -> DataFrame:
    """Each shard's rows together, its blocks in the order of their positions (a seeded local shuffle), a block's documents together."""
    return rows.repartition("shard").sortWithinPartitions("shard", "position", "key", "block", "at", "start")


def shard_rows(docs: DataFrame, block: int = BLOCK, levels: int | None = None, shard_words: int = 1 << 22, texts: bool = False) -> DataFrame:
    """The mix as ordered shards."""
    return ordered(placed(*mix(docs, block, levels, shard_words, texts)))


def pieces(block: int, texts: bool = False) -> Column:
    """The parts of a document in the blocks of its source, for each pass over the source, with their texts if asked for.

    Word w of pass p is word p * source_size + at + w of the source's stream, of which the mix
    takes the first ``take`` words."""
    none = F.array().cast("array<struct<block:bigint,start:bigint,n:bigint>>")

    def one(p):
        a = p * F.col("source_size") + F.col("at")
        b = F.least(a + F.col("size"), F.col("take"))
        part = lambda k: F.struct(
            k.alias("block"),
            (F.greatest(a, k * block) - a).alias("start"),
            (F.least(b, (k + 1) * block) - F.greatest(a, k * block)).alias("n"),
        )
        blocks = F.sequence(F.floor(a / block).cast("long"), F.floor((b - 1) / block).cast("long"))
        return F.when(b > a, F.transform(blocks, part)).otherwise(none)

    parts = F.flatten(F.array(*[one(F.lit(p).cast("long")) for p in range(MOST)]))
    if not texts:
        return parts

    def cut(words):
        return F.transform(
            parts,
            lambda p: F.struct(
                p["block"].alias("block"), p["start"].alias("start"), p["n"].alias("n"),
                F.array_join(F.slice(words, (p["start"] + 1).cast("int"), p["n"].cast("int")), "").alias("text"),
            ),
        )

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPACED_WORD), F.lit(0))
    return F.transform(F.array(words), cut)[0]


def counted(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words of a document in the rows of all shards."""
    taken = rows.groupBy("key", "at").agg(F.sum("n").alias("taken")).select(F.col("key").alias("k"), F.col("at").alias("a"), "taken")
    place = F.when(F.col("size") > 0, F.col("at"))  # a document without words has no row, but may share its place with the next
    return documents.join(taken, (F.col("key") == F.col("k")) & (place == F.col("a")), "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def digest(docs: DataFrame) -> DataFrame:
    """counted() for the mix of docs."""
    documents, slices = mix(docs)
    return counted(documents, placed(documents, slices))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: writes the mix of what is left as ordered shards (a table "shards-..." in the shared folder, whose rows
    name the words of documents; shard_rows(texts=True) has their texts too); returns a row per document with the words that
    the shards hold of it."""
    documents, slices = mix(docs)
    rows = save(ordered(placed(documents, slices)), "shards")
    return counted(documents, rows)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || doc_id) AS m FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source),
w AS (
  SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (
  SELECT source, source_size,
    coalesce(least(cap::DOUBLE, w * (SELECT level FROM l WHERE cap > w * level ORDER BY cap / w, r LIMIT 1)), cap::DOUBLE) AS target FROM l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS take,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY m, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(a + size, take) - a) + greatest(0, least(source_size + a + size, take) - source_size - a))::BIGINT AS taken
FROM o
"""

"""Registered queries of constraints, references, digests and panel arrays, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arrays, constraints, digests
from . import fixtures as X
from .fixtures import sql, table
from .queries import query

# --- constraints ---


@query("""WITH w AS (SELECT o_custkey AS match_id, o_orderkey, o_orderkey % 40 AS origin, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal,
  CASE WHEN o_orderkey % 23 = 0 THEN 'same' ELSE o_orderkey::VARCHAR END AS window_id, CASE WHEN o_orderkey % 29 = 0 THEN 'other' WHEN o_orderkey % 23 = 0 THEN 'same' ELSE o_orderkey::VARCHAR END AS expected FROM orders),
r AS (SELECT *, lag(origin) OVER (PARTITION BY match_id ORDER BY ordinal) AS before, count(*) OVER (PARTITION BY match_id, window_id) AS n FROM w),
s AS (SELECT match_id, window_id, o_orderkey, unnest(['home', 'away']) AS scene FROM w),
v AS (SELECT match_id, window_id, 'order' AS problem FROM r WHERE origin <= before UNION ALL SELECT match_id, window_id, 'history' FROM r WHERE origin < 25
  UNION ALL SELECT match_id, window_id, 'repeated' FROM r WHERE n > 1 UNION ALL SELECT match_id, window_id, 'identity' FROM r WHERE window_id <> expected
  UNION ALL SELECT match_id, window_id, 'too_few_players' FROM s WHERE o_orderkey % 31 = 0 UNION ALL SELECT match_id, window_id, 'players_unordered' FROM s WHERE o_orderkey % 37 = 0 AND o_orderkey % 31 <> 0
  UNION ALL SELECT match_id, window_id, 'bad_digest' FROM s WHERE o_orderkey % 41 = 0 AND scene = 'away'
  UNION ALL SELECT match_id, window_id, 'scenes' FROM (SELECT match_id, window_id, count(*) AS n, bool_or(o_orderkey % 43 = 0) AS lost FROM w GROUP BY ALL) WHERE n > 1 OR lost)
SELECT problem, count(*) AS n FROM v GROUP BY problem""")
def membership_problems(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    w = o.select(
        F.col("o_custkey").alias("match_id"), k.alias("key"), F.lit(1).alias("period"), (k % 40).alias("origin_index"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("ordinal"),
        F.when(k % 23 == 0, "same").otherwise(k.cast("string")).alias("window_id"), F.when(k % 29 == 0, "other").when(k % 23 == 0, "same").otherwise(k.cast("string")).alias("expected_window_id"),
    )
    key = F.col("key")
    s = w.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2))))
    players = F.sequence(F.lit(1).cast("long"), F.when(key % 31 == 0, 6).otherwise(11).cast("long"))
    s = s.select(
        "match_id", "window_id", F.col("side").alias("scene_ordinal"), F.when(F.col("side") == 1, "home").when(key % 43 == 0, "home").otherwise("away").alias("scene_id"),
        F.when((key % 37 == 0) & (key % 31 != 0), F.reverse(players)).otherwise(players).alias("player_ids"),
        F.when((key % 41 == 0) & (F.col("side") == 2), F.lit("none")).otherwise(F.sha2(key.cast("string"), 256)).alias("truth_sha256"),
    )
    found = constraints.membership(w.drop("key"), s)
    return found.groupBy("problem").agg(F.count("*").alias("n"))


@query("""SELECT ps_part AS part_id, n, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS status FROM (
  SELECT p_partkey AS ps_part, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)""")
def exact_lookup(spark, d):
    requests = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"))
    return constraints.exact_lookup(requests, rows, ["part_id"])


@query("SELECT l_orderkey AS window_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <> 2")
def rows_per_window(spark, d):
    return constraints.rows_per_window(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("window_id")), ["window_id"])


@query("SELECT l_orderkey AS window_id, 'row_arithmetic' AS problem FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 2 * count(DISTINCT l_linestatus)")
def membership_counts(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("window_id")).agg(F.count("*").alias("n_rows"), F.count_distinct("l_linestatus").alias("windows"))
    return constraints.membership_counts(c, ["window_id"], "windows", "n_rows")


@query("""SELECT l_suppkey AS unit, 'l_returnflag' AS grouping, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1
UNION ALL SELECT l_suppkey, 'fold', count(DISTINCT l_suppkey % 3) FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey % 3) > 1""")
def disjoint_groupings(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_returnflag", (F.col("l_suppkey") % 3).alias("fold"))
    return constraints.disjoint(a, "unit", ["l_returnflag", "fold"])


@query("""WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'Bad Id' WHEN s_suppkey % 10 = 1 THEN 'family.1' ELSE 'object.' || (s_suppkey - s_suppkey % 4) END AS id, 'family.' || (s_nationkey % 12) AS family_id FROM supplier),
a AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'family.2' ELSE 'alias.' || (c_custkey - c_custkey % 3) END AS alias, 'object.' || (c_custkey % 16) AS canonical_id FROM customer),
f AS (SELECT DISTINCT 'family.' || (n_nationkey % 10) AS f FROM nation), i AS (SELECT DISTINCT id FROM e),
v AS (SELECT id, 'not_canonical' AS problem FROM e WHERE id = 'Bad Id' UNION ALL SELECT id, 'unknown_family' FROM e WHERE family_id NOT IN (SELECT f FROM f) UNION ALL SELECT id, 'is_family' FROM e WHERE id IN (SELECT f FROM f)
  UNION ALL SELECT id, 'duplicate' FROM e WHERE id IN (SELECT id FROM e GROUP BY id HAVING count(*) > 1) UNION ALL SELECT alias, 'alias_target_missing' FROM a WHERE canonical_id NOT IN (SELECT id FROM i)
  UNION ALL SELECT alias, 'alias_repeated' FROM a WHERE alias IN (SELECT alias FROM a GROUP BY alias HAVING count(*) > 1) UNION ALL SELECT alias, 'alias_is_id' FROM a WHERE alias IN (SELECT id FROM i) UNION ALL SELECT alias, 'alias_is_family' FROM a WHERE alias IN (SELECT f FROM f))
SELECT id, problem, count(*) AS n FROM v GROUP BY ALL""")
def registry_conflicts(spark, d):
    k = F.col("s_suppkey")
    e = table(spark, d, "supplier").select(F.when(k % 9 == 0, "Bad Id").when(k % 10 == 1, "family.1").otherwise(F.concat(F.lit("object."), (k - k % 4).cast("string"))).alias("id"), F.concat(F.lit("family."), (F.col("s_nationkey") % 12).cast("string")).alias("family_id"))
    c = F.col("c_custkey")
    a = table(spark, d, "customer").select(F.when(c % 6 == 0, "family.2").otherwise(F.concat(F.lit("alias."), (c - c % 3).cast("string"))).alias("alias"), F.concat(F.lit("object."), (c % 16).cast("string")).alias("canonical_id"))
    f = table(spark, d, "nation").select(F.concat(F.lit("family."), (F.col("n_nationkey") % 10).cast("string")).alias("family_id"))
    return constraints.registry(e, f, a).groupBy("id", "problem").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_orderkey - o_orderkey % 2 AS t, CASE o_orderkey % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'extend' ELSE 'strange' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'kept' ELSE 'new' END AS consequence, o_orderkey % 7 = 0 AS blank, o_orderkey % 11 = 0 AS bare FROM orders)
SELECT t AS transition_id, problem, count(*) AS n FROM (SELECT t, 'repeated' AS problem FROM g WHERE t IN (SELECT t FROM g GROUP BY t HAVING count(*) > 1) UNION ALL SELECT t, 'no_evidence' FROM g WHERE bare UNION ALL SELECT t, 'no_rationale' FROM g WHERE blank
  UNION ALL SELECT t, 'consequence' FROM g WHERE NOT coalesce((kind = 'replace' AND consequence = 'new') OR (kind = 'extend' AND consequence = 'kept'), false)) GROUP BY ALL""")
def transition_problems(spark, d):
    k = F.col("o_orderkey")
    g = table(spark, d, "orders").select(
        (k - k % 2).alias("transition_id"), F.when(k % 3 == 0, "replace").when(k % 3 == 1, "extend").otherwise("strange").alias("kind"), F.when(k % 5 == 0, "kept").otherwise("new").alias("consequence"),
        F.when(k % 7 == 0, "  ").otherwise("why").alias("explanation"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("evidence"),
    )
    return constraints.transitions(g, {"replace": "new", "extend": "kept"}).groupBy("transition_id", "problem").agg(F.count("*").alias("n"))


@query("""SELECT run_id, problem FROM (SELECT o_orderkey AS run_id, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'bad_lock' END, CASE WHEN o_orderkey % 5 = 1 THEN 'bad_checkpoint' END, CASE WHEN o_orderkey % 7 = 0 THEN 'metric_names' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'metric_values' END, CASE WHEN o_orderstatus = 'F' THEN 'invalidated_with_metrics' END, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'evaluator_state' END, CASE WHEN o_custkey % 4 = 0 OR o_custkey % 4 = 3 THEN 'population_scope' END], lambda c: c IS NOT NULL)) AS problem FROM orders)""")
def result_problems(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sha = F.sha2(k.cast("string"), 256)
    m = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    r = table(spark, d, "orders").select(
        k.alias("run_id"), F.when(k % 3 == 0, F.upper(F.lit("x"))).otherwise(sha).alias("lock_sha256"), F.when(k % 5 == 0, None).when(k % 5 == 1, "short").otherwise(sha).alias("checkpoint_sha256"),
        F.when(k % 13 == 0, "unheard").otherwise("ade").alias("evaluator_id"), F.when(k % 17 == 0, "raw").otherwise("physical").alias("evaluator_state"),
        F.when(c % 4 == 0, "odd").otherwise("lomo").alias("split_protocol_id"), F.when(c % 4 == 3, "public").otherwise("cross").alias("population"), F.when(F.col("o_orderstatus") == "F", "invalidated").otherwise("recorded").alias("validity"),
        F.array(m(F.lit("a"), F.when(k % 11 == 0, F.lit(float("inf"))).otherwise(1.0)), m(F.when(k % 7 == 0, "a").otherwise("b"), F.lit(2.0))).alias("metrics"),
    )
    return constraints.results(r, {"lomo": ["cross"]}, {"ade": "physical"})


@query("""WITH m AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity - CASE WHEN l_orderkey % 50 = 0 THEN 100 ELSE 0 END END AS v, l_linenumber AS w FROM lineitem),
p AS (SELECT id, count(*) AS n, sum(w) AS w, count(*) - count(v) AS nulls, avg(v) AS mean, count(CASE WHEN v < 0 THEN 1 END) AS neg FROM m GROUP BY id)
SELECT id AS document_id, unnest(list_filter([CASE WHEN id % 9 = 0 THEN 'match_count' END, CASE WHEN id % 10 = 0 THEN 'window_count' END, CASE WHEN neg > 0 THEN 'negative_value' END, CASE WHEN nulls > 0 AND mean IS NOT NULL OR nulls = 0 AND id % 8 = 0 THEN 'population_value' END], lambda c: c IS NOT NULL)) AS problem FROM p""")
def result_document_problems(spark, d):
    k = F.col("l_orderkey")
    m = table(spark, d, "lineitem").select(k.alias("document_id"), F.when(F.col("l_linenumber") != 6, F.col("l_quantity") - F.when(k % 50 == 0, 100).otherwise(0)).alias("value"), F.col("l_linenumber").alias("windows"))
    i = F.col("document_id")
    docs = m.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("windows").alias("w"), F.avg("value").alias("v"))
    docs = docs.select("document_id", (F.col("v") + F.when(i % 8 == 0, 1).otherwise(0)).alias("population_value"), (F.col("n") + F.when(i % 9 == 0, 1).otherwise(0)).alias("n_matches"), (F.col("w") + F.when(i % 10 == 0, 1).otherwise(0)).alias("n_windows"))
    return constraints.result_documents(docs, m, 1e-9)


@query("SELECT p_name, 'forbidden_feature' AS problem FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 10 = 0")
def forbidden_features(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 6 == 0, "Future-Truth.").otherwise("past."), F.when(k % 10 == 0, "target").otherwise(k.cast("string")))
    p = table(spark, d, "part").select("p_name", name.alias("n"))
    denied = ["past_target", "future_truth_target"]
    bad = constraints.forbidden_features(p, "n", denied, ["future_truth"]).distinct()
    return p.join(bad, "n").select("p_name", "problem")


@query("""SELECT l_orderkey AS payload, array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(f, x))), ',') AS missing, array_to_string(list_sort(list_filter(f, lambda x: x NOT IN ('A', 'N', 'R'))), ',') AS unexpected
FROM (SELECT l_orderkey, list(DISTINCT CASE WHEN l_linenumber = 7 THEN 'Z' ELSE l_returnflag END) AS f FROM lineitem GROUP BY l_orderkey) WHERE NOT (len(f) = 3 AND list_contains(f, 'A') AND list_contains(f, 'N') AND list_contains(f, 'R'))""")
def payload_fields(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("payload"), F.when(F.col("l_linenumber") == 7, "Z").otherwise(F.col("l_returnflag")).alias("field"))
    out = constraints.payload_fields(f, "payload", "field", ["A", "N", "R"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "unexpected")})


@query("SELECT event_id, 'invalid_v' AS problem FROM events WHERE event_id % 6 = 0 OR event_id % 10 = 0 OR value > 100 AND event_id % 3 <> 0")
def invalid_metrics(spark, d):
    i = F.col("event_id")
    v = F.when(i % 6 == 0, F.lit(None)).when(i % 10 == 0, F.lit(float("nan"))).when((F.col("value") > 100) & (i % 3 != 0), -F.col("value")).otherwise(F.col("value"))
    return constraints.invalid_metrics(table(spark, d, "events").select("event_id", v.alias("v")), ["event_id"], ["v"])


@query("SELECT DISTINCT l_suppkey AS match_id, 'unknown_id' AS problem FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def unknown_ids(spark, d):
    known = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("match_id"))
    return constraints.unknown_ids(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("match_id")), known, "match_id")


@query("""SELECT path, unnest(list_filter([CASE WHEN path LIKE '%.PT' THEN 'forbidden_suffix' END, CASE WHEN NOT regexp_matches(path, '^[a-z0-9_/.]+$') THEN 'bad_name' END], lambda c: c IS NOT NULL)) AS problem
FROM (SELECT 'data/' || replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE '#' END) || CASE WHEN c_custkey % 5 = 0 THEN '.PT' ELSE '.json' END AS path FROM customer)""")
def naming_problems(spark, d):
    k = F.col("c_custkey")
    path = F.concat(F.lit("data/"), F.replace("c_name", F.lit("#"), F.when(k % 2 == 0, "_").otherwise("#")), F.when(k % 5 == 0, ".PT").otherwise(".json"))
    return constraints.naming(table(spark, d, "customer").select(path.alias("path")), "path", r"^[a-z0-9_/.]+$", [".pt"])


@query("""WITH p AS (SELECT n_nationkey AS ordinal, CASE WHEN n_nationkey < 12 THEN 'train' WHEN n_nationkey = 20 THEN 'other' WHEN n_nationkey < 18 THEN 'validation' ELSE 'evaluation' END AS role, CASE WHEN n_nationkey = 5 THEN 1 ELSE n_nationkey * 2 END AS match_id FROM nation),
k AS (SELECT *, CASE role WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'evaluation' THEN 3 ELSE 0 END AS r FROM p), l AS (SELECT *, lag(r) OVER (ORDER BY ordinal) AS lr, lag(match_id) OVER (ORDER BY ordinal) AS lm FROM k)
SELECT ordinal, role, match_id, unnest(list_filter([CASE WHEN r = 0 THEN 'unknown_role' END, CASE WHEN r < lr OR r = lr AND match_id <= lm THEN 'order' END], lambda c: c IS NOT NULL)) AS problem FROM l""")
def protocol_order(spark, d):
    k = F.col("n_nationkey")
    p = table(spark, d, "nation").select(k.alias("ordinal"), F.when(k < 12, "train").when(k == 20, "other").when(k < 18, "validation").otherwise("evaluation").alias("role"), F.when(k == 5, 1).otherwise(k * 2).alias("match_id"))
    return constraints.protocol_order(p, "ordinal", "role", "match_id", ["train", "validation", "evaluation"])


@query("SELECT user_id, ts, event_id FROM events ORDER BY user_id, ts, event_id LIMIT 64")
def first_windows(spark, d):
    return constraints.first_rows(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], 64)


@query("""SELECT user_id, count(*) AS n, count(*) > 41 AS more FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 42 GROUP BY ALL""")
def bounded_prefix(spark, d):
    p = constraints.bounded_prefix(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 41)
    return p.groupBy("user_id").agg(F.count("*").alias("n"), (F.count("*") > 41).alias("more"))


_REFS = """r AS (SELECT sha256((l_partkey % 500)::VARCHAR) AS sha256 FROM lineitem), f AS (SELECT sha256((p_partkey % 300)::VARCHAR) AS sha256 FROM part WHERE p_size > 10),
j AS (SELECT r.sha256, r.n AS n_references, coalesce(f.n, 0) AS n_matches FROM (SELECT sha256, count(*) AS n FROM r GROUP BY ALL) r LEFT JOIN (SELECT sha256, count(*) AS n FROM f GROUP BY ALL) f USING (sha256))"""


def _resolved(spark, d):
    refs = table(spark, d, "lineitem").select(F.sha2((F.col("l_partkey") % 500).cast("string"), 256).alias("sha256"))
    files = table(spark, d, "part").where("p_size > 10").select(F.sha2((F.col("p_partkey") % 300).cast("string"), 256).alias("sha256"))
    return constraints.resolved(refs, files)


@query("WITH " + _REFS + " SELECT *, CASE n_matches WHEN 0 THEN 'zero_matches' WHEN 1 THEN 'one_match' ELSE 'multiple_matches' END AS status FROM j")
def evidence_resolution(spark, d):
    return _resolved(spark, d)


@query("WITH " + _REFS + ' SELECT sum(n_references)::BIGINT AS "references", count(*) AS digests, count(CASE WHEN n_matches = 0 THEN 1 END) AS zero_matches, count(CASE WHEN n_matches = 1 THEN 1 END) AS one_match, count(CASE WHEN n_matches > 1 THEN 1 END) AS multiple_matches FROM j')
def evidence_counts(spark, d):
    return constraints.resolution_counts(_resolved(spark, d))


@query("SELECT p_partkey AS record FROM part WHERE p_size % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def catalogue_scan(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(k.alias("record"), F.sha2(k.cast("string"), 256).alias("sha256"), F.when(F.col("p_size") % 3 == 0, "draft").otherwise("released").alias("status"),
        F.when(k % 4 == 0, F.lit("other")).otherwise(k.cast("string")).cast("binary").alias("content"))
    want = table(spark, d, "lineitem").select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"))
    return constraints.catalogue_matches(c, want, "sha256", "status", ["released"], "content").select("record")


@query("""WITH a AS (SELECT l_suppkey AS match_id, count(*) AS n, sum(l_linenumber) AS s FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY ALL), b AS (SELECT l_suppkey AS match_id, count(*) AS n, sum(CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 1 THEN 2 ELSE l_linenumber END) AS s FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY ALL)
SELECT match_id, CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' WHEN a.n = b.n AND a.s = b.s THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b USING (match_id)""")
def summaries_reconciled(spark, d):
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    li = table(spark, d, "lineitem").select(k.alias("match_id"), n.alias("x"), F.when((k % 5 == 0) & (n == 1), 2).otherwise(n).alias("y"))
    a = li.where("match_id % 7 <> 0").groupBy("match_id").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    b = li.where("match_id % 9 <> 0").groupBy("match_id").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    return constraints.reconciled(a, b, ["match_id"], ["n", "s"])


@query("""WITH e AS (SELECT sha256((p_partkey - p_partkey % 2)::VARCHAR) AS sha256, list_sort(list('e' || p_partkey)) AS x FROM part WHERE p_size < 30 GROUP BY ALL), a AS (SELECT sha256(p_partkey::VARCHAR) AS sha256, list_sort(list('a' || p_partkey)) AS x FROM part WHERE p_size > 20 GROUP BY ALL)
SELECT sha256, array_to_string(e.x, ',') AS expected_names, array_to_string(a.x, ',') AS actual_names, CASE WHEN a.x IS NULL THEN 'missing' WHEN e.x IS NULL THEN 'unexpected' WHEN len(e.x) > 1 OR len(a.x) > 1 THEN 'ambiguous' END AS problem FROM e FULL JOIN a USING (sha256)""")
def files_by_digest(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    e = p.where("p_size < 30").select(F.sha2((k - k % 2).cast("string"), 256).alias("sha256"), F.concat(F.lit("e"), k.cast("string")).alias("name"))
    a = p.where("p_size > 20").select(F.sha2(k.cast("string"), 256).alias("sha256"), F.concat(F.lit("a"), k.cast("string")).alias("name"))
    return constraints.inventory_by_digest(e, a, "sha256", "name").withColumns({c: F.array_join(c, ",") for c in ("expected_names", "actual_names")})


@query("""WITH a AS (SELECT event_id AS ordinal, user_id FROM events WHERE event_id % 10 <> 0), b AS (SELECT event_id AS ordinal, CASE WHEN event_id % 25 = 1 THEN 0 ELSE user_id END AS user_id FROM events WHERE event_id % 15 <> 0)
SELECT ordinal, CASE WHEN b.ordinal IS NULL THEN 'missing_right' WHEN a.ordinal IS NULL THEN 'missing_left' ELSE 'identity' END AS problem FROM (SELECT ordinal, user_id AS ua, true AS l FROM a) x FULL JOIN (SELECT ordinal, user_id AS ub, true AS r FROM b) y USING (ordinal) LEFT JOIN a USING (ordinal) LEFT JOIN b USING (ordinal)
WHERE l IS NULL OR r IS NULL OR ua <> ub""")
def ordered_coscan(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), "user_id")
    right = e.where("ordinal % 15 <> 0").withColumn("user_id", F.when(F.col("ordinal") % 25 == 1, 0).otherwise(F.col("user_id")))
    return constraints.ordered_pairs(e.where("ordinal % 10 <> 0"), right, "ordinal", ["user_id"])


@query("""SELECT count(*) AS n_files, count(DISTINCT s_name) AS n_unique, count(CASE WHEN s_suppkey % 5 = 0 THEN 1 END) AS stale, count(CASE WHEN s_suppkey % 7 = 0 THEN 1 END) AS bad_digests, false AS ready FROM supplier""")
def preflight_inventory(spark, d):
    k = F.col("s_suppkey")
    now = F.lit("2024-06-02 00:00:00").cast("timestamp")
    f = table(spark, d, "supplier").select("s_name", F.when(k % 7 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("sha"), F.when(k % 5 == 0, now - F.expr("interval 3 day")).otherwise(now).alias("seen"))
    return constraints.preflight(f, "s_name", "sha", "seen", 117, now)


@query(sql("sp") + """, s AS (SELECT player_id, idx, event_type AS state, lag(event_type) OVER (PARTITION BY player_id ORDER BY idx) AS before FROM sp)
SELECT player_id, idx, before, state FROM s WHERE NOT coalesce((before IS NULL AND state = 'signup') OR (before = 'signup' AND state IN ('view', 'click')) OR (before = 'view' AND state IN ('click', 'view', 'error')) OR (before = 'click' AND state = 'purchase'), false)""")
def run_transitions(spark, d):
    legal = {None: ["signup"], "signup": ["view", "click"], "view": ["click", "view", "error"], "click": ["purchase"]}
    p = X.sample_players(spark, d).select("player_id", "idx", F.col("event_type").alias("state"))
    return constraints.run_transitions(p, "player_id", "idx", "state", legal)


# --- digests ---

_NATIONS = "m AS (SELECT n_name AS match_id, CASE n_regionkey WHEN 0 THEN 'evaluation' WHEN 1 THEN 'validation' ELSE 'train' END AS role FROM nation)"


@query("WITH " + _NATIONS + """, r AS (SELECT role, '"' || role || '":[' || string_agg('"' || match_id || '"', ',' ORDER BY match_id) || ']' AS e FROM m GROUP BY role) SELECT sha256('{' || string_agg(e, ',' ORDER BY role) || '}') AS digest FROM r""")
def role_digest(spark, d):
    k = F.col("n_regionkey")
    m = table(spark, d, "nation").select(F.col("n_name").alias("match_id"), F.when(k == 0, "evaluation").when(k == 1, "validation").otherwise("train").alias("role"))
    return digests.role_digest(m, "role", "match_id")


@query("""WITH f AS (SELECT 'fold_' || h.n_name AS fold, t.n_name AS m, h.n_name AS held FROM nation h JOIN nation t ON h.n_name <> t.n_name), e AS (SELECT fold, '["' || fold || '",[' || string_agg('"' || m || '"', ',' ORDER BY m) || '],"' || held || '"]' AS e FROM f GROUP BY fold, held)
SELECT sha256('[' || string_agg(e, ',' ORDER BY fold) || ']') AS digest FROM e""")
def fold_digest(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("m"))
    held = n.withColumnRenamed("m", "held")
    f = held.join(n, F.col("m") != F.col("held")).withColumn("fold", F.concat(F.lit("fold_"), "held"))
    return digests.fold_digest(f, "fold", "m", "held")


@query("""WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS b, CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '1' END AS v, o_orderkey % 11 = 0 AS bad FROM orders),
t AS (SELECT *, sha256('{' || array_to_string(list_filter([CASE WHEN a IS NOT NULL THEN '"a":"' || a || '"' END, CASE WHEN b IS NOT NULL THEN '"b":"' || b || '"' END, '"lock_schema_version":"' || v || '"'], lambda x: x IS NOT NULL), ',') || '}') AS h FROM l)
SELECT id, h AS lock_sha256, CASE WHEN a IS NULL THEN 'missing_field' WHEN v <> '1' THEN 'bad_version' WHEN bad THEN 'mismatch' ELSE 'ok' END AS status FROM t""")
def lock_status(spark, d):
    k = F.col("o_orderkey")
    l = table(spark, d, "orders").select(  # noqa: E741
        k.alias("id"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("a"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("b"), F.when(k % 7 == 0, "0").otherwise("1").alias("lock_schema_version"),
    )
    fields = ["b", "a", "lock_schema_version"]
    own = digests.locks(l, "id", fields, ["a"], "1").select("id", "lock_sha256")
    l = l.join(own, "id").withColumn("stated", F.when(F.col("id") % 11 == 0, "?").otherwise(F.col("lock_sha256")))  # noqa: E741
    return digests.locks(l, "id", fields, ["a"], "1", "stated")


@query("""SELECT n_nationkey AS id, '{"A":["' || n_name || '","x"],"b":{"c":"' || n_regionkey || '"}}' AS form FROM nation""")
def string_trees(spark, d):
    text = F.format_string('{ "b": {"c": "%s"}, "A": ["%s", "x"] }', F.col("n_regionkey").cast("string"), F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), digests.string_tree(text).alias("form"))


@query("""WITH f AS (SELECT split_part(p_name, ' ', 1) || '/' || p_partkey AS path, CASE WHEN p_size % 9 = 0 THEN 'symlink' ELSE 'file' END AS kind, sha256(p_name) AS h FROM part),
g AS (SELECT split_part(path, '/', 1) AS d, sha256(string_agg(path || chr(0) || kind || chr(0) || h, chr(10) ORDER BY encode(path))) AS x, count(*) AS n FROM f GROUP BY 1)
SELECT sha256(string_agg(d || chr(0) || x, chr(10) ORDER BY encode(d))) AS digest, sum(n)::BIGINT AS n FROM g""")
def tree_digest(spark, d):
    p = table(spark, d, "part")
    f = p.select(F.concat(F.substring_index("p_name", " ", 1), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_size") % 9 == 0, "symlink").otherwise("file").alias("kind"), F.sha2("p_name", 256).alias("sha"))
    return digests.tree_digest(f, "path", "kind", "sha")


_CHAIN = """, c AS (SELECT player_id, idx, event_type || event_id AS t, sha256(event_type || event_id) AS chain FROM sp WHERE idx = 0 UNION ALL SELECT sp.player_id, sp.idx, sp.event_type || sp.event_id, sha256(c.chain || sp.event_type || sp.event_id) FROM c JOIN sp ON sp.player_id = c.player_id AND sp.idx = c.idx + 1)"""


def _receipts(spark, d):
    return X.sample_players(spark, d).select("player_id", "idx", F.concat("event_type", F.col("event_id").cast("string")).alias("t"))


@query(sql("sp").replace("WITH sp", "WITH RECURSIVE sp", 1) + _CHAIN + " SELECT player_id, idx, chain FROM c")
def running_digest(spark, d):
    return digests.record_stream(_receipts(spark, d), ["player_id"], "idx", "t").select("player_id", "idx", "chain")


@query(sql("sp") + " SELECT player_id, count(*) AS n_rows, least(count(*), min(CASE WHEN idx % 50 = 20 + player_id % 5 THEN idx ELSE 1000000 END)) AS n_sealed FROM sp GROUP BY ALL")
def sealed_prefix(spark, d):
    r = _receipts(spark, d)
    sealed = digests.record_stream(r, ["player_id"], "idx", "t").withColumn("sealed", F.when(F.col("idx") % 50 == 20 + F.col("player_id") % 5, "broken").otherwise(F.col("chain")))
    return digests.sealed_prefix(sealed.select("player_id", "idx", "t", "sealed"), ["player_id"], "idx", "t", "sealed")


@query("""SELECT c_nationkey AS k, sha256(string_agg(printf('%016x', octet_length(encode(c_name))) || ':' || c_name, '' ORDER BY c_name)) AS digest, count(*) AS n FROM customer GROUP BY ALL""")
def length_prefixed_digest(spark, d):
    return digests.length_prefixed(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name"), ["k"], "c_name")


# --- arrays of panels ---


def _panels(spark, d):
    """Each player's values in order, as an array of pairs."""
    p = X.sample_players(spark, d).groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("s"))
    return p.select("player_id", F.transform("s", lambda e: F.array(F.round(e["x"], 2), e["y"])).alias("panel"))


@query(sql("sp") + """ SELECT player_id, array_to_string(list_transform(list(round(x, 2) ORDER BY idx), lambda v: v::DECIMAL(18, 2)::VARCHAR), ' ') AS xs, 2 AS entities, count(*) AS steps, true AS back FROM sp GROUP BY player_id""")
def transposed_panels(spark, d):
    p = _panels(spark, d).withColumn("t", arrays.transposed("panel"))
    xs = F.array_join(F.transform(F.element_at("t", 1), lambda v: v.cast("decimal(18,2)").cast("string")), " ")
    return p.select("player_id", xs.alias("xs"), F.size("t").alias("entities"), F.size("panel").cast("long").alias("steps"), (arrays.transposed("t") == F.col("panel")).alias("back"))


@query(sql("sp") + """, g AS (SELECT match_id, player_id, list(event_id ORDER BY idx) AS v, count(*) AS n FROM sp GROUP BY ALL), m AS (SELECT match_id, max(n) AS m FROM g GROUP BY ALL)
SELECT match_id, player_id, m AS width, n AS own, list_sum(v)::BIGINT - (m - n) AS total FROM g JOIN m USING (match_id)""")
def padded_sets(spark, d):
    p = arrays.collated(X.sample_players(spark, d), ["match_id"], ["player_id"], "idx", "event_id", F.lit(-1).cast("long"))
    add = lambda s, x: s + x
    return p.select("match_id", "player_id", F.size("values").cast("long").alias("width"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("own"), F.aggregate("values", F.lit(0).cast("long"), add).alias("total"))


@query(sql("sp") + """ SELECT player_id, count(*) AS pairs, round(sum(abs(x - y)), 6) AS gap, string_agg(CASE WHEN event_type <> 'view' THEN '1' ELSE '0' END, '' ORDER BY idx) AS mask, count(CASE WHEN event_type <> 'view' THEN 1 END) AS n_present,
 arg_max(event_id, idx) AS last_event, 'period_2/sample_' || count(*) AS slot_id, player_id % 3 = 0 AS whole FROM sp GROUP BY player_id""")
def panel_arrays(spark, d):
    s = X.sample_players(spark, d).groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "event_type", "event_id"))).alias("s"))
    s = s.select("player_id", "s", F.transform("s", lambda e: e["x"]).alias("xs"), F.transform("s", lambda e: e["y"]).alias("ys"), F.transform("s", lambda e: F.when(e["event_type"] != "view", e["x"])).alias("seen"))
    z = s.withColumn("z", arrays.zip_strict(a="xs", b="ys"))
    gap = F.aggregate("z", F.lit(0.0), lambda t, e: t + F.abs(e["a"] - e["b"]))
    text = F.when(F.col("player_id") % 3 == 0, "abc-1").otherwise("abc-1x")
    return z.select(
        "player_id", F.size("z").cast("long").alias("pairs"), F.round(gap, 6).alias("gap"), F.array_join(F.transform(arrays.present_mask("seen"), lambda m: F.when(m, "1").otherwise("0")), "").alias("mask"),
        F.size(arrays.present("seen")).cast("long").alias("n_present"), arrays.lookup("s", "idx", "event_id", (F.size("s") - 1).cast("long")).alias("last_event"),
        arrays.origin_id(F.lit(2), F.size("s")).alias("slot_id"), arrays.full_match(text, r"[a-z]+-\d").alias("whole"),
    )


@query("SELECT vec_id, vec_id % 4 <> 0 AND vec_id % 5 <> 0 AS ok FROM embeddings")
def panel_shapes(spark, d):
    k = F.col("vec_id")
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    point = lambda x: F.array(x, F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(x))
    rows = F.array(F.transform(v, point), F.when(k % 4 == 0, F.slice(F.transform(v, point), 1, 2)).otherwise(F.transform(v, point)))
    return table(spark, d, "embeddings").select("vec_id", arrays.xy_panel_ok(rows, 3, 2).alias("ok"))

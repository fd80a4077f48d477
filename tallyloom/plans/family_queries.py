"""Families, repetition, distances, clustering and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import behavior as B
from tallyloom.operators import cluster as C
from tallyloom.operators import distance as D
from tallyloom.operators import families as A
from tallyloom.plans.rate_queries import rounded
from tallyloom.plans.registry import query
from tallyloom.plans.shared import table

@query("""
WITH s AS (SELECT lang, source, count(*) AS size FROM documents GROUP BY lang, source), t AS (SELECT *, sum(size) OVER (PARTITION BY lang) AS n FROM s)
SELECT lang, count(*) AS raw_count, max(n)::BIGINT AS n, round(-sum(size / n * ln(size / n)), 6) + 0.0 AS entropy_nats, round(-sum(size / n * log2(size / n)), 6) + 0.0 AS entropy_bits,
  round(exp(-sum(size / n * ln(size / n))), 6) AS effective_count, round(max(size / n), 6) AS dominant_share, round(count(*) FILTER (WHERE size = 1) / max(n), 6) AS singleton_rate
FROM t GROUP BY lang""")
def family_stats(spark, sf_dir):
    return rounded(A.family_stats(table(spark, sf_dir, "documents").select("lang", "source"), ["lang"], "source"))


DISCOVERY = """
WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label), t AS (SELECT size, sum(size) OVER () AS n FROM s),
g AS (SELECT unnest(range(1, 41)) AS k),
c AS (SELECT g.k, sum(1 - CASE WHEN n - size < g.k THEN 0.0 ELSE list_product(list_transform(range(g.k), lambda i: (n - size - i)::DOUBLE / greatest(n - i, 1))) END) AS df FROM t, g WHERE g.k <= n GROUP BY g.k)
"""


@query(DISCOVERY + "SELECT CAST(k AS INTEGER) AS k, round(df, 6) AS df FROM c")
def family_discovery(spark, sf_dir):
    return rounded(A.discovery_curve(table(spark, sf_dir, "embeddings").select("label"), [], "label", 40))


@query(DISCOVERY + ", w AS (SELECT k, df, lag(df) OVER (ORDER BY k) AS before FROM c) SELECT round(sum((df + before) / 2) / (max(k) - 1), 6) AS auc, CAST(max(k) AS INTEGER) AS k_used, CAST(NULL AS VARCHAR) AS reason FROM w")
def discovery_auc(spark, sf_dir):
    return rounded(A.discovery_auc(A.discovery_curve(table(spark, sf_dir, "embeddings").select("label"), [], "label", 40), [], 40))


@query("""
WITH d AS (SELECT lang, sha256(text) AS h FROM documents), g AS (SELECT lang, h, count(*) AS size FROM d GROUP BY lang, h)
SELECT lang, sum(size)::BIGINT AS n, count(*) AS distinct_hashes, round(count(*) / sum(size), 6) AS unique_rate, round(max(size) / sum(size), 6) AS modal_share FROM g GROUP BY lang""")
def exact_repetition(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("h"))
    return rounded(A.exact_repetition(rows, ["lang"], "h", "doc_id"))


@query("SELECT sha256(text) AS h, count(*) AS count, min(doc_id) AS first_run FROM documents GROUP BY 1 HAVING count(*) >= 2")
def repetition_groups(spark, sf_dir):
    return A.repetition_groups(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), [], "h", "doc_id")


@query("""
WITH r AS (SELECT label, count(*) AS n, min(vec_id) AS m FROM embeddings GROUP BY label)
SELECT e.vec_id, e.label, CAST(f.family_id AS INTEGER) AS family_id FROM embeddings e JOIN (SELECT label, row_number() OVER (ORDER BY n DESC, m) - 1 AS family_id FROM r) f USING (label)""")
def stable_labels(spark, sf_dir):
    return A.stable_labels(table(spark, sf_dir, "embeddings").select("vec_id", "label"), [], "label", "vec_id").select("vec_id", "label", "family_id")


ARI = """
WITH c AS (SELECT lang, source, count(*) AS c FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source),
a AS (SELECT lang, sum(c) AS c FROM c GROUP BY lang), b AS (SELECT source, sum(c) AS c FROM c GROUP BY source),
t AS (SELECT (SELECT sum(c * (c - 1) / 2.0) FROM c) AS ij, (SELECT sum(c * (c - 1) / 2.0) FROM a) AS i, (SELECT sum(c * (c - 1) / 2.0) FROM b) AS j, (SELECT sum(c) FROM c) AS n,
  (SELECT count(*) FROM a) AS n_lang, (SELECT count(*) FROM b) AS n_source)
"""


@query(ARI + "SELECT n::BIGINT AS n, n_lang, n_source, round((ij - i * j / (n * (n - 1) / 2.0)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2.0)), 6) AS ari FROM t")
def ari(spark, sf_dir):
    return rounded(A.adjusted_rand(table(spark, sf_dir, "documents").select("lang", "source"), [], "lang", "source"))


@query(ARI + "SELECT n::BIGINT AS n, n_lang, n_source, round((ij - i * j / (n * (n - 1) / 2.0)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2.0)), 6) AS ari, CAST(NULL AS VARCHAR) AS reason FROM t")
def partition_agreement(spark, sf_dir):
    return rounded(A.agreement(table(spark, sf_dir, "documents").select("lang", "source"), [], "lang", "source"))


COSINE = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS l, b.vec_id AS r, a.label AS label_l, b.label AS label_r, 1 - greatest(-1.0, least(1.0, list_cosine_similarity(a.e, b.e))) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id)
"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("space"), F.col("vec_id").alias("run"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query(COSINE + 'SELECT l AS "left", r AS "right", round(distance, 5) AS distance FROM p')
def cosine_pairs(spark, sf_dir):
    return D.vector_pairs(vectors(spark, sf_dir), [], "run", "vector", digits=5)


@query(COSINE + "SELECT round(avg(distance), 6) AS mean_distance, count(*) AS n_pairs FROM p")
def mean_pairwise(spark, sf_dir):
    return rounded(D.vector_mean(vectors(spark, sf_dir), ["space"], "run", "vector").drop("space"))


@query(COSINE + """,
b AS (SELECT label_l AS family, l AS run, distance FROM p WHERE label_l = label_r UNION ALL SELECT label_l, r, distance FROM p WHERE label_l = label_r),
m AS (SELECT family, run, avg(distance) AS mean FROM b GROUP BY family, run)
SELECT v.label AS family, count(*) AS size, arg_min(v.vec_id, (round(coalesce(m.mean, 0), 9), v.vec_id)) AS medoid,
  round(coalesce((SELECT avg(distance) FROM b WHERE b.family = v.label), 0), 6) AS mean_distance, round(coalesce((SELECT max(distance) FROM b WHERE b.family = v.label), 0), 6) AS max_distance
FROM v LEFT JOIN m ON m.run = v.vec_id GROUP BY v.label""")
def representatives(spark, sf_dir):
    return rounded(D.vector_representatives(vectors(spark, sf_dir), ["space"], "run", "vector", "label").drop("space"))


@query(COSINE + """,
b AS (SELECT l AS run, label_l AS own, label_r AS other, distance FROM p UNION ALL SELECT r, label_r, label_l, distance FROM p),
m AS (SELECT run, own, other, avg(distance) AS d FROM b GROUP BY run, own, other),
s AS (SELECT run, own, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM m GROUP BY run, own)
SELECT count(*) AS n, count(DISTINCT own) AS families, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    return rounded(D.vector_silhouette(vectors(spark, sf_dir), ["space"], "run", "vector", "label").drop("space"))


@query()
def clusters(spark, sf_dir):
    return C.clusters(vectors(spark, sf_dir), ["space"], 0.5)


@query()
def threshold_sensitivity(spark, sf_dir):
    return C.sensitivity(vectors(spark, sf_dir), ["space"], 0.5)


@query()
def vendi(spark, sf_dir):
    return C.vendi_scores(vectors(spark, sf_dir), ["space"])


@query()
def bootstrap_ci(spark, sf_dir):
    return C.bootstrap(vectors(spark, sf_dir), ["space"], 0.5, k_max=5)


def event_features(spark, sf_dir):
    """Event types and value bands of users as two blocks of features."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    kinds = e.select(F.lit("all").alias("space"), F.col("user_id").alias("run"), F.lit("kind").alias("block"), F.col("event_type").alias("feature"), F.lit(1.0).alias("value"))
    bands = e.select(F.lit("all").alias("space"), F.col("user_id").alias("run"), F.lit("band").alias("block"), F.floor(F.col("value") / 20).cast("string").alias("feature"), F.lit(1.0).alias("value"))
    return kinds.unionByName(bands)


@query()
def ablation(spark, sf_dir):
    return C.ablation(event_features(spark, sf_dir), ["space"], {"both": ["kind", "band"], "kind": ["kind"], "band": ["band"]}, 0.3)


@query("""
WITH f AS (SELECT user_id AS run, 'kind' AS block, event_type AS feature, count(*) AS v FROM events WHERE user_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT user_id, 'band', CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR), count(*) FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
b AS (SELECT run, block || ':' || feature AS feature, v / sqrt(sum(v * v) OVER (PARTITION BY run, block)) AS v FROM f),
n AS (SELECT run, feature, v / sqrt(sum(v * v) OVER (PARTITION BY run)) AS v FROM b)
SELECT a.run AS "left", c.run AS "right", round(1 - least(1.0, coalesce(sum(a.v * c.v), 0)), 5) AS distance
FROM (SELECT DISTINCT run FROM n) x JOIN (SELECT DISTINCT run FROM n) y ON x.run < y.run JOIN n a ON a.run = x.run JOIN n c ON c.run = y.run AND c.feature = a.feature GROUP BY a.run, c.run""")
def feature_distances(spark, sf_dir):
    f = event_features(spark, sf_dir).filter("feature is not null")
    return D.cosine_distances(D.normalized_features(f, []), f.select("run").distinct(), [], digits=5)


WORDS = "list_distinct(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> ''))"


@query(f"""
WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark)
SELECT a.item_id AS "left", c.item_id AS "right", round(1 - len(list_intersect(a.w, c.w))::DOUBLE / len(list_distinct(list_concat(a.w, c.w))), 6) AS distance
FROM b a JOIN b c ON a.item_id < c.item_id""")
def token_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("space"), F.col("item_id").alias("run"), F.array_distinct(F.filter(F.split("text", "[ \n]+"), lambda w: w != "")).alias("w"))
    pairs = D.pairs_of(b.select("space", "run"), ["space"])
    for s in ("left", "right"):
        pairs = pairs.join(b.select(F.col("run").alias(s), F.col("w").alias(f"w_{s}")), s)
    return rounded(pairs.select("left", "right", D.token_jaccard_distance("w_left", "w_right").alias("distance")))


# DuckDB's distance counts bytes: letters beyond ASCII stand for one byte each in the SQL
LETTERS = "ÄÇÈÉÊÑÖÜßäçèéêíñóöü"
ONE_BYTE = f"translate(text, '{LETTERS}', {' || '.join(f'chr({c})' for c in [*range(1, 9), *range(14, 14 + len(LETTERS) - 8)])})"


@query(f"""
WITH b AS (SELECT item_id, {ONE_BYTE} AS t FROM benchmark)
SELECT a.item_id AS "left", c.item_id AS "right", round(levenshtein(a.t, c.t)::DOUBLE / greatest(length(a.t), length(c.t)), 6) AS distance
FROM b a JOIN b c ON a.item_id < c.item_id""")
def levenshtein_pairs(spark, sf_dir):
    from tallyloom.functions.text import lexical_distance

    b = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("space"), F.col("item_id").alias("run"), "text")
    pairs = D.pairs_of(b.select("space", "run"), ["space"])
    for s in ("left", "right"):
        pairs = pairs.join(b.select(F.col("run").alias(s), F.col("text").alias(f"t_{s}")), s)
    return rounded(pairs.select("left", "right", lexical_distance("t_left", "t_right").alias("distance")))


@query("""
WITH b AS (SELECT item_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '') AS w FROM benchmark),
p AS (SELECT a.item_id AS l, c.item_id AS r, a.w AS x, c.w AS y, greatest(1, least(5, len(a.w), len(c.w))) AS k FROM b a JOIN b c ON a.item_id < c.item_id),
g AS (SELECT l, r, list_transform(range(1, greatest(len(x), 1) - k + 2), lambda i: substr(sha256(array_to_string(x[i:i + k - 1], chr(31))), 1, 16)) AS x,
  list_transform(range(1, greatest(len(y), 1) - k + 2), lambda i: substr(sha256(array_to_string(y[i:i + k - 1], chr(31))), 1, 16)) AS y FROM p),
f AS (SELECT l, r, list_distinct(list_transform(range(1, greatest(1, len(x) - 3) + 1), lambda i: list_min(x[i:i + 3]))) AS x, list_distinct(list_transform(range(1, greatest(1, len(y) - 3) + 1), lambda i: list_min(y[i:i + 3]))) AS y FROM g)
SELECT l AS "left", r AS "right", 1 - len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS distance FROM f""")
def winnow_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("space"), F.col("item_id").alias("run"), F.filter(F.split("text", "[ \n]+"), lambda w: w != "").alias("w"))
    return D.winnowing_pairs(b, ["space"], "run", "w").drop("space")


CALLS = "list_distinct(regexp_extract_all(text, '([A-Za-z_]+)\\s*[(.]', 1))"


@query(f"""
WITH b AS (SELECT item_id, {CALLS} AS w FROM benchmark)
SELECT a.item_id AS "left", c.item_id AS "right", round(CASE WHEN len(a.w) + len(c.w) = 0 THEN 0.0 ELSE 1 - len(list_intersect(a.w, c.w))::DOUBLE / len(list_distinct(list_concat(a.w, c.w))) END, 6) AS distance
FROM b a JOIN b c ON a.item_id < c.item_id""")
def callset_distance(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("space"), F.col("item_id").alias("run"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]+)\s*[(.]"), F.lit(1))).alias("w"))
    pairs = D.pairs_of(b.select("space", "run"), ["space"])
    for s in ("left", "right"):
        pairs = pairs.join(b.select(F.col("run").alias(s), F.col("w").alias(f"w_{s}")), s)
    return rounded(pairs.select("left", "right", D.token_jaccard_distance("w_left", "w_right").alias("distance")))


@query("""
WITH e AS (SELECT event_type, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events), f AS (SELECT * FROM e WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2.0 AS b FROM f)
SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY event_type""")
def spearman(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rounded(D.spearman(e, ["event_type"], "value", "k"))


def high_mean():
    """Aggregate: whether the mean value is over 50, to nine places. A mean of just 50 isn't, in whatever order its values are added."""
    return F.round(F.coalesce(F.avg("value"), F.lit(0)), 9) > 50


def traces(spark, sf_dir):
    """Users as runs, their first events of each type as cases, whether the value is high as verdict."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return e.groupBy(F.lit("all").alias("space"), F.col("user_id").alias("run"), F.col("event_type").alias("case_id")).agg(F.when(high_mean(), "PASS").otherwise("FAIL").alias("verdict"))


TRACES = """
WITH t AS (SELECT user_id AS run, event_type AS case_id, CASE WHEN coalesce(avg(value), 0) > 50 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
i AS (SELECT run, string_agg(case_id, ',' ORDER BY case_id) AS ids FROM t GROUP BY run),
p AS (SELECT a.run AS l, b.run AS r, a.ids = b.ids AS same FROM i a JOIN i b ON a.run < b.run),
d AS (SELECT p.l, p.r, same, count(y.run) FILTER (WHERE same) AS n, avg(CASE WHEN x.verdict <> y.verdict THEN 1 ELSE 0 END) FILTER (WHERE same) AS distance
  FROM p JOIN t x ON x.run = p.l LEFT JOIN t y ON y.run = p.r AND y.case_id = x.case_id GROUP BY ALL)
"""


@query(TRACES + 'SELECT l AS "left", r AS "right", CASE WHEN same THEN n END AS n_cases, round(distance, 6) AS distance FROM d')
def verdict_disagreement(spark, sf_dir):
    return rounded(B.disagreement(traces(spark, sf_dir), ["space"]).drop("space"))


@query(TRACES + "SELECT count(*) AS n_pairs, count(*) FILTER (WHERE NOT same) AS incomparable, CASE WHEN count(*) FILTER (WHERE NOT same) = 0 THEN round(avg(distance), 6) END AS mean_distance FROM d")
def disagreement_summary(spark, sf_dir):
    return rounded(B.disagreement_totals(traces(spark, sf_dir), ["space"]).select("n_pairs", "incomparable", "mean_distance"))


@query("""WITH e AS (SELECT user_id AS run, event_type AS case_id, value FROM events WHERE user_id IS NOT NULL),
v AS (SELECT 'visible' AS scope, run, case_id, CASE WHEN coalesce(avg(value), 0) > 50 THEN 'PASS' WHEN count(*) > 4 THEN 'CRASH' ELSE 'FAIL' END AS verdict FROM e GROUP BY run, case_id
  UNION ALL SELECT 'heldout', run, CASE WHEN value > 50 THEN 'high' ELSE 'low' END, CASE WHEN count(*) > 5 THEN 'PASS' ELSE 'FAIL' END FROM e GROUP BY ALL),
r AS (SELECT * FROM v UNION ALL SELECT 'combined', run, scope || '::' || case_id, verdict FROM v),
p AS (SELECT scope, run, count(*) AS n, string_agg(case_id, ',' ORDER BY case_id) AS ids, string_agg(case_id || '=' || verdict, ',' ORDER BY case_id) AS print FROM r GROUP BY scope, run),
q AS (SELECT a.scope, count(*) AS n_pairs, count(*) FILTER (WHERE a.ids <> b.ids) AS incomparable FROM p a JOIN p b ON a.scope = b.scope AND a.run < b.run GROUP BY a.scope),
g AS (SELECT scope, count(*) AS n_behaviors, max(c) AS top FROM (SELECT scope, print, count(*) AS c FROM p GROUP BY scope, print) GROUP BY scope),
l AS (SELECT p.print AS behavior, c_nationkey AS nation, c_mktsegment AS segment FROM p JOIN customer ON c_custkey = p.run WHERE p.scope = 'combined'),
ari AS (SELECT s, n, CASE WHEN (a + b) / 2 = a * b / t THEN 1 ELSE (ij - a * b / t) / ((a + b) / 2 - a * b / t) END AS ari FROM (
  SELECT s, sum(c) AS n, sum(c) * (sum(c) - 1) / 2 AS t, sum(c * (c - 1) / 2) AS ij,
    (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM l GROUP BY behavior)) AS a,
    CASE s WHEN 'nation' THEN (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM l GROUP BY nation)) ELSE (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM l GROUP BY segment)) END AS b
  FROM (SELECT 'nation' AS s, behavior, CAST(nation AS VARCHAR) AS x, count(*) AS c FROM l GROUP BY ALL UNION ALL SELECT 'segment', behavior, segment, count(*) FROM l GROUP BY ALL) GROUP BY s)),
m AS (SELECT count(*) AS successful_runs, count(*) FILTER (WHERE c_custkey IN (SELECT run FROM v)) AS measured_runs FROM customer),
d AS (SELECT a.scope, avg(CASE WHEN x.verdict <> y.verdict THEN 1.0 ELSE 0 END) AS mean FROM (SELECT scope FROM q WHERE incomparable = 0) a JOIN r x ON x.scope = a.scope JOIN r y ON y.scope = x.scope AND y.case_id = x.case_id AND x.run < y.run GROUP BY a.scope)
SELECT q.scope, (SELECT count(*) FROM p WHERE p.scope = q.scope) AS n_runs, (SELECT count(DISTINCT ids) FROM p WHERE p.scope = q.scope) AS n_corpora, n_pairs, incomparable, round(mean, 6) AS mean_distance,
  CASE WHEN incomparable > 0 THEN 'runs with other cases' END AS reason, (SELECT count(DISTINCT n) FROM p WHERE p.scope = q.scope) AS n_counts, n_behaviors,
  round(n_behaviors / (SELECT count(*) FROM p WHERE p.scope = q.scope), 6) AS unique_rate, round(top / (SELECT count(*) FROM p WHERE p.scope = q.scope), 6) AS modal_share,
  successful_runs, measured_runs, round(measured_runs / successful_runs, 6) AS coverage, CAST(x.n AS BIGINT) AS nation_runs, round(x.ari, 6) AS nation_ari, round(y.ari, 6) AS segment_ari, (SELECT count(DISTINCT n) <= 1 FROM p WHERE p.scope = q.scope) AS stable
FROM q JOIN g USING (scope) LEFT JOIN d USING (scope), m, ari x, ari y WHERE x.s = 'nation' AND y.s = 'segment'""")
def behavior_summary(spark, sf_dir):
    """Users as runs: visible cases by event type, held-out ones by whether values are high; customers' nations and segments as structures."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").withColumnRenamed("user_id", "run")
    mean = F.when(high_mean(), "PASS").when(F.count("*") > 4, "CRASH").otherwise("FAIL")
    visible = e.groupBy("run", F.col("event_type").alias("case_id")).agg(mean.alias("verdict")).withColumn("scope", F.lit("visible"))
    heldout = e.groupBy("run", F.when(F.col("value") > 50, "high").otherwise("low").alias("case_id")).agg(F.when(F.count("*") > 5, "PASS").otherwise("FAIL").alias("verdict")).withColumn("scope", F.lit("heldout"))
    c = table(spark, sf_dir, "customer")
    labels = c.select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    out = B.behavior_summary(visible.unionByName(heldout), c.select(F.col("c_custkey").alias("run"), F.lit(True).alias("success")), labels, ("nation", "segment"))
    return rounded(out.withColumn("n_counts", F.size("case_counts").cast("long")).drop("case_counts", "nation_reason", "segment_reason", "segment_runs"))


@query(TRACES + "SELECT count(*) AS runs, count(DISTINCT n) AS distinct_counts, count(DISTINCT n) <= 1 AS stable FROM (SELECT run, count(*) AS n FROM t GROUP BY run)")
def case_count_stability(spark, sf_dir):
    return B.case_count_stability(traces(spark, sf_dir), ["space"]).drop("space")


@query(TRACES + "SELECT verdict, count(*) AS n, verdict = 'FAIL' AS failing FROM t GROUP BY verdict")
def trace_counts(spark, sf_dir):
    return B.verdict_counts(traces(spark, sf_dir), ["space"]).drop("space")


@query(TRACES + """SELECT run, count(*) AS n_cases, sha256('behavior' || chr(10) || chr(10) || '[' || string_agg('{"case_id":"' || case_id || '","verdict":"' || verdict || '"}', ',' ORDER BY case_id) || ']') AS fingerprint FROM t GROUP BY run""")
def behavior_fingerprint(spark, sf_dir):
    return B.trace_fingerprints(traces(spark, sf_dir), ["space"]).drop("space")


@query(TRACES + """, f AS (SELECT run, string_agg(case_id || verdict, ',' ORDER BY case_id) AS f FROM t GROUP BY run), g AS (SELECT f, count(*) AS size FROM f GROUP BY f)
SELECT sum(size)::BIGINT AS n, count(*) AS distinct_hashes, round(count(*) / sum(size), 6) AS unique_rate, round(max(size) / sum(size), 6) AS modal_share FROM g""")
def convergence_summary(spark, sf_dir):
    return rounded(A.exact_repetition(B.trace_fingerprints(traces(spark, sf_dir), ["space"]), ["space"], "fingerprint", "run").drop("space"))


@query(TRACES + "SELECT 'visible::' || case_id AS case_id, count(*) AS n FROM t GROUP BY case_id UNION ALL SELECT 'heldout::' || case_id, count(*) FROM t GROUP BY case_id")
def namespaced_union(spark, sf_dir):
    t = traces(spark, sf_dir)
    return B.namespaced(t, "visible").unionByName(B.namespaced(t, "heldout")).groupBy("case_id").agg(F.count("*").alias("n"))

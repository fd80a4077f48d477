"""Queries of bundles: closures, payloads, manifests and flattened names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import bundles
from tallyloom.plans.registry import query
from tallyloom.plans.shared import table


@query("""WITH RECURSIVE r(name) AS (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 97 = 1 UNION SELECT CAST(CAST(name AS BIGINT) // 2 AS VARCHAR) FROM r WHERE CAST(name AS BIGINT) > 1) SELECT name FROM r""")
def reached_names(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    uses = p.filter("p_partkey > 1").select(k.cast("string").alias("name"), F.floor(k / 2).cast("string").alias("uses"))
    return bundles.closure(p.filter("p_partkey % 97 = 1").select(k.cast("string").alias("name")), uses)


def material(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cases, ladder, definitions and references out of the parts: a check for each size, helpers that use each other in a tree of partkeys."""
    p = table(spark, sf_dir, "part")
    n, size, key = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey").cast("string")
    flags = F.array_compact(F.array(F.when(size % 2 == 0, "-a"), F.when(size % 3 == 0, "-b"), F.when(size % 5 == 0, "-c")))
    cases = p.select(
        F.col("p_brand").alias("suite"), n.alias("ordinal"), flags.alias("flags"), F.when(size % 7 == 0, F.array(F.lit("-c"))).alias("absent_flags"),
        F.when(n % 3 == 0, F.concat(F.lit("property:s"), size.cast("string"))).otherwise("golden").alias("check"),
        F.concat(F.lit('{"name":"'), "p_name", F.lit('","size":'), size.cast("string"), F.lit("}")).alias("body"),
    )
    ladder = spark.createDataFrame([("000", ["-x"]), ("001", ["-a"]), ("002", ["-b", "-a"]), ("003", ["-a", "-b", "-c"])], "checkpoint string, allowed array<string>")
    line = lambda name, position, source, check, imported: [name.alias("name"), position.cast("long").alias("position"), source.alias("source"), check.cast("string").alias("check"), F.lit(imported).alias("imported")]
    sizes, none = p.select("p_size").distinct(), F.lit(None)
    check = F.concat(F.lit("check_s"), size.cast("string"))
    definitions = sizes.select(*line(check, size, F.concat(F.lit("def "), check), F.concat(F.lit("property:s"), size.cast("string")), False))
    definitions = definitions.unionByName(p.select(*line(F.concat(F.lit("k"), key), n + 100, F.concat(F.lit("def k"), key, F.lit("  # "), "p_name"), none, False)))
    definitions = definitions.unionByName(p.select("p_type").distinct().select(*line(F.col("p_type"), F.lit(0), F.concat(F.lit("import "), "p_type"), none, True)))
    uses = p.filter("p_partkey > 1").select(F.concat(F.lit("k"), key).alias("name"), F.concat(F.lit("k"), F.floor(n / 2).cast("string")).alias("uses"))
    uses = uses.unionByName(p.filter("p_partkey % 50 = 0").select(check.alias("name"), F.concat(F.lit("k"), key).alias("uses")))
    return cases, ladder, definitions, uses.unionByName(spark.createDataFrame([("k1", "k2")], "name string, uses string"))  # and a cycle


_DIGEST = """{name}1 AS (SELECT {by}, {at} // 4096 AS b, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY {at}, d)) AS d FROM {rows} GROUP BY ALL),
{name}2 AS (SELECT {by}, b // 4096 AS b, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY {name}1.b)) AS d FROM {name}1 GROUP BY {by}, {name}1.b // 4096),
{name}3 AS (SELECT {by}, b // 4096 AS b, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY {name}2.b)) AS d FROM {name}2 GROUP BY {by}, {name}2.b // 4096),
{name} AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS d FROM {name}3 GROUP BY ALL)"""

MEMBERS = f"""WITH RECURSIVE ladder(checkpoint, allowed) AS (VALUES ('000', ['-x']), ('001', ['-a']), ('002', ['-b', '-a']), ('003', ['-a', '-b', '-c'])),
c AS (SELECT p_brand AS suite, p_partkey AS ordinal, p_size, p_partkey % 3 = 0 AS property,
  list_filter([CASE WHEN p_size % 2 = 0 THEN '-a' END, CASE WHEN p_size % 3 = 0 THEN '-b' END, CASE WHEN p_size % 5 = 0 THEN '-c' END], lambda x: x IS NOT NULL) AS flags,
  sha256('{{"name":"' || p_name || '","size":' || p_size || '}}') AS d FROM part),
kept AS (SELECT checkpoint, c.* FROM c JOIN ladder ON list_has_all(allowed, flags) AND p_size % 7 <> 0),
{_DIGEST.format(name="suites", by="checkpoint, suite", at="ordinal", rows="kept")},
needed AS (SELECT DISTINCT checkpoint, p_size FROM kept WHERE property),
edges AS (SELECT 'k' || p_partkey AS name, 'k' || p_partkey // 2 AS uses FROM part WHERE p_partkey > 1 UNION ALL SELECT 'check_s' || p_size, 'k' || p_partkey FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'k1', 'k2'),
reached(checkpoint, name) AS (SELECT checkpoint, 'check_s' || p_size FROM needed UNION SELECT checkpoint, uses FROM reached JOIN edges ON edges.name = reached.name),
lines AS (SELECT 'check_s' || p_size AS name, CAST(p_size AS BIGINT) AS position, sha256('def check_s' || p_size) AS d FROM (SELECT DISTINCT p_size FROM part)
  UNION ALL SELECT 'k' || p_partkey, p_partkey + 100, sha256('def k' || p_partkey || '  # ' || p_name) FROM part),
held AS (SELECT checkpoint, position, d FROM lines JOIN reached USING (name) UNION ALL SELECT checkpoint, 0, sha256('import ' || p_type) FROM (SELECT DISTINCT p_type FROM part), ladder),
{_DIGEST.format(name="source", by="checkpoint", at="position", rows="held")},
entries AS (SELECT checkpoint, string_agg(e, chr(10) ORDER BY e) AS e FROM (SELECT checkpoint, 'property:s' || p_size || '=check_s' || p_size AS e FROM needed) GROUP BY checkpoint),
totals AS (SELECT suite, count(*) AS total FROM c GROUP BY suite),
members AS (SELECT l.checkpoint, 'suites/' || t.suite || '.json' AS path, coalesce(n, 0) AS kept, total - coalesce(n, 0) AS dropped, d AS sha256
  FROM totals t CROSS JOIN ladder l LEFT JOIN suites s ON s.checkpoint = l.checkpoint AND s.suite = t.suite
  UNION ALL SELECT s.checkpoint, 'checks.py', n, NULL, sha256(d || chr(10) || coalesce(e, '')) FROM source s LEFT JOIN entries USING (checkpoint)
  UNION ALL SELECT checkpoint, 'config.json', len(allowed), NULL, sha256('{{"checkpoint":"' || checkpoint || '","implemented":["' || array_to_string(list_sort(allowed), '","') || '"]}}') FROM ladder)
"""


@query(MEMBERS + "SELECT * FROM members")
def bundle_payload(spark, sf_dir):
    return bundles.payload(*material(spark, sf_dir))


@query(MEMBERS + """SELECT checkpoint, count(sha256) AS files, CAST(sum(kept) FILTER (WHERE path LIKE 'suites/%') AS BIGINT) AS cases_included, CAST(sum(dropped) AS BIGINT) AS cases_withheld,
  sha256('{' || string_agg('"' || path || '":"' || sha256 || '"', ',' ORDER BY path) FILTER (WHERE sha256 IS NOT NULL) || '}') AS fingerprint FROM members GROUP BY checkpoint""")
def bundle_manifests(spark, sf_dir):
    return bundles.manifests(bundles.payload(*material(spark, sf_dir)))


@query("""WITH c AS (SELECT p_size, p_partkey % 3 = 0 AS property FROM part WHERE p_size % 2 > 0 AND p_size % 3 > 0 AND p_size % 5 > 0 AND p_size % 7 > 0)
SELECT '000' AS checkpoint, 'undefined check: property:s' || p_size AS problem FROM (SELECT DISTINCT p_size FROM c WHERE property AND p_size > 20) UNION ALL SELECT '009', 'keeps no case' WHERE NOT EXISTS (SELECT 1 FROM part WHERE FALSE)""")
def bundle_faults(spark, sf_dir):
    """Checks of sizes above 20 aren't defined, and nothing fits a checkpoint if all cases need another flag."""
    cases, _, definitions, _ = material(spark, sf_dir)
    ladder = spark.createDataFrame([("000", ["-x"]), ("009", ["-x", "-y"])], "checkpoint string, allowed array<string>")
    other = cases.withColumn("flags", F.concat("flags", F.array(F.lit("-x")))).withColumn("absent_flags", F.coalesce("absent_flags", F.array().cast("array<string>")))
    first = bundles.bundle_problems(other, ladder.filter("checkpoint = '000'"), definitions.filter("check is null or position <= 20"))
    return first.unionByName(bundles.bundle_problems(other.withColumn("flags", F.array(F.lit("-z"))), ladder.filter("checkpoint = '009'"), definitions))


@query("""WITH f AS (SELECT p_partkey, 'd' || p_partkey % 5 AS parent, p_type || '.c' AS base, lpad(p_partkey::VARCHAR, 9, '0') AS path FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS nth FROM f), m AS (SELECT *, row_number() OVER (PARTITION BY base, parent, nth > 1 ORDER BY path) AS k FROM n)
SELECT p_partkey, CASE WHEN nth = 1 THEN base WHEN k = 1 THEN parent || '__' || base ELSE parent || '__' || k || '__' || base END AS flat_name FROM m""")
def flattened_names(spark, sf_dir):
    """Files of one name in folders of five names, each many times."""
    from tallyloom.operators.contracts import flat_names

    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/src/"), F.lpad(key, 9, "0"), F.lit("/d"), (F.col("p_partkey") % 5).cast("string"), F.lit("/"), "p_type", F.lit(".c"))
    return flat_names(p.select("p_partkey", path.alias("path"))).select("p_partkey", "flat_name")

"""Prefix trie of conversations from mergeable partial tries.

A node is a distinct sequence of first turns (role, text); the root is the empty one. A node's key is a chain of hashes over the digests of its turns, so
equal sequences have the same key wherever they are met.

1. Turns are placed in their conversations (by turn, nulls first; of equal turns by role, then text) as narrow rows of digests and sizes;
   texts are shuffled only where turns tie.
2. Conversations are rebuilt: `shared_heads` gives each one the first turns of another.
3. Partial tries: rows are range-partitioned by conversation and sorted, and each task streams over its own, combining them in a table of
   nodes by key (members, smallest member, the ids of those that end there). The table is emitted and emptied whenever it is full.
4. Tree merges: `FAN` neighbouring partial tries at a time are merged by key, until one is left. Members are added up, lists of ends are
   joined, and since ranges follow each other they stay in order. A list of RUN ids or more leaves the merges as a run of its own, so rows have a bounded size.
5. Bottom-up rollup: each node carries the keys of its ancestors 1, 2, 4, ... levels up. In round r every node's sums go to the ancestor 2^r
   levels up, which then has the sums of 2^(r+1) levels below it. So the number of rounds is the logarithm of the depth.
6. The ids that end at a node are hashed in order, run by run, by one hash state for each node.

A null conv_id is no conversation; null roles and texts are empty. Rows that repeat are turns of their own. An empty table has no
nodes, not even a root. A conversation that is left without turns is a member of the root and ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import fresh_path, remove, scratch, table, written

FAN = 32  # partial tries that meet in one merge
RUN = 1 << 15  # ids of a list that is merged no further
TABLE = 1 << 17  # nodes and ends that a task holds before it emits them
ROOT = bytes(16)
NODE = "key binary, run long, part int, depth int, n long, conv long, jumps array<binary>, n_bytes long, ends array<long>"


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), digest, n_bytes of each turn of turns (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    digest = F.unhex(F.left(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), F.lit(32)))
    keys = ["conv_id", "turn"]
    narrow = rows.select(*keys, digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    tied = narrow.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    ties = rows.join(tied, same, "left_semi").groupBy(*keys, "role", "text").agg(F.first(digest).alias("digest"))  # equal turns may stand in any order
    ties = ties.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("digest").alias("d"), F.row_number().over(Window.partitionBy(*keys).orderBy("role", "text")).alias("at"))
    joined = narrow.join(ties, same & (F.col("digest") == F.col("d")), "left")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "at")
    return joined.select("conv_id", F.row_number().over(order).alias("i"), "digest", "n_bytes")


def shared_heads(placed: DataFrame, source: Column, length: Column, most: int) -> DataFrame:
    """conv_id, group, d, digest, n_bytes: each conversation as the first `length` (up to `most`) turns of conversation `source`, then its own after so many.

    Every conversation has a row of depth 0. source and length are expressions of conv_id; group is the source.
    """
    heads = placed.filter(F.col("i") <= most).groupBy(F.col("conv_id").alias("group")).agg(F.sort_array(F.collect_list(F.struct("i", "digest", "n_bytes"))).alias("head"))
    known = placed.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id", source.alias("group"), length.cast("int").alias("h"))
    known = known.join(heads, "group", "left").withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<i:int,digest:binary,n_bytes:bigint>>")), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array().cast("array<struct<i:int,digest:binary,n_bytes:bigint>>")))
    top = F.array(F.struct(F.lit(0).alias("i"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n_bytes")))
    first = known.select("conv_id", "group", F.explode(F.concat(top, "head")).alias("x")).select("conv_id", "group", F.col("x.i").alias("d"), "x.digest", "x.n_bytes")
    rest = placed.join(known.select("conv_id", "group", "h", F.size("head").alias("m")), "conv_id").filter("i > h")
    return first.unionByName(rest.select("conv_id", "group", (F.col("i") - F.col("h") + F.col("m")).alias("d"), "digest", "n_bytes"))


def partial_tries(rows: DataFrame, n: int) -> DataFrame:
    """Node tables of n ranges of conversations. rows: conv_id, group, d, digest, n_bytes; group rises with conv_id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nodes: dict[bytes, list] = {}  # depth, members, smallest, jumps, bytes, ends
        path: list[bytes] = []  # the keys of the conversation so far
        held, conv = 0, None

        def emitted() -> Iterator[pa.RecordBatch]:
            step = 1 << 13
            items = list(nodes.items())
            for lo in range(0, len(items), step):
                some = items[lo : lo + step]
                column = lambda i, kind: pa.array([x[i] for _, x in some], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.array([part] * len(some), pa.int32()), column(0, pa.int32()), column(1, pa.int64()),
                     column(2, pa.int64()), column(3, pa.list_(pa.binary())), column(4, pa.int64()), column(5, pa.list_(pa.int64()))],
                    ["key", "run", "part", "depth", "n", "conv", "jumps", "n_bytes", "ends"],
                )
            nodes.clear()

        for b in batches:
            for c, d, digest, n_bytes in zip(b["conv_id"].to_pylist(), b["d"].to_pylist(), b["digest"].to_pylist(), b["n_bytes"].to_pylist(), strict=True):
                if c != conv:
                    if path:
                        nodes[path[-1]][5].append(conv)
                        held += 1
                    if held + len(nodes) > TABLE:
                        yield from emitted()
                        held = 0
                    conv, path = c, []
                key = hashlib.blake2b(path[-1] + digest, digest_size=16).digest() if d else ROOT
                path.append(key)
                node = nodes.get(key)
                if node is None:
                    if len(nodes) > 2 * TABLE:  # within a very long conversation
                        yield from emitted()
                    nodes[key] = [d, 1, c, [path[d - (1 << r)] for r in range(d.bit_length())], n_bytes, []]
                else:
                    node[1] += 1
        if path:
            nodes[path[-1]][5].append(conv)
        yield from emitted()

    dealt = rows.repartitionByRange(n, "group").sortWithinPartitions("group", "conv_id", "d").select("conv_id", "d", "digest", "n_bytes")
    return dealt.mapInArrow(build, NODE)


def merged_tries(nodes: DataFrame, n: int) -> DataFrame:
    """Partial tries 0 to n - 1 merged into one. Rows with a run (its first id) only have ends.

    Where a list has left the merges, the ends of its node are null from then on, and lists on either side of it are not joined.
    """
    live = F.col("run").isNull()
    pick = [F.any_value(c).alias(c) for c in ("depth", "jumps", "n_bytes")]
    parts = max(2, n)
    while parts > 1:
        parts = -(-parts // FAN)
        met = nodes.withColumn("part", F.when(live, F.floor(F.col("part") / FAN).cast("int")).otherwise(0))
        # a task may emit the same node several times; lists go in order of their first ids
        lists = F.sort_array(F.collect_list(F.when(F.size("ends") > 0, F.struct(F.get("ends", F.lit(0)).alias("first"), "ends"))))
        met = met.groupBy("key", "run", "part").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.col("ends").isNull()).alias("closed"), lists.alias("lists"), *pick)
        met = met.withColumn("lists", F.transform("lists", lambda x: x["ends"]))
        long = F.aggregate("lists", F.lit(0), lambda total, x: total + F.size(x)) >= RUN
        away = F.when(~live, F.array().cast("array<array<long>>")).when(F.col("closed"), F.col("lists")).when(long, F.array(F.flatten("lists"))).otherwise(F.array().cast("array<array<long>>"))
        kept = F.when(~live | ~(F.col("closed") | long), F.flatten("lists"))
        own = F.array(F.struct("run", "n", kept.alias("ends")))
        runs = F.transform(away, lambda x: F.struct(F.get(x, F.lit(0)).alias("run"), F.lit(0).cast("long").alias("n"), x.alias("ends")))
        nodes = met.select("key", "part", "depth", "conv", "jumps", "n_bytes", F.inline(F.concat(own, runs)))
    return nodes


def end_digests(nodes: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes that have ends: one hash state a node, fed run by run."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            keys, hashes = [], []
            ends = b["ends"]
            for i, key in enumerate(b["key"].to_pylist()):
                ids = ",".join(map(str, ends[i].values.to_pylist())).encode()
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        keys.append(last)
                        hashes.append(state.hexdigest())
                    last, state = key, hashlib.sha256()
                state.update(ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    rows = nodes.filter(F.size("ends") > 0).select("key", "ends")
    return rows.repartition("key").sortWithinPartitions("key", F.get("ends", F.lit(0))).mapInArrow(digest, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str], depth: int) -> DataFrame:
    """key and the sums over each node's subtree; nodes have key, jumps and the columns of sums, depth is that of the deepest one."""
    for r in range(depth.bit_length()):
        up = F.get("jumps", F.lit(r))
        own = F.struct("key", "jumps", *sums)
        lifted = F.struct(up.alias("key"), F.lit(None).cast("array<binary>").alias("jumps"), *sums)
        nodes = nodes.select(F.inline(F.when(up.isNotNull(), F.array(own, lifted)).otherwise(F.array(own))))
        nodes = nodes.groupBy("key").agg(F.max("jumps").alias("jumps"), *[F.sum(c).alias(c) for c in sums])
    return nodes.select("key", *sums)


def prefix_trie(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key.

    rows: conv_id, group, d, digest, n_bytes, as of `shared_heads`. The result is written, and all that led to it is removed.
    """
    path = fresh_path(spark, "trie")
    with scratch(spark):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = written(spark, merged_tries(partial_tries(rows, n), n), "nodes")
        own = nodes.filter("run is null")
        depth = own.agg(F.max("depth")).first()[0] or 0
        up = F.get("jumps", F.lit(0))
        children = own.filter("depth > 0").groupBy(up.alias("key")).agg(F.count("*").alias("n_children"))
        own = own.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        own = written(spark, own.select("key", "depth", "n", "conv", "jumps", "n_bytes", "n_children"), "nodes")
        sums = rolled_up(own.select("key", "jumps", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("n_bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], depth)
        parents = own.filter("n_children > 0").select(F.col("key").alias("up"), F.col("conv").alias("parent_conv_id"))
        out = own.withColumn("up", up).join(parents, "up", "left").join(sums, "key").join(end_digests(nodes), "key", "left")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = out.select(
            F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), F.lower(F.hex("key")).alias("key"),
        )
        return written(spark, out, "trie", path)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = written(spark, placed_turns(table(spark, sf_dir, "conversations")), "turns", path := fresh_path(spark, "turns"))
    source = F.col("conv_id") - F.col("conv_id") % 5
    length = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    out = prefix_trie(spark, shared_heads(placed, source, length, 8)).drop("key")
    remove(spark, path)
    return out


#: the CRC-32 of an id's decimal digits, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(0, 8)), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

OP12_SQL = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS source, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (
  SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN o ON o.conv_id = c.source WHERE i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE i > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, role, text FROM t),
k AS (
  SELECT conv_id, d, octet_length(encode(text)) AS n_bytes,
         sha256(string_agg(sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS key
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
p AS (
  SELECT *, lag(key) OVER w AS parent, lead(key) OVER w IS NULL AS last FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
n AS (
  SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM p GROUP BY key),
m AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.key) AS n_children FROM n),
s AS (
  SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved_tokens
  FROM (SELECT DISTINCT a.key AS top, b.key AS key FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.d >= a.d) JOIN m USING (key) GROUP BY top)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.top = m.key LEFT JOIN n u ON u.key = m.parent
"""

"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of five-word shingles (A-Z lowered, words split at x20 and x09-x0D; fewer than five words make one
shingle of the whole sequence). Two documents link when 100 * intersection >= 80 * union. Result: each document's number of
shingles and its component, the smallest doc_id reachable by links.

1. Documents of equal sets are one class; only the class goes on.
2. Shingles are ordered by how many documents have them, rare ones first (`exchange` finds the number of those that several
   documents have; the others can't be shared).
3. Of two sets of n shingles with similarity t, those first n - ceil(t n) + l in this order share at least l. Each
   class takes the l (1 to MATCHES) with the least estimated cost: the entries of its prefix's shingles, plus
   VERIFY times the most candidates that can share l of them (the entries over l). For a pair, whose two sizes ask for a
   certain intersection, the same prefixes hold as many more shared shingles, and the pair must have them.
4. First links: each class is verified against one pivot (the first or last class in the list of a prefix shingle; the one it
   shares most lists with), and this is repeated across the components that result. So a group of thousands of near copies
   is mostly linked without its pairs.
5. Lists whose classes already are in one component are done. In the others, pairs across components that
   fit and share enough prefix shingles are verified too, so no link between components is lost. A pair fits if the sizes
   allow the similarity, and if each set has as many shingles that any other document has as the two sizes ask of
   the intersection. Long lists are worked through block by block, and only pairs that pass become rows.

Sets are identified (n_shingles, the classes by 128 bits of sums) and ordered by keyed 64-bit hashes of shingles. Hashes only
propose pairs of classes: each pair is verified on the words of the two texts.

A null or empty text, or one without words, has no shingles and links with nothing: its component is its own doc_id. A null
doc_id counts as larger than all others, and its component is null if it reaches no other. Rows of one doc_id are one
node, with each row's own number of shingles. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import few, fresh_path, release, remove, scratch, table, text_bytes, written
from tallyloom.llm.decontaminate import SHINGLES_SQL
from tallyloom.llm.exchange import NULL_ID, Layout, dealt, look_up, received, shared_hashes
from tallyloom.llm.words import lower_words, mix, shared_shingles, shingle_sets

PERCENT = 80
MATCHES = 6
VERIFY = 16
STARS = 3
BLOCK = 512


def _shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    h, at = shingle_sets(part.column("text"))
    return h, np.repeat(np.arange(len(at) - 1), np.diff(at))


SETS = "doc long, n int, common int, set_a long, set_b long, need int, short int, tokens array<long>, text string"


def _prefixes(layout: Layout):
    def prefixes(docs: pa.Table, shared: pa.Table) -> pa.Table:
        known, numbers = received(shared)
        h, at = shingle_sets(docs["text"])
        place, has = look_up(known, layout.cut(h))
        df = np.where(has, numbers[place] if len(numbers) else 1, 1)
        size = np.diff(at)
        twice = [np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)]
        np.cumsum(mix(h), out=twice[0][1:])
        np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=twice[1][1:])
        tokens, need, short, common = [], [], [], []
        for d in range(len(size)):
            n = int(size[d])
            own, often = h[at[d] : at[d + 1]], df[at[d] : at[d + 1]]
            base = n - -(-n * PERCENT // 100)
            single = int((often == 1).sum())
            common.append(n - single)
            if n == 0 or single > base:  # no set can share a shingle of the shortest prefix
                tokens.append([])
                need.append(1)
                short.append(0)
                continue
            order = np.lexsort((own, often))
            cost = np.cumsum(np.where(often[order] > 1, often[order], 0))
            matches = np.arange(1, min(MATCHES, n - base) + 1)
            total = cost[base + matches - 1]
            best = int(np.argmin(total + VERIFY * total / matches))
            first = order[: base + best + 1]
            tokens.append(own[first][often[first] > 1].view(np.int64))
            need.append(best + 1)
            short.append(base + 1 - single)
        sums = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in twice]
        counts = [len(x) for x in tokens]
        flat = np.concatenate(tokens) if sum(counts) else np.zeros(0, np.int64)
        text = pc.if_else(pa.array(np.array(counts) > 0, pa.bool_()), docs["text"], pa.scalar(None, docs["text"].type))  # of what may be verified
        return pa.table({
            "doc": docs["doc"], "n": pa.array(size, pa.int32()), "common": pa.array(common, pa.int32()), "set_a": pa.array(sums[0]), "set_b": pa.array(sums[1]), "need": pa.array(need, pa.int32()), "short": pa.array(short, pa.int32()),
            "tokens": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat.astype(np.int64))), "text": text,
        })

    return prefixes


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("text_u").to_pylist(), b.column("text_v").to_pylist(), strict=True):
            common, n_x, n_y = shared_shingles(lower_words(x), lower_words(y))
            keep.append(100 * common >= PERCENT * (n_x + n_y - common))
        rows = b.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([rows.column("u"), rows.column("v")], ["u", "v"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of the pairs that link. texts: doc, text."""
    out = pairs.select("u", "v")
    for side in ("u", "v"):
        out = out.join(texts.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}")), side)
    return out.select("u", "v", "text_u", "text_v").mapInArrow(_verify, "u long, v long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, component for every node of links (u, v): the smallest node reachable.

    Each round a node takes the smallest label among its neighbours', then its label's label; so a chain's length shrinks by
    a factor each round. Labels are written each round into the shared folder, and nothing is collected.
    """
    edges = written(spark, few(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct()), "edges")
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))
    path = fresh_path(spark, "labels")
    few(labels).write.parquet(path)
    while True:
        labels = spark.read.schema("node long, label long").parquet(path)
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        low = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = low.join(jump, "to", "left").select("node", F.col("label").alias("old"), F.least("to", F.coalesce("further", "to")).alias("label"))
        following = fresh_path(spark, "labels")
        few(new).write.parquet(following)
        changed = spark.read.parquet(following).filter("old <> label").limit(1).count()
        remove(spark, path)
        path = following
        if not changed:
            return spark.read.schema("node long, label long").parquet(path).withColumnRenamed("label", "component")


def _apart(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """lists with each class's component, without the lists whose classes are all in one."""
    rows = lists.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("token")
    return rows.join(mixed, "token", "left_semi")


def _best_pivots(rows: DataFrame, fits: Column, last: bool) -> DataFrame:
    """For each class the one pivot (first or last class of a list, of another component) that it shares most lists with: u, v."""
    pick = (F.max if last else F.min)(F.struct("component", "doc", "n", "common"))
    pivots = rows.groupBy("token").agg(pick.alias("p"))
    met = rows.join(pivots, "token").filter(F.col("component") != F.col("p.component"))
    met = met.select(F.col("p.doc").alias("u"), F.col("p.n").alias("n_u"), F.col("p.common").alias("common_u"), F.col("doc").alias("v"), F.col("n").alias("n_v"), F.col("common").alias("common_v")).filter(fits)
    counted = met.groupBy("u", "v").agg(F.count("*").alias("k"))
    return counted.groupBy("v").agg(F.max_by("u", F.struct("k", -F.col("u"))).alias("u")).select("u", "v")


def _blocks(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """For each row its members' fields as arrays; `tokens` of all members in one, with the member of each in `row`, and where each member's end."""
    ends, members = column.offsets.to_numpy(), column.values
    fields = {f.name: members.field(f.name) for f in members.type}
    tokens = fields.pop("tokens")
    plain = {name: x.to_numpy() for name, x in fields.items()}
    token_ends, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = token_ends[a : b + 1]
        yield {name: x[a:b] for name, x in plain.items()} | {"tokens": flat[own[0] : own[-1]], "row": np.repeat(np.arange(b - a), np.diff(own)), "ends": own - own[0]}


def _candidates(u: dict, v: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places in u and v) of two blocks that aren't in one component, fit, and share enough prefix shingles."""
    n_u, n_v = u["n"][:, None].astype(np.int64), v["n"][None, :].astype(np.int64)
    both = n_u + n_v
    least = -(-PERCENT * both // (100 + PERCENT))  # the intersection that two such sizes ask for
    fits = u["component"][:, None] != v["component"][None, :]
    fits &= 100 * np.minimum(n_u, n_v) >= PERCENT * np.maximum(n_u, n_v)
    fits &= np.minimum(u["common"][:, None], v["common"][None, :]) >= least
    if same:
        fits = np.triu(fits, 1)
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.intersect1d(u["tokens"], v["tokens"])
    shared = np.zeros(fits.shape, np.float32)
    for k in range(0, len(known), 2048):
        column = known[k : k + 2048]
        tables = []
        for x in (u, v):
            at, has = look_up(column, x["tokens"])
            table = np.zeros((len(x["n"]), len(column)), np.float32)
            table[x["row"][has], at[has]] = 1
            tables.append(table)
        shared += tables[0] @ tables[1].T
    # a prefix of (n - intersection) + l shingles holds l of the shared ones
    extra = [x["need"] - -(-x["n"].astype(np.int64) * PERCENT // 100) for x in (u, v)]
    needed = np.maximum(1, np.minimum(extra[0][:, None], extra[1][None, :]) + least)
    return np.nonzero(fits & (shared >= needed))


def _first_met(u: dict, v: dict, i: np.ndarray, j: np.ndarray, token: int) -> np.ndarray:
    """Of the pairs, those whose first common shingle is this list's, so that each pair is found in one list only."""
    own = lambda x, k: x["tokens"][x["ends"][k] : x["ends"][k + 1]].tolist()
    left, right = {k: own(u, k) for k in np.unique(i)}, {k: set(own(v, k)) for k in np.unique(j)}
    return np.array([next(t for t in left[a] if t in right[b]) == token for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)


def _across(open_lists: DataFrame, reps: DataFrame) -> DataFrame:
    """u, v: candidate pairs across components. A list is cut into blocks, and each pair of blocks is one row's work."""
    counts = open_lists.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = open_lists.select("token", "doc", "component").join(counts, "token").join(reps.select("doc", "n", "common", "need", "tokens"), "doc")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    members = F.array_sort(F.collect_list(F.struct("doc", "component", "n", "common", "need", "tokens")))
    packed = rows.groupBy("token", "block").agg(members.alias("m"))
    left, right = (packed.select("token", F.col("block").alias(f"block_{s}"), F.col("m").alias(f"m_{s}")) for s in "uv")
    pairs = left.join(right, "token").filter("block_u <= block_v").select("token", (F.col("block_u") == F.col("block_v")).alias("same"), "m_u", "m_v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for u, v, same, token in zip(_blocks(b.column("m_u")), _blocks(b.column("m_v")), b.column("same").to_pylist(), b.column("token").to_pylist(), strict=True):
                i, j = _candidates(u, v, same)
                if len(i):
                    met = _first_met(u, v, i, j, token)
                    i, j = i[met], j[met]
                    found.append(np.stack([np.minimum(u["doc"][i], v["doc"][j]), np.maximum(u["doc"][i], v["doc"][j])]))
            all_found = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(all_found[0]), pa.array(all_found[1])], ["u", "v"])

    return pairs.mapInArrow(search, "u long, v long").distinct()


def _written_sets(spark: SparkSession, docs: DataFrame, layout: Layout) -> DataFrame:
    rows = dealt(docs, layout)
    shared = shared_hashes(rows, layout, _shingles, owner=False)
    return written(spark, rows.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_prefixes(layout), SETS), "sets")


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text). The result is written, and all that led to it is removed."""
    path = fresh_path(spark, "components")
    with scratch(spark):
        return written(spark, _components(spark, docs.select("doc_id", "text")), "components", path)


def _components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    layout = Layout(text_bytes(docs), spare_bits=14)
    sets = _written_sets(spark, docs, layout)
    release(spark)  # the texts and hashes that were shuffled
    same = ["set_a", "set_b", "n"]
    classes = sets.filter("n > 0").groupBy(*same).agg(F.min("doc").alias("rep")).withColumn("number", F.monotonically_increasing_id())
    classes = written(spark, classes, "classes")  # once numbered, a class keeps its number
    # a class goes by the document that stands for it, so early documents are pivots; further classes of one document by a number below 0
    first = classes.filter(F.col("rep") != NULL_ID).groupBy("rep").agg(F.min("number").alias("first"))
    own = F.when(F.col("number") == F.col("first"), F.col("rep")).otherwise(-F.col("number") - 2)
    classes = classes.join(first, "rep", "left").select(*same, "rep", own.alias("class"))
    members = sets.filter("n > 0").select("doc", *same).join(classes, same).select("doc", "rep")
    alone = sets.filter("size(tokens) > 0").select("doc", "common", *same, "need", "short", "tokens", "text")
    reps = alone.join(classes.withColumnRenamed("rep", "doc"), [*same, "doc"]).dropDuplicates(["class"]).select(F.col("class").alias("doc"), "n", "common", "need", "short", "tokens", "text")
    reps = written(spark, reps, "representatives")
    lists = written(spark, few(reps.select("doc", "n", "common", F.explode(F.slice("tokens", F.lit(1), F.col("short"))).alias("token"))), "lists")

    fits = F.expr(f"100 * least(n_u, n_v) >= {PERCENT} * greatest(n_u, n_v) and {100 + PERCENT} * least(common_u, common_v) >= {PERCENT} * (n_u + n_v)")
    links, open_lists = None, lists.withColumn("component", F.col("doc"))
    for r in range(STARS):
        stars = written(spark, few(_verified(_best_pivots(open_lists, fits, last=r % 2 == 1), reps)), "links")
        if r and not stars.take(1):
            break
        links = stars if links is None else links.union(stars)
        open_lists = written(spark, few(_apart(lists, components(spark, links))), "lists")

    more = written(spark, few(_verified(_across(open_lists, reps), reps)), "links")

    # from classes back to documents: one document may stand for several classes
    linked = links.union(more)
    for side in ("u", "v"):
        linked = linked.join(classes.select(F.col("class").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    edges = linked.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")).union(members.filter("doc <> rep").select(F.col("rep").alias("u"), F.col("doc").alias("v")))
    final = components(spark, edges)
    out = sets.select("doc", "n").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.withColumn("component", F.coalesce("component", "doc")).select(known("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), known("component").alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component, with their columns: those of the smallest doc_id, nulls last.

    Rows of the same doc_id and text are one. Texts without a doc_id are nodes of their own, and so are all texts if a doc_id has several.
    """
    known, own = F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1) + (1 << 62)
    text = F.xxhash64("text")
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b")
    node = own if several.take(1) else F.coalesce(known, own) if docs.filter("doc_id is null").take(1) else known
    found = jaccard_components(spark, docs.select(node.alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    if node is known:
        kept = found.filter("node = component_id").select(F.col("node").alias("kept")).distinct()
    else:
        ids = docs.select(node.alias("node"), known.alias("id"))
        first = F.min_by("node", F.struct(F.col("id").isNull(), "id", "node"))
        kept = found.distinct().join(ids, "node").groupBy("component_id").agg(first.alias("kept")).select("kept")
    rows = docs.select(F.struct("*").alias("row"), node.alias("node"))  # so no name of docs can clash
    rows = rows.join(kept, F.col("node") == F.col("kept"), "left_semi")
    return rows.select("row.*").dropDuplicates(["doc_id", "text"])


OP4_SQL = f"""
WITH RECURSIVE s AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u)
SELECT d.doc_id, CAST(coalesce(n_shingles, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) ON node = d.doc_id
"""

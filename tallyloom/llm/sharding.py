"""Sharding by vector bin packing.

Every document goes to one shard so that bytes, tokens and rows are balanced jointly. Groups (documents
with equal text) are the units of placement. Groups of at least 1/(64 * n_shards) of any dimension are units of
their own (so there are at most 3 * 64 * n_shards of them); all other groups are hashed into 64 * n_shards bundles.
The driver therefore packs a number of units that depends on n_shards alone. It visits the units from the
largest down and puts each where the dot product of its vector with the shard's residual capacity is highest. Swaps
between the fullest and the emptiest shard of a dimension then level all three, bytes before tokens and rows: a swap must lessen
the weighted squares of the two shards' differences.

A group above one shard's share in any dimension can't stay whole with balanced shards: only such a group is
cut, into salted pieces of a small part of a shard each. All rows are kept.

Null text counts as no bytes and no tokens; null and empty text are two groups. Ties between shards
go to the lower number. Rows that repeat are rows of their own, each with its own slot. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table, written

OVERHEAD = 16
UNITS_PER_SHARD = 64
WEIGHTS = (8.0, 1.0, 1.0)  # bytes, tokens, rows


def token_count(text: Column) -> Column:
    """Words of the text, by the separators x20 and x09-x0D: the places where a word begins."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    starts = F.regexp_count(blank, F.lit("[^ ]+"))
    return F.coalesce(starts, F.lit(0)).cast("long")


def pack(vectors: np.ndarray, keys: list, n_shards: int) -> np.ndarray:
    """The shard of each row of vectors. Rows of vectors are units, columns dimensions."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    order = sorted(range(len(keys)), key=lambda i: (-share[i].max(), -share[i].sum(), keys[i]))
    residual = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    shard = np.zeros(len(keys), np.int64)
    for i in order:
        score = residual @ share[i]
        fits = (residual - share[i] >= -1e-12).all(axis=1)
        # where no shard can take the unit, the one that then stands out least takes it
        best = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax((residual - share[i]).min(axis=1))
        shard[i] = best
        residual[best] -= share[i]
    return even_out(share, shard, n_shards)


def even_out(share: np.ndarray, shard: np.ndarray, n_shards: int, rounds: int = 4000) -> np.ndarray:
    """Swap units (or move one) between the fullest and the emptiest shard of a dimension while that brings the two closer in all."""
    load = np.stack([np.bincount(shard, weights=x, minlength=n_shards) for x in share.T], axis=1)
    weight = np.array(WEIGHTS[: share.shape[1]])
    for _ in range(rounds):
        for d in np.argsort(-(np.ptp(load, axis=0) * np.sqrt(weight)), kind="stable"):
            hi, lo = int(load[:, d].argmax()), int(load[:, d].argmin())
            gap = load[hi] - load[lo]
            mine, other = np.flatnonzero(shard == hi), np.append(np.flatnonzero(shard == lo), -1)  # -1: a move without return
            back = np.where(other[:, None] >= 0, share[other], 0.0)
            left = gap - 2 * (share[mine][:, None, :] - back[None, :, :])
            cost = (weight * left**2).sum(axis=2)
            if not cost.size or cost.min() >= (weight * gap**2).sum() * (1 - 1e-9):
                continue
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            moved = share[mine[i]] - back[j]
            shard[mine[i]] = lo
            if other[j] >= 0:
                shard[other[j]] = hi
            load[hi] -= moved
            load[lo] += moved
            break
        else:
            break
    return shard


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text, ...)."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        token_count(text).alias("_tokens"),
        F.xxhash64(text.isNull(), text, F.octet_length(text)).alias("_group"),
    )
    rows = written(spark, rows, "sharding")  # the texts are read once
    sums = [F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r")]
    total = rows.agg(*sums).first()
    if not total["r"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    whole = np.array([total["b"], max(total["t"], 1), total["r"]], float)
    n_units = UNITS_PER_SHARD * n_shards

    def above(part: int):
        return (F.col("b") * part >= float(whole[0])) | (F.col("t") * part >= float(whole[1])) | (F.col("r") * part >= float(whole[2]))

    # at most 3 * n_units rows, by the definition of above()
    heavy = rows.groupBy("_group").agg(*sums).filter(above(n_units)).orderBy("_group").collect()
    pieces, cut = {}, set()
    for g in heavy:
        share = (np.array([g["b"], g["t"], g["r"]]) / whole).max()
        pieces[g["_group"]] = int(np.ceil(share * n_units))
        if share * n_shards > 1:
            cut.add(g["_group"])
    known = spark.createDataFrame([(k, v) for k, v in pieces.items()], "_group long, _n int")
    own = F.col("_n").isNotNull()
    units = rows.join(F.broadcast(known), "_group", "left").select(
        "doc_id", "size", "text_crc32", "_tokens",
        F.when(own, F.col("_group")).otherwise(F.pmod("_group", F.lit(n_units))).alias("_unit"),
        F.when(own, F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.col("_n"))).otherwise(-1).cast("int").alias("_piece"),
    )
    # (unit, piece): at most n_units bundles and, as pieces are parts of the whole, 6 * n_units pieces
    counted = sorted(tuple(r) for r in units.groupBy("_unit", "_piece").agg(F.sum("size"), F.sum("_tokens"), F.count("*")).collect())
    packed: dict[tuple, list[int]] = {}
    for i, (unit, piece, *_) in enumerate(counted):
        packed.setdefault((unit, piece) if piece < 0 or unit in cut else (unit, "all"), []).append(i)
    vectors = np.array([np.sum([counted[i][2:] for i in members], axis=0) for members in packed.values()], float)
    shards = pack(vectors, [str(k) for k in packed], n_shards)
    filled, places = [0] * n_shards, []
    for members, shard in zip(packed.values(), shards.tolist(), strict=True):
        for i in members:
            unit, piece, _, _, n = counted[i]
            places.append((unit, piece, int(shard), filled[shard]))
            filled[shard] += n
    place = spark.createDataFrame(places, "_unit long, _piece int, shard int, _first long")
    nth = F.row_number().over(Window.partitionBy("_unit", "_piece").orderBy("doc_id", "text_crc32", "size"))
    return units.join(F.broadcast(place), ["_unit", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + nth - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"), 40)

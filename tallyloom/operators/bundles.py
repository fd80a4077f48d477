"""What a checkpoint's test bundle holds: kept cases, the checks they reach, digests of all members, and its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.shared import written

STEPS = 6  # that a closure walks in one plan
LADDER = 1000  # checkpoints
BLOCK = 4096  # digests in one digest


def closure(roots: DataFrame, references: DataFrame, by: tuple[str, ...] = (), steps: int = STEPS) -> DataFrame:
    """by, name: all names reachable from the roots (by, name) over references (name, uses); roots themselves are reachable.

    Each round walks `steps` steps in one plan, from the names that the last step of the round before came upon, and is written. So a plan doesn't depend on the depth, the
    number of rounds is the depth divided by steps, and cycles end where nothing new is found. (A recursive query would keep repeats, as only UNION ALL is allowed there, and
    took three times as long.)
    """
    keys = [*by, "name"]
    edges = references.filter("uses is not null").select(F.col("name").alias("_from"), F.col("uses").alias("_to")).distinct()
    # every name also leads to itself, so that a step keeps what was reached
    edges = written(edges.withColumn("_own", F.lit(False)).unionByName(edges.select("_from", F.col("_from").alias("_to"), F.lit(True).alias("_own")).distinct()), "references")
    front, known = roots.select(*keys).distinct(), None
    while True:
        found = front.withColumn("_age", F.lit(0))  # steps since the name was reached
        for _ in range(steps):
            stepped = found.join(edges, F.col("name") == F.col("_from"), "left")
            stepped = stepped.select(*by, F.coalesce("_to", "name").alias("name"), F.when(F.coalesce("_own", F.lit(True)), F.col("_age") + 1).otherwise(0).alias("_age"))
            found = stepped.groupBy(*keys).agg(F.max("_age").alias("_age"))
        if known is not None:
            found = found.join(known, keys, "left_anti")
        found = written(found, "closure")
        known = found.select(*keys) if known is None else known.unionByName(found.select(*keys))
        front = found.filter("_age = 0").select(*keys)
        if not front.take(1):
            return known


def ordered_digest(rows: DataFrame, by: list[str], position: str, digest: str = "sha256") -> DataFrame:
    """by, n, digest: one digest over the rows' digests in order, by way of digests of BLOCK places each, so that no group is large.

    Positions are whole numbers from 0 on. Every digest is SHA-256 over the lower-case hexadecimal ones below it, joined by newlines.
    """
    rows = rows.select(*by, F.col(position).cast("long").alias("_at"), F.lit(1).cast("long").alias("_n"), F.col(digest).alias("_d"))
    for _ in range(3):
        # equal positions go by their digests
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), "\n")
        rows = rows.withColumn("_block", F.floor(F.col("_at") / BLOCK)).groupBy(*by, F.col("_block").alias("_up")).agg(F.sum("_n").alias("_n"), F.sha2(joined, 256).alias("_d")).withColumnRenamed("_up", "_at")
    return rows.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), "\n"), 256).alias(digest))


def _ladder(checkpoints: DataFrame) -> Column:
    """The ladder (checkpoint, allowed), a short list, as an array."""
    rows = checkpoints.select("checkpoint", "allowed").limit(LADDER + 1).collect()
    if len(rows) > LADDER:
        raise ValueError(f"a ladder of more than {LADDER} checkpoints")
    return F.array(*[F.struct(F.lit(r["checkpoint"]).alias("checkpoint"), F.array(*map(F.lit, r["allowed"])).cast("array<string>").alias("allowed")) for r in rows])


def kept_cases(cases: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """cases (flags, absent_flags, ...) with the checkpoint, once for each that a case is kept at: it needs allowed flags only, and none that must be absent."""
    needed, absent = (F.coalesce(c, F.array().cast("array<string>")) for c in ("flags", "absent_flags"))
    fits = F.filter(_ladder(checkpoints), lambda x: (F.size(F.array_except(needed, x["allowed"])) == 0) & (F.size(absent) == 0))
    return cases.withColumn("checkpoint", F.explode(F.transform(fits, lambda x: x["checkpoint"])))


def needed_checks(kept: DataFrame) -> DataFrame:
    """checkpoint, check of kept cases that a property check judges."""
    return kept.filter(F.startswith("check", F.lit("property:"))).select("checkpoint", "check").distinct()


def bundle_problems(cases: DataFrame, checkpoints: DataFrame, definitions: DataFrame) -> DataFrame:
    """checkpoint, problem: kept cases whose check nothing defines, and checkpoints that keep no case."""
    kept = kept_cases(cases, checkpoints)
    missing = needed_checks(kept).join(definitions.select("check").distinct(), "check", "left_anti")
    empty = checkpoints.select("checkpoint").join(kept.select("checkpoint").distinct(), "checkpoint", "left_anti")
    return missing.select("checkpoint", F.concat(F.lit("undefined check: "), "check").alias("problem")).unionByName(empty.select("checkpoint", F.lit("keeps no case").alias("problem")))


def payload(cases: DataFrame, checkpoints: DataFrame, definitions: DataFrame, references: DataFrame) -> DataFrame:
    """checkpoint, path, kept, dropped, sha256 of the members of every checkpoint's bundle.

    cases: suite, ordinal, flags, absent_flags, check, body (canonical text). definitions: name, position, source, check (that it implements, or null), and imported
    (lines that every bundle has). references: name, uses. A suite of which nothing is kept has a row without a digest and is no member.
    """
    kept = kept_cases(cases, checkpoints)
    checkpoint = F.explode(F.transform(_ladder(checkpoints), lambda x: x["checkpoint"])).alias("checkpoint")
    digests = ordered_digest(kept.select("checkpoint", "suite", "ordinal", F.sha2("body", 256).alias("sha256")), ["checkpoint", "suite"], "ordinal")
    whole = cases.groupBy("suite").agg(F.count("*").alias("total")).select("suite", "total", checkpoint)
    suites = whole.join(digests, ["checkpoint", "suite"], "left").withColumn("kept", F.coalesce("n", F.lit(0).cast("long")))
    suites = suites.select("checkpoint", F.concat(F.lit("suites/"), "suite", F.lit(".json")).alias("path"), "kept", (F.col("total") - F.col("kept")).alias("dropped"), "sha256")

    needed = needed_checks(kept).join(definitions.filter("check is not null").select("check", "name"), "check")
    reached = closure(needed.select("checkpoint", "name"), references, ("checkpoint",))
    lines = definitions.select("name", "position", "imported", F.sha2("source", 256).alias("sha256"))
    held = lines.filter("not imported").join(reached, "name").select("checkpoint", "position", "sha256")
    held = held.unionByName(lines.filter("imported").select(checkpoint, "position", "sha256"))
    source = ordered_digest(held, ["checkpoint"], "position")
    entries = needed.groupBy("checkpoint").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "check", "name"))), "\n").alias("entries"))
    code = source.join(entries, "checkpoint", "left").select(
        "checkpoint", F.lit("checks.py").alias("path"), F.col("n").alias("kept"), F.lit(None).cast("long").alias("dropped"), F.sha2(F.concat_ws("\n", "sha256", F.coalesce("entries", F.lit(""))), 256).alias("sha256"),
    )
    config = checkpoints.select(
        "checkpoint", F.lit("config.json").alias("path"), F.size("allowed").cast("long").alias("kept"), F.lit(None).cast("long").alias("dropped"),
        F.sha2(F.to_json(F.struct(F.col("checkpoint").alias("checkpoint"), F.array_sort("allowed").alias("implemented"))), 256).alias("sha256"),
    )
    return suites.unionByName(code).unionByName(config)


def manifests(members: DataFrame) -> DataFrame:
    """checkpoint, files, cases_included, cases_withheld, fingerprint: SHA-256 of the members' digests as compact JSON in the order of paths."""
    suite = F.startswith("path", F.lit("suites/"))
    quoted = F.to_json(F.array("path"))  # in brackets
    entry = F.when(F.col("sha256").isNotNull(), F.struct("path", F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(':"'), "sha256", F.lit('"')).alias("text")))
    rows = members.groupBy("checkpoint").agg(
        F.count("sha256").alias("files"), F.sum(F.when(suite, F.col("kept")).otherwise(0)).alias("cases_included"), F.sum(F.when(suite, F.col("dropped")).otherwise(0)).alias("cases_withheld"), F.array_sort(F.collect_list(entry)).alias("_e")
    )
    text = F.concat(F.lit("{"), F.array_join(F.transform("_e", lambda x: x["text"]), ","), F.lit("}"))
    return rows.select("checkpoint", "files", "cases_included", "cases_withheld", F.sha2(text, 256).alias("fingerprint"))

"""Contracts of test material: command lines, frozen cases, corpora, test folders and captured files."""

from __future__ import annotations

import signal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Options of the search command and the feature that each belongs to
SEARCH_OPTIONS = {"-i": "ignore_case", "--ignore-case": "ignore_case", "-H": "with_filename", "--with-filename": "with_filename", "-h": "no_filename", "--no-filename": "no_filename", "-r": "recursive", "--recursive": "recursive"}


def search_arguments(argv: list[str], implemented: set[str] | None = None) -> dict:
    """pattern, operands and features of a search command line; options may stand anywhere before --.

    implemented: the features known so far (None: all); an error for other options and a missing pattern.
    """
    features: list[str] = []
    words, plain = [], False
    for word in argv:
        if plain or word == "-" or not word.startswith("-"):
            words.append(word)
        elif word == "--":
            plain = True
        else:
            for option in [word] if word.startswith("--") else [f"-{c}" for c in word[1:]]:
                feature = SEARCH_OPTIONS.get(option)
                if feature is None or implemented is not None and feature not in implemented:
                    raise ValueError(f"unknown option: {option}")
                features.append(feature)
    if not words:
        raise ValueError("missing pattern")
    shown = [f for f in features if f in ("with_filename", "no_filename")]
    return {"pattern": words[0], "operands": words[1:], "ignore_case": "ignore_case" in features, "recursive": "recursive" in features, "filename": shown[-1] if shown else None}


def case_problems(cases: DataFrame) -> DataFrame:
    """name, problem of frozen cases (name, args, flags, absent_flags, check, exit_code, stdout_b64, stderr_class) that contradict themselves."""
    out = F.coalesce(F.unbase64("stdout_b64").cast("string"), F.lit(""))
    code, stderr = F.col("exit_code"), F.col("stderr_class")
    flags, absent = F.coalesce("flags", F.array().cast("array<string>")), F.coalesce("absent_flags", F.array().cast("array<string>"))
    options = F.array_sort(F.array_distinct(F.filter("args", lambda a: a.startswith("-") & (a != "-") & (a != "--"))))
    golden = F.coalesce("check", F.lit("golden")) == "golden"
    problems = F.array_compact(F.array(
        F.when(F.col("name").isNull() | F.col("args").isNull() | F.col("flags").isNull() | code.isNull(), "a required field is missing"),
        F.when(golden & F.col("stdout_b64").isNull(), "a golden case without output"), F.when(~code.isin(0, 1, 2), "exit status outside 0, 1, 2"),
        F.when((code == 0) & (out == ""), "exit 0 without a line"), F.when((code == 1) & (out != ""), "exit 1 with output"),
        F.when(code.isin(0, 1) & ~stderr.eqNullSafe(F.lit("empty")), "a diagnostic with exit 0 or 1"), F.when((code == 2) & ~stderr.eqNullSafe(F.lit("nonempty")), "exit 2 without a diagnostic"),
        F.when((out != "") & ~out.endswith("\n"), "output without a final newline"), F.when(F.arrays_overlap(flags, absent), "a flag both required and absent"),
        F.when(~options.eqNullSafe(F.array_sort(F.array_distinct(F.concat(flags, absent)))), "flags that differ from the options used"), F.when((F.size(absent) > 0) & ~code.eqNullSafe(F.lit(2)), "an absent flag that isn't rejected"),
    ))
    return cases.select("name", F.explode(problems).alias("problem"))


def corpus_problems(cases: DataFrame, ladder: DataFrame) -> DataFrame:
    """name, problem of a corpus: repeated names, flags outside of the ladder (checkpoint, pos, allowed), checkpoints that select nothing."""
    twice = cases.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit("repeated name").alias("problem"))
    every = ladder.select(F.explode("allowed").alias("flag")).distinct()
    outside = cases.select("name", F.explode("flags").alias("flag")).join(every, "flag", "left_anti").select("name", F.concat(F.lit("flag outside of the ladder: "), "flag").alias("problem"))
    # a ladder is a short list
    fits = F.size(F.array_except("flags", "allowed")) == 0
    live = cases.select("flags").join(F.broadcast(ladder.select("checkpoint", "allowed")), fits).select("checkpoint").distinct()
    empty = ladder.join(live, "checkpoint", "left_anti").select(F.col("checkpoint").alias("name"), F.lit("selects no case").alias("problem"))
    return twice.unionByName(outside).unionByName(empty)


def changed_files(originals: DataFrame, copies: DataFrame, by: list[str]) -> DataFrame:
    """by, path, change (modified, added, deleted) of files (by, path, sha256)."""
    a, b = (df.select(*by, "path", F.col("sha256").alias(n)) for df, n in ((originals, "_a"), (copies, "_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, [*by, "path"], "full_outer").withColumn("change", change).filter("change is not null").select(*by, "path", "change")


def capture_table(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """flat_name, status (A added, M modified, = same) and sha256 of captured files (flat_name, sha256)."""
    b = baseline.select("flat_name", F.col("sha256").alias("_b"))
    status = F.when(F.col("_b").isNull(), "A").when(F.col("_b") != F.col("sha256"), "M").otherwise("=")
    return candidate.join(b, "flat_name", "left").select("flat_name", status.alias("status"), "sha256")


def signal_number(name: str) -> int:
    """9, KILL or SIGKILL as a number."""
    name = name.upper()
    if name.isdigit():
        return int(name)
    try:
        return int(getattr(signal.Signals, name if name.startswith("SIG") else f"SIG{name}"))
    except AttributeError:
        raise ValueError(f"unknown signal: {name}") from None


def flat_names(files: DataFrame, path: str = "path") -> DataFrame:
    """files with flat_name. In the order of paths a file gets its base name if that is free, else parent__base, else parent__2__base and so on.

    The folder of a file without one is called root. Only files whose base names agree behind the last __ can want the same name; where none of them has __, places among the files of
    one base name and folder name say it all. Others (rare) are named one after the other.
    """
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    base, parent = F.element_at(parts, -1), F.coalesce(F.nullif(F.get(parts, F.size(parts) - 2), F.lit("")), F.lit("root"))
    rows = files.withColumn("_base", base).withColumn("_parent", parent).withColumn("_root", F.element_at(F.split("_base", "__"), -1))
    odd = rows.filter(F.contains("_base", F.lit("__"))).select("_root").distinct()

    nth = F.row_number().over(Window.partitionBy("_base").orderBy(path))
    plain = rows.join(odd, "_root", "left_anti").withColumn("_later", nth > 1)
    k = F.row_number().over(Window.partitionBy("_base", "_parent", "_later").orderBy(path))
    name = F.when(~F.col("_later"), F.col("_base")).when(k == 1, F.concat_ws("__", "_parent", "_base")).otherwise(F.concat_ws("__", "_parent", k.cast("string"), "_base"))
    plain = plain.withColumn("flat_name", name).drop("_later")

    def named(done: Column, x: Column) -> Column:
        mangled = lambda i: F.when(i == 1, F.concat_ws("__", x["parent"], x["base"])).otherwise(F.concat_ws("__", x["parent"], i.cast("string"), x["base"]))
        free = F.filter(F.concat(F.array(x["base"]), F.transform(F.sequence(F.lit(1), F.size(done) + 1), mangled)), lambda n: ~F.array_contains(done, n))
        return F.concat(done, F.array(F.get(free, F.lit(0))))

    row = F.struct(F.col(path).alias("path"), F.col("_parent").alias("parent"), F.col("_base").alias("base"), F.struct(*files.columns).alias("row"))
    gathered = rows.join(odd, "_root", "left_semi").groupBy("_root").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)).alias("_f"))
    names = F.aggregate("_f", F.array().cast("array<string>"), named)
    clashing = gathered.select(F.inline(F.arrays_zip(F.col("_f.row").alias("row"), names.alias("flat_name")))).select("row.*", "flat_name")
    return plain.select(*files.columns, "flat_name").unionByName(clashing)

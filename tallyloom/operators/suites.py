"""Test suites: selection, verdicts, failure lists and comparison of case tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.orders import validated

# Fixed values
SEVERITY = {"PASS": 0, "SKIP": 0, "XFAIL": 0, "FAIL": 1, "TIMEOUT": 2, "SANITIZER": 3, "CRASH": 4}


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def skip_reason(implemented: list[str] | None, excluded_tags: list[str] = (), scope: str | None = None, never_absent: bool = False) -> Column:
    """Why a case (flags, absent_flags, tags, args, scope) doesn't run; null if it does.

    implemented: None stands for all flags; cases that need a flag's absence then don't run. never_absent: such cases never run.
    """
    tags = F.when(F.exists("args", lambda a: a.rlike("^-y[0-9]*$")), F.array_union("tags", _array(["obsolete"]))).otherwise(F.col("tags"))
    absent = F.size("absent_flags") > 0
    if implemented is not None:
        missing = F.size(F.array_except("flags", _array(implemented))) > 0
        present = F.arrays_overlap("absent_flags", _array(implemented)) if implemented else F.lit(False)
        reasons = F.when(missing, "flag not implemented").when(absent if never_absent else present, "needs a flag's absence")
    else:
        reasons = F.when(absent, "needs a flag's absence")
    if excluded_tags:
        reasons = reasons.when(F.arrays_overlap(tags, _array(excluded_tags)), "excluded tag")
    if scope is not None:
        reasons = reasons.when(F.coalesce(F.col("scope") != scope, F.lit(False)), "other scope")
    return reasons


def select_cases(cases: DataFrame, **conditions) -> DataFrame:
    return cases.withColumn("reason", skip_reason(**conditions)).withColumn("selected", F.col("reason").isNull())


def case_modes(cases: DataFrame, stdin_only: bool = False) -> DataFrame:
    """A row for each way that input reaches the command; suffix .p for a pipe, .r for a redirect."""
    modes = F.when(F.size("stdin_modes") > 0, F.col("stdin_modes")).otherwise(_array(["file"]))
    if stdin_only:
        modes = F.filter(modes, lambda m: m != "file")
        modes = F.when(F.size(modes) > 0, modes).otherwise(_array(["pipe"]))
    out = cases.withColumn("mode", F.explode(modes))
    return out.withColumn("suffix", F.when(F.col("mode") == "pipe", ".p").when(F.col("mode") == "redirect", ".r").otherwise(""))


def case_id(suite, ordinal, name, suffix="") -> Column:
    return F.format_string("%s::%06d::%s%s", F.col(suite), F.col(ordinal), F.col(name), F.col(suffix) if suffix else F.lit(""))


def stderr_ok() -> Column:
    """Whether stderr (text) fits stderr_exact, stderr_b64, stderr_regex or stderr_class, the first that is given."""
    return F.coalesce(
        F.col("stderr") == F.col("stderr_exact"), F.col("stderr") == F.unbase64("stderr_b64").cast("string"), F.expr("stderr rlike concat('(?s)', stderr_regex)"),
        F.when(F.col("stderr_class") == "empty", F.col("stderr") == "").when(F.col("stderr_class") == "nonempty", F.col("stderr") != ""), F.lit(True),
    )


def verdict(allowed_signals: Column | None = None) -> tuple[Column, Column]:
    """(verdict, problems) of a result beside its case: needs_root_skip, timed_out, sanitizer, signal, allow_signals, expected_exit,
    exit_code, expected_stdout, stdout, stderr..., expected_failure.
    """
    problems = F.array_join(F.array_compact(F.array(
        F.when(F.col("expected_exit").isNotNull() & ~F.col("exit_code").eqNullSafe(F.col("expected_exit")), F.concat(F.lit("exit "), F.col("exit_code").cast("string"), F.lit(" instead of "), F.col("expected_exit").cast("string"))),
        F.when(F.col("expected_stdout").isNotNull() & ~F.col("stdout").eqNullSafe(F.col("expected_stdout")), F.lit("stdout differs")),
        F.when(~stderr_ok(), F.lit("stderr differs")),
    )), "; ")
    crashed = F.col("signal").isNotNull() & ~F.coalesce(F.array_contains("allow_signals", F.col("signal")), F.lit(False))
    kind = (
        F.when(F.coalesce("needs_root_skip", F.lit(False)), "SKIP").when(F.coalesce("timed_out", F.lit(False)), "TIMEOUT").when(F.coalesce("sanitizer", F.lit(False)), "SANITIZER")
        .when(crashed, "CRASH").when(problems != "", F.when(F.coalesce("expected_failure", F.lit(False)), "XFAIL").otherwise("FAIL")).otherwise("PASS")
    )
    return kind, problems


def severity(name: str = "verdict") -> Column:
    pairs = [x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(name))


def top_failures(results: DataFrame, by: list[str], k: int, order: list[str]) -> DataFrame:
    """The k worst failures of each group, worst first and then in order, and how many more there are."""
    bad = results.withColumn("severity", severity()).filter("severity > 0")
    worst = Window.partitionBy(*by).orderBy(F.desc("severity"), *order)
    total = bad.groupBy(*by).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return bad.withColumn("nth", F.row_number().over(worst)).filter(F.col("nth") <= k).join(total, by)


def suite_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """passed of total, SKIP and XFAIL aside, and CLEAN or the number of problems."""
    counted = ~F.col("verdict").isin("SKIP", "XFAIL")
    out = results.groupBy(*by).agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count_if(counted).alias("total"))
    left = F.col("total") - F.col("passed")
    return out.withColumn("verdict", F.when(left == 0, "CLEAN").otherwise(F.concat(left.cast("string"), F.lit(" problems"))))


def case_diff(fresh: DataFrame, committed: DataFrame, key: list[str], fields: dict[str, bool]) -> DataFrame:
    """key, kind (only_fresh, only_committed, differs), field, semantic: every difference of two case tables. fields: name -> semantic."""
    names = list(fields)
    a = fresh.select(*key, F.struct(*names).alias("_a"))
    both = a.join(committed.select(*key, F.struct(*names).alias("_b")), key, "full_outer")
    one = F.when(F.col("_a").isNull(), "only_committed").when(F.col("_b").isNull(), "only_fresh")
    sided = both.withColumn("kind", one).filter("kind is not null").select(*key, "kind", F.lit(None).cast("string").alias("field"), F.lit(True).alias("semantic"))
    checks = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.struct(F.lit(f).alias("field"), F.lit(s).alias("semantic"))) for f, s in fields.items()]))
    differs = both.filter("_a is not null and _b is not null").select(*key, F.lit("differs").alias("kind"), F.explode(checks).alias("_x")).select(*key, "kind", "_x.field", "_x.semantic")
    return sided.unionByName(differs)


def tree_diff(expected: DataFrame, actual: DataFrame, by: list[str], expected_only: bool = False) -> DataFrame:
    """by, path, problem between two trees (path, type, mode, target); a link's mode doesn't count."""
    mode = F.when(F.col("type") != "symlink", F.col("mode"))
    flat = lambda df, n: df.select(*by, "path", F.struct("type", mode.alias("mode"), "target").alias(n))
    both = flat(expected, "_e").join(flat(actual, "_a"), [*by, "path"], "left" if expected_only else "full_outer")
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_e")), "differs")
    return both.withColumn("problem", problem).filter("problem is not null").select(*by, "path", "problem")


def availability(ladder: DataFrame) -> DataFrame:
    """checkpoint, pos, allowed, forbidden: flags introduced so far, and the rest. ladder: checkpoint, pos, flags."""
    # the ladder is a short list of checkpoints, so one window over all of it is small
    so_far = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ladder.withColumn("allowed", F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags").over(so_far)))))
    every = F.array_distinct(F.flatten(F.collect_list("flags").over(everything)))
    return out.withColumn("forbidden", F.array_sort(F.array_except(every, "allowed"))).withColumn("added", F.array_sort(F.array_except("allowed", F.coalesce(F.lag("allowed").over(Window.orderBy("pos")), F.array().cast("array<string>")))))


def probe_problems() -> Column:
    """What is wrong with a probe of a forbidden option (exit_code, stdout, stderr): empty if it was rejected."""
    return F.array_join(F.array_compact(F.array(
        F.when(~F.coalesce(F.col("exit_code") > 0, F.lit(False)), "was not rejected"), F.when(F.col("stdout") != "", "wrote to stdout"),
        F.when(F.col("stderr").rlike("(?i)sanitizer|runtime error"), "sanitizer report"), F.when(F.coalesce(F.col("stderr"), F.lit("")) == "", "no diagnostic"),
    )), "; ")


def boundary_ok(probes: DataFrame, by: list[str]) -> DataFrame:
    """Whether all forbidden spellings were rejected, and the problems."""
    rows = probes.withColumn("_p", probe_problems())
    return rows.groupBy(*by).agg(F.bool_and(F.col("_p") == "").alias("rejected_all"), F.array_sort(F.collect_set(F.when(F.col("_p") != "", F.col("_p")))).alias("problems"))


def monotone_coverage(counts: DataFrame) -> DataFrame:
    """Selected cases by checkpoint (checkpoint, pos, n) with whether they grow and are not none."""
    return counts.withColumn("ok", (F.col("n") > 0) & (F.col("n") >= F.coalesce(F.lag("n").over(Window.orderBy("pos")), F.lit(0))))


def premature_cases(cases: DataFrame, ladder: DataFrame) -> DataFrame:
    """Cases with absent flags that run at a checkpoint where one of these is already there, or don't where none is."""
    grid = cases.filter(F.size("absent_flags") > 0).join(F.broadcast(availability(ladder)), F.lit(True))  # a ladder is short
    live = ~F.arrays_overlap("absent_flags", "allowed")
    return grid.withColumn("expected", live).filter(F.col("live") != live).select("name", "checkpoint", "live", "expected")


def combination_frame(spark: SparkSession, flags: list[str], size: int) -> DataFrame:
    """All combinations of so many flags with the rule that each breaks, if any. Rows are made by joins of the short list with itself."""
    each = spark.createDataFrame([(f,) for f in sorted(set(flags))], "flag string")
    out = each.select(F.array("flag").alias("flags"))
    for _ in range(size - 1):
        out = out.join(F.broadcast(each), F.col("flag") > F.element_at("flags", -1)).select(F.array_append("flags", F.col("flag")).alias("flags"))
    return validated(out)


def valued_combinations(spark: SparkSession, values: dict[str, list[str]], size: int) -> DataFrame:
    """All combinations of so many options with one value each (flags, values), and the rule that each breaks, if any."""
    each = spark.createDataFrame([(o, v) for o in sorted(values) for v in values[o]], "option string, value string")
    out = each.select(F.array("option").alias("flags"), F.create_map("option", F.array("value")).alias("values"))
    for _ in range(size - 1):
        out = out.join(F.broadcast(each), F.col("option") > F.element_at("flags", -1)).select(F.array_append("flags", F.col("option")).alias("flags"), F.map_concat("values", F.create_map("option", F.array("value"))).alias("values"))
    return validated(out, values="values")


def random_combinations(spark: SparkSession, flags: list[str], n: int, seed: int, most: int = 6) -> DataFrame:
    """nth, flags of n draws of 2 to `most` flags without the draws that break a rule; each goes by a hash of the seed and its number, so it can be repeated."""
    names = sorted(set(flags))
    draws = spark.range(n).withColumn("size", 2 + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(most - 1)))
    scored = F.transform(F.array(*map(F.lit, names)), lambda f: F.struct(F.xxhash64(F.lit(seed), F.col("id"), f).alias("k"), f.alias("f")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(scored), F.lit(1), F.col("size").cast("int")), lambda s: s["f"]))
    return validated(draws.select(F.col("id").alias("nth"), chosen.alias("flags"))).filter("verdict = 'OK'").select("nth", "flags")


def drawn_combinations(rows: DataFrame, key: str, flags: list[str], seed: int, least: int = 3, most: int = 6) -> DataFrame:
    """rows with flags: `least` to `most` of the options for each row, by a hash of the seed and the key, so a draw can be repeated; and the rule that each draw breaks, if any."""
    size = least + F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(most - least + 1))
    scored = F.transform(F.array(*map(F.lit, sorted(set(flags)))), lambda f: F.struct(F.xxhash64(F.lit(seed), F.col(key), f).alias("k"), f.alias("f")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(scored), F.lit(1), size.cast("int")), lambda s: s["f"]))
    return validated(rows.withColumn("flags", chosen))


# What makes a family of cases by utility, and which cases have no dual
FAMILIES = {"sort": ["flags", "check", "tags"], "grep": ["flags", "tags"], "chmod": ["flags", "tags"], "mkdir": ["flags", "check", "tags"]}
WITHOUT_DUAL = {"sort": "coalesce(stdin_b64, '') = ''", "grep": "model_only_reason is not null", "chmod": "size(absent_flags) > 0"}


def heldout_selection(cases: DataFrame, utility: str, order: list[str]) -> DataFrame:
    """The first case of each family that can have a dual; the order of flags and tags makes no difference, and a missing list is an empty one."""
    none = F.array().cast("array<string>")
    shape = [F.array_sort(F.coalesce(c, none)) if c in ("flags", "tags") else F.col(c) for c in FAMILIES[utility]]
    rows = cases.filter(f"not coalesce({WITHOUT_DUAL[utility]}, false)") if utility in WITHOUT_DUAL else cases
    nth = F.row_number().over(Window.partitionBy(*[f"_f{i}" for i in range(len(shape))]).orderBy(*order))
    rows = rows.withColumns({f"_f{i}": c for i, c in enumerate(shape)}).withColumn("_n", nth)
    return rows.filter("_n = 1").select(*cases.columns)


def heldout_duals(cases: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """The first case of each family, with letters and digits of its input rotated."""
    nth = F.row_number().over(Window.partitionBy(*family).orderBy(*order))
    first = cases.withColumn("_n", nth).filter("_n = 1").drop("_n")
    return first.withColumns({"dual_of": F.col("name"), "name": F.concat(F.lit("heldout-"), "name"), "stdin": rotated("stdin")})


def rotated(x: str, letters: int = 7, digits: int = 5) -> Column:
    """Letters moved on by 7 and digits by 5; other bytes stay."""
    low, high, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    turn = lambda s, k: s[k:] + s[:k]
    return F.translate(x, low + high + num, turn(low, letters) + turn(high, letters) + turn(num, digits))

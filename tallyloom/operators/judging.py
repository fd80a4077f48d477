"""Judging one program against another: which check applies, how they differ, inputs made and made smaller, reports and inventories."""

from __future__ import annotations

import platform
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of options that take a value, and options that change which lines are equal
VALUED = "kotST"
KEY_LETTERS = "fidbnghMVkt"
KEY_WORDS = [
    "--ignore-case", "--dictionary-order", "--ignore-nonprinting", "--ignore-leading-blanks", "--numeric-sort", "--general-numeric-sort",
    "--human-numeric-sort", "--month-sort", "--version-sort", "--key", "--field-separator",
]
MUTATIONS = ["drop", "repeat", "flip", "nul", "shuffle", "number"]


def letters_of(args: Column) -> Column:
    """The option letters among arguments. In -xyz all letters count up to the first that takes a value."""
    bundles = F.transform(args, lambda a: F.regexp_extract(a, rf"^-(?!-)([^{VALUED}]*[{VALUED}]?)", 1))
    return F.array_distinct(F.flatten(F.transform(bundles, lambda b: F.filter(F.split(b, ""), lambda c: c != ""))))


def _letters(text: str) -> Column:
    return F.array(*map(F.lit, text))


def check_policy(args: Column) -> Column:
    """golden; for random orders property:shuffle, or none where a check or annotations make the output meaningless."""
    letters = letters_of(args)
    random = F.arrays_overlap(letters, _letters("R")) | F.exists(args, lambda a: a.isin("--random-sort", "--sort=random"))
    aside = F.arrays_overlap(letters, _letters("cC")) | F.exists(args, lambda a: a.rlike("^--(check|debug)(=|$)"))
    return F.when(~random, "golden").when(aside, "none").otherwise("property:shuffle")


def is_unique(args: Column) -> Column:
    return F.arrays_overlap(letters_of(args), _letters("u")) | F.array_contains(args, "--unique")


def is_keyed(args: Column) -> Column:
    """Whether lines are equal by a key and not as a whole."""
    return F.arrays_overlap(letters_of(args), _letters(KEY_LETTERS)) | F.exists(args, lambda a: F.split(a, "=")[0].isin(KEY_WORDS))


def mismatch(candidate: str = "candidate", oracle: str = "oracle", policy: str = "policy") -> Column:
    """Why a candidate's result isn't the oracle's; null if it is or can't be compared.

    Both are structs of timed_out, signal, sanitizer, exit_code, stdout; `loose_exit` tells that exit codes are random too, and
    `property` what is wrong with a shuffled output (null: nothing).
    """
    c, o = (lambda f: F.col(f"{candidate}.{f}")), (lambda f: F.col(f"{oracle}.{f}"))
    own = F.when(c("timed_out"), "candidate timed out").when(c("signal").isNotNull(), F.concat(F.lit("candidate crashed: "), c("signal"))).when(c("sanitizer").isNotNull(), F.concat(F.lit("sanitizer: "), F.left(c("sanitizer"), F.lit(80))))
    incomparable = F.coalesce(o("timed_out"), F.lit(False)) | o("signal").isNotNull() | ((F.col(policy) == "none") & F.coalesce("loose_exit", F.lit(False)))
    exits = F.when(~c("exit_code").eqNullSafe(o("exit_code")), F.format_string("exit %s, oracle %s", c("exit_code"), o("exit_code")))
    output = F.when(F.col(policy) == "property:shuffle", F.concat(F.lit("property: "), F.col("property"))).when((F.col(policy) == "golden") & ~c("stdout").eqNullSafe(o("stdout")), "stdout differs")
    return F.when(own.isNotNull(), own).when(~incomparable, F.coalesce(exits, output))


def mutated(inputs: DataFrame, seed: int, key: str = "id", data: str = "data") -> DataFrame:
    """inputs with `mutation` and the changed binary data: what happens, and where, goes by a hash of the seed and key, so it can be repeated."""
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), n.cast("long") if isinstance(n, Column) else F.lit(n))
    text = F.decode(F.col(data), "ISO-8859-1")
    lines, size = F.split(text, "\n", -1), F.octet_length(data)
    some, at = F.greatest(size, F.lit(1)), draw("line", F.size(F.split(text, "\n", -1)))
    joined = lambda x: F.encode(F.array_join(x, "\n"), "ISO-8859-1")
    spot = draw("byte", some).cast("int")
    byte = F.conv(F.substr(F.hex(data), 2 * spot + 1, F.lit(2)), 16, 10).cast("int")
    flipped = F.unhex(F.overlay(F.hex(data), F.lpad(F.hex(byte.bitwiseXOR(F.expr("1") * F.pow(F.lit(2), draw("bit", 8)).cast("int"))), 2, "0"), 2 * spot + 1, 2))
    order = F.transform(lines, lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), i).alias("k"), x.alias("x")))
    number = joined(F.array_append(lines, (draw("number", 2_000_000_001) - 1_000_000_000).cast("string")))
    changes = {  # where there is nothing to drop or to flip, a number is added
        "drop": F.when(F.size(lines) > 1, joined(F.filter(lines, lambda x, i: i != at))).otherwise(number),
        "repeat": joined(F.array_append(lines, F.get(lines, at.cast("int")))),
        "flip": F.when(size > 0, flipped).otherwise(number),
        "nul": F.concat(F.substr(data, F.lit(1), spot), F.lit(bytearray(1)), F.substr(data, spot + 1)),
        "shuffle": joined(F.transform(F.array_sort(order), lambda s: s["x"])),
        "number": number,
    }
    kind = F.get(F.array(*map(F.lit, MUTATIONS)), draw("kind", len(MUTATIONS)).cast("int"))
    out = inputs.withColumn("mutation", kind)
    change = F.coalesce(*[F.when(F.col("mutation") == m, c) for m, c in changes.items()])
    return out.withColumn(data, change)


def minimized(cases: DataFrame, still_bad: Callable[[DataFrame], DataFrame], written: Callable[[DataFrame, str], DataFrame], key: str = "id") -> DataFrame:
    """key, lines: for each case (key, lines) the smallest run of lines that halving finds while still_bad() keeps it.

    still_bad takes rows (key, side, lines) and gives those that deviate. All cases are halved in the same round, so there are about as many
    rounds as the longest case has halvings; written() cuts the lineage of each.
    """
    open_ = written(cases.select(key, "lines"), "minimized")
    done = open_.limit(0)
    while open_.take(1):
        half = F.greatest(F.lit(1), F.floor(F.size("lines") / 2).cast("int"))
        sides = F.array(F.struct(F.lit(0).alias("side"), F.slice("lines", F.lit(1), half).alias("lines")), F.struct(F.lit(1).alias("side"), F.slice("lines", half + 1, F.size("lines")).alias("lines")))
        halves = open_.filter("size(lines) > 1").select(key, F.inline(sides).alias("side", "lines"))
        kept = still_bad(halves).groupBy(key).agg(F.min_by("lines", "side").alias("_half"))
        after = written(open_.join(kept, key, "left"), "minimized")
        done = done.unionByName(after.filter("_half is null").select(key, "lines"))
        open_ = after.filter("_half is not null").select(key, F.col("_half").alias("lines"))
    return done


def report_failures(reports: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """by, ord, name, verdict of the failures that JSON reports list; details are left out. An entry without a verdict is an error."""
    entries = F.from_json(F.get_json_object(payload, "$.failures"), "array<array<string>>")
    rows = reports.select(*by, F.posexplode(entries).alias("ord", "_e"))
    part = lambda i: F.when(F.size("_e") >= 2, F.get("_e", F.lit(i))).otherwise(F.raise_error(F.concat(F.lit("malformed failure entry: "), F.array_join("_e", ","))))
    return rows.select(*by, "ord", part(0).alias("name"), part(1).alias("verdict"))


def report_case_count(payload: str = "payload") -> Column:
    """How many cases a JSON report accounts for, over all verdicts."""
    counts = F.from_json(F.get_json_object(payload, "$.counts"), "map<string,bigint>")
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))


def inventory_problems(committed: DataFrame, generated: DataFrame, separate: DataFrame, fresh: DataFrame) -> DataFrame:
    """name, problem: committed suites that nobody declares, and separately maintained ones that generation makes. All have a name."""
    names = [df.select("name").distinct() for df in (committed, generated, separate, fresh)]
    stray = names[0].join(names[1], "name", "left_anti").join(names[2], "name", "left_anti")
    moved = names[2].join(names[3], "name", "left_semi")
    return stray.select("name", F.lit("not declared").alias("problem")).unionByName(moved.select("name", F.lit("separately maintained, but generated").alias("problem")))


def suite_comparison(differences: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: semantic and other differences, inventory problems, and whether the suites can be reproduced."""
    a = differences.agg(F.count_if("semantic").alias("semantic"), F.count_if(~F.col("semantic")).alias("cosmetic"))
    b = inventory.agg(F.count("*").alias("inventory"))
    return a.crossJoin(b).withColumn("reproducible", (F.col("semantic") == 0) & (F.col("inventory") == 0))  # one row each


def derivation_problems(cases: DataFrame, by: list[str]) -> DataFrame:
    """by, problem: cases whose two derivations (model, oracle: binary) differ though nothing exempts them, or agree though exempt."""
    same = F.col("model").eqNullSafe(F.col("oracle"))
    exempt = F.col("exempt_reason").isNotNull()
    problem = F.when(~exempt & F.col("oracle").isNull(), "no oracle").when(~exempt & ~same, "model and oracle differ")
    return cases.withColumn("problem", problem).filter("problem is not null").select(*by, "problem")


class IncompatibleEnvironment(RuntimeError):
    """What is required isn't there; `status` is what a program should exit with."""

    status = 3


def environment(spark: SparkSession) -> dict[str, str]:
    jvm = spark.sparkContext._jvm
    return {
        "spark": spark.version, "java": jvm.System.getProperty("java.specification.version"), "python": ".".join(map(str, sys.version_info[:2])), "system": platform.system(),
        "machine": platform.machine(), "time_zone": spark.conf.get("spark.sql.session.timeZone"), "ansi": spark.conf.get("spark.sql.ansi.enabled"),
    }


def incompatibilities(actual: dict[str, str], required: dict[str, str | list[str]]) -> list[str]:
    """Sorted sentences on what differs; a requirement is a value or a list of possible ones."""
    wanted = {k: v if isinstance(v, list) else [v] for k, v in required.items()}
    return sorted(f"{k} is {actual.get(k)}, not {' or '.join(v)}" for k, v in wanted.items() if actual.get(k) not in v)


def require_environment(spark: SparkSession, required: dict[str, str | list[str]]) -> None:
    problems = incompatibilities(environment(spark), required)
    if problems:
        raise IncompatibleEnvironment("; ".join(problems))

"""Rules that frozen cases must keep, as data; every rule set is checked and counted in the pass that reads the cases.

A rule set has stages of rules: a rule is a name and an expression of the problems that a case has (an array of texts, empty if there are none). Where a case has
problems in a stage, later stages don't look at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.functions.modes import symbolic
from tallyloom.operators.contracts import case_problems

Rules = list[list[tuple[str, Column]]]

# Options of the mode command by their short names, the mark of a link, and how held-out cases are named
CHMOD_OPTIONS = {"-R": "-R", "--recursive": "-R", "-c": "-c", "--changes": "-c", "-v": "-v", "--verbose": "-v", "-f": "-f", "--silent": "-f", "--quiet": "-f"}
LINK = "link"
HELDOUT_PREFIX = "heldout-"
CHANGED = r"^mode of '(.*)' changed from ([0-7]{4}) \((.{9})\) to ([0-7]{4}) \((.{9})\)$"
RETAINED = r"^mode of '(.*)' retained as ([0-7]{4}) \((.{9})\)$"


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(condition: Column, text: str | Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(_none())


def _set(c: str) -> Column:
    return F.coalesce(F.col(c), _none())


def _missing(*columns: str) -> list[tuple[str, Column]]:
    return [("required field", _if(F.col(c).isNull(), f"a required field is missing: {c}")) for c in columns]


def used_options(args: str = "args") -> Column:
    """The options before the mode, by their short names; -- and the first word without - end them."""
    short = F.create_map(*[F.lit(x) for pair in CHMOD_OPTIONS.items() for x in pair])
    ends = F.transform(args, lambda a: (a == "--") | (a == "-") | ~a.startswith("-"))
    first = F.array_position(ends, True).cast("int")
    words = F.when(first > 0, F.slice(args, F.lit(1), first - 1)).otherwise(F.col(args))
    letters = lambda w: F.transform(F.split(F.substr(w, F.lit(2)), ""), lambda c: F.concat(F.lit("-"), c))
    found = F.flatten(F.transform(words, lambda w: F.when(w.startswith("--"), F.array(w)).otherwise(letters(w))))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda o: F.element_at(short, o)))))


def _line_problems(line: Column, paths: Column) -> Column:
    """What is wrong with a report line."""
    changed, kept = line.rlike(CHANGED), line.rlike(RETAINED)
    part = lambda i: F.regexp_extract(line, CHANGED, i)
    held = lambda i: F.regexp_extract(line, RETAINED, i)
    path = F.when(changed, part(1)).otherwise(held(1))
    shown = lambda octal, letters: _if(symbolic(F.conv(octal, 8, 10).cast("int")) != letters, F.concat(octal, F.lit(" isn't shown as "), letters))
    known = _if(~F.array_contains(paths, F.regexp_replace(path, "/+$", "")), F.concat(F.lit("a report line names a path that isn't in the fixture: "), path))
    both = F.concat(known, shown(part(2), part(3)), shown(part(4), part(5)), _if(part(2) == part(4), "a changed line has one mode twice"))
    return F.when(line == "", _none()).when(changed, both).when(kept, F.concat(known, shown(held(2), held(3)))).otherwise(F.array(F.concat(F.lit("no report line: "), line)))


def chmod_rules() -> Rules:
    """For cases with name, args, flags, absent_flags, tags, check, exit_code, stdout_b64, stderr_class, fixture (path, type) and expected_tree (path to mode)."""
    out = F.coalesce(F.unbase64("stdout_b64").cast("string"), F.lit(""))
    code, flags, absent = F.col("exit_code"), _set("flags"), _set("absent_flags")
    fixture = F.coalesce("fixture", F.array().cast("array<struct<path:string,type:string>>"))
    paths = F.transform(fixture, lambda e: e["path"])
    expected = lambda e: F.element_at("expected_tree", e["path"])
    mode = lambda e: F.when(expected(e).isNull(), F.concat(F.lit("no mode is expected for "), e["path"])).when(
        e["type"] == "symlink", F.when(expected(e) != LINK, F.concat(F.lit("a link has a mode: "), e["path"]))
    ).when(~expected(e).rlike("^[0-7]{4}$"), F.concat(F.lit("a malformed mode: "), e["path"], F.lit(" "), expected(e)))
    stray = F.filter(F.map_keys("expected_tree"), lambda p: ~F.array_contains(paths, p))
    bare = F.transform(paths, lambda p: F.regexp_replace(p, "/+$", ""))
    return [
        _missing("name", "args", "flags", "exit_code", "tags", "expected_tree"),
        [("output", _if((F.coalesce("check", F.lit("golden")) == "golden") & F.col("stdout_b64").isNull(), "a golden case without output"))],
        [
            ("exit status", _if(~code.isin(0, 1), "exit status outside 0, 1")),
            ("diagnostic", F.concat(_if((code == 0) & ~F.col("stderr_class").eqNullSafe(F.lit("empty")), "a diagnostic with exit 0"), _if((code == 1) & ~F.col("stderr_class").eqNullSafe(F.lit("nonempty")), "exit 1 without a diagnostic"))),
            ("output", F.concat(_if((out != "") & ~out.endswith("\n"), "output without a final newline"), _if((out != "") & ~F.arrays_overlap(flags, F.array(F.lit("-c"), F.lit("-v"))), "output without -c or -v"))),
            ("tree", F.concat(F.transform(stray, lambda p: F.concat(F.lit("the tree names a path that isn't in the fixture: "), p)), F.array_compact(F.transform(fixture, mode)))),
            ("report line", F.flatten(F.transform(F.split(out, "\n"), lambda line: _line_problems(line, bare)))),
            ("flags", F.concat(_if(F.arrays_overlap(flags, absent), "a flag both required and absent"), _if(used_options() != F.array_sort(F.array_distinct(F.concat(flags, absent))), "flags that differ from the options used"))),
            ("absent flag", _if((F.size(absent) > 0) & (code != 1), "an absent flag that isn't rejected")),
        ],
    ]


def heldout_rules() -> Rules:
    """For cases with name, args, flags, exit_code and dual_of."""
    return [
        [("name", _if(F.coalesce("name", F.lit("")) == "", "a case without a name"))],
        [
            ("name", _if(~F.startswith("name", F.lit(HELDOUT_PREFIX)), f"a name that doesn't begin with {HELDOUT_PREFIX}")), *_missing("args", "flags", "exit_code"),
            ("dual", _if(F.coalesce("dual_of", F.lit("")) == "", "no visible case that it mirrors")),
        ],
    ]


def audited(cases: DataFrame, rules: Rules, name: str) -> tuple[DataFrame, Observation]:
    """cases with problems (rule, text), and an observation of how many cases there are, how many are wrong, and how many problems each rule found; it holds them once the result was read."""

    def named(rule: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(rule).alias("rule"), t.alias("text")))

    def number(rule: str) -> Column:
        return F.sum(F.size(F.filter("problems", lambda p: p["rule"] == rule))).alias(rule)

    stages = [F.concat(*[named(r, e) for r, e in stage]) for stage in rules]
    problems = stages[-1]
    for found in reversed(stages[:-1]):
        problems = F.when(F.size(found) > 0, found).otherwise(problems)
    names = list(dict.fromkeys(r for stage in rules for r, _ in stage))
    seen = Observation(name)
    return cases.withColumn("problems", problems).observe(seen, F.count(F.lit(1)).alias("cases"), F.count_if(F.size("problems") > 0).alias("wrong"), *map(number, names)), seen


def violations(cases: DataFrame, rules: Rules, name: str = "rules") -> DataFrame:
    """name, rule, problem of all cases that break a rule."""
    return audited(cases, rules, name)[0].select("name", F.inline("problems").alias("rule", "problem"))


def corpus_violations(search: DataFrame, chmod: DataFrame, heldout: DataFrame) -> DataFrame:
    """corpus, name, rule, problem over the cases of all three contracts, in one job."""
    parts = [case_problems(search).select(F.lit("search").alias("corpus"), "name", F.lit("search").alias("rule"), "problem")]
    for corpus, cases, rules in (("chmod", chmod, chmod_rules()), ("heldout", heldout, heldout_rules())):
        parts.append(violations(cases, rules, corpus).select(F.lit(corpus).alias("corpus"), "name", "rule", "problem"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

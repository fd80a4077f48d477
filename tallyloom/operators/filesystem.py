"""Trees as tables of paths: listing, pre-order walks, link resolution, and the sequential chmod and mkdir contracts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.modes import apply_change, mkdir_mode, parse_change

MAX_LINKS = 16


def walk_key(path: str = "path") -> Column:
    """Sorts paths in pre-order with names in byte order: by components, as / would sort after other bytes."""
    return F.split(F.col(path), "/")


def children(tree: DataFrame, parent: str) -> DataFrame:
    base = "" if parent == "/" else parent.rstrip("/")
    name = F.substr("path", F.lit(len(base) + 2))
    below = F.startswith("path", F.lit(base + "/")) & (name != "") & ~F.contains(name, F.lit("/"))
    return tree.filter(below).withColumn("name", name).orderBy("name")


def walk(tree: DataFrame, root: str) -> DataFrame:
    """Everything at or below root in pre-order, without links and without what lies below a folder that can't be listed."""
    base = root.rstrip("/") or "/"
    inside = (F.col("path") == base) | F.startswith("path", F.lit(base.rstrip("/") + "/"))
    rows = tree.filter(inside & (F.col("type") != "symlink"))
    closed = rows.filter((F.col("type") == "dir") & (F.col("mode").bitwiseAND(0o500) != 0o500)).select(F.concat(F.col("path"), F.lit("/")).alias("_closed"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    hidden = rows.select("path", F.explode(above).alias("_closed")).join(closed, "_closed", "left_semi").select("path").distinct()
    return rows.join(hidden, "path", "left_anti").orderBy(walk_key())


def resolve_links(tree: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """path, resolved: what each path leads to; null where it dangles or takes more than max_links steps."""
    here = tree.select(F.col("path").alias("_at"), F.col("type").alias("_type"), F.col("target").alias("_target"))
    open_rows = tree.select("path", F.col("path").alias("_at"))
    done = None
    for _ in range(max_links + 1):
        step = open_rows.join(here, "_at")
        ended = step.filter("_type <> 'symlink'").select("path", F.col("_at").alias("resolved"))
        done = ended if done is None else done.unionByName(ended)
        folder = F.regexp_replace("_at", "/[^/]*$", "")
        following = F.when(F.startswith("_target", F.lit("/")), F.col("_target")).otherwise(F.concat(folder, F.lit("/"), F.col("_target")))
        open_rows = step.filter("_type = 'symlink'").select("path", following.alias("_at"))
    return tree.select("path").join(done, "path", "left")


def snapshot(tree: DataFrame) -> DataFrame:
    """path, mode as four octal digits, or `link`."""
    from tallyloom.functions.modes import octal

    return tree.select("path", F.when(F.col("type") == "symlink", "link").otherwise(octal(F.col("mode").bitwiseAND(0o7777))).alias("mode"))


def chmod_arguments(argv: list[str]) -> tuple[list[str], str, list[str]]:
    """(options, mode, operands): options stand before the mode, may be bundled, and end at --."""
    options, rest = [], list(argv)
    while rest and rest[0].startswith("-") and len(rest[0]) > 1 and parse_change(rest[0]) is None:
        word = rest.pop(0)
        if word == "--":
            break
        if set(word[1:]) - set("cfvR"):
            raise ValueError(f"invalid option: {word}")
        options += [f"-{c}" for c in word[1:]]
    if not rest:
        raise ValueError("missing mode")
    if len(rest) < 2:
        raise ValueError("missing operand")
    return options, rest[0], rest[1:]


def chmod_run(tree: dict[str, dict], argv: list[str]) -> tuple[list[str], list[str], int]:
    """(reports, diagnostics, status) of one invocation on a tree (path -> type, mode, target), which it changes.

    Operands go one after the other, and a later one sees what earlier ones did. Of -c and -v the last counts. -f
    silences diagnostics and the status of failed operands.
    """
    try:
        options, mode, operands = chmod_arguments(argv)
    except ValueError as e:
        return [], [f"chmod: {e}"], 1
    change = parse_change(mode)
    if change is None:
        return [], [f"chmod: invalid mode: '{mode}'"], 1
    report = next((o for o in reversed(options) if o in ("-c", "-v")), None)
    out, errors, failed = [], [], False

    def text(m: int) -> str:
        letters = "".join("".join((c if m >> s & b else "-") for c, b in (("r", 4), ("w", 2))) + (("s" if x == "s" else x) if m & special and m >> s & 1 else x.upper() if m & special else "x" if m >> s & 1 else "-") for s, special, x in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")))
        return f"{m:04o} ({letters})"

    def one(path: str) -> None:
        entry = tree[path]
        old = entry["mode"]
        entry["mode"] = apply_change(old, change, entry["type"] == "dir") & 0o7777
        if entry["mode"] != old and report:
            out.append(f"mode of '{path}' changed from {text(old)} to {text(entry['mode'])}")
        elif report == "-v":
            out.append(f"mode of '{path}' retained as {text(old)}")

    def visit(path: str) -> None:
        nonlocal failed
        one(path)
        if tree[path]["type"] == "dir" and "-R" in options:
            if tree[path]["mode"] & 0o500 != 0o500:
                errors.append(f"chmod: cannot read directory '{path}': Permission denied")
                failed = True
                return
            base = path.rstrip("/") + "/"
            for name in sorted((p[len(base) :] for p in tree if p.startswith(base) and "/" not in p[len(base) :]), key=str.encode):
                if tree[base + name]["type"] != "symlink":
                    visit(base + name)

    for operand in operands:
        path, hops = operand.rstrip("/") or "/", 0
        while path in tree and tree[path]["type"] == "symlink" and hops <= MAX_LINKS:
            target = tree[path]["target"]
            path, hops = target if target.startswith("/") else f"{path.rpartition('/')[0]}/{target}".lstrip("/") if "/" in path else target, hops + 1
        if path not in tree or hops > MAX_LINKS:
            errors.append(f"chmod: cannot access '{operand}': No such file or directory")
            failed = True
        else:
            visit(path)
    quiet = "-f" in options
    return out, [] if quiet else errors, int(failed and not quiet)


def mkdir_run(tree: dict[str, dict], operands: list[str], parents: bool = False, mode: str | None = None, umask: int = 0o022) -> tuple[list[str], int]:
    """(diagnostics, status) of making folders on a tree, which it changes; what can't be made doesn't stop the rest."""
    leaf = mkdir_mode(mode, umask)
    if leaf is None:
        return [f"mkdir: invalid mode '{mode}'"], 1
    errors = []

    def problem(path: str) -> str | None:
        above = path.rpartition("/")[0]
        if path in tree:
            return "File exists"
        if above and above not in tree:
            return "No such file or directory"
        if above and tree[above]["type"] != "dir":
            return "Not a directory"
        if above and tree[above]["mode"] & 0o300 != 0o300:
            return "Permission denied"
        return None

    for operand in operands:
        path = operand.rstrip("/") or "/"
        if parents:
            steps = path.split("/")
            for i in range(1, len(steps)):
                above = "/".join(steps[:i])
                if above and above not in tree and problem(above) is None:
                    tree[above] = {"type": "dir", "mode": 0o777 & ~umask | 0o300, "target": None}
            if path in tree and tree[path]["type"] == "dir":
                continue
        why = problem(path)
        if why:
            errors.append(f"mkdir: cannot create directory '{operand}': {why}")
        else:
            tree[path] = {"type": "dir", "mode": leaf, "target": None}
    return errors, int(bool(errors))


def chmod_invocations(trees: DataFrame, invocations: DataFrame) -> DataFrame:
    """id, path, mode, reports, diagnostics, status: each invocation (id, argv) on its own tree (id, path, type, mode, target), in one task each."""

    def fold(tree: pd.DataFrame, calls: pd.DataFrame) -> pd.DataFrame:
        if calls.empty:
            return pd.DataFrame(columns=["id", "path", "mode", "reports", "diagnostics", "status"])
        state = {r.path: {"type": r.type, "mode": int(r.mode), "target": r.target} for r in tree.itertuples()}
        out, errors, status = chmod_run(state, list(calls["argv"].iloc[0]))
        return pd.DataFrame([{"id": calls["id"].iloc[0], "path": p, "mode": e["mode"], "reports": out, "diagnostics": errors, "status": status} for p, e in sorted(state.items())])

    return trees.groupBy("id").cogroup(invocations.groupBy("id")).applyInPandas(fold, "id long, path string, mode int, reports array<string>, diagnostics array<string>, status int")


def created_problems(before: DataFrame, after: DataFrame, required: DataFrame, preserved: DataFrame) -> DataFrame:
    """path, problem: required folders that aren't there, and paths whose mode should have stayed but changed."""
    there = after.filter("type = 'dir'").select("path")
    missing = required.join(there, "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    modes = preserved.join(before.select("path", F.col("mode").alias("_b")), "path").join(after.select("path", F.col("mode").alias("_a")), "path", "left")
    return missing.unionByName(modes.filter("not (_a <=> _b)").select("path", F.lit("mode changed").alias("problem")))


def bad_report_lines(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """Report lines that are malformed or name a path that isn't in the tree."""
    pattern = r"^mode of '(.*)' (?:changed from [0-7]{4} \([-rwxsStT]{9}\) to|retained as) [0-7]{4} \([-rwxsStT]{9}\)$"
    rows = lines.withColumn("path", F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    return rows.join(tree.select("path"), "path", "left_anti").select("line", F.when(F.col("path").isNull(), "malformed").otherwise("unknown path").alias("problem"))

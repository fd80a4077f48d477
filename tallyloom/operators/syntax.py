"""Features of syntax trees and edit scripts that other tools made: JSON trees, and the text of a tree differ."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a location may be, kinds of nodes with an operator, names of edit actions
PLACES = ["spellingLoc", "expansionLoc", "presumedLoc"]
OPERATORS = ["UnaryOperator", "BinaryOperator", "CompoundAssignOperator"]
ACTIONS = ["insert-node", "insert-tree", "delete-node", "delete-tree", "update-node", "move-tree"]
OLD_ACTIONS = ["insert", "delete", "update", "move"]

NODES = "node int, parent int, kind string, opcode string, function string, in_source boolean, error string"


def _known(location, field: str, kind: type) -> list:
    """The field's first value in a location or the places nested in it; none if there is none."""
    spots = [location, *(location.get(p) for p in PLACES)] if isinstance(location, dict) else []
    return [s[field] for s in spots if isinstance(s, dict) and isinstance(s.get(field), kind) and not isinstance(s[field], bool)][:1]


def _inside(span, path: str, lines: int, inherited: bool) -> bool:
    """Whether a node belongs to the source: by its files if it names any, else by its lines, else as its parent."""
    ends = [span.get("begin"), span.get("end")] if isinstance(span, dict) else []
    files = [f for e in ends for f in _known(e, "file", str) if f]
    if files:
        return any(posixpath.normpath(f) == posixpath.normpath(path) for f in files)
    numbers = [n for e in ends for n in _known(e, "line", int)]
    return all(1 <= n <= lines for n in numbers) if numbers else inherited


def tree_nodes(tree, path: str, lines: int) -> Iterator[tuple[int, int | None, str | None, str | None, str | None, bool]]:
    """(node, parent, kind, opcode, function, in_source) of each object of a tree, parents first. Depth is not bounded by the stack."""
    waiting, number = [(tree, None, False, None)], 0
    while waiting:
        value, parent, inside, function = waiting.pop()
        if isinstance(value, list):
            waiting += [(v, parent, inside, function) for v in reversed(value)]
        if not isinstance(value, dict):
            continue
        inner = value.get("inner") if isinstance(value.get("inner"), list) else []
        inside = _inside(value.get("range"), path, lines, inside)
        kind = value.get("kind")
        defines = kind == "FunctionDecl" and (value.get("isThisDeclarationADefinition") is True or any(isinstance(c, dict) and c.get("kind") == "CompoundStmt" for c in inner))
        if inside and defines and isinstance(value.get("name"), str):
            function = value["name"]
        opcode = value.get("opcode") if kind in OPERATORS else None
        yield number, parent, kind if isinstance(kind, str) else None, opcode if isinstance(opcode, str) else None, function, inside
        waiting += [(c, number, inside, function) for c in reversed(inner)]
        number += 1


def ast_nodes(trees: DataFrame, by: list[str], tree: str = "tree", path: str = "path", lines: str = "lines") -> DataFrame:
    """by and a row for each node of the JSON tree of a source (its path and number of lines); one row with an error for what is no JSON."""
    kept = trees.select(*by, F.col(tree).alias("_tree"), F.col(path).alias("_path"), F.col(lines).cast("int").alias("_lines"))
    names = [f.split()[0] for f in NODES.split(", ")]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, where, n = (b.column(c)[i].as_py() for c in ("_tree", "_path", "_lines"))
                try:
                    rows = [(*r, None) for r in tree_nodes(json.loads(text or ""), where or "", n or 0)]
                except ValueError as e:
                    rows = [(None, None, None, None, None, None, str(e))]
                columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in names}
                same = b.slice(i, 1).select(by)
                repeated = [same.column(c).take(pa.array([0] * len(rows), pa.int32())) for c in by]
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([*repeated, *(pa.array(columns[c], k) for c, k in zip(names, kinds, strict=True))], [*by, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*by).schema)
    return kept.mapInArrow(flat, f"{schema}, {NODES}")


def ast_features(nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, block, feature, value: kinds of nodes and operators, by function or file; each node of the source counts once."""
    scope = F.when(F.col("function").isNotNull(), F.concat(F.lit("function."), "function")).otherwise("file")
    kind = F.concat_ws(".", scope, F.lit("kind"), "kind")
    operator = F.when(F.col("opcode").isNotNull(), F.concat_ws(".", scope, F.lit("operator"), "kind", "opcode"))
    found = nodes.filter("in_source and kind is not null").select(*by, F.explode(F.array_compact(F.array(kind, operator))).alias("feature"))
    return found.groupBy(*by, F.lit("clang").alias("block"), "feature").agg(F.count("*").cast("double").alias("value"))


def edit_action(line: Column) -> Column:
    """The edit action that a line of a tree differ's output tells of; null if none."""
    new = F.lower(F.regexp_extract(line, rf"(?i)\b({'|'.join(ACTIONS)})\b", 1))
    old = F.lower(F.regexp_extract(F.trim(line), rf"(?i)^===\s*({'|'.join(OLD_ACTIONS)})\b", 1))
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def edit_actions(diffs: DataFrame, by: list[str], output: str = "output") -> DataFrame:
    """by, action, n of each edit script."""
    lines = diffs.select(*by, F.explode(F.split(output, "\n")).alias("_line")).withColumn("action", edit_action(F.col("_line")))
    return lines.filter("action is not null").groupBy(*by, "action").agg(F.count("*").alias("n"))


def edit_magnitude(diffs: DataFrame, by: list[str], output: str = "output") -> DataFrame:
    """by, actions, magnitude, problem. diffs: exit_code, output, nodes_before, nodes_after, same (whether both sources are the same bytes).

    The magnitude is the number of actions over the larger tree; null where a tree's size isn't known or the differ failed.
    """
    counted = edit_actions(diffs, by, output).groupBy(*by).agg(F.sum("n").alias("_n"))
    out = diffs.join(counted, by, "left").withColumn("actions", F.coalesce("_n", F.lit(0)))
    failed = F.coalesce(F.col("exit_code") != 0, F.lit(True))
    known = F.col("nodes_before").isNotNull() & F.col("nodes_after").isNotNull()
    magnitude = F.when(known & ~failed, F.col("actions") / F.greatest("nodes_before", "nodes_after", F.lit(1)))
    problem = F.when(failed, F.concat(F.lit("exit status "), F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown")))).when((F.col("actions") == 0) & ~F.col("same"), "no edit action was found")
    return out.select(*by, "actions", magnitude.alias("magnitude"), problem.alias("problem"))


def source_bundle(sources: DataFrame, by: list[str], **blocks: DataFrame) -> DataFrame:
    """sources with, for each block of features, its number of nodes (<block>_nodes), features as a map, and whether it is missing."""
    out = sources
    for name, features in blocks.items():
        packed = features.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias(f"{name}_features"), F.sum("value").alias(f"{name}_nodes"))
        out = out.join(packed, by, "left").withColumn(f"{name}_missing", F.col(f"{name}_nodes").isNull())
    return out

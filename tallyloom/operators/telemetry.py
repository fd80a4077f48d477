"""Session telemetry and log text: token and tool rollups, test logs, churn."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Token kinds of a message, and the names that a count goes by in logs
TOKENS = {"input": "$.tokens.input", "output": "$.tokens.output", "reasoning": "$.tokens.reasoning", "cache_read": "$.tokens.cache.read", "cache_write": "$.tokens.cache.write", "total": "$.tokens.total"}
ALIASES = {"input_tokens": "input_tokens|prompt_tokens|inputTokens|promptTokens", "output_tokens": "output_tokens|completion_tokens|outputTokens|completionTokens", "total_tokens": "total_tokens|totalTokens"}


def message_rollup(messages: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """Of each session: assistant steps, tokens by kind, cost, duration (never negative), finishes by kind, user messages. data: JSON."""
    get = lambda path: F.get_json_object(data, path)
    assistant = get("$.role") == "assistant"
    own = lambda c: F.coalesce(F.when(assistant, c), F.lit(0))
    span = F.greatest(F.lit(0), get("$.time.completed").cast("long") - get("$.time.created").cast("long"))
    return messages.groupBy(*by).agg(
        F.count_if(assistant).alias("steps"), F.count_if(get("$.role") == "user").alias("user_messages"),
        *[F.sum(own(get(p).cast("long"))).alias(f"{n}_tokens") for n, p in TOKENS.items()],
        F.sum(own(get("$.cost").cast("double"))).alias("cost"), F.sum(own(span)).alias("duration_ms"),
        F.array_sort(F.collect_set(F.when(assistant, get("$.modelID")))).alias("models"),
    )


def part_rollup(parts: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """Of each session and part type or tool: number, characters, errors and milliseconds (only spans that end after they start)."""
    get = lambda path: F.get_json_object(data, path)
    start, end = get("$.state.time.start").cast("long"), get("$.state.time.end").cast("long")
    return parts.groupBy(*by, get("$.type").alias("type"), get("$.tool").alias("tool")).agg(
        F.count("*").alias("n"), F.sum(F.length(F.coalesce(get("$.text"), F.lit("")))).alias("chars"),
        F.count_if(get("$.state.status") == "error").alias("errors"), F.sum(F.when(end >= start, end - start).otherwise(0)).alias("ms"),
    )


def tool_totals(rollup: DataFrame) -> DataFrame:
    """The sum over sessions by tool."""
    return rollup.filter("tool is not null").groupBy("tool").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "ms")])


def with_ordinal(sessions: DataFrame, by: list[str], created: str, session: str) -> DataFrame:
    return sessions.withColumn("loop", F.row_number().over(Window.partitionBy(*by).orderBy(created, session)) - 1)


def _last_section(text: str, mark: str) -> Column:
    return F.element_at(F.split(F.col(text), mark, -1), -1)


def test_log(logs: DataFrame, text: str) -> DataFrame:
    """run, failures, errors, passed and whether OK, of what follows the last validation mark."""
    part = _last_section(text, r"===== VALIDATION LOOP [0-9]+:[^\n]*=====")
    number = lambda pattern: F.try_to_number(F.nullif(F.regexp_extract(part, pattern, 1), F.lit("")), F.lit("999999999")).cast("long")
    ran, bad, broken = number(r"Ran ([0-9]+) tests?"), number(r"failures=([0-9]+)"), number(r"errors=([0-9]+)")
    out = logs.withColumns({"tests_run": ran, "failures": F.coalesce(bad, F.lit(0)), "errors": F.coalesce(broken, F.lit(0)), "ok": part.rlike(r"(?m)^OK")})
    return out.withColumn("passed", F.greatest(F.lit(0), F.col("tests_run") - F.col("failures") - F.col("errors")))


def log_tokens(logs: DataFrame, by: list[str], text: str) -> DataFrame:
    """input, output and total tokens: in each invocation's section the largest number of each kind, then summed; total falls back to the sum."""
    sections = logs.select(*by, F.posexplode(F.split(F.col(text), r"===== LLM INVOCATION [0-9]+[^\n]*", -1)).alias("_s", "_t"))
    most = {k: F.array_max(F.transform(F.regexp_extract_all("_t", F.lit(rf'"?(?:{names})"?\s*[:=]\s*([0-9]+)'), F.lit(1)), lambda x: x.cast("long"))) for k, names in ALIASES.items()}
    rows = sections.withColumns(most)
    rows = rows.withColumn("total_tokens", F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens")))
    return rows.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ALIASES])


def test_failures(logs: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, kind, name, detail: failures of the last section, by the first of suite, unit-test and compiler patterns that finds any."""
    part = _last_section(text, r"===== VALIDATION LOOP [0-9]+:[^\n]*=====")
    kinds = {"suite": r"(?m)^(?:FAIL|TIMEOUT|SANITIZER|CRASH)\s+(\S+)", "unittest": r"(?m)^(?:FAIL|ERROR): (\S+)", "compiler": r"(?m)^(\S+:[0-9]+:[0-9]+): (?:fatal )?error: "}

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(part, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    arrays = [named(k, p) for k, p in kinds.items()]
    first = F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])
    return logs.select(*by, F.posexplode(first).alias("ord", "_x")).select(*by, "ord", "_x.kind", "_x.name")


def change_metrics(numstat: DataFrame, by: list[str]) -> DataFrame:
    """added, deleted and files of numstat rows (added, deleted, path as strings); a dash counts as nothing."""
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0))
    return numstat.groupBy(*by).agg(F.sum(number("added")).alias("added"), F.sum(number("deleted")).alias("deleted"), F.count("*").alias("files"))


def line_churn(pairs: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """added, deleted lines of each pair of texts, as the standard library's ndiff counts them."""
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pairs.select(*by).schema)

    def churn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for a, b in zip(p["_a"], p["_b"], strict=True):
                marks = [x[:2] for x in difflib.ndiff((a or "").splitlines(), (b or "").splitlines())]
                rows.append((marks.count("+ "), marks.count("- ")))
            yield p[by].assign(added=[r[0] for r in rows], deleted=[r[1] for r in rows])

    return pairs.select(*by, F.col(before).alias("_a"), F.col(after).alias("_b")).mapInPandas(churn, kinds + "added long, deleted long")

"""Feature tables of C sources, by Arrow batches: lexer features, functions, token streams and tree distances."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import csource


def source_features(sources: DataFrame, run: str = "run", source: str = "source") -> DataFrame:
    """run, block, feature, value of every source; null sources have none."""

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(r, b, f, float(n)) for r, s in zip(p["run"], p["source"], strict=True) if s is not None for (b, f), n in csource.features(s).items()]
            yield pd.DataFrame(rows, columns=["run", "block", "feature", "value"])

    return sources.select(F.col(run).cast("string").alias("run"), F.col(source).alias("source")).mapInPandas(extract, "run string, block string, feature string, value double")


def function_table(sources: DataFrame, run: str = "run", source: str = "source") -> DataFrame:
    """run, name, start_byte, end_byte, sha256, calls of every function."""

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(r, f.name, f.start, f.end, f.sha256, f.calls) for r, s in zip(p["run"], p["source"], strict=True) if s is not None for f in csource.functions(s)]
            yield pd.DataFrame(rows, columns=["run", "name", "start_byte", "end_byte", "sha256", "calls"])

    return sources.select(F.col(run).cast("string").alias("run"), F.col(source).alias("source")).mapInPandas(extract, "run string, name string, start_byte int, end_byte int, sha256 string, calls array<string>")


def with_streams(sources: DataFrame, source: str = "source") -> DataFrame:
    """sources with `stream`, the abstract token stream, and its descriptors."""

    @F.pandas_udf("array<string>")
    def stream(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else csource.abstract_stream(x))

    @F.pandas_udf("fixed_arrays int, subscripts int")
    def shape(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([csource.descriptors(x or "") for x in s], columns=["fixed_arrays", "subscripts"])

    return sources.withColumn("stream", stream(source)).withColumn("descriptors", shape(source))


def tree_distances(pairs: DataFrame, left: str, right: str, max_nodes: int = 20_000) -> DataFrame:
    """pairs with `tree_distance`; null above max_nodes."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else csource.tree_distance(x, y, max_nodes) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.withColumn("tree_distance", distance(left, right))


def strategy_functions(changes: DataFrame, baseline: DataFrame, parser: str = r"(?i)(parse|arg|opt|usage)", forced: list[str] = ()) -> DataFrame:
    """run, name, kind of behavioral functions: created and edited ones (run, name, kind), and the baseline's (name) for every run.

    Names like a parser's don't count unless they are forced.
    """
    behavioral = ~F.col("name").rlike(parser) | F.col("name").isin(list(forced))
    every = changes.select("run").distinct().join(F.broadcast(baseline.select("name").distinct()), F.lit(True)).select("run", "name", F.lit("baseline").alias("kind"))
    return changes.filter(F.col("kind").isin("created", "edited")).select("run", "name", "kind").unionByName(every).filter(behavioral)


def strategy_features(delta: DataFrame, allowed: DataFrame, canonical: DataFrame) -> DataFrame:
    """Features function.<name>.<rest> whose name, made canonical (run, name, canonical), is allowed (run, name); summed."""
    name, rest = F.regexp_extract("feature", r"^function\.([^.]+)\.(.+)$", 1), F.regexp_extract("feature", r"^function\.([^.]+)\.(.+)$", 2)
    rows = delta.withColumn("name", name).withColumn("_rest", rest).filter("name <> ''").join(canonical, ["run", "name"], "left")
    rows = rows.withColumn("name", F.coalesce("canonical", "name")).join(allowed.select("run", "name").distinct(), ["run", "name"], "left_semi")
    return rows.groupBy("run", F.concat(F.lit("function."), "name", F.lit("."), "_rest").alias("feature")).agg(F.sum("value").alias("value"))

"""Configurations as VARIANT columns: canonical text and fingerprints, settings by precedence, and where a run departs from what was recorded for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.report import SIGNATURE_EXEMPT

DEFAULT_THRESHOLD = 0.30
# Settings, and the names that they are recorded under: frozen as a whole, or one by one
FROZEN = {
    "architecture_threshold": "architecture_threshold", "strategy_threshold": "strategy_threshold", "diversity_k_max": "fixed_diversity_k", "strategy_exclude_regex": "strategy_exclusion_regex",
    "strategy_include_functions": "strategy_include_functions", "strategy_main_included": "include_main", "clang_extra_args": "clang_extra_arguments", "threshold_sensitivity": "threshold_sensitivity",
    "bootstrap_repetitions": "bootstrap_repetitions", "bootstrap_seed": "bootstrap_seed",
}
RECORDED = ["architecture_threshold", "strategy_threshold", "diversity_k_max", "strategy_exclude_regex", "strategy_include_functions", "strategy_main_included", "clang_extra_args"]
# What counts as recorded where nothing is, as JSON; the other settings must be there
IMPLIED = {"strategy_include_functions": "[]", "strategy_main_included": "true", "clang_extra_args": "[]"}


def _ascii(text: Column) -> Column:
    """JSON text with all other characters than ASCII as escapes."""

    def escaped(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        far = code - 0x10000
        pair = F.concat(escaped(F.shiftright(far, 10) + 0xD800), escaped(F.pmod(far, F.lit(0x400)) + 0xDC00))
        return F.when(code < 127, c).when(code < 0x10000, escaped(code)).otherwise(pair)

    return F.when(text.rlike("^[\\x00-\\x7e]*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def canonical(config: DataFrame, by: list[str], column: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """by and text: objects as compact JSON in ASCII, keys in order at every level, without some of the keys of the first level; numbers and control characters as Spark writes them."""
    members = config.sparkSession.tvf.variant_explode_outer(F.col(column).outer())
    exploded = config.lateralJoin(members, how="left").select(*by, "key", "value")
    kept = F.when(F.col("key").isNotNull() & ~F.col("key").isin(*leave_out), F.struct("key", F.concat(F.substring(F.to_json(F.array("key")), F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), F.to_json("value")).alias("text")))
    entries = F.array_sort(F.collect_list(kept))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: x["text"]), ","), F.lit("}"))
    return exploded.groupBy(*by).agg(text.alias("text")).withColumn("text", _ascii(F.col("text")))


def fingerprints(config: DataFrame, by: list[str], column: str, leave_out: tuple[str, ...] = SIGNATURE_EXEMPT) -> DataFrame:
    """by and fingerprint: SHA-256 of the canonical text without its own digest, the number of lineages and the output folder."""
    return canonical(config, by, column, leave_out).select(*by, F.sha2("text", 256).alias("fingerprint"))


def part(config: str, key: str) -> Column:
    """A member as a variant: null if it isn't there, a variant null if it is null."""
    return F.try_variant_get(config, f"$.{key}", "variant")


def _number(v: Column) -> Column:
    """The value of a number, null for everything else, true and false too."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def settings(configs: DataFrame, given: str = "given", recorded: str = "recorded", inherit: str = "inherit") -> DataFrame:
    """configs with the value, source and problem of architecture_threshold, strategy_threshold and diversity_k_max.

    given and recorded are variants. What is given comes first (a null is not given), then what is recorded if the run inherits (a null is recorded), then the default; the strategy's is the
    architecture's. Thresholds must be positive numbers, K a positive whole number or null; a value that isn't is null, with a problem.
    """
    out = configs
    for name, label in (("architecture_threshold", "architecture"), ("strategy_threshold", "strategy"), ("diversity_k_max", "diversity")):
        own, old = part(given, name), part(recorded, f"analysis_{name}")
        from_given = own.isNotNull() & ~F.is_variant_null(own)
        from_old = F.coalesce(F.col(inherit), F.lit(False)) & old.isNotNull()
        chosen = F.when(from_given, own).when(from_old, old)
        value, some = _number(chosen), from_given | from_old
        if name == "diversity_k_max":
            fine = F.is_variant_null(chosen) | (F.schema_of_variant(chosen) == "BIGINT") & (value >= 1)
            problem, fallback, source = "must be a positive whole number or null", F.lit(None).cast("double"), "default"
        else:
            fine = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
            problem, fallback, source = "must be a positive finite number", F.lit(DEFAULT_THRESHOLD), "default"
            if label == "strategy":
                fallback, source = F.col("architecture_threshold"), "architecture_threshold"
        fine = F.coalesce(fine, F.lit(False))
        out = out.withColumns({
            name: F.when(~some, fallback).when(fine, value), f"{name}_source": F.when(from_given, "cli").when(from_old, "experiment_metadata").otherwise(source),
            f"{name}_problem": F.when(some & ~fine, F.lit(f"{label}: {problem}")),
        })
    return out.withColumn("diversity_k_max", F.col("diversity_k_max").cast("int"))


def _same(a: Column, b: Column) -> Column:
    """Whether two variants are the same value: numbers by value, all else by canonical text; what isn't there is null."""
    none = lambda v: v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))
    x, y = _number(a), _number(b)
    return F.when(none(a) | none(b), none(a) & none(b)).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.to_json(a) == F.to_json(b))


def departures(configs: DataFrame, by: list[str], recorded: str = "recorded", resolved: str = "resolved", implied: dict[str, str] | None = None) -> DataFrame:
    """by, setting, recorded, resolved (as JSON), reason of each setting of a run that isn't as recorded.

    recorded and resolved are variants. A frozen configuration is compared as a whole; else the settings that were recorded one by one, of which some have implied values and the
    others must be there. A configuration without departures is confirmatory.
    """
    implied = IMPLIED if implied is None else implied
    frozen = part(recorded, "frozen_analysis_configuration")
    whole = F.coalesce(F.schema_of_variant(frozen).startswith("OBJECT"), F.lit(False))
    entry = lambda name, old, reason: F.struct(F.lit(name).alias("setting"), old.alias("old"), part(resolved, name).alias("new"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    as_whole = [entry(s, F.try_variant_get(recorded, f"$.frozen_analysis_configuration.{k}", "variant"), none) for s, k in FROZEN.items()]
    single = []
    for s in RECORDED:
        old = part(recorded, f"analysis_{s}")
        missing = none if s in implied else F.when(old.isNull(), "missing recorded configuration")
        single.append(entry(s, F.coalesce(old, F.parse_json(F.lit(implied[s]))) if s in implied else old, missing))
    rows = configs.select(*by, F.explode(F.when(whole, F.array(*as_whole)).otherwise(F.array(*single))).alias("x")).select(*by, "x.*")
    wrong = rows.filter(F.col("reason").isNotNull() | ~_same(F.col("old"), F.col("new")))
    return wrong.select(*by, "setting", F.to_json("old").alias("recorded"), F.to_json("new").alias("resolved"), "reason")

"""Configurations on variants against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tallyloom.operators import configurations as C
from tallyloom.operators.report import SIGNATURE_EXEMPT, config_fingerprint


def test_fingerprints(spark):
    rng = random.Random(5)

    def value(depth):
        if depth and rng.random() < 0.4:
            return {rng.choice("abcé\"") + str(k): value(depth - 1) for k in range(rng.randint(0, 3))} if rng.random() < 0.6 else [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, False, 0, -7, 1 << 40, 0.25, -1.5, "", "text", "ü😀\\ \" /\n\t", "\x7f"])

    configs = [{**{k: value(3) for k in rng.sample(["model", "stages", "é", "a.b", "Z", "n"], rng.randint(0, 6))}, **{k: rng.random() for k in SIGNATURE_EXEMPT if rng.random() < 0.5}} for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, c in enumerate(configs)], "id int, text string")
    rows = rows.select("id", F.parse_json("text").alias("config"))
    got = {r.id: r.fingerprint for r in C.fingerprints(rows, ["id"], "config").collect()}
    assert got == {i: config_fingerprint(c) for i, c in enumerate(configs)}
    assert got[0] == hashlib.sha256(json.dumps({k: v for k, v in configs[0].items() if k not in SIGNATURE_EXEMPT}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_settings(spark):
    cases = [
        ("{}", "{}", True, (0.3, "default", None), (0.3, "architecture_threshold", None), (None, "default", None)),
        ('{"architecture_threshold": 1, "strategy_threshold": 0.2, "diversity_k_max": 4}', "{}", True, (1.0, "cli", None), (0.2, "cli", None), (4, "cli", None)),
        ("{}", '{"analysis_architecture_threshold": 0.5, "analysis_diversity_k_max": null}', True, (0.5, "experiment_metadata", None), (0.5, "architecture_threshold", None), (None, "experiment_metadata", None)),
        ("{}", '{"analysis_architecture_threshold": 0.5}', None, (0.3, "default", None), (0.3, "architecture_threshold", None), (None, "default", None)),
        ('{"architecture_threshold": 0}', "{}", True, (None, "cli", "architecture"), (None, "architecture_threshold", None), (None, "default", None)),
        ("{}", '{"analysis_architecture_threshold": null, "analysis_strategy_threshold": "0.3", "analysis_diversity_k_max": 2.5}', True, (None, "experiment_metadata", "architecture"), (None, "experiment_metadata", "strategy"), (None, "experiment_metadata", "diversity")),
        ('{"diversity_k_max": true, "strategy_threshold": -1e400}', "{}", True, (0.3, "default", None), (None, "cli", "strategy"), (None, "cli", "diversity")),
    ]
    cases = [c for c in cases if "e400" not in c[0]]  # no number of JSON
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, given string, recorded string, inherit boolean")
    rows = rows.withColumns({c: F.parse_json(c) for c in ("given", "recorded")})
    got = {r.id: r for r in C.settings(rows).drop("given", "recorded").collect()}
    for i, c in enumerate(cases):
        for name, (value, source, wrong) in zip(("architecture_threshold", "strategy_threshold", "diversity_k_max"), c[3:], strict=True):
            problem = got[i][f"{name}_problem"]
            assert (got[i][name], got[i][f"{name}_source"], problem and problem.split(":")[0]) == (value, source, wrong)


def test_departures(spark):
    full = {s: 1 for s in C.FROZEN}
    resolved = {**full, "threshold_sensitivity": {"b": [1.0], "a": None}, "strategy_include_functions": [], "strategy_main_included": True, "clang_extra_args": []}
    frozen = {k: resolved[s] for s, k in C.FROZEN.items()}
    rows = [
        (0, {"frozen_analysis_configuration": frozen}, resolved), (1, {"frozen_analysis_configuration": {**frozen, "fixed_diversity_k": None}}, resolved), (2, {"frozen_analysis_configuration": {}}, {}),
        (3, {f"analysis_{s}": resolved[s] for s in C.RECORDED}, resolved), (4, {"frozen_analysis_configuration": None}, resolved),
    ]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in rows], "id int, recorded string, resolved string").withColumns({c: F.parse_json(c) for c in ("recorded", "resolved")})
    got = {}
    for r in C.departures(df, ["id"]).collect():
        got.setdefault(r.id, {})[r.setting] = (r.recorded, r.resolved, r.reason)
    assert set(got) == {1, 4} and got[1] == {"diversity_k_max": ("null", "1", None)}
    assert got[4] == {s: (None, "1", "missing recorded configuration") for s in ("architecture_threshold", "strategy_threshold", "diversity_k_max", "strategy_exclude_regex")}

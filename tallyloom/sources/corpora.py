"""Seeded line corpora for tests of line operators. All are made by rule; the same seed gives the same bytes."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession


def corpora(seed: int = 20260723) -> dict[str, bytes]:
    rng = random.Random(seed)
    fruit = [f"{a}{b}" for a in ("ap", "Ap", "ba", "fi", "KI") for b in ("ple", "nana", "g", "WI")]
    lines = lambda xs: "".join(f"{x}\n" for x in xs).encode()
    numbers = ["", "0", "-0", "+1", "1e3", "1.50", "-2", "007", "10", "9", "1" * 30, "inf", "nan", "x"]
    return {
        "generic": lines(rng.choices(fruit, k=30)),
        "ties": lines([x for x in fruit[:5] for _ in range(3)]),
        "numbers": lines(numbers),
        "sizes": lines(["1K", "1M", "2", "900", "-1K", "1G", "512k"]),
        "months": lines(["mar", "JAN", " feb", "xyz", "Dec", ""]),
        "versions": lines(["a1.10", "a1.9", "a1.010", "b", "a"]),
        "fields": lines([f"{rng.randint(0, 9)}:{rng.choice('xyz')}\t{rng.randint(0, 99)}" for _ in range(20)]),
        "presorted": lines(sorted(fruit)), "reversed": lines(sorted(fruit, reverse=True)),
        "nul_records": b"b\nx\0a\0c\0", "empty": b"", "blanks": b"  \n\t\n \n", "no_newline": b"b\na", "nul_bytes": b"a\0b\n\0\n", "not_utf8": b"\xff\n\xfe\n\x80a\n", "crlf": b"b\r\na\r\n",
        "huge_line": b"z" * (1 << 20) + b"\na\n", "many_lines": lines(rng.randrange(10**6) for _ in range(20_000)), "wide": b":".join(str(i).encode() for i in range(10_000)) + b"\n",
    }


def corpus_frame(spark: SparkSession, seed: int = 20260723) -> DataFrame:
    """name, content of all corpora."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in corpora(seed).items()], "name string, content binary")

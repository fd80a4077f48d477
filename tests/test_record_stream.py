"""The stream of lineage records gives the batch's rows, with events out of order, replayed, and after a restart."""

import random

from pyspark.sql import functions as F

from tallyloom.operators.records import interrupted, record_state
from tallyloom.streaming import records

EVENT = "lineage int, kind string, checkpoint string, success boolean, reason string, s long"


def events(rng):
    rows = []
    for lineage in range(40):
        t = rng.randint(0, 500)
        rows.append((lineage, "init", None, None, None, t))
        for c in ("a", "b", "c", "other"):
            for _ in range(rng.choice([0, 1, 1, 2])):  # a checkpoint may run again
                t += rng.randint(1, 300)
                ok = rng.random() < 0.8
                rows.append((lineage, "stage", c, ok if ok or rng.random() < 0.7 else None, None if ok else rng.choice(["tests", None]), t))
        if rng.random() < 0.4:
            won = rng.random() < 0.5
            rows.append((lineage, "finish", None if won else rng.choice(["c", None]), won, None if won else "gave up", t + 5))
    rows += [(100, "init", None, None, None, 10), (100, "stage", "a", True, None, 20)]  # nothing more is heard of this one
    return rows


def test_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = events(rng)
    clock = [(900, "init", None, None, None, 100_000 + i) for i in range(2)]  # event time goes on
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "checkpoint string, pos int")
    timed = lambda rows: spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds("s")).drop("s")

    def put(rows, i):
        timed(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))

    def run():
        stream = spark.readStream.schema(timed([]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        found = records.record_stream(stream, order, patience="3 hours", late="2 days")
        query = records.write_records(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination(240)
        assert query.exception() is None

    def same(now=None):
        every = timed(seen)
        want = record_state(every, order)
        if now is not None:
            want = interrupted(want, F.timestamp_seconds(F.lit(now)), "3 hours")
        columns = sorted(want.columns)
        rows = lambda df: sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
        got = records.read_records(spark, str(tmp_path / "out"))
        assert rows(got) == rows(want)

    rng.shuffle(rows)  # out of order within what may be late
    seen = rows[:60]
    put(rows[:30], 0)
    put(rows[30:60], 1)
    run()
    same()
    seen = rows
    put(rows[40:120] + rows[:10], 2)  # a replay, and new events, after a restart
    put(rows[120:], 3)
    run()
    same()
    seen = rows + [clock[0], (100, "stage", "a", True, None, 20)]
    put(seen[-2:], 4)
    run()
    same()
    late = (101, "init", None, None, None, 400_000)  # now event time is two days beyond the rest
    seen = seen + [late]
    put([late], 5)
    run()
    same(400_000 - 2 * 86400)
    state = {r.lineage: r.state for r in records.read_records(spark, str(tmp_path / "out")).collect()}
    assert state[100] == "controller_interrupted" and state[101] == "running"
    back = (100, "finish", None, True, None, 400_001)  # it comes back after all
    seen = seen + [back]
    put([back], 6)
    run()
    same(400_001 - 2 * 86400)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != records.PROVIDER

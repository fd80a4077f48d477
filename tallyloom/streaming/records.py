"""Lineage records as a stream of events: the rows of `operators.records.record_state`, kept up to date with a state for each lineage.

What a record holds is a set of largest and smallest values (the last stage of each checkpoint, the last failure, the last finish), so events may come in any order and more than
once. A lineage that is still running when event time has gone `patience` beyond its last event is reported as interrupted, by a timer; an event that comes after all sets it running again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

LAST = (1 << 31) - 1  # the place of an undeclared checkpoint


def _struct(*fields: tuple[str, str]) -> StructType:
    """A schema that needs no session."""
    out = StructType()
    for name, kind in fields:
        out = out.add(name, kind)
    return out


RECORD = _struct(
    ("started", "long"), ("updated", "long"), ("failed_ts", "long"), ("failed_checkpoint", "string"), ("failed_reason", "string"), ("ended_ts", "long"), ("ended_success", "boolean"),
    ("ended_checkpoint", "string"), ("ended_reason", "string"), ("version", "long"),
)
STAGE = _struct(("ts", "long"), ("success", "boolean"))
PLACE = _struct(("checkpoint", "string"))
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(values: tuple) -> tuple:
    """Nulls before all else, as Spark orders structs."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


class Lifecycle(StatefulProcessor):
    """order: the place of each declared checkpoint. patience: microseconds."""

    def __init__(self, order: dict[str, int], patience: int):
        self.order, self.patience = order, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.stages = handle.getMapState("stages", PLACE, STAGE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        r = self.record.get() if self.record.exists() else (None,) * 9 + (0,)
        started, updated, failed, ended, version = r[0], r[1], tuple(r[2:5]), tuple(r[5:9]), r[9]
        for e in rows:
            updated = e.ts if updated is None else max(updated, e.ts)
            if e.kind == "init":
                started = e.ts if started is None else min(started, e.ts)
            elif e.kind == "finish":
                ended = max(ended, (e.ts, e.success, e.checkpoint, e.reason), key=_order)
            elif e.kind == "stage":
                if not e.success:
                    failed = max(failed, (e.ts, e.checkpoint, "unknown" if e.reason is None else e.reason), key=_order)
                if e.checkpoint is not None:
                    place, now = (e.checkpoint,), (e.ts, e.success)
                    if not self.stages.containsKey(place) or _order(tuple(self.stages.getValue(place))) < _order(now):
                        self.stages.updateValue(place, now)
        self.record.update((started, updated, *failed, *ended, version + 1))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        state = self._state(failed, ended)
        if state == "running":
            self.handle.registerTimer((updated + self.patience) // 1000)
        yield self._row(key, state, started, updated, failed, ended, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        r = self.record.get()
        failed, ended = tuple(r[2:5]), tuple(r[5:9])
        if self._state(failed, ended) == "running":
            self.record.update((*r[:9], r[9] + 1))
            yield self._row(key, "controller_interrupted", r[0], r[1], failed, ended, r[9] + 1)

    def close(self) -> None:
        pass

    @staticmethod
    def _state(failed: tuple, ended: tuple) -> str:
        if ended[0] is not None:
            return "completed" if ended[1] else "stopped"
        return "stopped" if failed[0] is not None else "running"

    def _row(self, key, state, started, updated, failed, ended, version) -> Row:
        passed = [(self.order.get(c[0], LAST), c[0]) for c, s in self.stages.iterator() if s[1]]
        lost = state != "completed"
        first = lambda a, b: a if a is not None else b
        return Row(
            lineage=key[0], state=state, checkpoints_completed=len(passed), completed_ids=[c for _, c in sorted(passed)], failure_stage=first(ended[2], failed[1]) if lost else None,
            failure_reason=first(ended[3], failed[2]) if lost else None, started=started, updated=updated, finished=first(ended[0], failed[0]), version=version,
        )


def record_stream(events: DataFrame, order: DataFrame, patience: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A row for each lineage that changed. events: a stream of lineage, kind, checkpoint, success, reason, ts (timestamp); order (checkpoint, pos) is a short list.

    Events more than `late` behind the latest ones are dropped, as event time decides about interruptions.
    """
    spark = events.sparkSession
    wait = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval '{patience}')").first()[0]
    places = {r["checkpoint"]: r["pos"] for r in order.collect()}
    timed = events.filter("lineage is not null and ts is not null").withWatermark("ts", late)
    kind = dict(events.dtypes)["lineage"]
    rows = timed.select("lineage", "kind", "checkpoint", "success", "reason", F.col("ts").alias("event_time"), F.unix_micros("ts").alias("ts"))
    schema = f"lineage {kind}, state string, checkpoints_completed int, completed_ids array<string>, failure_stage string, failure_reason string, started long, updated long, finished long, version long"
    out = rows.groupBy("lineage").transformWithState(Lifecycle(places, wait), schema, "Update", "EventTime")
    return out.withColumns({f"{c}_at": F.timestamp_micros(c) for c in ("started", "updated", "finished")}).drop("started", "updated", "finished")


@contextmanager
def _provider(spark: SparkSession) -> Iterator[None]:
    """The state store that such states need, while a query starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_records(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing the stream's batches below path; a batch that runs again after a failure replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _provider(stream.sparkSession):
        return stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each lineage."""
    nth = F.row_number().over(Window.partitionBy("lineage").orderBy(F.desc("version")))
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").withColumn("_n", nth).filter("_n = 1").drop("_n", "version", "batch")

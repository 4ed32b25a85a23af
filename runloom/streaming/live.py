"""Run history kept up to date from streams of fact files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.history import TRANSITIONS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("event_no", T.LongType()), T.StructField("state", T.StringType())])
LATEST = T.StructType([T.StructField("tasks", T.ArrayType(TRANSITION))])
#: Into so many groups (run, task) are dealt; each has its latest events in one value.
BUCKETS = 1 << 14
LIVE = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("event_no", T.LongType()), T.StructField("state", T.StringType()), T.StructField("violation", T.StringType())])


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """Stream of transition facts from JSON files."""
    return spark.readStream.schema(TRANSITION).option("recursiveFileLookup", True).json(path)


def _processor():
    from pyspark.sql.streaming import StatefulProcessor

    made = Row(*LIVE.names)

    class LiveState(StatefulProcessor):
        """Keeps the latest event of each (run, task) of one bucket; late and repeated events change nothing."""

        def init(self, handle) -> None:
            self.latest = handle.getValueState("latest", LATEST)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
            got: dict[tuple, dict[int, str]] = {}
            for row in rows:
                got.setdefault((row.run_id, row.task_id), {}).setdefault(row.event_no, row.state)
            was = self.latest.get()
            known = {(run, task): (no, state) for run, task, no, state in (was[0] if was else ())}
            changed = False
            for group, events in got.items():
                no, state = known.get(group, (-1, "pending"))
                for event in sorted(events):
                    if event <= no:
                        continue
                    new = events[event]
                    wrong = new != state and (state, new) not in TRANSITIONS
                    yield made(*group, event, new, f"{state}>{new}" if wrong else None)
                    no, state = event, new
                    known[group], changed = (no, state), True
            if changed:
                self.latest.update(([(*group, *last) for group, last in known.items()],))

        def close(self) -> None:
            pass

    return LiveState()


def live_state(transitions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Every applied event with the state it leads to and the violation it is, if any.

    The last row of a (run, task) is its current state. Events are applied in order of their number
    within a batch; one whose number isn't above the last applied is ignored, so a file that is listed
    again changes nothing. Needs the RocksDB state store (``STATE_STORE``).

    A key of the state store is a bucket of (run, task) by their hash, which costs three messages a batch, however many
    of them it holds; all that a bucket holds is written anew when one of them changes. ``buckets`` can't be changed
    for a stream that has begun.
    """
    dealt = transitions.withColumn("bucket", F.pmod(F.xxhash64("run_id", "task_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithState(_processor(), outputStructType=LIVE, outputMode="Append", timeMode="None")


def open_attempts(started: DataFrame, finished: DataFrame, delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Attempts that nothing finished within ``within``, once the watermark has passed.

    ``started``: attempt_id, started_at; ``finished``: finished_id, ended_at (timestamps). A stream-stream
    left outer join bounded in time, so state is dropped as the watermark moves.
    """
    s, f = started.withWatermark("started_at", delay), finished.withWatermark("ended_at", delay)
    on = F.expr(f"attempt_id = finished_id AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {within}")
    return s.join(f, on, "left_outer").where("finished_id IS NULL").select("attempt_id", "started_at")

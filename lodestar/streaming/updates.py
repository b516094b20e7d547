"""Change files as a stream, and progress lines folded into monotone percentages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import name_in_line, progress_marker

STEP = 0.01


def _targets(lines: DataFrame) -> DataFrame:
    return lines.select("run", "pos", "start_pct", "stage_pct", "expected", progress_marker(F.col("line")).alias("m"), name_in_line(F.col("line")).alias("name")).select(
        "run", "pos", "start_pct", "stage_pct", "expected", F.col("m.current").alias("current"), F.col("m.total").alias("total"), "name"
    )


def progress(lines: DataFrame) -> DataFrame:
    """lines: run, pos, line, start_pct, stage_pct, expected (people). Rows (run, pos, percent, name) that a run emits.

    A marker gives its share of the stage; a line that names a new person gives the share of people seen.
    Percentages are kept inside the stage, and one is emitted only if it is more than the last by over STEP.
    Only a target above all before it can be emitted, so those alone are folded, in order, inside one row a run;
    steps of STEP bound what a run emits."""
    along = Window.partitionBy("run").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(Window.partitionBy("run", "name").orderBy("pos")) == 1
    rows = _targets(lines).withColumn("new", F.col("name").isNotNull() & first).withColumn("seen", F.count_if("new").over(upto))
    share = F.when(F.col("total").isNotNull(), F.col("current") / F.col("total")).when(F.col("new"), F.col("seen") / F.greatest("expected", F.lit(1)))
    rows = rows.withColumn("share", share).where("share is not null")
    rows = rows.withColumn("percent", F.least(F.greatest(F.col("start_pct") + F.col("share") * F.col("stage_pct"), "start_pct"), F.col("start_pct") + F.col("stage_pct")))
    before = F.coalesce(F.max("percent").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rising = rows.withColumn("before", before).where("percent > before").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "percent", "name"))).alias("x"))
    none = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<struct<pos:bigint,percent:double,name:string>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        up = x["percent"] > state["last"] + STEP
        return F.struct(F.when(up, x["percent"]).otherwise(state["last"]).alias("last"), F.when(up, F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out"))

    return rising.select("run", F.inline(F.aggregate("x", none, add, lambda state: state["out"])))


class _Progress(StatefulProcessor):
    """A run's names as a map, its last percentage and the number of people seen as a value; a run that stays silent is forgotten."""

    def __init__(self, silent_ms: int | None) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "seen boolean")
        self.at = handle.getValueState("at", "last double, seen long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen, timer = self.at.get() if self.at.exists() else (0.0, 0, -1)
        given = pd.concat(list(rows)).sort_values("pos")
        # A look-up for each different name of the batch, whatever the run has seen before.
        new = {n for n in given["name"].dropna().unique() if not self.names.containsKey((n,))}
        # What has no marker and no name that is new for the run changes nothing.
        first = given["name"].isin(new) & ~given["name"].duplicated()
        out = []
        for r in given[given["total"].notna() | first].itertuples(index=False):
            known = r.name if isinstance(r.name, str) else None
            target = None
            fresh = known in new
            if fresh:
                new.discard(known)
                self.names.updateValue((known,), (True,))
                seen += 1
            if pd.notna(r.total):
                target = r.start_pct + r.current / r.total * r.stage_pct
            elif fresh:
                target = r.start_pct + seen / max(r.expected, 1) * r.stage_pct
            if target is not None:
                percent = min(max(target, r.start_pct), r.start_pct + r.stage_pct)
                if percent > last + STEP:
                    last = percent
                    out.append((key[0], r.pos, percent, known))
        if self.silent_ms is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
            self.handle.registerTimer(timer)
        self.at.update((last, seen, timer))
        yield pd.DataFrame(out, columns=["run", "pos", "percent", "name"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.names.clear()
        self.at.clear()
        yield pd.DataFrame([], columns=["run", "pos", "percent", "name"])

    def close(self) -> None:
        pass


def progress_stream(lines: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """The same as a stream with keyed state: a batch touches the names that it brings, not all that a run has seen.

    silent_ms: a run that brings no line for so long is forgotten. It is for streams that go on: with a timer Spark never ends one that
    reads what is there (``availableNow``). Lines of a run must come in order from batch to batch; lines is read by a ``state_session``."""
    run = lines.schema["run"].dataType.simpleString()
    mode = "none" if silent_ms is None else "processingTime"
    telling = _targets(lines).where("total IS NOT NULL OR name IS NOT NULL")
    return telling.groupBy("run").transformWithStateInPandas(_Progress(silent_ms), f"run {run}, pos long, percent double, name string", "append", mode)


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own, with the state store that keyed state needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type in tumbling windows with a watermark (an extension; works on streams and tables)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

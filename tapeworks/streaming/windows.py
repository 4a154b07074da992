"""Per-row windows and islands over Structured Streaming, and a runner for streams that arrive in parts.

State is kept by session. Rows are put in order within a micro-batch; one that comes before a row already answered is
refused, as the batch forms never look ahead either. A window's rows are a list that a batch appends to and that is written
anew only when most of it has left the window, so a batch writes about as much as it brings. With `idle` a session that
has had no row for so long is forgotten, by an event-time timer, once the watermark has passed it.

Rows of a session that lie in one Arrow batch travel as one row of arrays, there and back, and a session asks for its state
in few calls: what a stream costs is the work of its rows and not a frame and a dozen calls a session.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeworks.sources.shared import shared_path

ROLLING = "session_id long, seq long, ts_ns long, total long, events long"
ISLANDS = "session_id long, seq long, ts_ns long, island long"
VALUED = ["session_id", "seq", "ts_ns", "value"]
MS = 1_000_000
#: How many results a session hands on as one row.
HANDED = 4096


class Ordered(StatefulProcessor):
    """A session's rows in order, with the place of the last one and, if sessions can go idle, the timer that ends them.

    Each call to the state goes to the executor and back. What is small and written by every batch can be declared in
    `kept` and travels with the place of the last row.
    """

    kept = ""

    def __init__(self, idle_ns: int | None = None):
        self.idle_ns = idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ns long, seq long, timer long" + self.kept)

    def load(self, known: bool, *kept):
        """What is held of the session, from the state if it is known, and from what was kept with its last row."""
        raise NotImplementedError

    def save(self, held) -> tuple | None:
        """Writes back what has changed; gives what is to be kept with the last row."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clears what is held of the session."""
        raise NotImplementedError

    def step(self, held, session_id, seq, ts_ns, *values) -> tuple:
        """The result of a row; changes what is held."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.last.get()
        *last, timer = (stored or (-1, -1, None))[:3]
        held, last, out = self.load(stored is not None, *(stored or ())[3:]), tuple(last), []
        unpacked = [values for r in rows for values in zip(*r[1 : self.packed + 1])]
        for seq, ts_ns, *values in sorted(unpacked, key=lambda r: (r[1], r[0])):
            now = (int(ts_ns), int(seq))
            if now <= last:
                raise ValueError(f"session {key[0]}: row {now} after {last}")
            last = now
            out.append(self.step(held, key[0], now[1], now[0], *values))
        kept = self.save(held) or ()
        if self.idle_ns is not None:
            end = -(-(last[0] + self.idle_ns) // MS)
            if timer is not None and timer != end:
                self.handle.deleteTimer(timer)
            if timer != end:
                self.handle.registerTimer(end)
            timer = end
        self.last.update((*last, timer, *kept))
        for k in range(0, len(out), HANDED):
            yield Row(rows=out[k : k + HANDED])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Rolling(Ordered):
    def __init__(self, window_ns: int, idle_ns: int | None = None):
        super().__init__(idle_ns)
        self.window_ns = window_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = handle.getListState("rows", "ts_ns long, value long")
        self.gone = handle.getValueState("gone", "rows long")  # how many at the list's head have left the window

    def load(self, known: bool) -> dict:
        gone = (self.gone.get() or (0,))[0] if known else 0
        stored = [tuple(map(int, r)) for r in self.rows.get()][gone:] if known else []
        return {"window": deque(stored), "total": sum(v for _, v in stored), "stored": len(stored), "gone": gone, "was": gone}

    def step(self, held, session_id, seq, t, value):
        window, value = held["window"], int(value)
        while window and window[0][0] <= t - self.window_ns:
            held["total"] -= window.popleft()[1]
            if held["stored"]:
                held["stored"], held["gone"] = held["stored"] - 1, held["gone"] + 1
        window.append((t, value))
        held["total"] += value
        return session_id, seq, t, held["total"], len(window)

    def save(self, held) -> None:
        window, stored, gone = list(held["window"]), held["stored"], held["gone"]
        if gone > len(window):
            self.rows.put(window)
            gone = 0
        elif window[stored:]:
            self.rows.appendList(window[stored:])
        if gone != held["was"]:
            self.gone.update((gone,))

    def forget(self) -> None:
        self.rows.clear()
        self.gone.clear()


class _Islands(Ordered):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.island = handle.getValueState("island", "mark long, island long")

    def load(self, known: bool) -> list:
        return list(self.island.get()) if known else [None, 0]

    def step(self, held, session_id, seq, ts_ns, value):
        value = int(value)
        held[:] = value, held[1] + (held[0] != value)
        return session_id, seq, ts_ns, held[1]

    def save(self, held) -> None:
        self.island.update(tuple(held))

    def forget(self) -> None:
        self.island.clear()


def packed(rows: DataFrame) -> DataFrame:
    """(session_id, an array of every other column): the rows of a session that lie in one Arrow batch as one row."""
    by, *rest = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.Table.from_batches([batch]).group_by(by, use_threads=False).aggregate([(c, "list") for c in rest])
            yield from got.select([by, *(f"{c}_list" for c in rest)]).rename_columns([by, *rest]).to_batches()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"{by} {kinds[by]}", *(f"{c} array<{kinds[c]}>" for c in rest)]))


def by_session(rows: DataFrame, processor: Ordered, schema: str, late: str = "0 seconds") -> DataFrame:
    """Runs a processor over the sessions of a stream of (session_id, seq, ts_ns, ...). Where sessions can go idle, `late` is
    how far rows of other sessions may lag behind the latest one; rows later than that are dropped by the watermark."""
    processor.packed = len(rows.columns) - 1
    if processor.idle_ns is None:
        mode, dealt = "None", packed(rows)
    else:
        # The watermark judges single rows and belongs to their column, so these travel one by one.
        mode, by, *rest = "EventTime", *rows.columns
        timed = rows.withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))).withWatermark("event_time", late)
        dealt = timed.select(by, *(F.array(c).alias(c) for c in rest), "event_time")
    out = dealt.groupBy("session_id").transformWithState(statefulProcessor=processor, outputStructType=f"rows array<struct<{schema}>>", outputMode="Append", timeMode=mode)
    return out.select(F.inline("rows"))


def rolling_stream(rows: DataFrame, window_ns: int, idle_ns: int | None = None, late: str = "0 seconds") -> DataFrame:
    """(ROLLING) the sum and number of `value` over (t - w, t] up to each row of (session_id, seq, ts_ns, value)."""
    return by_session(rows.select(*VALUED), _Rolling(window_ns, idle_ns), ROLLING, late)


def island_stream(rows: DataFrame, idle_ns: int | None = None, late: str = "0 seconds") -> DataFrame:
    """(ISLANDS) numbers the maximal stretches of rows of equal `value`, from 1."""
    return by_session(rows.select(*VALUED), _Islands(idle_ns), ISLANDS, late)


def run_in_parts(spark: SparkSession, parts: list[DataFrame], operator: Callable[[DataFrame], DataFrame], latest_by: list[str] | None = None) -> DataFrame:
    """The results of a stream whose input arrives in parts, each part a run with the state of those before it.

    With `latest_by` the operator updates its results, and the last one of each key stands.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = shared_path(spark, "stream")
    schema = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = operator(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        schema = out.schema
        stream = out.writeStream.option("checkpointLocation", f"{base}/check").trigger(availableNow=True)
        if latest_by is None:
            stream = stream.format("parquet").outputMode("append").option("path", f"{base}/out")
        else:
            stream = stream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{base}/out/batch={k}"))
        stream.start().awaitTermination()
    if latest_by is None:
        return spark.read.schema(schema).parquet(f"{base}/out")
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(*latest_by).agg(*(F.max_by(c, "batch").alias(c) for c in schema.fieldNames() if c not in latest_by))

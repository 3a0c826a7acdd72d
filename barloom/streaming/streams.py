"""Streams: bars from ticks, first-write-wins dedupe, hourly liquidations, and alerts with a
cooldown. State is kept on the executors' disks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state on disk, and whose
    settings do not reach the caller's."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ON_DISK)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def tick_stream(spark, schema, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of events as they land, with event time as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def live_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", timeframe: str = "1h", order: Column | None = None) -> DataFrame:
    """Bars of each event type, closed once the watermark passes their end. order says which tick is
    first and which last; without it, the time and then the event's number."""
    cents = F.round(F.col("value") * 100).cast("long")
    order = F.struct("at", "event_id") if order is None else order
    return (
        ticks.withWatermark("at", late)
        .groupBy(F.window("at", width), F.col("event_type").alias("symbol"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), (F.sum(cents).cast("double") / 100).alias("volume"), F.count("*").alias("trade_count"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.unix_millis("window.start").alias("open_time_ms"), "open", "high", "low", "close", "volume", "trade_count")
    )


def first_only(rows: DataFrame, keys: list[str], at: str = "at", late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark's reach."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def live_liquidations(orders: DataFrame, late: str = "10 minutes") -> DataFrame:
    """orders(at, side, price, qty): long and short USD by hour."""
    usd, sold = F.col("price") * F.col("qty"), F.upper("side") == "SELL"
    return (
        orders.withWatermark("at", late).groupBy(F.window("at", "1 hour"))
        .agg(F.sum(F.when(sold, usd).otherwise(0.0)).alias("long_usd"), F.sum(F.when(~sold, usd).otherwise(0.0)).alias("short_usd"))
        .select(F.unix_millis("window.start").alias("open_time_ms"), "long_usd", "short_usd")
    )


ALERT = "user_id string, type string, t long, price double"


class Cooldown(StatefulProcessor):
    """Lets a hit through if none was let through for its user and type in the cooldown before
    it. The state of a key is one time, and ends by a timer once it can hold nothing back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long, until_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # each call to the state is a message to the executor: one of a kind for a key, not for a hit
        state = self.last.get()
        last, until = (int(state[0]), int(state[1])) if state else (None, None)
        ends = until
        for t, price, minutes in sorted((r["t"], r["price"], r["cooldown_minutes"]) for r in rows):
            if last is None or t - last > minutes * 60_000:
                yield Row(user_id=key[0], type=key[1], t=t, price=price)
                last, ends = t, t + minutes * 60_000 + 1
        if ends != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(ends)
            self.last.update((last, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.last.get()
        if state and int(state[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooled_alerts(hits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """hits(user_id, type, t, price, cooldown_minutes): those more than their cooldown after the
    last one let through for the user and type. A rule's hits are of a type of their own.

    A cooldown ends with event time, so that a restart from the checkpoint goes on as if there
    had been none. Hits that come later than `late` after newer ones are dropped. Needs a
    session whose state is on disk (stream_session).
    """
    timed = hits.withColumn("at", F.timestamp_millis("t")).withWatermark("at", late)
    return timed.groupBy("user_id", "type").transformWithState(
        statefulProcessor=Cooldown(), outputStructType=ALERT, outputMode="Append", timeMode="EventTime"
    )


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends all that is there now to a Parquet table, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(run, seconds: int = 3600) -> None:
    """Waits for a run that stops by itself; its error, if it has one, is raised here."""
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream did not end in {seconds} seconds")

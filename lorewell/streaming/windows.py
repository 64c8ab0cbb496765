"""Structured Streaming over event files: windows with watermarks, session state with checkpoints, last writes, queues."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import events as batch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Fixed values of the checkpoint policy: minutes and commands between checkpoints, checkpoints of a session.
MINUTES, COMMANDS, MOST = 30, 12, 6


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(e: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return batch.tumbling(e.withWatermark("ts", late), size)


def sliding(e: DataFrame, late: str = "10 minutes") -> DataFrame:
    return batch.sliding(e.withWatermark("ts", late))


def sessions(e: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return e.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(e: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (user, payload) once: a transcript whose hash did not change is not captured again."""
    return e.withWatermark("ts", late).withColumn("hash", F.sha2("props", 256)).dropDuplicatesWithinWatermark(["user_id", "hash"])


def decide(started: float, commands: int, checkpoints: int, last_at: float | None, last_commands: int, now: float) -> bool:
    """Whether a checkpoint is due: enough minutes or commands since the last, outside the debounce, below the cap."""
    if checkpoints >= MOST:
        return False
    if last_at is not None and (now - last_at) // 60 < MINUTES:
        return False
    return (now - started) // 60 >= MINUTES or commands - last_commands >= COMMANDS


def checkpoints(e: DataFrame) -> DataFrame:
    """user_id, at, commands of the checkpoints that each user's events call for; state a user, which goes when the
    watermark is a day past the user's last event."""
    import pandas as pd

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, commands, done, last_at, last_commands = state.get if state.exists else (None, 0, 0, None, 0)
        out, latest = [], 0.0
        for t in sorted(x.timestamp() for f in frames for x in f["ts"]):
            started = t if started is None else started
            commands, latest = commands + 1, t
            if decide(started, commands, done, last_at, last_commands, t):
                done, last_at, last_commands = done + 1, t, commands
                out.append((key[0], pd.Timestamp(round(t * 1e6), unit="us"), commands))
        state.update((started, commands, done, last_at, last_commands))
        state.setTimeoutTimestamp(max(int(latest * 1000), state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(out, columns=["user_id", "at", "commands"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return e.withWatermark("ts", "1 hour").groupBy("user_id").applyInPandasWithState(run, "user_id long, at timestamp, commands long", "started double, commands long, done long, last_at double, last_commands long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_latest(e: DataFrame, root: str, checkpoint: str):
    """Keep the latest row of each user and type as a table: every batch is merged with the state before it and written as a
    state of its own, so that a batch that is run again gives the same; latest_state() reads the newest. Available files are
    read once, oldest first."""

    def save(df: DataFrame, epoch: int) -> None:
        before = latest_state(df.sparkSession, root, epoch)
        new = batch.latest_rows(df).select("user_id", "event_type", "ts", "event_id", "value")
        merged = batch.latest_rows(new if before is None else before.unionByName(new))
        merged.write.mode("overwrite").parquet(f"{root}/state-{epoch:09d}")

    return e.writeStream.foreachBatch(save).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def latest_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The state that upsert_latest() wrote last (before that epoch), if any."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    done = sorted(n for n in names if n.startswith("state-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")) and (before is None or int(n[6:]) < before))
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available into a memory table of that name."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

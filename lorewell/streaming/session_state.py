"""Sessions of a project as keyed state: counters, checkpoints that fall due, the newest sessions kept, silent ones dropped."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorewell.streaming.windows import decide

#: Sessions of a project that are kept, and the silence in seconds after which a session is over.
KEEP, SILENCE = 50, 86_400.0
STATE = "started double, commands long, done long, last_at double, last_commands long, updated double"
SAVED = f"project long, session string, {STATE}"
TOLD = "project long, session string, at timestamp, event string, commands long"
FRESH = (0, 0, None, 0)


class Sessions:
    """What is known of a project's sessions, by name: (started, commands, done, last_at, last_commands, updated)."""

    def __init__(self, known: dict[str, tuple], keep: int = KEEP):
        self.known, self.keep = known, keep

    def saw(self, session: str, now: float, commands: int = 1) -> list[tuple[str, float, str, int]]:
        """Count an event; (session, time, checkpoint | evicted | restarted, commands) that follow from it. A session that was
        silent for longer than SILENCE begins anew, whether or not its timer has fired. If there are more than `keep`,
        those go that were updated longest ago (equal times: by name)."""
        out, old = [], self.known.get(session)
        if old is not None and now - old[5] > SILENCE:
            out.append((session, now, "restarted", old[1]))
            old = None
        started, count, done, last_at, last_commands = old[:5] if old is not None else (now, *FRESH)
        count += commands
        if decide(started, count, done, last_at, last_commands, now):
            done, last_at, last_commands = done + 1, now, count
            out.append((session, now, "checkpoint", count))
        self.known[session] = (started, count, done, last_at, last_commands, now if old is None else max(now, old[5]))
        while len(self.known) > self.keep:
            gone = min(self.known, key=lambda s: (self.known[s][5], s))
            out.append((gone, now, "evicted", self.known.pop(gone)[1]))
        return out

    def silent(self, now: float) -> list[str]:
        return sorted(s for s, v in self.known.items() if now - v[5] > SILENCE)


class Keeper(StatefulProcessor):
    """A map of sessions for each project and one timer for the session that falls silent first."""

    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("sessions", "session string", STATE)

    def _load(self) -> tuple[Sessions, dict]:
        before = {k[0]: tuple(v) for k, v in self.map.iterator()}
        return Sessions(dict(before), self.keep), before

    def _save(self, s: Sessions, before: dict) -> None:
        for name in before.keys() - s.known.keys():
            self.map.removeKey((name,))
        for name, value in s.known.items():
            if before.get(name) != value:
                self.map.updateValue((name,), value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s.known:
            self.handle.registerTimer(int((min(v[5] for v in s.known.values()) + SILENCE) * 1000) + 1)

    def _told(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        made = [(key[0], s, pd.Timestamp(round(at * 1e6), unit="us"), event, n) for s, at, event, n in rows]
        yield pd.DataFrame(made, columns=["project", "session", "at", "event", "commands"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, before = self._load()
        seen = [x for f in rows for x in zip(f["ts"], f["session"], f["commands"], strict=True)]
        out = [t for ts, session, n in sorted((ts.timestamp(), session, int(n)) for ts, session, n in seen) for t in s.saw(session, ts, n)]
        self._save(s, before)
        yield from self._told(key, out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        s = Sessions({}, self.keep)
        for r in initialState.itertuples(index=False):
            s.known[r.session] = (r.started, int(r.commands), int(r.done), None if pd.isna(r.last_at) else r.last_at, int(r.last_commands), r.updated)
        for name in sorted(s.known, key=lambda n: (s.known[n][5], n))[: max(0, len(s.known) - self.keep)]:
            del s.known[name]
        self._save(s, {})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        s, before = self._load()
        out = [(name, now, "expired", s.known.pop(name)[1]) for name in s.silent(now)]
        self._save(s, before)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def session_events(e: DataFrame, late: str = "1 hour", keep: int = KEEP, saved: DataFrame | None = None) -> DataFrame:
    """project, session, at, event (checkpoint, evicted, restarted, expired), commands from a stream of project, session, ts,
    commands. saved (SAVED): sessions of an earlier run to begin with. Rows without project, session or time are left out.
    A project's sessions are one state of at most `keep` entries; a batch is read in order of time. To be started under
    rocksdb_state()."""
    rows = e.filter("project IS NOT NULL AND session IS NOT NULL AND ts IS NOT NULL").select("project", "session", "ts", F.coalesce("commands", F.lit(0)).alias("commands")).withWatermark("ts", late)
    first = saved.groupBy("project") if saved is not None else None
    return rows.groupBy("project").transformWithStateInPandas(Keeper(keep), TOLD, "Append", "EventTime", initialState=first)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start in here keep their state in RocksDB, which keyed maps and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def project_events(e: DataFrame, projects: int = 8) -> DataFrame:
    """The driver's events as commands of sessions, a user being a session of one of so many projects."""
    return e.select((F.col("user_id") % projects).alias("project"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), "ts", F.lit(1).cast("long").alias("commands"))

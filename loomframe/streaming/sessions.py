"""Session activity on streams. Every function takes a streaming or a batch DataFrame of session events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomframe.operators.sessions import TTL

LATE = "10 minutes"


def _times(column) -> list:
    """Times of a column as Python's, null as None: without an object of pandas for each."""
    return column.to_numpy("datetime64[us]").tolist()


def _frame(rows: list[tuple], names: list[str], times: tuple[str, ...]) -> pd.DataFrame:
    """Rows as a frame whose times are made at once."""
    made = dict(zip(names, zip(*rows)))
    return pd.DataFrame({n: np.array(made[n], "datetime64[us]").astype("datetime64[ns]") if n in times else list(made[n]) for n in names})


def _timed(events: DataFrame, late: str) -> DataFrame:
    """ts as TIMESTAMP, in the session's time zone, with a watermark: one on TIMESTAMP_NTZ is refused."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def minute_activity(events: DataFrame, late: str = LATE) -> DataFrame:
    """(start, app_name, users, sessions): how many were seen in each minute, exactly. A stream keeps each user and session of a minute
    and app once, until the watermark has passed the minute, and counts what is kept; a minute comes out once, when it is closed."""
    timed = _timed(events, late).select(F.window("ts", "1 minute").alias("minute"), "app_name", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("user", "user_sub"), ("session", "session_id"))])).alias("seen"))
    once = timed.select("minute", "app_name", "seen.kind", "seen.name").dropDuplicates(["minute", "app_name", "kind", "name"])
    known = lambda kind: F.count_if((F.col("kind") == kind) & F.col("name").isNotNull())
    out = once.groupBy("minute", "app_name").agg(known("user").alias("users"), known("session").alias("sessions"))
    return out.select(F.col("minute.start").alias("start"), "app_name", "users", "sessions")


def ttl_sessions(events: DataFrame, ttl: int = 120, late: str = LATE) -> DataFrame:
    """(session_id, start, last_seen, events): stretches without a gap of ttl seconds."""
    window = F.session_window("ts", f"{ttl} seconds")
    out = _timed(events, late).groupBy("session_id", window).agg(F.min("ts").alias("start"), F.max("ts").alias("last_seen"), F.count("*").alias("events"))
    return out.select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "events")


STATE = "first timestamp, login timestamp, ts timestamp, event_id long, kind string, user_sub string, app_name string"
SEEN = "session_id string, user_sub string, app_name string, login_at timestamp, last_seen timestamp, logout_at timestamp, expired boolean"


def session_states(events: DataFrame, ttl: int = TTL, late: str = LATE) -> DataFrame:
    """(session_id, user_sub, app_name, login_at, last_seen, logout_at, expired) of a stream, in update mode: the state of each
    session that a batch has touched, and once more, expired, when the watermark has passed its last event by ttl; then it is
    forgotten, and a later event begins it anew. The rules are those of operators.sessions.latest_sessions.
    """

    names = [c.split()[0] for c in SEEN.split(", ")]

    def row(session: str, state: tuple, expired: bool) -> pd.DataFrame:
        first, login, ts, _, kind, user, app = state
        out = (session, user, app, login if login is not None else first, ts, ts if kind == "logout" else None, expired)
        return _frame([out], names, ("login_at", "last_seen", "logout_at"))

    def ends(state: tuple) -> int:
        return int((state[2].timestamp() + ttl) * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(key[0], state.get, True)
            state.remove()
            return
        now = state.get if state.exists else None
        if now is not None and ends(now) <= state.getCurrentWatermarkMs():  # its time was up before these events
            yield row(key[0], now, True)
            now = None
        for frame in frames:
            for ts, number, kind, user, app in zip(_times(frame["ts"]), *(frame[c].tolist() for c in ("event_id", "kind", "user_sub", "app_name"))):
                if now is None:
                    now = (ts, None, ts, number, kind, user, app)
                first, login, last, at, *rest = now
                login = ts if kind == "login" and (login is None or ts > login) else login
                now = (min(first, ts), login, *((ts, number, kind, user, app) if (ts, number) >= (last, at) else (last, at, *rest)))
        state.update(now)
        if ends(now) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends(now))
            yield row(key[0], now, False)
        else:
            yield row(key[0], now, True)
            state.remove()

    return _timed(events.filter("ts IS NOT NULL"), late).groupBy("session_id").applyInPandasWithState(fold, SEEN, STATE, "update", GroupStateTimeout.EventTimeTimeout)


KEPT = "last timestamp, waiting array<struct<ts: timestamp, event_id: bigint, user_sub: string, app_name: string>>"
THINNED = "session_id string, event_id long, user_sub string, app_name string, ts timestamp"


def thinned_stream(events: DataFrame, seconds: int = 30, late: str = LATE) -> DataFrame:
    """(session_id, event_id, user_sub, app_name, ts) of a stream's heartbeats of which each comes at least so many seconds after the one
    kept before it in its session: what operators.sessions.folded_heartbeats keeps of a table, whatever order the events come in.

    Heartbeats wait in the session's state until the watermark has passed them, are then taken in order of time and event_id, and
    the time of the last one kept is remembered for as long as it matters.
    """

    names = [c.split()[0] for c in THINNED.split(", ")]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting, mark = [tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in waiting], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for frame in frames:
                waiting += zip(_times(frame["ts"]), *(frame[c].tolist() for c in ("event_id", "user_sub", "app_name")))
        waiting.sort(key=lambda w: (w[0], w[1]))
        ripe = [w for w in waiting if w[0].timestamp() * 1000 <= mark]
        waiting, out = waiting[len(ripe) :], []
        for ts, number, user, app in ripe:
            if last is None or (ts - last).total_seconds() >= seconds:
                out.append((key[0], number, user, app, ts))
                last = ts
        ends = [w[0].timestamp() for w in waiting[:1]] or ([last.timestamp() + seconds] if last is not None else [])
        if not ends or ends[0] * 1000 <= mark:  # whatever comes now is later than all that is remembered
            state.remove()
        else:
            state.update((last, waiting))
            state.setTimeoutTimestamp(int(ends[0] * 1000) + 1)
        if out:
            yield _frame(out, names, ("ts",))

    own = _timed(events.filter("kind = 'heartbeat' AND ts IS NOT NULL"), late)
    return own.groupBy("session_id").applyInPandasWithState(fold, THINNED, KEPT, "append", GroupStateTimeout.EventTimeTimeout)

"""Session activity: heartbeats to latest states, active counts, minute samples and daily minutes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Seconds without a heartbeat after which a session counts no more.
TTL = 120
#: Seconds of a span in which a session's next event is looked for.
CELL = 3600


def session_partials(events: DataFrame) -> DataFrame:
    """(session_id, last, login, first) of events: what latest states are made of, one row a session; such rows can be merged."""
    rows = events.select("session_id", F.struct("ts", "event_id", "kind", "user_sub", "app_name").alias("last"), F.when(F.col("kind") == "login", F.col("ts")).alias("login"), F.col("ts").alias("first"))
    return merged_partials(rows)


def merged_partials(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.max("last").alias("last"), F.max("login").alias("login"), F.min("first").alias("first"))


def finished_sessions(partials: DataFrame) -> DataFrame:
    logout = F.when(F.col("last.kind") == "logout", F.col("last.ts"))
    return partials.select("session_id", "last.user_sub", "last.app_name", F.coalesce("login", "first").alias("login_at"), F.col("last.ts").alias("last_seen"), logout.alias("logout_at"))


def latest_sessions(events: DataFrame) -> DataFrame:
    """(session_id, user_sub, app_name, login_at, last_seen, logout_at) after all events (kind login, heartbeat or logout).

    A login sets login_at anew and clears the logout; a heartbeat clears the logout; a logout sets both times. Equal times:
    the later event_id counts. A session without a login began with its first event.
    """
    return finished_sessions(session_partials(events))


def is_active(now: Column, ttl: int = TTL) -> Column:
    return (F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(ttl))) & F.col("logout_at").isNull()


def active_counts(sessions: DataFrame, now: Column, ttl: int = TTL, app: str | None = None) -> DataFrame:
    """One row: active_sessions and distinct active_users, of one app if named."""
    own = sessions.filter(is_active(now, ttl))
    own = own.filter(F.col("app_name") == app) if app else own
    return own.agg(F.count("*").alias("active_sessions"), F.countDistinct("user_sub").alias("active_users"))


def active_sessions(sessions: DataFrame, now: Column, ttl: int = TTL, limit: int = 500) -> DataFrame:
    """The latest active sessions, newest first."""
    return sessions.filter(is_active(now, ttl)).orderBy(F.desc("last_seen"), "session_id").limit(limit)


def _pieces(events: DataFrame, ttl: int) -> DataFrame:
    """(app_name, minute, user_sub, session_id, a, b): when sessions are active, as half-open spans [a, b) that lie in one minute.

    An event keeps its session active until ttl seconds have passed, or to the session's next event, and a logout ends it. The next
    event matters only within ttl, so it is looked for in spans of CELL seconds (no window holds a session); an event so close to
    the beginning of a span that it may follow one of the span before is a row of both. Spans of a session don't overlap.
    """
    kind = events.schema["ts"].dataType
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", zero, "ts") if kind.typeName() == "timestamp_ntz" else F.unix_seconds("ts")
    size = max(CELL, ttl)
    own = events.filter(F.col("session_id").isNotNull() & F.col("ts").isNotNull()).select("app_name", "user_sub", "session_id", "ts", "event_id", "kind", F.floor(seconds / size).alias("cell"), F.pmod(seconds, F.lit(size)).alias("into"))
    dealt = own.withColumn("cell", F.explode(F.when(F.col("into") <= ttl, F.array(F.col("cell"), F.col("cell") - 1)).otherwise(F.array("cell")))).withColumn("own", F.col("cell") == F.floor(seconds / size))
    nxt = F.lead("ts").over(W.partitionBy("session_id", "cell").orderBy("ts", "event_id"))
    end = F.col("ts") + F.make_dt_interval(secs=F.lit(ttl) + F.lit(0.000001))  # times are whole microseconds: up to and with ttl
    spans = dealt.withColumn("next", nxt).filter("own AND kind <> 'logout'").select("app_name", "user_sub", "session_id", "ts", F.least(end, "next").alias("end"))
    minutes = F.sequence(F.date_trunc("minute", "ts"), F.date_trunc("minute", "end"), F.expr("INTERVAL 1 MINUTE"))
    spans = spans.filter("end > ts").withColumn("minute", F.explode(minutes))
    first = F.col("minute").cast(kind)
    cut = spans.select("app_name", "minute", "user_sub", "session_id", F.greatest("ts", first).alias("a"), F.least("end", first + F.expr("INTERVAL 1 MINUTE")).alias("b"))
    return cut.filter("a < b")


def _user_pieces(pieces: DataFrame) -> DataFrame:
    """(app_name, minute, user_sub, a, b): the union of each user's spans in a minute, as spans that don't overlap."""
    before = W.partitionBy("app_name", "minute", "user_sub").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    own = pieces.select("app_name", "minute", "user_sub", "a", "b", F.max("b").over(before).alias("seen"))
    return own.select("app_name", "minute", "user_sub", F.greatest("a", "seen").alias("a"), "b").filter("a < b")


def _swept(pieces: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    """(app_name, minute, at, users, sessions): how many are active at each heartbeat's time, where any session is.

    A sweep over each minute of an app: a span adds one at its start and takes one at its end (it ends by itself with the minute),
    equal times are added up before they are shuffled, and counts are running sums. Rows are as many as events, however many
    users are active at once.
    """
    one = lambda c, n, name: F.lit(n).cast("long").alias(name) if c == name else F.lit(0).cast("long").alias(name)
    row = lambda df, at, c, n, beat=0: df.select("app_name", "minute", F.col(at).alias("at"), *[one(c, n, name) for name in ("sessions", "users")], F.lit(beat).alias("beat"))
    known = users.filter(F.col("user_sub").isNotNull())
    beats = events.filter("kind = 'heartbeat'").select("app_name", F.date_trunc("minute", "ts").alias("minute"), "ts")
    steps = row(pieces, "a", "sessions", 1).union(row(pieces, "b", "sessions", -1)).union(row(known, "a", "users", 1)).union(row(known, "b", "users", -1)).union(row(beats, "ts", "", 0, 1))
    steps = steps.groupBy("app_name", "minute", "at").agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"), F.max("beat").alias("beat"))
    so_far = W.partitionBy("app_name", "minute").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    counts = steps.select("app_name", "minute", "at", "beat", F.sum("users").over(so_far).alias("users"), F.sum("sessions").over(so_far).alias("sessions"))
    return counts.filter("beat = 1 AND sessions > 0").drop("beat")


def minute_samples(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """(bucket_ts, app_name, active_users, active_sessions, peak_users, peak_sessions): each minute's last sample and maxima. Events
    without a session or time take no part, users without a name are not counted."""
    pieces = _pieces(events, ttl)
    out = _swept(pieces, _user_pieces(pieces), events).groupBy(F.col("minute").alias("bucket_ts"), "app_name").agg(F.max_by("users", "at").alias("active_users"), F.max_by("sessions", "at").alias("active_sessions"), F.max("users").alias("peak_users"), F.max("sessions").alias("peak_sessions"))
    return out.select("bucket_ts", "app_name", "active_users", "active_sessions", "peak_users", "peak_sessions")


def daily_minutes(events: DataFrame, ttl: int = TTL, compat: bool = False) -> DataFrame:
    """(date, user_sub, app_name, active_minutes, peak_users_day, peak_sessions_day): minutes at whose first sample the user
    was active, and the greatest counts of those samples. compat: the first minute of a day counts as a minute, but not for the
    peaks, which are 0 on a day of one minute."""
    pieces = _pieces(events, ttl)
    users = _user_pieces(pieces)
    first = _swept(pieces, users, events).groupBy("app_name", "minute").agg(F.min_by(F.struct("at", "users", "sessions"), "at").alias("s"))
    # a user's spans don't overlap, so each user meets a minute's one sample at most once
    own = users.join(first, ["app_name", "minute"]).filter("a <= s.at AND s.at < b")
    rows = own.select("app_name", "minute", "user_sub", "s.users", "s.sessions", F.date_format("minute", "yyyy-MM-dd").alias("date"))
    if compat:
        first = F.col("minute") == F.min("minute").over(W.partitionBy("date", "user_sub", "app_name"))
        rows = rows.withColumn("first", first).withColumn("users", F.when(F.col("first"), 0).otherwise(F.col("users"))).withColumn("sessions", F.when(F.col("first"), 0).otherwise(F.col("sessions")))
    return rows.groupBy("date", "user_sub", "app_name").agg(F.count("*").alias("active_minutes"), F.max("users").alias("peak_users_day"), F.max("sessions").alias("peak_sessions_day"))


def folded_heartbeats(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Heartbeats of each session of which each comes at least so many seconds after the one kept before it: a fold in order of
    time (equal times by event_id) over sorted rows, which remembers a session's last kept time from one batch to the next."""
    names, step = events.columns, seconds * 1_000_000

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = "", None
        for frame in frames:
            kept = np.zeros(len(frame), bool)
            times = frame["ts"].to_numpy("datetime64[us]").astype(np.int64).tolist()
            for k, (own, at) in enumerate(zip(frame["session_id"].tolist(), times)):
                if own != session or last is None or at - last >= step:
                    session, last, kept[k] = own, at, True
            yield frame[kept]

    beats = events.filter("kind = 'heartbeat'").repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return beats.mapInPandas(keep, events.schema).select(*names)


def thinned(events: DataFrame, seconds: int = 30) -> DataFrame:
    """One heartbeat for each session and fixed span of seconds, the first of each: what a stream can do without state, and about
    what folded_heartbeats gives."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    order = W.partitionBy("session_id", "slot").orderBy("ts", "event_id")
    return events.filter("kind = 'heartbeat'").withColumn("slot", slot).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("slot", "n")

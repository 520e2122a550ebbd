from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import sessions as S
from loomframe.operators.states import session_states
from loomframe.plans.views import query, view
from loomframe.sources.shared import new_path

NOW = "2024-01-15 12:00:00"
_at = lambda: F.lit(NOW).cast("timestamp_ntz")
_STATE = """, st AS (SELECT session_id, arg_max(user_sub, event_id) AS user_sub, arg_max(app_name, event_id) AS app_name,
  coalesce(max(ts) FILTER (WHERE kind = 'login'), min(ts)) AS login_at, max(ts) AS last_seen,
  (SELECT CASE WHEN e.kind = 'logout' THEN e.ts END FROM ses e WHERE e.session_id = s.session_id ORDER BY e.ts DESC, e.event_id DESC LIMIT 1) AS logout_at
  FROM ses s GROUP BY session_id)"""
_ACTIVE = f"last_seen >= TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND AND logout_at IS NULL"


def _before(spark, sf_dir):
    return view(spark, sf_dir, "ses").filter(F.col("ts") <= _at())


def _state_sql(body: str, before: bool = True) -> str:
    own = f", ses AS (SELECT * FROM ses0 WHERE ts <= TIMESTAMP '{NOW}')" if before else ", ses AS (SELECT * FROM ses0)"
    return own, _STATE, body


def _sql(body: str, before: bool = True) -> str:
    from loomframe.plans.views import VIEWS

    own, state, body = _state_sql(body, before)
    return f"WITH ses0 AS ({VIEWS['ses']}){own}{state} {body}"


@query(_sql(f"SELECT count(*) AS active_sessions, count(DISTINCT user_sub) AS active_users FROM st WHERE {_ACTIVE}"))
def d1_active_counts(spark, sf_dir):
    return S.active_counts(S.latest_sessions(_before(spark, sf_dir)), _at(), 3600)


@query(_sql(f"SELECT count(*) AS active_sessions, count(DISTINCT user_sub) AS active_users FROM st WHERE {_ACTIVE} AND app_name = 'app1'"))
def b6_active_in_app(spark, sf_dir):
    return S.active_counts(S.latest_sessions(_before(spark, sf_dir)), _at(), 3600, "app1")


@query(_sql(f"SELECT session_id, user_sub, app_name, last_seen FROM st WHERE {_ACTIVE} ORDER BY last_seen DESC, session_id LIMIT 500"))
def f5_active_sessions(spark, sf_dir):
    return S.active_sessions(S.latest_sessions(_before(spark, sf_dir)), _at(), 3600).select("session_id", "user_sub", "app_name", "last_seen")


@query(_sql("SELECT session_id, user_sub, app_name, login_at, last_seen, logout_at FROM st", before=False))
def e6_latest_sessions(spark, sf_dir):
    return S.latest_sessions(view(spark, sf_dir, "ses"))


@query(_sql("SELECT session_id, user_sub, app_name, login_at, last_seen, logout_at FROM st", before=False))
def e6b_merged_sessions(spark, sf_dir):
    """The same from a state table into which the events were merged in three batches, one of them twice."""
    table = session_states(spark, new_path(spark, "sessions"), 8)
    events = view(spark, sf_dir, "ses")
    for k in (2, 0, 1, 0):
        table.update(S.session_partials(events.filter(F.col("event_id") % 3 == k)))
    return S.finished_sessions(table.read())


_SAMPLES = """SELECT b.app_name, date_trunc('minute', b.t0) AS minute, b.t0, s.user_sub, s.session_id
  FROM (SELECT DISTINCT app_name, ts AS t0 FROM ses WHERE kind = 'heartbeat') b
  JOIN (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS nxt FROM ses) s
  ON b.app_name = s.app_name AND s.kind <> 'logout' AND b.t0 >= s.ts AND b.t0 <= s.ts + INTERVAL 120 SECOND AND (s.nxt IS NULL OR b.t0 < s.nxt)"""


@query(f"""SELECT minute AS bucket_ts, app_name, arg_max(u, t0) AS active_users, arg_max(n, t0) AS active_sessions, max(u) AS peak_users, max(n) AS peak_sessions
FROM (SELECT app_name, minute, t0, count(DISTINCT user_sub) AS u, count(DISTINCT session_id) AS n FROM ({_SAMPLES}) q GROUP BY ALL) r GROUP BY minute, app_name""", "ses")
def d2_minute_samples(spark, sf_dir):
    return S.minute_samples(view(spark, sf_dir, "ses"))


@query(f"""SELECT strftime(q.minute, '%Y-%m-%d') AS date, user_sub, q.app_name, count(DISTINCT q.minute) AS active_minutes, max(u) AS peak_users_day, max(n) AS peak_sessions_day
FROM ({_SAMPLES}) q JOIN (SELECT app_name, minute, t0, u, n FROM (SELECT app_name, minute, t0, count(DISTINCT user_sub) AS u, count(DISTINCT session_id) AS n,
  row_number() OVER (PARTITION BY app_name, minute ORDER BY t0) AS k FROM ({_SAMPLES}) p GROUP BY app_name, minute, t0) c WHERE k = 1) f
ON q.app_name = f.app_name AND q.minute = f.minute AND q.t0 = f.t0 GROUP BY ALL""", "ses")
def d3_daily_minutes(spark, sf_dir):
    return S.daily_minutes(view(spark, sf_dir, "ses"))


_FIRST = f"""SELECT app_name, minute, t0, u, n FROM (SELECT app_name, minute, t0, count(DISTINCT user_sub) AS u, count(DISTINCT session_id) AS n,
  row_number() OVER (PARTITION BY app_name, minute ORDER BY t0) AS k FROM ({_SAMPLES}) p GROUP BY app_name, minute, t0) c WHERE k = 1"""


@query(f"""SELECT date, user_sub, app_name, count(*) AS active_minutes, max(CASE WHEN k = 1 THEN 0 ELSE u END) AS peak_users_day, max(CASE WHEN k = 1 THEN 0 ELSE n END) AS peak_sessions_day FROM (
SELECT *, row_number() OVER (PARTITION BY date, user_sub, app_name ORDER BY minute) AS k FROM (
  SELECT DISTINCT strftime(q.minute, '%Y-%m-%d') AS date, q.minute, user_sub, q.app_name, u, n FROM ({_SAMPLES}) q JOIN ({_FIRST}) f ON q.app_name = f.app_name AND q.minute = f.minute AND q.t0 = f.t0) a) b GROUP BY ALL""", "ses")
def d3b_daily_minutes_compat(spark, sf_dir):
    return S.daily_minutes(view(spark, sf_dir, "ses"), compat=True)


_FOLDED = """SELECT event_id, session_id, user_sub, app_name, kind, ts FROM ses JOIN (
  WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM ses WHERE kind = 'heartbeat'),
  r AS (SELECT session_id, n, event_id, ts AS kept_at, true AS kept FROM o WHERE n = 1 UNION ALL
    SELECT o.session_id, o.n, o.event_id, CASE WHEN o.ts - r.kept_at >= INTERVAL 600 SECOND THEN o.ts ELSE r.kept_at END, o.ts - r.kept_at >= INTERVAL 600 SECOND
    FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1)
  SELECT event_id FROM r WHERE kept) k USING (event_id)"""


@query(_FOLDED, "ses")
def s6b_folded_heartbeats(spark, sf_dir):
    return S.folded_heartbeats(view(spark, sf_dir, "ses"), 600)


@query("""SELECT event_id, session_id, user_sub, app_name, kind, ts FROM (SELECT *, row_number() OVER (PARTITION BY session_id, floor(epoch(ts) / 30) ORDER BY ts, event_id) AS n
FROM ses WHERE kind = 'heartbeat') q WHERE n = 1""", "ses")
def s6_thinned_heartbeats(spark, sf_dir):
    return S.thinned(view(spark, sf_dir, "ses"))


@query("""SELECT session_id, min(ts) AS start, max(ts) AS last_seen, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) < INTERVAL 120 SECOND THEN 0 ELSE 1 END AS new FROM ses) a) b
GROUP BY session_id, g""", "ses")
def s2_ttl_sessions(spark, sf_dir):
    from loomframe.streaming.sessions import ttl_sessions

    return ttl_sessions(view(spark, sf_dir, "ses"))

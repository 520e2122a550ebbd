from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import costs
from loomframe.operators import runs as R
from loomframe.plans.views import query, view

_P = "(VALUES ('gpt-5-mini', 0.25, 2.0, NULL), ('gpt-4o', 2.5, 10.0, NULL), ('text-embedding-3-large', NULL, NULL, 0.13)) p(model, i, o, e)"
_CHAT = "(CAST(input_tokens AS DOUBLE) / 1e6 * p.i + CAST(output_tokens AS DOUBLE) / 1e6 * p.o)"
_USD = f"coalesce({_CHAT}, CAST(input_tokens AS DOUBLE) / 1e6 * p.e)"
_FROM = f"FROM run LEFT JOIN {_P} ON run.model = p.model"
runs = lambda spark, sf_dir: view(spark, sf_dir, "run")


@query("SELECT run_id, user_sub, app_name, status FROM run WHERE status = 'error' AND app_name = 'app1' ORDER BY started_at DESC, run_id LIMIT 50", "run")
def b4_recent_runs(spark, sf_dir):
    return R.recent(runs(spark, sf_dir), app="app1", status="error").select("run_id", "user_sub", "app_name", "status")


@query("SELECT run_id, user_sub, started_at FROM run WHERE status = 'running' ORDER BY started_at DESC, run_id LIMIT 200", "run")
def f6_running_runs(spark, sf_dir):
    return R.recent(runs(spark, sf_dir), status="running", limit=200).select("run_id", "user_sub", "started_at")


def _events(spark, sf_dir):
    own = runs(spark, sf_dir)
    return R.start_events(own).unionByName(R.finish_events(own))


@query("""SELECT 'start' AS event_type, run_id, started_at AS ts FROM run WHERE run_id = '77' UNION ALL
SELECT 'finish', run_id, started_at + elapsed_ms * INTERVAL 1 MILLISECOND FROM run WHERE run_id = '77' AND status <> 'running'""", "run")
def b5_events_of_a_run(spark, sf_dir):
    return _events(spark, sf_dir).filter("run_id = '77'").orderBy("ts", "event_type").limit(2000).select("event_type", "run_id", "ts")


_RECORD = """SELECT run_id, user_sub, app_name, page_name, provider, task_type, parent_run_id, model, status, started_at, CASE WHEN status <> 'running' THEN started_at + elapsed_ms * INTERVAL 1 MILLISECOND END AS finished_at,
CASE WHEN status <> 'running' THEN elapsed_ms END AS elapsed_ms, CASE WHEN status <> 'running' THEN input_tokens END AS input_tokens, CASE WHEN status <> 'running' THEN output_tokens END AS output_tokens,
CASE WHEN status <> 'running' AND (input_tokens IS NOT NULL OR output_tokens IS NOT NULL) THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS total_tokens,
CASE WHEN status <> 'running' THEN round(CAST(usd AS DOUBLE), 9) END AS cost_usd, CASE WHEN status <> 'running' AND usd IS NOT NULL THEN CAST(150 AS DOUBLE) END AS usd_jpy, CASE WHEN status <> 'running' THEN round(CAST(usd AS DOUBLE) * 150, 6) END AS cost_jpy,
CASE WHEN status = 'error' THEN error_type END AS error_type, CASE WHEN status = 'error' THEN 'failed ' || run_id END AS error_message,
CASE WHEN status <> 'running' THEN coalesce(finish_meta, start_meta) ELSE start_meta END AS meta_json FROM (SELECT run.*, {usd} AS usd {rows}) r""".format(usd=_USD, rows=_FROM)


@query(_RECORD, "run")
def i8_runs_from_events(spark, sf_dir):
    return R.runs_from_events(_events(spark, sf_dir))


@query(_RECORD, "run")
def c10_start_finish_join(spark, sf_dir):
    own = runs(spark, sf_dir)
    return R.updated_runs(R.start_events(own), R.finish_events(own))


@query(f"SELECT run_id, run.model, round({_CHAT}, 9) AS usd {_FROM}", "run")
def i1_chat_cost(spark, sf_dir):
    return costs.priced(runs(spark, sf_dir)).select("run_id", "model", F.round(costs.chat_usd(F.col("input_tokens"), F.col("output_tokens")), 9).alias("usd"))


@query(f"SELECT run_id, round(CAST(input_tokens AS DOUBLE) / 1e6 * p.e, 9) AS usd {_FROM}", "run")
def i2_embedding_cost(spark, sf_dir):
    return costs.priced(runs(spark, sf_dir)).select("run_id", F.round(costs.embedding_usd(F.col("input_tokens")), 9).alias("usd"))


@query(f"SELECT run_id, round(coalesce(CASE WHEN m = 'gpt-4o' THEN CAST(input_tokens AS DOUBLE) / 1e6 * 2.5 + CAST(output_tokens AS DOUBLE) / 1e6 * 10.0 END, CASE WHEN m = 'whisper-1' THEN elapsed_ms / 1000.0 / 60 * 0.006 END), 9) AS usd FROM (SELECT *, CASE WHEN model = 'unpriced' THEN 'whisper-1' ELSE model END AS m FROM run WHERE model IN ('unpriced', 'gpt-4o')) q", "run")
def i3_audio_cost(spark, sf_dir):
    own = runs(spark, sf_dir).filter("model in ('unpriced', 'gpt-4o')").withColumn("model", F.when(F.col("model") == "unpriced", "whisper-1").otherwise(F.col("model")))
    usd = costs.audio_usd(F.col("elapsed_ms") / 1000, F.col("input_tokens"), F.col("output_tokens"))
    return costs.priced(own).select("run_id", F.round(usd, 9).alias("usd"))


@query(f"SELECT run_id, round(round({_USD} * 150.0, 2), 2) AS jpy {_FROM} WHERE p.model IS NOT NULL", "run")
def i4_jpy(spark, sf_dir):
    return R.costed(runs(spark, sf_dir)).filter("model <> 'unpriced'").select("run_id", F.col("cost_jpy").alias("jpy"))


@query(f"SELECT run_id, CAST(round(CAST(coalesce(input_tokens, 0) * CAST(p.i AS DECIMAL(9,3)) + coalesce(output_tokens, 0) * CAST(p.o AS DECIMAL(9,3)) AS DECIMAL(24,9)) * CAST(0.000001 AS DECIMAL(9,6)), 6) AS DOUBLE) AS usd {_FROM} WHERE p.i IS NOT NULL", "run")
def i5_strict_cost(spark, sf_dir):
    own = costs.priced(runs(spark, sf_dir)).filter("model in ('gpt-5-mini', 'gpt-4o')")
    return own.select("run_id", costs.strict_usd(F.col("input_tokens"), F.col("output_tokens")).alias("usd"))


@query(f"SELECT run_id, round(coalesce(CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 1.5 END, {_USD}), 9) AS usd {_FROM}", "run")
def i6_filled_cost(spark, sf_dir):
    own = R.costed(runs(spark, sf_dir))
    known = F.when(F.col("run_id").cast("long") % 3 == 0, F.lit(1.5))
    return own.select("run_id", F.round(F.coalesce(known, "cost_usd"), 9).alias("usd"))


@query(f"SELECT run_id, CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS total, round({_USD} * 150.0, 6) AS jpy {_FROM}", "run")
def i7_finish_totals(spark, sf_dir):
    own = R.costed(runs(spark, sf_dir))
    i, o = F.col("input_tokens"), F.col("output_tokens")
    total = F.when(i.isNotNull() | o.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0)))
    return own.select("run_id", total.alias("total"), F.round(costs.jpy(F.col("cost_usd"), digits=None), 6).alias("jpy"))


@query(f"SELECT DISTINCT run.model, p.i / 1000 AS in_1k, p.o / 1000 AS out_1k {_FROM}", "run")
def i9_price_per_1k(spark, sf_dir):
    return costs.priced(runs(spark, sf_dir).select("model").distinct()).select("model", (F.col("in_usd") / 1000).alias("in_1k"), (F.col("out_usd") / 1000).alias("out_1k"))


_PAID = "provider = 'openai' AND status = 'success'"
_SUMS = f"SELECT app_name, round(coalesce(sum(CASE WHEN p.e IS NOT NULL THEN {_USD} END), 0), 9) AS e, round(sum(CASE WHEN p.i IS NOT NULL AND {{paid}} THEN coalesce({_CHAT}, 0) ELSE 0 END), 9) AS c {_FROM} GROUP BY app_name"


@query(f"SELECT app_name, e AS embedding_usd, c AS chat_usd, round(e + c, 9) AS total_usd, round(round(e + c, 9) * 150.0, 4) AS total_jpy FROM ({_SUMS.format(paid=_PAID)}) q", "run")
def i10_usage_summary(spark, sf_dir):
    return R.usage_summary(runs(spark, sf_dir), "app_name", paid=(F.col("provider") == "openai") & (F.col("status") == "success"))


@query(f"SELECT app_name, c AS chat_usd, c AS total_usd, round(c * 150.0, 4) AS total_jpy FROM ({_SUMS.format(paid='true')}) q", "run")
def i10b_chat_summary(spark, sf_dir):
    return R.usage_summary(runs(spark, sf_dir), "app_name", chat_only=True)


@query(f"SELECT run.model, count(*) AS n, count({_USD}) AS priced {_FROM} GROUP BY run.model", "run")
def c6_price_lookup(spark, sf_dir):
    return R.costed(runs(spark, sf_dir)).groupBy("model").agg(F.count("*").alias("n"), F.count("cost_usd").alias("priced"))


@query(f"""SELECT user_sub, count(*) AS parts, sum(CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL THEN input_tokens END) AS input_tokens,
sum(CASE WHEN input_tokens IS NOT NULL AND output_tokens IS NOT NULL THEN output_tokens END) AS output_tokens, round(sum({_USD}), 9) AS cost_usd,
count(*) FILTER (WHERE input_tokens IS NULL OR output_tokens IS NULL) = 0 AS complete {_FROM} GROUP BY user_sub""", "run")
def d16_usage_roll_up(spark, sf_dir):
    return R.rolled_up(R.costed(runs(spark, sf_dir)), "user_sub")


@query("SELECT run_id, input_tokens AS input, output_tokens AS output, CAST(NULL AS BIGINT) AS total FROM run", "run")
def h26_usage_from_json(spark, sf_dir):
    own = runs(spark, sf_dir)
    named = F.when(F.col("run_id").cast("long") % 2 == 0, F.to_json(F.struct("input_tokens", "output_tokens"))).otherwise(F.to_json(F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"))))
    return own.select("run_id", costs.usage_tokens(named).alias("u")).select("run_id", "u.*")


@query("SELECT run_id, coalesce(input_tokens, CAST(run_id AS BIGINT) % 50) AS input_tokens, coalesce(output_tokens, 7) AS output_tokens FROM run", "run")
def u1_injected_extractor(spark, sf_dir):
    """A caller's extractor for a shape that the library does not know."""
    answer = F.to_json(F.struct(F.struct((F.col("run_id").cast("long") % 50).alias("read"), F.lit(7).alias("written")).alias("n")))
    extract = lambda c: F.struct(F.get_json_object(c, "$.n.read").alias("input"), F.get_json_object(c, "$.n.written").alias("output"))
    return R.with_usage(runs(spark, sf_dir).withColumn("answer", answer), "answer", extract).select("run_id", "input_tokens", "output_tokens")


@query(f"SELECT run_id, round(CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 THEN {_USD} ELSE 0.5 END, 9) AS usd, round(CASE WHEN CAST(run_id AS BIGINT) % 2 = 0 AND {_USD} IS NOT NULL THEN round({_USD} * 150.0, 2) END, 2) AS jpy {_FROM} WHERE p.model IS NOT NULL AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL", "run")
def h27_picked_cost(spark, sf_dir):
    own = R.costed(runs(spark, sf_dir)).filter("model <> 'unpriced' and input_tokens is not null and output_tokens is not null")
    even = F.col("run_id").cast("long") % 2 == 0
    own = own.withColumn("cost_usd", F.when(even, F.col("cost_usd"))).withColumn("cost_jpy", F.when(even, F.col("cost_jpy"))).withColumn("total_cost_usd", F.lit(0.5)).withColumn("total_cost_jpy", F.lit(None).cast("double"))
    return own.select("run_id", costs.picked_cost([("cost_usd", "cost_jpy"), ("total_cost_usd", "total_cost_jpy")]).alias("c")).select("run_id", F.round("c.usd", 9).alias("usd"), F.round("c.jpy", 2).alias("jpy"))


@query("SELECT run_id, CASE WHEN length(m) > 8 THEN substr(m, 1, 8) || '...' ELSE m END AS message FROM (SELECT run_id, 'failed ' || run_id AS m FROM run) q", "run")
def h25_truncated_message(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", R.truncated(F.concat(F.lit("failed "), "run_id"), 8).alias("message"))

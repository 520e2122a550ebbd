"""Model runs: from start and finish events to one row each, with usage and cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions import costs

MESSAGE = 2_000


def truncated(c: Column, most: int = MESSAGE) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


#: Columns of an event, in order; a start has no outcome and a finish no more than ids and outcome.
WHO = ("user_sub", "app_name", "page_name", "provider", "task_type", "parent_run_id", "model")
OUTCOME = ("status", "input_tokens", "output_tokens", "cost_usd", "usd_jpy", "cost_jpy", "error_type", "error_message")


def start_events(runs: DataFrame) -> DataFrame:
    none = {"input_tokens": "long", "output_tokens": "long", "cost_usd": "double", "usd_jpy": "double", "cost_jpy": "double"}
    outcome = [F.lit(None).cast(none.get(c, "string")).alias(c) for c in OUTCOME]
    return runs.select("run_id", F.lit("start").alias("event_type"), F.col("started_at").alias("ts"), *WHO, *outcome, F.col("start_meta").alias("meta_json"))


def finish_events(runs: DataFrame, rate: float = costs.USD_JPY) -> DataFrame:
    """Finishes with their cost in dollars, where tokens and prices are known, and the rate it was made at."""
    done = costed(runs.filter("status <> 'running'"), rate)
    end = F.col("started_at") + F.make_dt_interval(secs=F.col("elapsed_ms") / 1000)
    message = F.when(F.col("status") == "error", F.concat(F.lit("failed "), "run_id"))
    kind = F.when(F.col("status") == "error", F.col("error_type"))
    return done.select("run_id", F.lit("finish").alias("event_type"), end.alias("ts"), *WHO, "status", "input_tokens", "output_tokens", "cost_usd", F.when(F.col("cost_usd").isNotNull(), F.lit(rate)).alias("usd_jpy"), F.lit(None).cast("double").alias("cost_jpy"), kind.alias("error_type"), message.alias("error_message"), F.col("finish_meta").alias("meta_json"))


def _record(start: str, finish: str) -> list[Column]:
    """A run's columns from its start and finish structs."""
    i, o = F.col(f"{finish}.input_tokens"), F.col(f"{finish}.output_tokens")
    total = F.when(i.isNotNull() | o.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    elapsed = ((micros(f"{finish}.ts") - micros(f"{start}.ts")) / 1000).cast("long")
    error = [F.col(f"{finish}.error_type").alias("error_type"), truncated(F.col(f"{finish}.error_message")).alias("error_message")]
    times = [F.col(f"{start}.ts").alias("started_at"), F.col(f"{finish}.ts").alias("finished_at"), elapsed.alias("elapsed_ms")]
    meta = F.coalesce(f"{finish}.meta_json", f"{start}.meta_json").alias("meta_json")
    usd, rate = F.col(f"{finish}.cost_usd"), F.col(f"{finish}.usd_jpy")
    cost = [F.round(usd, 9).alias("cost_usd"), rate.alias("usd_jpy"), F.round(F.coalesce(F.col(f"{finish}.cost_jpy"), usd * rate), 6).alias("cost_jpy")]
    return [*[F.col(f"{start}.{c}").alias(c) for c in WHO], F.coalesce(f"{finish}.status", F.lit("running")).alias("status"), *times, i.alias("input_tokens"), o.alias("output_tokens"), total.alias("total_tokens"), *cost, *error, meta]


def runs_from_events(events: DataFrame) -> DataFrame:
    """One row for each started run. A run without a finish is running. total is in + out if either is known, meta_json the
    finish's or else the start's, the cost in yen the finish's or else dollars at its rate; equal times of several finishes of one run:
    the greater status counts."""
    kind = F.col("event_type")
    start = F.min_by(F.struct("ts", *WHO, "meta_json"), F.when(kind == "start", F.col("ts")))
    finish = F.max_by(F.struct("ts", *OUTCOME, "meta_json"), F.when(kind == "finish", F.struct("ts", "status")))
    own = events.groupBy("run_id").agg(start.alias("s"), finish.alias("f"), F.count_if(kind == "start").alias("n")).filter("n > 0")
    return own.select("run_id", *_record("s", "f"))


def updated_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """The same by a join of start rows with finish rows, one of each run at most."""
    s = starts.select("run_id", F.struct("ts", *WHO, "meta_json").alias("s"))
    f = finishes.select("run_id", F.struct("ts", *OUTCOME, "meta_json").alias("f"))
    return s.join(f, "run_id", "left").select("run_id", *_record("s", "f"))


def with_usage(rows: DataFrame, response: str, extract: Callable[[Column], Column] = costs.usage_tokens) -> DataFrame:
    """rows with input_tokens and output_tokens, where they have none, from a response by the caller's extractor: a function of
    its column to a struct with input and output."""
    found = rows.withColumn("__usage", extract(F.col(response)))
    out = found.withColumn("input_tokens", F.coalesce("input_tokens", F.col("__usage.input").cast("long")))
    return out.withColumn("output_tokens", F.coalesce("output_tokens", F.col("__usage.output").cast("long"))).drop("__usage")


def usage_summary(runs: DataFrame, *by: str, paid: Column | None = None, chat_only: bool = False, rate: float = costs.USD_JPY) -> DataFrame:
    """embedding_usd, chat_usd, total_usd and total_jpy of each group: chat counts only where paid, the yen come from summed
    dollars; chat_only leaves embedding out."""
    own = costs.priced(runs)
    chat = F.coalesce(costs.chat_usd(F.col("input_tokens"), F.col("output_tokens")), F.lit(0.0))
    chat = F.when(F.col("in_usd").isNotNull() & (F.lit(True) if paid is None else paid), chat).otherwise(0.0)
    embedding = F.lit(0.0) if chat_only else F.coalesce(costs.embedding_usd(F.col("input_tokens")), F.lit(0.0))
    out = own.groupBy(*by).agg(F.round(F.sum(embedding), 9).alias("embedding_usd"), F.round(F.sum(chat), 9).alias("chat_usd"))
    out = out.withColumn("total_usd", F.round(F.col("embedding_usd") + F.col("chat_usd"), 9)).withColumn("total_jpy", F.round(F.col("total_usd") * rate, 4))
    return out.drop("embedding_usd") if chat_only else out


def costed(runs: DataFrame, rate: float = costs.USD_JPY) -> DataFrame:
    """runs with cost_usd (chat or embedding price) and cost_jpy, rounded to two digits."""
    own = costs.priced(runs)
    usd = F.coalesce(costs.chat_usd(F.col("input_tokens"), F.col("output_tokens")), costs.embedding_usd(F.col("input_tokens")))
    return own.withColumn("cost_usd", usd).withColumn("cost_jpy", costs.jpy(F.col("cost_usd"), rate)).drop("in_usd", "out_usd", "embed_usd", "minute_usd")


def recent(runs: DataFrame, user: str | None = None, app: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    for column, value in (("user_sub", user), ("app_name", app), ("status", status)):
        runs = runs.filter(F.col(column) == value) if value is not None else runs
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def rolled_up(parts: DataFrame, *by: str) -> DataFrame:
    """Sums of the parts of a run or group: tokens where both counts are known, cost where it is; complete tells if all were."""
    both = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return parts.groupBy(*by).agg(
        F.count("*").alias("parts"),
        F.sum(F.when(both, F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(both, F.col("output_tokens"))).alias("output_tokens"),
        F.round(F.sum("cost_usd"), 9).alias("cost_usd"),
        (F.count_if(~both) == 0).alias("complete"),
    )

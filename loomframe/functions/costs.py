"""Prices of models and costs of usage. A price or token count that is not known makes a null cost, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# USD for a million tokens in and out; for a million tokens; for a minute of audio.
CHAT = {
    "gpt-5": (1.25, 10.00),
    "gpt-5-mini": (0.25, 2.00),
    "gpt-5-nano": (0.05, 0.40),
    "azure:gpt-5-mini": (0.25, 2.00),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o-transcribe-diarize": (2.50, 10.00),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-3.5-turbo": (0.50, 1.50),
    "gemini-2.0-flash": (0.10, 0.40),
    "gemini-3.5-flash": (1.50, 9.00),
}
EMBEDDING = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}
AUDIO = {"whisper-1": 0.006, "gpt-4o-mini-transcribe": 0.006, "gpt-4o-transcribe": 0.006}
USD_JPY = 150.0


def prices(spark: SparkSession) -> DataFrame:
    """(model, in_usd, out_usd, embed_usd, minute_usd): one row for each model of the tables above, so safe to broadcast."""
    models = sorted({*CHAT, *EMBEDDING, *AUDIO})
    rows = [(m, *CHAT.get(m, (None, None)), EMBEDDING.get(m), AUDIO.get(m)) for m in models]
    return spark.createDataFrame(rows, "model string, in_usd double, out_usd double, embed_usd double, minute_usd double")


def priced(runs: DataFrame) -> DataFrame:
    """runs with the prices of their model; null for a model that has none."""
    return runs.join(F.broadcast(prices(runs.sparkSession)), "model", "left")


def chat_usd(tokens_in: Column, tokens_out: Column) -> Column:
    """Needs both token counts."""
    return tokens_in / 1e6 * F.col("in_usd") + tokens_out / 1e6 * F.col("out_usd")


def embedding_usd(tokens_in: Column) -> Column:
    return tokens_in / 1e6 * F.col("embed_usd")


def audio_usd(seconds: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """By tokens where their use was returned and has a price, else by the minute."""
    return F.coalesce(chat_usd(tokens_in, tokens_out), seconds / 60 * F.col("minute_usd"))


def jpy(usd: Column, rate: float | Column = USD_JPY, digits: int | None = 2) -> Column:
    """Rounded for estimates; digits None leaves what a run's own record stores."""
    out = usd * rate
    return out if digits is None else F.round(out, digits)


def strict_usd(tokens_in: Column, tokens_out: Column) -> Column:
    """Negative and unknown counts as zero, rounded to six digits; an unknown model is an error."""
    usd = F.greatest(tokens_in, F.lit(0)) / 1e6 * F.col("in_usd") + F.greatest(tokens_out, F.lit(0)) / 1e6 * F.col("out_usd")
    return F.when(F.col("in_usd").isNull(), F.raise_error(F.concat(F.lit("no price: "), F.coalesce("model", F.lit("null")))).cast("double")).otherwise(F.round(usd.cast("decimal(24,9)"), 6).cast("double"))


def usage_tokens(json: Column) -> Column:
    """Struct (input, output, total) of a usage record in JSON under any of the providers' names; nothing is inferred."""
    pick = lambda *names: F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names]).try_cast("long")
    return F.struct(
        pick("input_tokens", "prompt_tokens", "prompt_token_count").alias("input"),
        pick("output_tokens", "completion_tokens", "candidates_token_count").alias("output"),
        pick("total_tokens", "total_token_count").alias("total"),
    )


def picked_cost(row_pairs: list[tuple[str, str]]) -> Column:
    """Struct (usd, jpy) of the first pair of columns of which either is known."""
    pairs = [F.when(F.col(u).isNotNull() | F.col(j).isNotNull(), F.struct(F.col(u).alias("usd"), F.col(j).alias("jpy"))) for u, j in row_pairs]
    return F.coalesce(*pairs)

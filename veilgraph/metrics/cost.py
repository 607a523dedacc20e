"""Cost models: prices by model, batch estimates, extrapolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_cost(tokens: Column, price_per_million: Column) -> Column:
    return tokens * price_per_million / 1e6


def batch_estimate(chunks: DataFrame, prices: DataFrame, out_ratio: float) -> DataFrame:
    """(model, calls, tokens_in, tokens_out, cost): chunks(n_words) under every model of the catalogue (a small dimension)."""
    total = chunks.agg(F.count("*").alias("calls"), F.sum("n_words").alias("tokens_in"))
    rows = prices.crossJoin(F.broadcast(total))  # one row
    out = F.floor(F.col("tokens_in") * out_ratio).cast("long")
    return rows.select("model", "calls", "tokens_in", out.alias("tokens_out"), F.round(token_cost(F.col("tokens_in"), F.col("price_in")) + token_cost(out, F.col("price_out")), 6).alias("cost"))


def extrapolate(lines: DataFrame, factor: float) -> DataFrame:
    """(line, cost): calls x tokens x price, scaled by corpus size."""
    return lines.select("line", F.round(F.col("calls") * token_cost(F.col("tokens"), F.col("price")) * factor, 6).alias("cost"))

"""Metering prices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per million tokens (in, out), and per unit of other work; a credit is a thousandth of a dollar.
TOKEN_PRICES = {"large": (2.5, 10.0), "small": (0.15, 0.6)}
EMBEDDING_PER_MILLION, RERANK_PER_MILLION, PAGE_PRICE, TRANSLATION_PER_MILLION = 0.12, 0.05, 0.01, 10.0
CREDIT_USD = 0.001


def in_credits(usd: Column, least: int = 1) -> Column:
    """Dollars in whole credits, rounded up (to a millionth first), at least `least`."""
    return F.greatest(F.ceil(F.round(usd / CREDIT_USD, 6)).cast("long"), F.lit(least).cast("long"))


def llm_credits(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    usd = F.lit(None).cast("double")
    for name, (a, b) in TOKEN_PRICES.items():
        usd = F.when(model == name, tokens_in * a / 1e6 + tokens_out * b / 1e6).otherwise(usd)
    return in_credits(usd)


def embedding_credits(tokens: Column) -> Column:
    return in_credits(tokens * EMBEDDING_PER_MILLION / 1e6)


def page_credits(pages: Column) -> Column:
    return in_credits(pages * PAGE_PRICE)


# Fixed value: USD an hour and GB of memory.
GRAPH_HOUR_GB = 0.035


def rerank_credits(tokens: Column) -> Column:
    return in_credits(tokens * RERANK_PER_MILLION / 1e6)


def graph_credits(memory_gb: Column, seconds: Column) -> Column:
    return in_credits(memory_gb * (seconds / 3600) * GRAPH_HOUR_GB)


def translation_credits(characters: Column) -> Column:
    return in_credits(characters * TRANSLATION_PER_MILLION / 1e6)


def query_credits(model: Column, tokens_in: Column, tokens_out: Column, embedded: Column, reranked: Column) -> Column:
    """The sum over the calls of a query; a call of no tokens costs nothing."""
    part = lambda used, cost: F.when(used > 0, cost).otherwise(F.lit(0).cast("long"))
    return part(tokens_in + tokens_out, llm_credits(model, tokens_in, tokens_out)) + part(embedded, embedding_credits(embedded)) + part(reranked, rerank_credits(reranked))

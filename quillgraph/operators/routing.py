"""Heuristic routing of questions, as expressions over a column of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that decide the route, and that a date question has.
MULTI_HOP = ("relationship between", "connected to", "compare", "how does", "impact of", "chain of")
THEMATIC = ("main themes", "overall", "summarize", "across all", "trends", "common")
LATEST, OLDEST = ("latest", "newest", "most recent"), ("oldest", "earliest", "first document")
EXHAUSTIVE = ("all", "every", "each", "list")


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def route(question: Column) -> Column:
    low = F.lower(question)
    return F.when(_any(low, MULTI_HOP), "multi_hop").when(_any(low, THEMATIC), "thematic").otherwise("local")


def date_order(question: Column) -> Column:
    """desc or asc for a question about the latest or oldest document; null else."""
    low = F.lower(question)
    about = _any(low, ("document", "file", "contract", "report"))
    return F.when(about & _any(low, LATEST), "desc").when(about & _any(low, OLDEST), "asc")


def complexity(question: Column) -> Column:
    """0 to 1: a quarter for each multi-hop or thematic phrase, a tenth for each further question word."""
    low = F.lower(question)
    score = F.lit(0.0)
    for w in MULTI_HOP + THEMATIC:
        score = score + F.contains(low, F.lit(w)).cast("double") * 0.25
    for w in ("why", "how", "which", "and"):
        score = score + F.contains(low, F.lit(w)).cast("double") * 0.1
    return F.round(F.least(score, F.lit(1.0)), 6)


def wants_coverage(question: Column) -> Column:
    low = F.lower(question)
    return F.regexp_like(low, F.lit(r"\b(" + "|".join(EXHAUSTIVE) + r")\b")) & _any(low, ("document", "contract", "file"))

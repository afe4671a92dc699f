"""Noise penalties, denoising and score filters for retrieved passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The factors, the lengths they start from, and the forms of lines.
FORM_LABEL, EMPTY, BARE_HEADING, THIN = 0.05, 0.10, 0.10, 0.20
LEAST_SIGNS, LEAST_TOKENS = 20, 50
LABEL = r"[A-Za-z0-9 '\-/()]+:"
FILLED = r"[A-Za-z][A-Za-z0-9 /\-()']+:\s*[A-Za-z0-9]"
BLANK_SIGNS = r"[\s_\-.=:|/\[\]()#*>`]+"

#: A label with a rule of at least two signs, a checkbox or nothing after it; or a line of separators.
FORM_LINE = rf"^(?:{LABEL}\s*(?:[_\-.]{{2,}}|\[?\s*\]?)|[_\-.=]{{4,}})$"


def form_label_penalty(text: Column) -> Column:
    """0.05 if at least half the lines that are not blank are form lines, 0.10 where there are none, else 1."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    forms = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(FORM_LINE))))
    return F.when(F.size(lines) == 0, EMPTY).when(forms * 2 >= F.size(lines), FORM_LABEL).otherwise(1.0)


def bare_heading_penalty(text: Column) -> Column:
    """0.10 for under 20 signs other than white space, rules and marks of structure."""
    return F.when(F.length(F.regexp_replace(text, BLANK_SIGNS, "")) < LEAST_SIGNS, BARE_HEADING).otherwise(1.0)


def thin_penalty(text: Column) -> Column:
    """0.20 for under 50 estimated tokens, unless a label with a value is there."""
    return F.when((F.floor(F.length(text) / 4) + 1 < LEAST_TOKENS) & ~F.regexp_like(text, F.lit(FILLED)), THIN).otherwise(1.0)


def noise_penalty(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.round(form_label_penalty(text) * bare_heading_penalty(text) * thin_penalty(text), 6)


def denoised(s: Column) -> Column:
    """True for a passage worth keeping: not a tag soup, a stub, a form line or a fragment without a sentence end."""
    tags = F.regexp_count(s, F.lit(r"<[^>]+>"))
    return ~(
        (tags >= 2)
        | (F.length(s) < 25)
        | F.regexp_like(s, F.lit(r"(?i)^\s*(signature|signed by|print name|date)\s*[:_]"))
        | ((F.length(s) < 60) & s.endswith(":"))
        | ((F.length(s) < 50) & ~F.regexp_like(s, F.lit(r"[.?!]")))
    )


def numeric_relevance(text: Column) -> Column:
    """5, 4, 3, 2 or 1 fifths for the first of $, amount, invoice, cost, price that a text has; 0 for none."""
    out = F.lit(0)
    for score, word in ((1, "price"), (2, "cost"), (3, "invoice"), (4, "amount"), (5, "$")):
        out = F.when(F.contains(F.lower(text), F.lit(word)), score).otherwise(out)
    return F.round(out / 5.0, 6)


def filter_stats(passages: DataFrame) -> DataFrame:
    """penalty and n: how many passages get each penalty."""
    return passages.groupBy(noise_penalty(F.col("text")).alias("penalty")).agg(F.count(F.lit(1)).alias("n"))

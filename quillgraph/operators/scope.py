"""Who may see what: tenants, folders, and rows and seeds that are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The group that all tenants share, names of stored chunks, seeds that name no entity, and roles.
SHARED = "__global__"
CHUNK_ID = r"(?i)^doc_[a-f0-9]{20,}_(chunk|sent)_\d+"
GENERIC_SEEDS = (
    "ach", "wire", "wire transfer", "swift", "swift code", "swift codes", "iban", "bic", "vat", "tax id", "tax id number",
    "routing number", "routing numbers", "bank routing number", "bank routing numbers", "bank account number",
)
SHORT_GENERIC = ("swift", "iban", "bic", "ach")
ROLES = (
    "builder", "buyer", "buyer/owner", "seller", "owner", "agent", "customer", "contractor", "subcontractor", "vendor", "supplier", "manufacturer", "administrator", "arbitrator", "mediator",
    "pumper", "tenant", "landlord", "lessee", "lessor", "licensee", "licensor", "manager", "principal", "representative", "authorized representative",
    "party", "parties", "claimant", "respondent", "insured", "beneficiary", "guarantor", "indemnitor", "county", "state", "municipality", "city", "government",
)


def group_ids(group: str) -> list[str]:
    return [group] if group == SHARED else [group, SHARED]


def tenant(rows: DataFrame, group: str, column: str = "group_id") -> DataFrame:
    """Rows of a group and of the one that all share. On a table partitioned by the column only their folders are read."""
    return rows.where(F.col(column).isin(*group_ids(group)))


def in_folder(rows: DataFrame, membership: DataFrame, folder: Column | None) -> DataFrame:
    """Rows (doc_id) in a folder of membership (doc_id, folder); all rows without a folder."""
    return rows if folder is None else rows.join(membership.where(F.col("folder") == folder).select("doc_id").distinct(), "doc_id", "left_semi")


def is_chunk_id(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(CHUNK_ID), F.lit(False))


def without_chunk_ids(entities: DataFrame, name: str = "name") -> DataFrame:
    return entities.where(~is_chunk_id(F.col(name)))


def is_generic_seed(c: Column) -> Column:
    s = T.seed_phrase(c)
    short = F.lit(False)
    for word in SHORT_GENERIC:
        short = short | s.contains(word)
    return (s == "") | s.isin(*GENERIC_SEEDS) | (short & (F.length(s) <= 20))


def is_role_label(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*ROLES), F.lit(False))


def by_category(rows: DataFrame, include: str | None = None, exclude: str | None = None, column: str = "category") -> DataFrame:
    """Rows of one category, or of all but one (rows without a category are in none)."""
    if include is not None:
        rows = rows.where(F.col(column) == include)
    return rows if exclude is None else rows.where(~F.col(column).eqNullSafe(F.lit(exclude)))


def field_exists(chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """doc_id, found, section: whether any chunk (doc_id, idx, section, text) of a document holds any keyword, and the section of the first one that does."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.lower("text").contains(k.lower())
    return chunks.groupBy("doc_id").agg(F.max(hit).alias("found"), F.min(F.when(hit, F.struct("idx", "section")))["section"].alias("section"))


def pattern_in_documents(chunks: DataFrame, pattern: str, titles: DataFrame | None = None, keyword: str | None = None) -> DataFrame:
    """doc_id of documents of which any chunk fits the pattern: of those whose title (doc_id, title) holds the keyword, and if none of these fits, of all."""
    fits = chunks.where(F.col("text").rlike(pattern)).select("doc_id").distinct()
    if keyword is None:
        return fits
    named = fits.join(titles.where(F.lower("title").contains(keyword.lower())).select("doc_id"), "doc_id", "left_semi")
    return named.unionAll(fits.join(named.select(F.lit(1).alias("any")).limit(1), F.lit(True), "left_anti"))

"""Soft deletes, restores, deletes and garbage collection as rewrites of whole tables.

Each operator returns the table's new state (or the ids it would touch, for a
dry run); a caller writes it as a new version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deprecate(sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """sid, doc_id, deprecated, reason: sentences of the given documents (doc_id) are deprecated with their parent."""
    gone = documents.select(F.col("doc_id").alias("gone")).distinct()
    out = sentences.join(gone, sentences["doc_id"] == gone["gone"], "left")
    return out.select("sid", "doc_id", F.col("gone").isNotNull().alias("deprecated"), F.when(F.col("gone").isNotNull(), "parent_deprecated").alias("reason"))


def restore(state: DataFrame, documents: DataFrame) -> DataFrame:
    """Undoes `deprecate` for the given documents, where the reason was the parent."""
    back = documents.select(F.col("doc_id").alias("back")).distinct()
    rows = state.join(back, state["doc_id"] == back["back"], "left")
    undo = F.col("back").isNotNull() & (F.col("reason") == "parent_deprecated")
    return rows.select("sid", "doc_id", F.when(undo, False).otherwise(F.col("deprecated")).alias("deprecated"), F.when(~F.coalesce(undo, F.lit(False)), F.col("reason")).alias("reason"))


def orphans(mentions: DataFrame, state: DataFrame) -> DataFrame:
    """eid of entities without a mention in a sentence that is not deprecated."""
    alive = mentions.join(state.where("not deprecated").select("sid"), "sid", "left_semi").select("eid").distinct()
    return mentions.select("eid").distinct().join(alive, "eid", "left_anti")


def impact(mentions: DataFrame, sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, sentences, mentions, orphans: what deleting each of the documents would remove."""
    own = sentences.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("sid", "doc_id")
    spread = mentions.join(sentences.select("sid", "doc_id"), "sid").groupBy("eid", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    only = spread.groupBy("eid").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("doc_id")).where("docs = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("orphans"))
    per = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    m = spread.groupBy("doc_id").agg(F.sum("m").alias("mentions"))
    return per.join(m, "doc_id", "left").join(only, "doc_id", "left").fillna(0, ["mentions", "orphans"])


def stale_edges(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Edges (src, dst) of which an end is deprecated."""
    dead = state.where("deprecated").select("sid")
    a = edges.join(dead, edges["src"] == dead["sid"], "left_semi")
    b = edges.join(dead, edges["dst"] == dead["sid"], "left_semi")
    return a.unionAll(b).distinct()


def isolation(tables: dict[str, DataFrame], tenant: str = "group_id") -> DataFrame:
    """label, missing: rows of each table without a tenant."""
    parts = [df.agg(F.count_if(F.col(tenant).isNull() | (F.col(tenant) == "")).alias("missing")).select(F.lit(name).alias("label"), "missing") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def health(sentences: DataFrame, mentions: DataFrame, edges: DataFrame, computed: DataFrame, violations: DataFrame) -> DataFrame:
    """Counts of every group and their `health_score`.

    sentences (sid, doc_id, group_id, deprecated), mentions (sid, eid), edges
    (src, dst) between sentences, computed (group_id, last_change, last_computed),
    violations (label, missing) as `isolation` gives them. A document is deprecated
    in a group if all its sentences there are; an entity is an orphan of a group
    that only deprecated sentences of it mention; an edge is stale in the group of
    its first end if either end is deprecated; a group that changed after its last
    computation, or was never computed, is stale. Rows without a tenant count
    against every group, and are in no group.
    """
    own = sentences.where("group_id is not null")
    live = F.bool_or(~F.col("deprecated"))
    docs = own.groupBy("group_id", "doc_id").agg(live.alias("live")).groupBy("group_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("live")).alias("deprecated"))
    place = own.select("sid", "group_id", "deprecated")
    entities = place.join(mentions.select("sid", "eid"), "sid").groupBy("group_id", "eid").agg(live.alias("live")).groupBy("group_id").agg(F.count(F.lit(1)).alias("entities"), F.count_if(~F.col("live")).alias("orphans"))
    ends = place.select(F.col("sid").alias("dst"), F.col("deprecated").alias("other"))
    stale = edges.select("src", "dst").distinct().join(place.withColumnRenamed("sid", "src"), "src").join(ends, "dst", "left").where(F.col("deprecated") | F.coalesce("other", F.lit(False))).groupBy("group_id").agg(F.count(F.lit(1)).alias("stale"))
    late = computed.select("group_id", F.coalesce(F.col("last_change") > F.col("last_computed"), F.col("last_computed").isNull()).alias("is_stale"))
    out = docs.join(entities, "group_id", "left").join(stale, "group_id", "left").join(late, "group_id", "left")
    out = out.crossJoin(F.broadcast(violations.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))))  # one row
    return health_score(out.fillna(0, ["entities", "orphans", "stale"]).fillna(False, ["is_stale"]))


def health_score(stats: DataFrame) -> DataFrame:
    """Adds `score`, 100 less: the percentage of orphans among entities, up to 20; a tenth of the stale edges, up to 15; 10 for a stale group; 5 for each row without a tenant, up to 30; 20 times the share of deprecated documents over a half, up to 10."""

    def share(part: str, whole: str):
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    score = (
        100.0
        - F.least(F.lit(20.0), 100.0 * share("orphans", "entities"))
        - F.least(F.lit(15.0), F.col("stale") / 10.0)
        - F.when(F.col("is_stale"), 10.0).otherwise(0.0)
        - F.least(F.lit(30.0), 5.0 * F.col("missing"))
        - F.least(F.lit(10.0), 20.0 * F.greatest(share("deprecated", "documents") - 0.5, F.lit(0.0)))
    )
    return stats.withColumn("score", F.greatest(F.round(score, 1), F.lit(0.0)))


def without_documents(documents: DataFrame, sentences: DataFrame, mentions: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables (documents, sentences, mentions) after the documents in `gone` (doc_id) are deleted with all below them, and `entities` (eid): those that only stood there."""
    ids = gone.select("doc_id").distinct()
    left = sentences.join(ids, "doc_id", "left_anti")
    kept = mentions.join(left.select("sid"), "sid", "left_semi")
    lost = mentions.select("eid").distinct().join(kept.select("eid").distinct(), "eid", "left_anti")
    return {"documents": documents.join(ids, "doc_id", "left_anti"), "sentences": left, "mentions": kept, "entities": lost}


def renamed(rows: DataFrame, names: DataFrame, keep_alias: bool = True) -> DataFrame:
    """Documents (doc_id, aliases) under their new ids (old, new); the old id joins the aliases."""
    out = rows.join(names, rows["doc_id"] == names["old"], "left")
    alias = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.col("old").cast("string")))
    aliases = F.when(F.col("old").isNotNull() & F.lit(keep_alias), alias).otherwise(F.col("aliases"))
    return out.withColumns({"doc_id": F.coalesce("new", "doc_id"), "aliases": aliases}).drop("old", "new")


def without_dead_vectors(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Vectors (sid, embedding) with null for those of deprecated sentences."""
    dead = state.where("deprecated").select("sid", F.lit(True).alias("dead"))
    return vectors.join(dead, "sid", "left").withColumn("embedding", F.when(F.col("dead").isNull(), F.col("embedding"))).drop("dead")


def collected(mentions: DataFrame, edges: DataFrame, vectors: DataFrame, state: DataFrame) -> DataFrame:
    """step, touched: garbage collection in order - orphan entities, stale edges, dead vectors - and how many rows each step takes away."""
    steps = {"1 entities": orphans(mentions, state), "2 edges": stale_edges(edges, state), "3 vectors": vectors.where("embedding is not null").join(state.where("deprecated").select("sid"), "sid", "left_semi")}
    parts = [df.agg(F.count(F.lit(1)).alias("touched")).select(F.lit(name).alias("step"), "touched") for name, df in steps.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def without_group(tables: dict[str, DataFrame], group: str, tenant: str = "group_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without a group's rows, and label, deleted: how many rows that are."""
    parts = [df.agg(F.count_if(F.col(tenant) == group).alias("deleted")).select(F.lit(name).alias("label"), "deleted") for name, df in tables.items()]
    count = parts[0]
    for p in parts[1:]:
        count = count.unionAll(p)
    return {name: df.where(~F.col(tenant).eqNullSafe(F.lit(group))) for name, df in tables.items()}, count


def without_folder(tree: DataFrame, root, cascade: bool = True) -> DataFrame:
    """Folders (id, parent) without `root`: with all below it, or, without `cascade`, its children move up to its parent."""
    from .graph import descendants

    if cascade:
        return tree.join(descendants(tree, root).select("id"), "id", "left_anti")
    up = tree.where(F.col("id") == root).select(F.col("id").alias("__at"), F.col("parent").alias("__up"))
    moved = tree.where(F.col("id") != root).join(F.broadcast(up), F.col("parent") == F.col("__at"), "left")  # one row
    return moved.select("id", F.when(F.col("__at").isNotNull(), F.col("__up")).otherwise(F.col("parent")).alias("parent"))


def page(rows: DataFrame, order: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next `size` rows by (order, key) after the last row of the page before, given as its (order, key)."""
    if after is not None:
        value, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(order) > value) | ((F.col(order) == value) & (F.col(key) > last)))
    return rows.orderBy(order, key).limit(size)


def stale_groups(changes: DataFrame, computed: DataFrame) -> DataFrame:
    """group_id of groups (group_id, ts) that changed after they were last computed (group_id, ts), or never were."""
    c = changes.groupBy("group_id").agg(F.max("ts").alias("changed"))
    return c.join(computed.groupBy("group_id").agg(F.max("ts").alias("done")), "group_id", "left").where("done is null or changed > done").select("group_id")


def sole_owned(owners: DataFrame, document, only_owner: bool = True) -> DataFrame:
    """Content rows (content_id, owner) that deleting a document's content keeps: those of others, and with `only_owner` those that have further owners."""
    own = owners.where(F.col("owner") == document).select("content_id").distinct()
    if not only_owner:
        return owners.join(own, "content_id", "left_anti")
    alone = owners.join(own, "content_id", "left_semi").groupBy("content_id").agg(F.countDistinct("owner").alias("n")).where("n = 1").select("content_id")
    return owners.join(alone, "content_id", "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n of keys that stand more than once or are null in part: what a uniqueness constraint would refuse."""
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | missing)

"""Graph-pattern joins and aggregations over mention and edge tables.

`mentions` is (sid, eid), one row a pair; `sentences` is (sid, doc_id,
section_id, idx, ...). A hot entity or section may own a large share of the
mentions: counts pre-aggregate before their shuffle, and pair counts start
from distinct (section, entity) rows, never from sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import durable


def entity_importance(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """eid, degree (edges at either end), chunk_count and 0.3 degree + 0.7 chunk_count."""
    degree = edges.select(F.col("src").alias("eid")).unionAll(edges.select(F.col("dst").alias("eid"))).groupBy("eid").agg(F.count(F.lit(1)).alias("degree"))
    chunks = mentions.groupBy("eid").agg(F.count(F.lit(1)).alias("chunk_count"))
    out = chunks.join(degree, "eid", "full").fillna(0, ["degree", "chunk_count"])
    return out.withColumn("importance", F.round(0.3 * F.col("degree") + 0.7 * F.col("chunk_count"), 6))


def appears_in(mentions: DataFrame, sentences: DataFrame, level: str) -> DataFrame:
    """eid, `level` and how many sentences of it mention the entity."""
    return mentions.join(sentences.select("sid", level), "sid").groupBy("eid", level).agg(F.count(F.lit(1)).alias("mentions"))


def documents_of(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """eid, doc_id, mention_count and section_count (distinct)."""
    per = mentions.join(sentences.select("sid", "doc_id", "section_id"), "sid").groupBy("eid", "doc_id", "section_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("eid", "doc_id").agg(F.sum("c").alias("mention_count"), F.count(F.lit(1)).alias("section_count"))


def hubs(mentions: DataFrame, sentences: DataFrame, k: int = 3) -> DataFrame:
    """The k entities of most sentences in each section; ties by eid."""
    per = appears_in(mentions, sentences, "section_id")
    rank = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("mentions"), "eid"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k)


def shares_entity(mentions: DataFrame, sentences: DataFrame, least: int = 2, block: int = 256, unit=("doc_id", "section_id")) -> DataFrame:
    """Pairs of units of different documents that share at least `least` entities: a, b, shared, boost = 0.1 shared.

    Every entity counts, however common. The units of an entity are dealt to
    blocks of about `block`, and each pair of blocks is a join key of its own,
    so that no task makes all pairs of a common entity.
    """
    units = mentions.join(sentences.select("sid", *unit), "sid").select("eid", F.col(unit[0]).alias("doc"), F.col(unit[1]).alias("sec")).distinct()
    count = units.groupBy("eid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("eid", F.ceil(F.col("n") / block).alias("blocks"))
    u = units.join(count, "eid").withColumn("own", F.pmod(F.xxhash64("doc", "sec"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = u.select("eid", F.col("own").alias("i"), other.alias("j"), F.col("doc").alias("doc_a"), F.col("sec").alias("sec_a"))
    b = u.select("eid", other.alias("i"), F.col("own").alias("j"), F.col("doc").alias("doc_b"), F.col("sec").alias("sec_b"))
    return (
        a.join(b, ["eid", "i", "j"])
        .where("doc_a < doc_b")
        .groupBy("doc_a", "sec_a", "doc_b", "sec_b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= least)
        .withColumn("boost", F.round(0.1 * F.col("shared"), 6))
    )


def co_mentions(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Pairs a < b of entities in at least `least` common sentences. A sentence mentions few entities, so pairs stay linear in sentences."""
    a, b = mentions.alias("a"), mentions.alias("b")
    return a.join(b, "sid").where("a.eid < b.eid").groupBy(F.col("a.eid").alias("a"), F.col("b.eid").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def cross_document(mentions: DataFrame, sentences: DataFrame, least: int = 2, titles: int = 5) -> DataFrame:
    """eid, doc_count, mentions and the first documents of entities in at least `least` documents."""
    docs = documents_of(mentions, sentences)
    rank = F.row_number().over(Window.partitionBy("eid").orderBy("doc_id"))
    first = docs.withColumn("r", rank).groupBy("eid").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("mention_count").alias("mentions"), F.sort_array(F.collect_list(F.when(F.col("r") <= titles, F.col("doc_id")))).alias("first_docs")
    )
    return first.where(F.col("doc_count") >= least)


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """node, distance (1 to depth) and paths: nodes reached from `seeds` (node) over undirected edges, with the count of shortest walks."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = seeds.select(F.col("node"), F.lit(1).cast("long").alias("paths")).distinct()
    seen, out = front.select("node"), None
    for d in range(1, depth + 1):
        step = front.join(both, front["node"] == both["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = step.join(seen, "node", "left_anti")
        layer = front.select("node", F.lit(d).alias("distance"), "paths")
        out = layer if out is None else out.unionAll(layer)
        seen = seen.unionAll(front.select("node"))
    return out


def decayed_spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, per_seed: int = 25, per_neighbour: int = 10) -> DataFrame:
    """node, score: 1 for a seed, d for its first `per_seed` neighbours by id, d^2 for the first `per_neighbour` of each of those; scores add up."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    top = lambda n: both.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("r") <= n).drop("r")
    zero = seeds.select("node", F.lit(1.0).alias("score")).distinct()
    one = zero.join(top(per_seed), zero["node"] == F.col("src")).select(F.col("dst").alias("node"), (F.col("score") * damping).alias("score"))
    two = one.join(top(per_neighbour), one["node"] == F.col("src")).select(F.col("dst").alias("node"), (F.col("score") * damping).alias("score"))
    return zero.unionAll(one).unionAll(two).groupBy("node").agg(F.round(F.sum("score"), 6).alias("score"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.5, rounds: int = 50, tolerance: float = 1e-6, dangling: bool = False, passages: DataFrame | None = None, self_loops: float = 0.0, devalue_hubs: bool = False) -> DataFrame:
    """node, score: personalised power iteration over weighted undirected edges (src, dst, w).

    Mass leaves a node in proportion to its edges' weights. Seeds are (node,
    weight), summed to 1; without any weight there is no row. What nodes without
    edges hold is lost, or with `dangling` goes back to the seeds, so that
    scores sum to 1. Nodes in `passages` (node) keep mass as by an edge of
    weight `self_loops` to themselves; with `devalue_hubs` what other nodes pass
    on is divided by the number of their edges. Rounds end when the scores
    change by less than `tolerance` in sum, after `rounds` at most. Every round
    is one join and one aggregation on the node, and is written to the
    checkpoint folder.
    """
    both = edges.select("src", "dst", "w").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = both.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = both.groupBy("src").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("degree"))
    kept = (passages if passages is not None else seeds.limit(0)).select(F.col("node").alias("src"), F.lit(float(self_loops)).alias("loop")).distinct()
    out = out.join(kept, "src", "left").withColumn("s", F.col("s") + F.coalesce("loop", F.lit(0.0)))
    share = F.col("w") / F.col("s")
    if devalue_hubs:
        share = F.when(F.col("loop").isNull(), share / F.greatest("degree", F.lit(1))).otherwise(share)
    arcs = both.join(out, "src").select("src", "dst", share.alias("p"))
    if self_loops > 0:
        arcs = arcs.unionAll(out.where("loop is not null").select("src", F.col("src").alias("dst"), (F.col("loop") / F.col("s")).alias("p")))
    arcs = durable(arcs)
    total = seeds.agg(F.sum("weight").alias("t")).where("t > 0")
    start = seeds.groupBy("node").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(total)).select("node", (F.col("weight") / F.col("t")).alias("score"))  # one row
    rank = start = durable(start)
    ends = durable(start.join(arcs.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node")) if dangling else None  # only a seed can have mass and no edge
    for _ in range(rounds):
        back = 1 - damping
        if ends is not None:
            back += damping * (rank.join(ends, "node", "left_semi").agg(F.sum("score")).first()[0] or 0.0)
        moved = rank.join(arcs, rank["node"] == arcs["src"]).select(F.col("dst").alias("node"), (F.col("score") * F.col("p") * damping).alias("score"))
        new = durable(moved.unionAll(start.select("node", (F.col("score") * back).alias("score"))).groupBy("node").agg(F.sum("score").alias("score")))
        both = new.unionAll(rank.select("node", (-F.col("score")).alias("score"))).groupBy("node").agg(F.sum("score").alias("d"))
        change = both.agg(F.sum(F.abs("d"))).first()[0]
        rank = new
        if change is None or change < tolerance:
            break
    return rank


def weighted_graph(related: DataFrame, mentions: DataFrame, similar: DataFrame, least: float = 0.7) -> DataFrame:
    """src, dst, w: one undirected graph of entities and sentences, as strings `e<id>` and `s<id>`.

    Of related entities (src, dst, w) the first weight by (src, dst) of each pair that has two directions, a mention
    with 1, similar sentences (a, b, score) of at least `least`.
    """
    e, s = (lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("s"), F.col(c).cast("string")))
    pair = related.where("src <> dst").groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.min(F.struct("src", "dst", "w"))["w"].alias("w"))
    return pair.select(e("x").alias("src"), e("y").alias("dst"), "w").unionAll(mentions.select(s("sid"), e("eid"), F.lit(1.0))).unionAll(similar.where(F.col("score") >= least).select(s("a"), s("b"), "score"))


def near_sections(similar: DataFrame, ordinals: DataFrame) -> DataFrame:
    """a, b, w: similarity of sections (a, b, score) less what their distance in order (id, ordinal) costs: score / (1 + 0.2 gap)."""
    x, y = (ordinals.select(F.col("id").alias(c), F.col("ordinal").alias(f"o{c}")) for c in ("a", "b"))
    return similar.join(x, "a").join(y, "b").select("a", "b", F.round(F.col("score") / (1 + 0.2 * F.abs(F.col("oa") - F.col("ob"))), 6).alias("w"))


def relations_or_co_mentions(related: DataFrame, mentions: DataFrame) -> DataFrame:
    """src, dst, w: the related entities, or, if there are none, entities in common sentences by their number."""
    if not related.isEmpty():
        return related.select("src", "dst", "w")
    return co_mentions(mentions, 1).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").cast("double").alias("w"))


def five_paths(seeds: DataFrame, related: DataFrame, mentions: DataFrame, sentences: DataFrame, similar: DataFrame, hubs_: DataFrame, damping: float = 0.85) -> DataFrame:
    """eid, score: what seeds (eid, weight) reach on five paths, each a weighted join, summed.

    An entity itself (1), related ones (d), those of the same section (d^2), of a section that is similar (section_id,
    other, score) to it (d^2 times the score), and hubs (section_id, eid) of its sections (d^3). A path counts once
    for each pair of entities.
    """
    zero = seeds.groupBy("eid").agg(F.sum("weight").alias("weight"))
    at = mentions.join(sentences.select("sid", "section_id"), "sid").select("eid", "section_id").distinct()
    own = zero.join(at, "eid").select("eid", "weight", "section_id")
    both = related.select("src", "dst").unionAll(related.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    there = at.select(F.col("eid").alias("to"), "section_id")
    reach = lambda rows, gain: rows.where("eid <> to").groupBy("eid", "to").agg(F.max("weight").alias("w"), F.max(gain).alias("g")).select(F.col("to").alias("eid"), (F.col("w") * F.col("g")).alias("score"))
    paths = [
        zero.select("eid", F.col("weight").alias("score")),
        reach(zero.join(both, zero["eid"] == both["src"]).withColumnRenamed("dst", "to"), F.lit(damping)),
        reach(own.join(there, "section_id"), F.lit(damping**2)),
        reach(own.join(similar, "section_id").drop("section_id").withColumnRenamed("other", "section_id").join(there, "section_id"), F.col("score") * damping**2),
        reach(own.join(hubs_.select("section_id", F.col("eid").alias("to")), "section_id"), F.lit(damping**3)),
    ]
    out = paths[0]
    for p in paths[1:]:
        out = out.unionAll(p)
    return out.groupBy("eid").agg(F.round(F.sum("score"), 6).alias("score"))


def target_documents(mentions: DataFrame, sentences: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, vote: each seed entity (eid) votes 1 / its number of documents for each of them."""
    docs = seeds.join(documents_of(mentions, sentences), "eid")
    count = docs.groupBy("eid").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(count, "eid").groupBy("doc_id").agg(F.round(F.sum(1 / F.col("n")), 6).alias("vote"), F.count(F.lit(1)).alias("seeds"))


def expand_by_entities(mentions: DataFrame, seeds: DataFrame, sentences: DataFrame, least: int = 1) -> DataFrame:
    """sid, overlap, score: sentences that share `least` entities with seed sentences (sid, score); 0.8 of the least seed score, 1.3 times in the same section."""
    own = seeds.join(mentions, "sid").join(sentences.select("sid", "section_id"), "sid").select(F.col("eid"), F.col("score").alias("s"), F.col("section_id").alias("sec"))
    found = own.join(mentions, "eid").join(seeds.select("sid"), "sid", "left_anti").join(sentences.select("sid", "section_id"), "sid")
    return (
        found.groupBy("sid")
        .agg(F.countDistinct("eid").alias("overlap"), F.min("s").alias("m"), F.max((F.col("section_id") == F.col("sec")).cast("int")).alias("same"))
        .where(F.col("overlap") >= least)
        .select("sid", "overlap", F.round(F.col("m") * 0.8 * F.when(F.col("same") == 1, 1.3).otherwise(1.0), 6).alias("score"))
    )


def descendants(tree: DataFrame, root: Column) -> DataFrame:
    """id, depth of everything below and including `root` in (id, parent), however deep; each level is written out, and a node is reached once, so a cycle ends."""
    front = durable(tree.where(F.col("id") == root).select("id", F.lit(0).alias("depth")))
    out, d = front, 0
    while not front.isEmpty():
        d += 1
        below = tree.join(front.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        front = durable(below.join(out.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth")))
        out = out.unionAll(front)
    return out


def overlapping(left: DataFrame, right: DataFrame, width: int = 256) -> DataFrame:
    """Interval join within a document: rows of both (doc_id, start, end, id) with left.start < right.end and right.start < left.end.

    Intervals are laid over cells of `width`, so the join is an equi-join on
    (doc, cell); a pair that meets in several cells counts in the first.
    """
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width))))
    a = cells(left).select("doc_id", "cell", F.col("id").alias("a_id"), F.col("start").alias("a0"), F.col("end").alias("a1"))
    b = cells(right).select("doc_id", "cell", F.col("id").alias("b_id"), F.col("start").alias("b0"), F.col("end").alias("b1"))
    met = a.join(b, ["doc_id", "cell"]).where("a0 < b1 and b0 < a1").where(F.col("cell") == F.floor(F.greatest("a0", "b0") / width))
    return met.select("doc_id", "a_id", "b_id", (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("overlap"))

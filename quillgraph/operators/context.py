"""From entities, sections and hits to the passages around them.

`entities` is (eid, name, kind, description), `mentions` (sid, eid),
`sentences` (sid, doc_id, section_id, idx, score), `edges` (src, dst, w).
Everything is joins on ids and ranks within a key; seeds are stated and small,
so Spark may broadcast them by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import top_per_group
from .resolve import token_overlap


def triples(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, triple: `subject | description | object` of every edge between two known entities; edges without a description have none."""
    s, o = (entities.select(F.col("eid").alias(k), F.col("name").alias(n)) for k, n in (("src", "subject"), ("dst", "object")))
    rows = edges.where(F.coalesce("description", F.lit("")) != "").join(s, "src").join(o, "dst")
    return rows.select("src", "dst", F.concat_ws(" | ", "subject", "description", "object").alias("triple"))


def triple_documents(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """src, dst, doc_id: the first document (eid, doc_id) that both ends stand in, else the subject's first; null if it stands in none."""
    a = documents.select(F.col("eid").alias("src"), "doc_id")
    b = documents.select(F.col("eid").alias("dst"), "doc_id")
    pairs = edges.select("src", "dst").distinct()
    both = pairs.join(a, "src").join(b, ["dst", "doc_id"]).groupBy("src", "dst").agg(F.min("doc_id").alias("shared"))
    own = a.groupBy("src").agg(F.min("doc_id").alias("first"))
    return pairs.join(both, ["src", "dst"], "left").join(own, "src", "left").select("src", "dst", F.coalesce("shared", "first").alias("doc_id"))


def relations_of(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """eid, other, out, w: every edge of the given entities (eid), from either end."""
    e = entities.select("eid").distinct()
    out = edges.select(F.col("src").alias("eid"), F.col("dst").alias("other"), F.lit(True).alias("out"), "w")
    back = edges.select(F.col("dst").alias("eid"), F.col("src").alias("other"), F.lit(False).alias("out"), "w")
    return out.unionAll(back).join(e, "eid", "left_semi")


def by_names(seeds: DataFrame, names: DataFrame, fields: DataFrame, most: int = 10) -> DataFrame:
    """seed, name, step: names for seed phrases, step by step for what is still unmatched.

    1: the name itself (canonical key), 2: a field's key, 3: a name that holds the seed or stands in it (words in a
    row; `most` a seed), 4: a name with a word of 3 letters in common (`most` a seed, most words first).
    `names` is (name), `fields` (key, name).
    """
    key = lambda c: T.canonical_key(F.col(c))
    rest = seeds.select("seed").distinct().withColumn("k", key("seed"))
    known = names.select("name").distinct().withColumn("k", key("name"))
    steps = []

    def done(found: DataFrame, step: int) -> None:
        nonlocal rest
        steps.append(found.select("seed", "name", F.lit(step).alias("step")))
        rest = rest.join(found.select("seed").distinct(), "seed", "left_anti")

    done(rest.join(known, "k").select("seed", "name"), 1)
    done(rest.join(fields.select(key("key").alias("k"), "name").distinct(), "k").select("seed", "name"), 2)
    # a phrase that stands in another shares all its words in a row: both sides meet on the shorter one's text
    runs = lambda df, c: df.withColumn("w", F.split("k", " ")).select(c, F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.size("w") - i + 1), lambda n: F.array_join(F.slice("w", i, n), " ")))))).alias("k"))
    inside = runs(known, "name").join(rest, "k").select("seed", "name").unionAll(runs(rest, "seed").join(known, "k").select("seed", "name")).distinct()
    done(top_per_group(inside, ["seed"], [F.col("name")], most), 3)
    done(top_per_group(token_overlap(rest, names.select("name").distinct()), ["seed"], [F.desc("shared"), F.col("name")], most), 4)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionAll(s)
    return out


def of_sentences(mentions: DataFrame, degree: DataFrame, sids: DataFrame, k: int = 5) -> DataFrame:
    """sid, eid, rank: the k entities of most degree (eid, degree) of each of the sentences (sid)."""
    rows = mentions.join(sids, "sid", "left_semi").join(degree, "eid", "left").fillna(0, ["degree"])
    return top_per_group(rows, ["sid"], [F.desc("degree"), F.col("eid")], k).select("sid", "eid", "rank")


def chunks_of_sections(seeds: DataFrame, mentions: DataFrame, sentences: DataFrame, k: int = 10) -> DataFrame:
    """eid, sid, weight: sentences of the sections that mention a seed entity (eid): 1 where the sentence does itself, else 0.5; the best k by weight, then by id."""
    own = mentions.join(seeds.select("eid").distinct(), "eid", "left_semi")
    section = own.join(sentences.select("sid", "doc_id", "section_id"), "sid").select("eid", "doc_id", "section_id").distinct()
    rows = section.join(sentences.select("sid", "doc_id", "section_id"), ["doc_id", "section_id"]).join(own.withColumn("own", F.lit(True)), ["eid", "sid"], "left")
    weight = F.when(F.col("own"), 1.0).otherwise(0.5)
    return top_per_group(rows.withColumn("weight", weight), ["eid"], [F.desc("weight"), F.col("sid")], k).select("eid", "sid", "weight")


def chunks_of_mentions(seeds: DataFrame, mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """eid, sid, doc_id, section_id of every sentence that mentions a seed entity."""
    return mentions.join(seeds.select("eid").distinct(), "eid", "left_semi").join(sentences.select("sid", "doc_id", "section_id"), "sid", "left").select("eid", "sid", "doc_id", "section_id")


def capped_chunks(rows: DataFrame, per_entity: int = 12, per_section: int = 3, per_document: int = 6) -> DataFrame:
    """The first rows (eid, sid, doc_id, section_id, idx) of each entity by document and place: capped for each section, then each document, then in all."""
    order = [F.col("doc_id"), F.col("idx"), F.col("sid")]
    a = top_per_group(rows, ["eid", "doc_id", "section_id"], order, per_section).drop("rank")
    b = top_per_group(a, ["eid", "doc_id"], order, per_document).drop("rank")
    return top_per_group(b, ["eid"], order, per_entity)


def full_context(seeds: DataFrame, entities: DataFrame, mentions: DataFrame, sentences: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """eid, name, description, chunks, documents, relations: the first k sentences and strongest k edges of each seed, and how many documents it stands in."""
    own = chunks_of_mentions(seeds, mentions, sentences)
    chunk = top_per_group(own, ["eid"], [F.col("sid")], k).groupBy("eid").agg(F.sort_array(F.collect_list("sid")).alias("chunks"))
    docs = own.groupBy("eid").agg(F.countDistinct("doc_id").alias("documents"))
    rel = top_per_group(relations_of(edges, seeds), ["eid"], [F.desc("w"), F.col("other"), F.col("out")], k).groupBy("eid").agg(F.sort_array(F.collect_list(F.struct("rank", "other")))["other"].alias("relations"))
    out = seeds.select("eid").distinct().join(entities, "eid").join(chunk, "eid", "left").join(docs, "eid", "left").join(rel, "eid", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return out.select("eid", "name", "description", F.coalesce("chunks", none).alias("chunks"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("relations", none).alias("relations"))


def stitched(hits: DataFrame, sentences: DataFrame, text: str = "text") -> DataFrame:
    """sid, score, passage: each hit (sid, score) once, with its best score, between the sentence before and after it in its document."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = sentences.select("sid", F.concat_ws(" ", F.lag(text).over(w), F.col(text), F.lead(text).over(w)).alias("passage"))
    return rows.join(hits.groupBy("sid").agg(F.max("score").alias("score")), "sid").select("sid", "score", "passage")


def skeleton(seeds: DataFrame, related: DataFrame, sentences: DataFrame, least: float = 0.45, reach: int = 2) -> DataFrame:
    """sid, score: seeds (sid, score) of at least `least`, what they are related to (src, dst, sim), and their neighbours in the section.

    A related sentence has score * sim * 0.85 in the same section, else * 0.6; neighbours up to `reach` places away
    have 0.9 of the score. A sentence keeps its best.
    """
    zero = seeds.where(F.col("score") >= least).select("sid", "score")
    place = sentences.select("sid", "doc_id", "section_id", "idx")
    both = related.unionAll(related.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    at = zero.join(place, "sid")
    there = place.select(F.col("sid").alias("dst"), F.col("doc_id").alias("d2"), F.col("section_id").alias("s2"))
    same = (F.col("doc_id") == F.col("d2")) & (F.col("section_id") == F.col("s2"))
    one = at.join(both, at["sid"] == both["src"]).join(there, "dst").select(F.col("dst").alias("sid"), (F.col("score") * F.col("sim") * F.when(same, 0.85).otherwise(0.6)).alias("score"))
    w = Window.partitionBy("doc_id", "section_id").orderBy("idx", "sid")
    steps = place.select("sid", F.array(*[f(c, n).over(w) for n in range(1, reach + 1) for f, c in ((F.lag, "sid"), (F.lead, "sid"))]).alias("near"))
    two = zero.join(steps, "sid").select(F.explode("near").alias("n"), F.col("score")).where("n is not null").select(F.col("n").alias("sid"), (F.col("score") * 0.9).alias("score"))
    return zero.unionAll(one).unionAll(two).groupBy("sid").agg(F.round(F.max("score"), 6).alias("score"))


def community_sentences(members: DataFrame, communities: DataFrame, mentions: DataFrame, sentences: DataFrame, k: int = 5) -> DataFrame:
    """community, sid, rank: the first k sentences by (document, place) that mention a member (node, community) of each given community."""
    own = members.join(communities.select("community").distinct(), "community", "left_semi").select("community", F.col("node").alias("eid"))
    rows = own.join(mentions, "eid").select("community", "sid").distinct().join(sentences.select("sid", "doc_id", "idx"), "sid")
    return top_per_group(rows, ["community"], [F.col("doc_id"), F.col("idx"), F.col("sid")], k).select("community", "sid", "rank")


def section_entities(sections: DataFrame, mentions: DataFrame, sentences: DataFrame, k: int = 10) -> DataFrame:
    """section_id, eid, mentions, rank: the k entities of most mentions in each given section (section_id)."""
    rows = sentences.join(sections.select("section_id").distinct(), "section_id", "left_semi").select("sid", "section_id").join(mentions, "sid").groupBy("section_id", "eid").agg(F.count(F.lit(1)).alias("mentions"))
    return top_per_group(rows, ["section_id"], [F.desc("mentions"), F.col("eid")], k)


def communities_of_folder(members: DataFrame, documents: DataFrame, folder_docs: DataFrame) -> DataFrame:
    """community of those with any member (node, community) in a document (eid, doc_id) of the folder (doc_id)."""
    inside = documents.join(folder_docs.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("eid").alias("node")).distinct()
    return members.join(inside, "node", "left_semi").select("community").distinct()


def roots(tree: DataFrame, depth: int = 16) -> DataFrame:
    """id, root: the topmost ancestor of every row of (id, parent), by jumping to the parent's own ancestor."""
    from .iterate import durable

    at = durable(tree.select("id", F.coalesce("parent", "id").alias("root")))
    for _ in range(depth):
        up = at.select(F.col("id").alias("__i"), F.col("root").alias("__r"))
        new = durable(at.join(up, at["root"] == up["__i"], "left").select("id", F.coalesce("__r", "root").alias("root"), F.col("root").alias("was")))
        at = new.drop("was")
        if new.where("root <> was").isEmpty():
            break
    return at


def cut_spans(documents: DataFrame, spans: DataFrame, most: int) -> DataFrame:
    """doc_id, idx, sentence: texts (doc_id, text) cut by the first `most` spans (doc_id, idx, offset, length) of each document."""
    first = top_per_group(spans, ["doc_id"], [F.col("idx")], most)
    return first.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "idx", F.substr("text", F.col("offset") + 1, F.col("length")).alias("sentence"))


def nested_documents(sentences: DataFrame, value: str) -> DataFrame:
    """doc_id, n, items: every document with its sentences' values in order, as one array a document."""
    return sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("idx", value)))[value].alias("items"))


def by_entity_pattern(entities: DataFrame, mentions: DataFrame, pattern: str, k: int) -> DataFrame:
    """sid, score: sentences by the share of k that the distinct entities fill whose name fits the pattern; the best k."""
    hit = mentions.join(entities.where(F.col("name").rlike(pattern)).select("eid"), "eid", "left_semi")
    rows = hit.groupBy("sid").agg(F.round(F.countDistinct("eid") / k, 6).alias("score"))
    return rows.orderBy(F.desc("score"), "sid").limit(k)


def structured(sentences: DataFrame, values: DataFrame, mentions: DataFrame, k: int = 3) -> DataFrame:
    """sid, n_entities, entities, keys: each sentence with its first k entities and the keys of the field values (doc_id, title, key) whose title holds the first 20 signs of its heading."""
    ent = top_per_group(mentions, ["sid"], [F.col("eid")], k).groupBy("sid").agg(F.sort_array(F.collect_list("eid")).alias("entities"))
    count = mentions.groupBy("sid").agg(F.count(F.lit(1)).alias("n_entities"))
    head = F.upper(F.substring("heading", 1, 20))
    pairs = sentences.select("sid", "doc_id", "heading").join(values, "doc_id").where(F.upper("title").contains(head)).groupBy("sid").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return sentences.select("sid").join(count, "sid", "left").join(ent, "sid", "left").join(pairs, "sid", "left")


def spread(rows: DataFrame, group: str, order: list[Column], back: list[Column], k: int) -> DataFrame:
    """The first and last rows of each group, k in all: the head has the odd one."""
    up, down = F.row_number().over(Window.partitionBy(group).orderBy(*order)), F.row_number().over(Window.partitionBy(group).orderBy(*back))
    return rows.withColumns({"head": up, "tail": down}).where((F.col("head") <= -(-k // 2)) | (F.col("tail") <= k // 2))

"""Entity resolution: names to canonical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Corporate endings that do not tell names apart.
SUFFIXES = ("inc", "llc", "ltd", "corp", "corporation", "company", "co", "gmbh", "plc", "limited")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), "")


def bare_name(name: Column) -> Column:
    """Canonical key without a corporate ending."""
    return F.trim(F.regexp_replace(T.canonical_key(name), r"\s(" + "|".join(SUFFIXES) + r")$", ""))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): smallest node of each component of (u, v), by passing minima along edges and jumping to the minimum's own minimum.

    Each round is checkpointed to the cluster's shared folder, so lineage stays short and executors may be lost.
    """
    from .iterate import durable

    both = durable(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = durable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("root").alias("m"))
        low = label.join(near, label["node"] == near["u"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        up = label.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = durable(low.join(up, low["root"] == up["n2"]).select("node", F.least("root", "r2").alias("root"), "was"))
        label = new.drop("was")
        if new.where("root <> was").isEmpty():
            return label
    raise RuntimeError("components did not settle")


# Short forms and what they stand for.
ABBREVIATIONS = {
    "dr": "doctor",
    "mr": "mister",
    "mrs": "missus",
    "ms": "miss",
    "prof": "professor",
    "intl": "international",
    "corp": "corporation",
    "inc": "incorporated",
    "ltd": "limited",
    "co": "company",
    "dept": "department",
    "gov": "government",
    "govt": "government",
    "mgmt": "management",
    "mgt": "management",
    "assoc": "association",
    "natl": "national",
}


def plain_words(name: Column) -> Column:
    return F.transform(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: F.regexp_replace(w, r"[^\w]", ""))


def expanded(name: Column) -> Column:
    """Lower-cased words without signs, short forms spelled out."""
    forms = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(plain_words(name), lambda w: F.coalesce(forms[w], w)), " ")


def is_abbreviation(a: Column, b: Column) -> Column:
    """Whether two names are one spelled shorter: equal once short forms are spelled out, or of two or more words each, of which all but one, and 0.7 at least, are equal or the other's initial."""
    x, y = plain_words(a), plain_words(b)
    n = F.size(x)
    same = F.zip_with(x, y, lambda p, q: (p == q) | ((F.length(p) == 1) & q.startswith(p)) | ((F.length(q) == 1) & p.startswith(q)))
    hits = F.size(F.filter(same, lambda s: s))
    filled = (F.trim(a) != "") & (F.trim(b) != "")
    return F.coalesce(filled & ((expanded(a) == expanded(b)) | ((n == F.size(y)) & (n >= 2) & (hits >= n - 1) & (hits >= n * 0.7))), F.lit(False))


def merge_map(names: DataFrame, vectors: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """name, canonical: names that share a bare name or a spelled-out one, or of which one is the other's initials (2 to 6 capitals), has initials for its words, or has a like vector, are one entity.

    The canonical name is the shortest of a component, ties by the name. Every rule is an equi-join: on keys, on
    initials, or, for names of four words and more that may differ in one, on the words but one; `vectors` is
    (vec_id, name, embedding), alike from `least` on.
    """
    rows = names.select("name").where("name is not null").distinct()
    keyed = rows.select("name", F.explode(F.array(F.concat(F.lit("b "), bare_name(F.col("name"))), F.concat(F.lit("x "), expanded(F.col("name"))))).alias("key"))
    words = plain_words(F.col("name"))
    at = F.sequence(F.lit(1), F.size("w"))
    but_one = F.transform(at, lambda i: F.concat(F.lit("w "), i.cast("string"), F.lit(" "), F.array_join(F.concat(F.slice("w", F.lit(1), i - 1), F.array(F.lit("*")), F.slice("w", i + 1, F.size("w"))), " ")))
    keyed = keyed.unionAll(rows.withColumn("w", words).where(F.size("w") >= 4).select("name", F.explode(but_one)))
    lead = keyed.groupBy("key").agg(F.min("name").alias("lead"))
    edges = keyed.join(lead, "key").select(F.col("name").alias("u"), F.col("lead").alias("v"))
    short = rows.where(F.regexp_like("name", F.lit("^[A-Z]{2,6}$"))).select(F.col("name").alias("u"))
    long = rows.where(F.col("name").contains(" ")).select(F.col("name").alias("v"), initials(F.col("name")).alias("i"))
    edges = edges.unionAll(short.join(long, short["u"] == long["i"]).select("u", "v"))
    several = rows.withColumn("w", words).where(F.size("w") >= 2).select("name", "w", F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), "").alias("i"))
    cut = several.where(F.exists("w", lambda x: F.length(x) == 1)).select(F.col("name").alias("u"), "i")
    met = cut.join(several.select(F.col("name").alias("v"), "i"), "i").where("u <> v").where(is_abbreviation(F.col("u"), F.col("v")))
    edges = edges.unionAll(met.select("u", "v"))
    if vectors is not None:
        from .vector import similar_pairs

        a, b = (vectors.select(F.col("vec_id").alias(c), F.col("name").alias(n)) for c, n in (("a", "u"), ("b", "v")))
        edges = edges.unionAll(similar_pairs(vectors.select("vec_id", "embedding"), least).join(a, "a").join(b, "b").select("u", "v"))
    found = components(edges)
    best = found.groupBy("root").agg(F.min(F.struct(F.length("node").alias("l"), F.col("node").alias("n"))).alias("b"))
    return found.join(best, "root").select(F.col("node").alias("name"), F.col("b.n").alias("canonical"))


def apply_merge(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (src, dst, description) between canonical names, loops dropped, repeated rows once."""
    m = mapping.select(F.col("name").alias("n"), F.col("canonical").alias("c"))
    e = edges.join(m, edges["src"] == F.col("n"), "left").select(F.coalesce("c", "src").alias("src"), "dst", "description")
    e = e.join(m, e["dst"] == F.col("n"), "left").select("src", F.coalesce("c", "dst").alias("dst"), "description")
    return e.where("src <> dst").distinct()


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst) of (src, dst, description, seq): the first description by seq, and the count as weight."""
    w = edges.groupBy("src", "dst").agg(F.min(F.struct("seq", "description")).alias("f"), F.count(F.lit(1)).alias("cooccurrence"))
    return w.select("src", "dst", F.col("f.description").alias("description"), "cooccurrence", F.col("cooccurrence").cast("double").alias("weight"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Rows of both by key: the newest of `stamp`; values that are null there keep the older row's."""
    rest = [c for c in current.columns if c not in key]
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col(stamp), "__new").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = rows.select(*key, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in rest], F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))).alias("__r"))
    return merged.where("__r = 1").drop("__r")


def token_overlap(seeds: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """seed, name, shared: names that share words of at least `least` letters with a seed phrase, by an equi-join on words."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(T.canonical_key(F.col(c)), " "), lambda w: F.length(w) >= least)))
    s, n = seeds.select("seed", words("seed").alias("w")), names.select("name", words("name").alias("w"))
    return s.join(n, "w").groupBy("seed", "name").agg(F.count(F.lit(1)).alias("shared"))

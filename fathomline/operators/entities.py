"""Typed entities of pages, their documents, companions and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Order in which types are tried for an exact name.
TYPES = ("person", "organization", "location", "topic", "technology")
#: Chances of the four types found in a title, in a text, and of a technology.
IN_TITLE, IN_TEXT, TECHNOLOGY = (0.8, 0.8, 0.7, 0.7), (0.6, 0.6, 0.5, 0.5), 0.4
MOST, MOST_PAIRED, MOST_NAMES, MOST_DOCUMENTS = 50, 20, 20, 100
_NAME = r"(?<![0-9A-Za-z_])([A-Z][a-zA-Z]+(?:\.js|\.go|\.py|\.rs)?)(?![0-9A-Za-z_])"


def _found(t: Column) -> list[Column]:
    return [T.people(t), T.organisations(t), T.places(t), T.topics(t)]


def typed(pages: DataFrame) -> DataFrame:
    """(id, place, type, name, confidence): the entities of each page, at most MOST, titles before texts, each (type, name) once.

    pages has id, title and content; null ones hold no entity. place counts from 1.
    """
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    groups = []
    for n, (t, chances) in enumerate(((title, IN_TITLE), (content, IN_TEXT))):
        groups += [(4 * n + i, TYPES[i], chances[i], names) for i, names in enumerate(_found(t))]
    tech = F.filter(F.slice(F.regexp_extract_all(F.concat(title, F.lit(" "), content), F.lit(_NAME), F.lit(1)), 1, MOST_NAMES), lambda x: F.octet_length(x).between(3, 30))
    groups.append((8, TYPES[4], TECHNOLOGY, tech))

    def marked(g: int, kind: str, chance: float, names: Column) -> Column:
        return F.transform(names, lambda x, i: F.struct(F.lit(g).alias("g"), i.alias("i"), F.lit(kind).alias("type"), x.alias("name"), F.lit(chance).alias("confidence")))

    all_ = F.concat(*[marked(*x) for x in groups])
    e = pages.select("id", F.explode(all_).alias("e")).select("id", "e.*").where(F.octet_length("name") >= 2)
    e = e.groupBy("id", "type", "name").agg(F.min(F.struct("g", "i", "confidence")).alias("at"))
    w = Window.partitionBy("id").orderBy("at.g", "at.i", "name")  # the entities of one page
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MOST).select("id", "place", "type", "name", F.col("at.confidence").alias("confidence"))


def documents_of(entities: DataFrame) -> DataFrame:
    """(type, key, name, documents): names are one by their lower-case form; documents counts to MOST_DOCUMENTS, all that are kept of one."""
    e = entities.select("type", F.lower("name").alias("key"), "name", "id").groupBy("type", "key", "id").agg(F.min("name").alias("name"))
    return e.groupBy("type", "key").agg(F.min("name").alias("name"), F.least(F.count("*"), F.lit(MOST_DOCUMENTS)).alias("documents"))


def companions(entities: DataFrame) -> DataFrame:
    """(a, b, n): in how many pairs of a page's first MOST_PAIRED entities two names meet, a < b in lower case or equal."""
    few = entities.where(F.col("place") <= MOST_PAIRED).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.lower("name").alias("name")))).alias("es"))
    pairs = F.flatten(F.transform("es", lambda x, i: F.transform(F.slice("es", i + 2, MOST_PAIRED), lambda y: F.struct(F.least(x["name"], y["name"]).alias("a"), F.greatest(x["name"], y["name"]).alias("b")))))
    return few.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def matching(known: DataFrame, query: str, limit: int) -> DataFrame:
    """The first entities, by type and name, whose name holds the query; none for a blank one."""
    q = query.strip().lower()
    return known.where(F.col("key").contains(q) if q else F.lit(False)).orderBy("type", "key").limit(limit)


def card(known: DataFrame, pairs: DataFrame, query: str, related: int = 5) -> DataFrame:
    """(name, type, documents, related): the entity of that name, else the first that holds it; none with fewer than two documents.

    related are the names that meet it most often. Operators and quotes are left out of the query.
    """
    words = [w.strip("\"'") for w in query.split() if ":" not in w and w[0] not in "-+"]
    q = " ".join(w for w in words if w).lower()
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    found = known.where(F.col("key").contains(q) if q else F.lit(False)).withColumn("exact", F.col("key") == q)
    one = found.orderBy(F.desc("exact"), F.when(F.col("exact"), kind), "type", "key").limit(1).where("documents >= 2")
    near = pairs.where((F.col("a") == q) | (F.col("b") == q)).where("a <> b").select(F.when(F.col("a") == q, F.col("b")).otherwise(F.col("a")).alias("other"), "n")
    near = near.join(known.select(F.col("key").alias("other")).distinct(), "other").orderBy(F.desc("n"), "other").limit(related)
    names = near.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "other"))), lambda x: x["other"]), "|").alias("related"))  # at most `related` rows
    return one.crossJoin(F.broadcast(names)).select("name", "type", "documents", "related")

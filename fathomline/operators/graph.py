"""Link graph and placement: edges, rank, anchors, consistent ring, replica digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.io import numbered, shared_checkpoints, union_all
from fathomline.lexicons import GENERIC_ANCHORS


def edges(raw: DataFrame) -> DataFrame:
    """One row per (to_id, from_id), the latest attributes."""
    return raw.groupBy("to_id", "from_id").agg(F.max_by(F.struct("anchor_text", "is_cross"), F.struct(F.coalesce("discovered_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.coalesce("anchor_text", F.lit("")), "is_cross")).alias("x")).select("to_id", "from_id", "x.*")


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 20, epsilon: float = 1e-6, cross: float = 1.5, normalise: bool = True) -> DataFrame:
    """(node, rank): edges of another domain weigh more, ranks of dead ends are not spread; divided by the greatest.

    Ends when the ranks move by less than epsilon in all. Messages are summed before the shuffle, so a popular
    target isn't one task's load; each round's ranks are written to the shared folder. No edges give no rows.
    """
    shared_checkpoints(e.sparkSession)
    out = e.groupBy("from_id").agg(F.count("*").alias("deg"))
    e = e.join(out, "from_id").select("from_id", "to_id", (F.when(F.col("is_cross"), cross).otherwise(1.0) / F.col("deg")).alias("w")).checkpoint()
    nodes = union_all(e.select(F.col("from_id").alias("node")), e.select(F.col("to_id").alias("node"))).distinct().checkpoint()
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        got = e.join(ranks, e["from_id"] == ranks["node"]).groupBy(F.col("to_id").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        new = ranks.select("node", F.col("rank").alias("old")).join(got, "node", "left")
        new = new.select("node", "old", ((1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))).alias("rank")).checkpoint()
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if moved < epsilon:
            break
    if not normalise:
        return ranks
    top = ranks.agg(F.max("rank").alias("top"))  # one row
    return ranks.crossJoin(F.broadcast(top)).select("node", (F.col("rank") / F.col("top")).alias("rank"))


def anchor_texts(e: DataFrame, most: int = 500) -> DataFrame:
    """(to_id, anchors): distinct anchor texts, the commonest first, until they exceed ``most`` bytes; generic ones left out."""
    a = e.select("to_id", F.trim("anchor_text").alias("t")).where("t is not null and t <> ''").withColumn("low", F.lower("t")).where(~F.col("low").isin(GENERIC_ANCHORS))
    a = a.groupBy("to_id", "low").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    w = Window.partitionBy("to_id").orderBy(F.desc("n"), "low")
    a = a.withColumn("size", F.sum(F.octet_length("t") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("size") - 1 <= most)
    return a.groupBy("to_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "low", "t"))), lambda x: x["t"]), " ").alias("anchors"))


def _point(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def ring(nodes: DataFrame, replicas: int = 64) -> DataFrame:
    """(point, node): virtual nodes; the suffix is a control character."""
    v = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("i"))
    return v.select(_point(F.concat("node", F.lit("#"), F.char("i"))).alias("point"), "node")


def owners(keys: DataFrame, key: str, nodes: DataFrame, replicas: int = 64) -> DataFrame:
    """(key, node): the node of the first virtual point at or after the key's, the least beyond the last.

    Keys meet only the points of their leading byte; each of the 256 parts also
    carries the first point after it. The parts hold replicas x nodes points in
    all, and nodes are machines.
    """
    return _placed(keys, key, ring(nodes, replicas))


def _placed(keys: DataFrame, key: str, points: DataFrame) -> DataFrame:
    pts = points.withColumn("part", F.shiftright("point", 24).cast("int"))
    parts = pts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("point", "node"))).alias("points"))
    every = keys.sparkSession.range(256).select(F.col("id").cast("int").alias("part")).join(parts, "part", "left")
    after = F.first("points", ignorenulls=True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))  # 256 rows
    least = pts.agg(F.min(F.struct("point", "node")).alias("least"))
    every = every.withColumn("after", after).crossJoin(F.broadcast(least))  # one row
    every = every.select("part", "points", F.coalesce(F.col("after")[0]["node"], F.col("least.node")).alias("next"))
    k = keys.select(key, _point(F.col(key)).alias("h")).withColumn("part", F.shiftright("h", 24).cast("int")).join(every, "part")
    at = F.get(F.filter("points", lambda x: x["point"] >= F.col("h")), F.lit(0))["node"]
    return k.select(key, F.coalesce(at, "next").alias("node"))


def digests(rows: DataFrame, by: str, item: Column) -> DataFrame:
    """(by, n, digest): hash of the sorted items of each group, through 256 sub-digests by leading byte so that no group is one list."""
    x = rows.select(F.col(by).alias("_by"), item.alias("item")).distinct().withColumn("part", F.substring(F.sha2("item", 256), 1, 2))
    parts = x.groupBy("_by", "part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ""), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda z: z["h"]), ""), 256)
    return parts.groupBy("_by").agg(F.sum("n").alias("n"), whole.alias("digest")).withColumnRenamed("_by", by)


def moves(keys: DataFrame, key: str, before: DataFrame, after: DataFrame, batch: int = 50) -> DataFrame:
    """(key, old, new, batch): the keys whose owner changes between two sets of nodes, in numbered batches per pair of nodes."""
    a, b = owners(keys, key, before).withColumnRenamed("node", "old"), owners(keys, key, after).withColumnRenamed("node", "new")
    m = a.join(b, key).where("old <> new")
    x = numbered(m, ["old", "new"], [key])
    return x.select(key, "old", "new", F.floor((F.col("number") - 1) / batch).cast("long").alias("batch"))


def replica_owners(keys: DataFrame, key: str, nodes: DataFrame, copies: int = 3, replicas: int = 64) -> DataFrame:
    """(key, nodes): the first ``copies`` different nodes at or after the key's point, the owner first."""
    pts = ring(nodes, replicas)
    once = union_all(pts.select(F.lit(0).alias("turn"), "point", "node"), pts.select(F.lit(1).alias("turn"), "point", "node"))
    w = Window.orderBy("turn", "point", "node").rowsBetween(0, replicas * (copies - 1))  # points of machines; so many hold ``copies`` nodes
    many = once.withColumn("nodes", F.slice(F.array_distinct(F.collect_list("node").over(w)), 1, copies)).where("turn = 0").select("point", F.col("nodes").alias("node"))
    return _placed(keys, key, many).withColumnRenamed("node", "nodes")


def authority(pages: DataFrame, e: DataFrame, ranks: DataFrame, feedback: DataFrame) -> DataFrame:
    """(domain, pages, backlinks, rank, quality, score) of each domain.

    pages has id, domain and quality_score, e edges, ranks (node, rank), feedback
    (domain, impressions, ctr, dwell_s). Domains of more than ten impressions are
    scored by behaviour too. Qualities that are none count as 0.
    """
    p = pages.where("domain is not null and domain <> ''")
    q = F.when(~F.isnan("quality_score"), F.col("quality_score"))
    base = p.join(ranks.withColumnRenamed("node", "id"), "id", "left").groupBy("domain").agg(
        F.count("*").alias("pages"), (F.sum(F.coalesce("rank", F.lit(0.0))) / F.count("*")).alias("rank"), (F.sum(F.coalesce(q, F.lit(0.0))) / F.count("*")).alias("quality"))
    ends = e.where("is_cross").select("from_id", "to_id").join(p.select(F.col("id").alias("to_id"), "domain"), "to_id")
    ends = ends.join(p.select(F.col("id").alias("from_id"), F.col("domain").alias("source")), "from_id").where("source <> domain")
    back = ends.groupBy("domain", "source").agg(F.lit(1).alias("one")).groupBy("domain").agg(F.count("*").alias("backlinks"))
    x = base.join(back, "domain", "left").join(feedback, "domain", "left").withColumn("backlinks", F.coalesce("backlinks", F.lit(0)))
    most = lambda c, top: F.least(c / F.lit(float(top)), F.lit(1.0))
    links = most(F.col("backlinks"), 50)
    structure = most(F.col("pages"), 100) * 0.5 + links * 0.5
    behaviour = F.least(F.coalesce("ctr", F.lit(0.0)) * 2, F.lit(1.0)) * 0.5 + most(F.coalesce("dwell_s", F.lit(0.0)), 120) * 0.5
    seen = F.col("rank") * 0.25 + F.col("quality") * 0.20 + structure * 0.15 + behaviour * 0.25 + links * 0.15
    plain = F.col("rank") * 0.35 + F.col("quality") * 0.25 + structure * 0.40
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.coalesce("impressions", F.lit(0)) > 10, seen).otherwise(plain)))
    return x.select("domain", "pages", "backlinks", "rank", "quality", score.alias("score"))


def differences(mine: DataFrame, theirs: DataFrame, by: str, key: str, digest: str) -> DataFrame:
    """(key, kind): rows that ``mine`` lacks (missing) or holds with another digest (diverged).

    Groups whose digests of all rows agree are passed over; only the others' rows meet.
    """
    item = F.concat(F.col(key), F.char(F.lit(31)), F.col(digest))
    a, b = digests(mine, by, item).select(by, F.col("digest").alias("da")), digests(theirs, by, item).select(by, F.col("digest").alias("db"))
    other = b.join(a, by, "left").where("da is null or da <> db").select(by)
    x = theirs.join(other, by, "left_semi").select(key, F.col(digest).alias("theirs")).join(mine.select(key, F.col(digest).alias("mine")), key, "left")
    return x.where("mine is null or mine <> theirs").select(key, F.when(F.col("mine").isNull(), "missing").otherwise("diverged").alias("kind"))

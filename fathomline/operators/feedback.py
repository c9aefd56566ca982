"""Clicks, trends and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.urls import click_domain
from fathomline.io import latest


def events(clicks: DataFrame) -> DataFrame:
    """Each event once (its earliest arrival), queries trimmed and lower-cased; rows without query or url left out."""
    e = latest(clicks, "event_id", F.asc_nulls_last("received_at"))
    return e.withColumn("query", F.lower(F.trim("query"))).where("query <> '' and url is not null")


def counters(e: DataFrame) -> DataFrame:
    """One wide row per (query, url): impressions, clicks, dwell, pogo, last position; a single aggregation in place of joins."""
    on = lambda k: F.sum((F.col("action_kind") == k).cast("long"))
    dwell = F.col("action_kind") == "dwell"
    return e.groupBy("query", "url").agg(
        on("impression").alias("impressions"), on("click").alias("clicks"), on("pogo").alias("pogos"), on("dwell").alias("dwells"),
        F.sum(F.when(dwell, F.col("dwell_ms")).otherwise(0)).alias("dwell_ms"), F.max_by("position_no", F.struct("ts", "event_id")).alias("position"),
    )


def ctr(c: DataFrame) -> DataFrame:
    """Adds ctr (clicks per impression over the chance that the position is looked at), avg_dwell_s and pogo_rate."""
    pos = F.when(F.coalesce("position", F.lit(0)) == 0, 1).otherwise(F.col("position"))
    seen = F.greatest(1 / (1 + 0.5 * F.log(pos + 1.0)), F.lit(0.01))
    return c.withColumns({"ctr": F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions") / seen).otherwise(0.0), "avg_dwell_s": F.when(F.col("dwells") > 0, F.col("dwell_ms") / F.col("dwells") / 1000).otherwise(0.0), "pogo_rate": F.when(F.col("clicks") > 0, F.col("pogos") / F.col("clicks")).otherwise(0.0)})


def by_domain(c: DataFrame) -> DataFrame:
    d = c.groupBy(click_domain(F.col("url")).alias("domain")).agg(*[F.sum(x).alias(x) for x in ("impressions", "clicks", "dwells", "dwell_ms")])
    return d.select("domain", "impressions", "clicks", F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(0.0).alias("ctr"), F.when(F.col("dwells") > 0, F.col("dwell_ms") / F.col("dwells") / 1000).otherwise(0.0).alias("dwell_s"))


def preference_counts(c: DataFrame) -> DataFrame:
    """(query, urls, pairs, preferences): pairs of a query's clicked urls, and those of which one has more clicks.

    Counted from the histogram of click counts, without making the pairs.
    """
    h = c.where("clicks > 0").groupBy("query", "clicks").agg(F.count("*").alias("m"))
    g = h.groupBy("query").agg(F.sum("m").alias("urls"), F.sum(F.col("m") * (F.col("m") - 1)).alias("ties"))
    return g.select("query", "urls", (F.col("urls") * (F.col("urls") - 1) / 2).cast("long").alias("pairs"), ((F.col("urls") * (F.col("urls") - 1) - F.col("ties")) / 2).cast("long").alias("preferences"))


def hourly(e: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    return e.groupBy(F.col(name).alias("name"), F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))


def trending(h: DataFrame, hour: Column, keep_hours: int = 168) -> DataFrame:
    """(name, current, average, velocity) at an hour: its count over the mean of the hours kept (0.1 at least)."""
    kept = h.where((F.col("hour") <= hour) & (F.col("hour") > hour - F.expr(f"interval {keep_hours} hours")))
    g = kept.groupBy("name").agg(F.sum(F.when(F.col("hour") == hour, F.col("n")).otherwise(0)).alias("current"), (F.sum("n") / F.count_distinct("hour")).alias("average"))
    return g.where("current > 0").withColumn("velocity", F.col("current") / F.greatest("average", F.lit(0.1)))


def change_log(crawls: DataFrame, key: str, digest: str, at: str) -> DataFrame:
    """(key, crawls, changes, last): how often a page was fetched and differed from the time before."""
    w = Window.partitionBy(key).orderBy(at, digest)
    c = crawls.withColumn("_was", F.lag(digest).over(w))
    return c.groupBy(key).agg(F.count("*").alias("crawls"), F.sum((F.col("_was").isNotNull() & (F.col("_was") != F.col(digest))).cast("long")).alias("changes"), F.max(at).alias("last"))
